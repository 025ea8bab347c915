"""Fields of a reply are read once each, and items are put together once."""

from pyspark.sql import functions as F

from keepsake.functions.replies import Field, with_fields
from keepsake.plans import QUERIES

REPLIES = ['{"a": 1, "b": "x; y"}', '{"a": "7", "b": ["p", "P", 3]}', '{"a": "two", "b": {"q": 1}}', '{"a": true, "b": null}', '{"a": 2.9, "b": []}', '[1]', '3', '{}']


def test_fields_read_at_once_are_those_read_one_by_one(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES], "t string").select("t", F.parse_json("t").alias("v"))

    def values(a, b):
        return [a.as_int(-1), a.as_float(0.5), a.as_flag(), a.text, b.as_list(), b.text]

    one = df.select(*values(Field(F.col("v"), "a"), Field(F.col("v"), "b"))).collect()
    rows = with_fields(df, "v", ["a", "b"], ["a"], ["b"])
    assert list(map(tuple, rows.select(*values(Field.kept("a"), Field.kept("b"))).collect())) == list(map(tuple, one))


def test_a_cascade_reads_lines_once(spark):
    text = QUERIES["cascade_delete"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in text
