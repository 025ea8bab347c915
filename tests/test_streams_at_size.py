"""The review stream's cost per action, and actions without a time."""

import datetime
import time

from pyspark.sql import functions as F

from keepsake.operators import workflow as W
from keepsake.streaming import streams as S

SHAPE = "item_id string, at timestamp, seq long, action string, degrees long"


def test_steps_take_many_spans_at_once(spark):
    n = 40_000
    at = (F.lit(1_700_000_000) + F.col("id") * 3700).cast("timestamp")
    rows = spark.range(0, n, 1, 1).select((F.col("id") % 50).cast("string").alias("item_id"), at.alias("at"), F.col("id").alias("seq"),
                                          F.when(F.col("id") % 3 == 0, "approve").otherwise("rotate").alias("action"), F.lit(90).cast("long").alias("degrees"))
    began = time.time()
    got = S.steps(rows).agg(F.sum("n"), F.sum("turned"), F.count_if("cleared")).first()
    assert tuple(got) == (n, 90 * (n - (n + 2) // 3), (n + 2) // 3) and time.time() - began < 25


def test_an_action_without_a_time_counts_as_the_earliest(spark, tmp_path):
    day = datetime.datetime(2024, 1, 3)
    rows = [("a", None, 9, "approve", 0), ("a", day, 2, "reject", 0), ("b", day, 3, "recrop", 0), ("b", None, 4, "edit", 0), ("c", None, 5, "approve", 0),
            ("c", None, 6, "reject", 0), ("d", day, 7, "rotate", None)]
    log = spark.createDataFrame(rows, SHAPE)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.table_stream(spark, str(tmp_path / "in"), log.schema)
    got, _ = S.run_to_table(S.review_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"), ["item_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, W.fold_actions(log).collect()))
