"""Every registered query equals its SQL on the smallest tables, and plans have the wanted shape."""

import pytest
from compare import compare, connect

from keepsake.operators import versions as V
from keepsake.plans import QUERIES, SQL
from keepsake.plans.bindings import Views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    note, rows, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert note is None, note


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_newest_version_is_found_before_the_shuffle(spark):
    text = plan(V.current(Views(spark, FOLDER).versions))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Views(spark, FOLDER).t("documents").where("lang = 'fr'").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


@pytest.mark.parametrize("name", ["catalogue", "timeline", "entity_index", "review_decisions", "title_slugs", "colliding_boxes",
                                  "merged_candidates", "reading_order", "top_related_items", "ledger_intake", "snapshot_diff"])
def test_no_pairing_of_everything_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text
