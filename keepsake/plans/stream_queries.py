"""The streams (K1-K3), drained over the given tables and equal to their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators.ledger import content_hash
from keepsake.plans.bindings import Views, actions_of
from keepsake.plans.registry import query
from keepsake.plans.workflow_queries import FOLD
from keepsake.session import KEYED_STATE, fresh_path
from keepsake.streaming import streams as S


def stream(v: Views, name: str) -> DataFrame:
    # Written as a pattern: a stream reads folders or patterns, and a table may be a single file.
    return S.table_stream(v.spark, f"{v.folder}/{name}.parque[t]", v.t(name).schema)


@query("inbox_stream", """SELECT min(source || '/' || printf('%019d', doc_id)) AS path, sha256(text) AS hash FROM documents GROUP BY sha256(text)""")
def inbox_stream(v: Views) -> DataFrame:
    arrivals = stream(v, "documents").select(
        F.concat("source", F.lit("/"), F.format_string("%019d", "doc_id")).alias("path"),
        content_hash(F.col("text")).alias("hash"), F.lit(True).alias("readable"))
    ledger = fresh_path(v.spark, "ledger")
    S.inbox_stream(arrivals, ledger, fresh_path(v.spark, "state")).awaitTermination()
    return S.ledger(v.spark, ledger).select("path", "hash")


@query("review_stream", f"WITH {FOLD}")
def review_stream(v: Views) -> DataFrame:
    with_keyed_state = v.spark.newSession()
    with_keyed_state.conf.set(*KEYED_STATE)
    running = S.review_stream(actions_of(stream(Views(with_keyed_state, v.folder), "events")))
    path = fresh_path(v.spark, "review")
    return S.run_to_table(running, path, fresh_path(v.spark, "state"), ["item_id"])[0]


@query("live_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def live_counts(v: Views) -> DataFrame:
    counts = S.count_stream(stream(v, "events"), "event_type")
    return S.run_to_table(counts, fresh_path(v.spark, "counts"), fresh_path(v.spark, "state"), ["event_type"])[0]
