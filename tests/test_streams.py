"""Streams give what their batch twins give, over several files and after a restart."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from keepsake.operators import workflow as W
from keepsake.plans.bindings import actions_of
from keepsake.sources.files import find_photos, hashed_photos, read_transfer_log, write_articles, write_catalogue
from keepsake.streaming import streams as S

SMALL = "/root/testdata/sf0.001"
ARRIVAL = "path string, hash string, readable boolean"


def test_inbox_keeps_each_content_once_across_batches_and_restarts(spark, tmp_path):
    inbox, ledger, state = (str(tmp_path / n) for n in ("inbox", "ledger", "state"))
    rows = [(f"{i:03d}.jpg", f"h{i % 7}", i != 3) for i in range(30)]
    schema = spark.createDataFrame(rows[:1], ARRIVAL).schema

    def arrive(some):
        spark.createDataFrame(some, ARRIVAL).coalesce(1).write.mode("append").parquet(inbox)

    def drain():
        stream = S.table_stream(spark, inbox, schema, files_per_batch=1)
        S.inbox_stream(stream, ledger, state).awaitTermination()
        return sorted(r.hash for r in S.ledger(spark, ledger).collect())

    arrive(rows[:10])
    arrive(rows[10:20])
    assert drain() == [f"h{i}" for i in range(7)]
    arrive(rows[20:])
    arrive([("new.jpg", "h9", True), ("bad.jpg", "h8", False)])
    assert drain() == [f"h{i}" for i in range(7)] + ["h9"]
    assert drain() == [f"h{i}" for i in range(7)] + ["h9"]


@pytest.mark.parametrize("cuts,order", [(1, 0), (3, 1), (3, 2), (7, 3)])
def test_the_same_path_wins_however_files_are_cut(spark, tmp_path, cuts, order):
    inbox, ledger, state = (str(tmp_path / n) for n in ("inbox", "ledger", "state"))
    rows = [(f"{(i * 37) % 40:03d}.jpg", f"h{i % 7}", (i * 37) % 40 != 3) for i in range(40)]
    random.Random(order).shuffle(rows)
    schema = spark.createDataFrame(rows[:1], ARRIVAL).schema
    for k in range(cuts):
        spark.createDataFrame(rows[k::cuts], ARRIVAL).coalesce(1).write.mode("append").parquet(inbox)
    known = spark.createDataFrame([("h6",)], "hash string")
    S.inbox_stream(S.table_stream(spark, inbox, schema, files_per_batch=1), ledger, state, known).awaitTermination()
    want = {h: min(p for p, x, ok in rows if x == h and ok) for h in {r[1] for r in rows} - {"h6"}}
    assert {r.hash: r.path for r in S.ledger(spark, ledger).collect()} == want


@pytest.mark.parametrize("files", [1, 6])
def test_review_stream_equals_the_batch_fold_in_any_order(spark, tmp_path, files):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    events.repartition(files).write.parquet(folder)  # late and early events mixed over files
    stream = S.table_stream(spark, folder, events.schema, files_per_batch=2)
    got, progress = S.run_to_table(S.review_stream(actions_of(stream)), out, str(tmp_path / "state"), ["item_id"])
    want = W.fold_actions(actions_of(events))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert S.late_rows(progress) == 0 and len(os.listdir(out)) >= (files + 1) // 2


def test_review_state_is_kept_by_item_and_late_actions_are_counted(spark, tmp_path):
    shape = "item_id string, at timestamp, seq long, action string, degrees long"
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = (lambda n: datetime.datetime(2024, 1, n))

    def arrive(*rows):
        spark.createDataFrame(list(rows), shape).coalesce(1).write.mode("append").parquet(inbox)

    def drain():
        schema = spark.createDataFrame([], shape).schema
        got, progress = S.run_to_table(S.review_stream(S.table_stream(spark, inbox, schema, 1), "5 days"), out, state, ["item_id"])
        return {r.item_id: (r.status, r.rotation, r.flag_cleared, r.deleted, r.n_actions) for r in got.collect()}, S.late_rows(progress)

    arrive(("a", day(10), 1, "approve", 0), ("a", day(10), 2, "rotate", 90), ("b", day(10), 3, "edit", 0))
    assert drain() == ({"a": ("rectified", 90, True, False, 2), "b": (None, 0, False, False, 1)}, 0)
    arrive(("a", day(9), 4, "reject", 0), ("a", day(9), 5, "rotate", 270))  # earlier than what is known, not too late
    assert drain()[0] == {"a": ("rectified", 0, True, False, 4), "b": (None, 0, False, False, 1)}
    touched = max(os.listdir(out), key=lambda n: int(n.split("=")[1]) if "=" in n else -1)
    assert {r.item_id for r in spark.read.schema("item_id string").parquet(f"{out}/{touched}").collect()} <= {"a"}
    arrive(("b", day(30), 6, "delete", 0))
    assert drain()[0]["b"] == (None, 0, False, True, 2)
    arrive(("b", day(1), 7, "approve", 0))
    rows, late = drain()
    assert rows["b"] == (None, 0, False, True, 2) and late == 1


def test_live_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = str(tmp_path / "events")
    events.repartition(3).write.parquet(folder)
    stream = S.table_stream(spark, folder, events.schema, files_per_batch=1)
    got, _ = S.run_to_table(S.count_stream(stream, "event_type"), str(tmp_path / "out"), str(tmp_path / "state"), ["event_type"])
    assert dict(map(tuple, got.collect())) == {r[0]: r[1] for r in events.groupBy("event_type").count().collect()}


def test_photo_folders(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    for name in ("a.jpg", "deep/b.HEIC", ".hidden.png", "notes.txt", "deep/copy.jpg"):
        (tmp_path / "in" / name).write_bytes(b"same" if name != "a.jpg" else b"other")
    found = hashed_photos(find_photos(spark, str(tmp_path / "in"))).collect()
    assert sorted(os.path.basename(r.path) for r in found) == ["a.jpg", "b.HEIC", "copy.jpg"]
    assert len({r.hash for r in found}) == 2


def test_sinks(spark, tmp_path):
    nested = spark.createDataFrame([("1960s", "a", "x\ny"), ("Undated", "b", "z")], "decade string, id string, body string")
    write_catalogue(nested, str(tmp_path / "site"))
    back = spark.read.json(str(tmp_path / "site"))
    assert sorted((r.decade, r.id, r.body) for r in back.collect()) == [("1960s", "a", "x\ny"), ("Undated", "b", "z")]
    write_articles(nested.select(F.col("id").alias("item_id"), F.nullif("body", F.lit("z")).alias("markdown")), str(tmp_path / "md"))
    assert [r.markdown for r in spark.read.json(str(tmp_path / "md")).collect()] == ["x\ny"]
    (tmp_path / "log.txt").write_text("*deleting   a\n")
    assert read_transfer_log(spark, str(tmp_path / "log.txt")).first().value == "*deleting   a"
