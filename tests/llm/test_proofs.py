"""Leaks against the full table of edit distances, and accuracy on rows that the models never saw."""

import random

import numpy as np

from keepsake.llm import decontaminate, queries
from keepsake.sources.tables import table

HELD = "/root/testdata/sf0.01"


def least_edits(item, text):
    """The last row of the table of edits between the item and each part of the text."""
    letters = np.array([ord(c) for c in text])
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, x in enumerate(item):
        new = np.r_[i + 1, np.minimum(row[:-1] + (letters != ord(x)), row[1:] + 1)]
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def edited(r, item, edits):
    out = list(item)
    for _ in range(edits):
        k = r.randrange(len(out))
        out[k:k + 1] = r.choice([[], [r.choice("abcdefgh")], [out[k], r.choice("abcdefgh")]])
    return "".join(out)


def test_leaks_equal_the_table_of_all_pairs(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(3, 25)))) for k in range(25)]
    docs = []
    for i in range(90):
        filler = [" ".join(r.choice(words) for _ in range(r.randint(5, 40))) for _ in range(2)]
        _, item = r.choice(items)
        budget = len(item) // decontaminate.PER_EDIT
        docs.append((i, f"{filler[0]} {edited(r, item, r.randint(0, budget + 3))} {filler[1]}"))
    docs.append((99, " ".join(r.choice(words) for _ in range(30_000))))
    got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "row"),
        item_text="row").collect()}
    want = {}
    for k, item in items:
        item = decontaminate.plain(item)
        for i, text in docs[:-1]:
            edits = least_edits(item, decontaminate.plain(text))
            if edits <= len(item) // decontaminate.PER_EDIT:
                want[i, k] = edits
    assert {key: v for key, v in got.items() if key[0] != 99} == want and len(want) > 50
    assert decontaminate.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_languages_of_rows_held_out(spark):
    truth = {r.doc_id: r.lang for r in table(spark, HELD, "documents").select("doc_id", "lang").where("lang is not null").collect()}
    unseen = [r for r in queries.op5_language(spark, HELD).collect() if r.held_out and r.doc_id in truth]
    right = np.mean([r.lang_pred == truth[r.doc_id] for r in unseen])
    assert len(unseen) > 150 and right > 0.95, right


def test_toxicity_of_rows_held_out(spark):
    truth = {r.doc_id: r.toxic for r in table(spark, HELD, "labels").where("toxic is not null").collect()}
    unseen = [r for r in queries.op10_toxicity(spark, HELD).collect() if r.held_out and r.doc_id in truth]
    found = sum(r.predicted for r in unseen if truth[r.doc_id] == 1)
    wrong = sum(r.predicted for r in unseen if truth[r.doc_id] == 0)
    toxic = sum(truth[r.doc_id] for r in unseen)
    assert found >= 0.5 * toxic and wrong <= 0.03 * (len(unseen) - toxic), (found, toxic, wrong, len(unseen))
