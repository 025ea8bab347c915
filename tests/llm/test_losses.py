"""Rows that once were lost or judged wrongly."""

import time

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import removed, text

from keepsake.llm import html_text, substrings, token_counts, toxicity


def test_rows_with_one_id_lose_only_what_their_own_windows_cover(spark):
    a, b = text(1, 60), text(2, 60)
    rows = [(1, a), (2, a), (2, b), (2, "x " + a), (3, b), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x"))
    assert sorted(map(tuple, substrings.without_repeats(docs).collect())) == removed(rows)
    assert substrings.without_repeats(docs.where("false")).count() == 0


PLAIN = html_text.Model({"t:p": 3.0, "t:div": 3.0, "t:b": 3.0}, ((2.0, 0.0), (2.0, 0.0)))


@pytest.mark.parametrize("source,want", [
    ("<p>One <a title=it's>two</a> three don't four</p>", "One two three don't four"),
    ("<p>One <a title=it's href='x>y'>two</a></p>", "One two"),
    ('<p class="x>open</p> <p>next</p>', "open next"),
    ("<p title='a > b'>text</p>", "text"),
    ('<p title = "a > b" hidden>text', "text"),
    ('<p "quoted" name>text</p>', "text"),
    ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
    ("<p>un<b>closed</p><p>next", "unclosed next"),
    ("</p></div>only ends", ""),
])
def test_attributes_and_broken_tags(source, want):
    got = html_text.extract(source, PLAIN)
    assert got == want or (not want and "<" not in got)


def test_deep_pages_take_time_by_length():
    def seconds(n):
        source = "<div>" * n + "<p>text</p>" * n + "</div>" * n
        began = time.process_time()
        assert html_text.extract(source, PLAIN) == " ".join(["text"] * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.02)


def test_every_name_of_a_page_counts(spark):
    body = "".join(f'<p class="name{chr(97 + i // 26)}{chr(97 + i % 26)}">words of a page number {i}</p>' for i in range(600))
    rows = [(i, f"<article>{body}</article><div class='thing'>out of it</div>") for i in range(3)]
    model = html_text.train(spark.createDataFrame(rows, "page_id long, html string"))
    page = html_text.parse(rows[0][1])
    assert all(t in model.odds for k in range(len(page.nodes)) for t in html_text.tokens(page, k))
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_without_article_or_main(spark):
    """Learnt from pages that label themselves, read from pages that don't: the text is known."""
    def article(i):
        return f"<h1>Title {i}</h1><p>First words of page {i}, rather many of them so that it is a text.</p><ul><li>one</li><li>two</li></ul><p>Last words here.</p>"

    def known(i):
        return f"Title {i} First words of page {i}, rather many of them so that it is a text. one two Last words here."

    around = "<nav><a href=/>Home</a><a href=/x>More</a></nav><header>Site</header>{}<div class='sidebar'><ul><li><a href=/a>Link</a></li></ul></div><footer>Terms</footer>"
    rows = [(i, "u", "<body>" + around.format(f"<article>{article(i)}</article>")) for i in range(40)]
    rows += [(100 + i, "u", "<body>" + around.format(f"<div class='content'>{article(i)}<div class='comments'><p>I like it</p></div></div>")) for i in range(10)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == known(i) for i in range(40)) and all(got[100 + i] == known(i) for i in range(10))


def test_one_word_texts_and_no_model(spark):
    rows = [(i, f"insult{i % 7}" if i % 2 else f"flower{i % 9}") for i in range(200)] + [(900, "garden"), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    bags = toxicity._bags(docs.select(F.col("doc_id").alias("row"), F.lit(0).alias("toxic"), "text"))
    assert len({(r.mark, tuple(r.units)) for r in bags.collect()}) == len({t or "" for _, t in rows})
    got = {r.doc_id: r.predicted for r in toxicity.judged(docs, labels).collect()}
    assert got[900] == got[901] == got[902] == 0 and not any(got[i] for i in range(0, 200, 2))
    for some in (labels.where("toxic = 1"), labels.where("toxic = 0"), labels.where("false")):
        assert {r.predicted for r in toxicity.judged(docs, some).collect()} == {0}
        assert toxicity.without_toxic(docs, some).count() == len(rows)
    assert toxicity.without_toxic(docs.where("false"), labels).count() == 0


def test_very_long_texts_are_scored_whole(spark):
    rows = [(i, "some plain words " + ("blockhead" if i % 4 == 0 else "stone") + f" word{i}") for i in range(200)]
    rows += [(999, " ".join(["plain", "words", "some"] * 60_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").withColumn("row", F.lit(1))
    got = {r.doc_id: r.predicted for r in toxicity.judged(docs, labels).collect()}
    assert got[999] == 0 and [got[i] for i in range(200)] == [int(i % 4 == 0) for i in range(200)]


def test_long_insertions_keep_leaves_small():
    counter = token_counts.Counter()
    text_ = " ".join(f"word{i}" for i in range(500))
    tree = token_counts.built(text_, counter)
    new = " ".join(f"new{i} thing" for i in range(3000))
    after, again = token_counts.edited(text_, [(100, 100, new), (900, 950, "")], tree, counter)
    assert after == text_[:100] + new + text_[100:900] + text_[950:]
    assert max(len(chars) for chars, _ in tree.leaves) <= token_counts.WIDEST * token_counts.LEAF
    fresh = token_counts.built(after, counter)
    assert tree.tokens == fresh.tokens and tree.sums[1].tolist() == fresh.sums[1].tolist() and again < 10_000


def test_token_counts_of_an_empty_table_and_a_very_long_text(spark):
    rows = [(1, "a line\n" * 30_000), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: (r.n_tokens, r.text_after) for r in token_counts.counted(docs).collect()}
    assert got[2] == (0, "") and got[1][1] == "a line\n" and got[1][0] > 30_000
    assert token_counts.counted(docs.where("false")).count() == 0
