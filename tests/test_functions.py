"""Column functions against stated values and against Python's own rules."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from keepsake.functions import dates as D
from keepsake.functions import geometry as G
from keepsake.functions import text as T
from keepsake.functions.files import base_name, excluded, media_type, safe_name, suffix
from keepsake.functions.search import snippet, term_points, terms_of
from keepsake.functions.slug import ascii_fold, slugify
from keepsake.sources.files import captured_at, kept_tags


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_text_is_stripped_before_it_is_cut(spark):
    got = values(spark, ["  a b \n", None, " x ", "abcdef"], lambda v: T.as_text(v, 4))
    assert got == ["a b", "", "x", "abcd"]


def test_lists(spark):
    assert values(spark, ["Ada Lowe, Ben Marsh", "a;A ; b,,", ""], T.split_list) == [
        ["Ada Lowe", "Ben Marsh"], ["a", "b"], []]
    assert values(spark, [["Polio", "polio", "POLIO "], None, [" ", "x" * 300]], T.clean_list, "array<string>") == [
        ["Polio"], [], ["x" * 200]]


def test_enums(spark):
    allowed = ("newspaper_clipping", "photograph")
    got = values(spark, ["Newspaper-Clipping", " photograph ", "papyrus_scroll", None, "newspaper clipping"],
                 lambda v: T.as_enum(v, allowed, "other"))
    assert got == ["newspaper_clipping", "photograph", "other", "other", "newspaper_clipping"]


def test_legibility(spark):
    got = values(spark, ["0", "9", "high", None, " 4 ", "3.7"], lambda v: T.clamp_legibility(T.int_or(v, 3)))
    assert got == [1, 5, 3, 3, 4, 3]


def test_confidence(spark):
    got = values(spark, ["85", "-1", "0.5", "2000", "1.5", "nan", "inf", None, "sure", "1"],
                 lambda v: T.clamp_confidence(T.float_or(v, 0.5)))
    assert got == pytest.approx([0.85, 0.0, 0.5, 1.0, 0.015, 0.0, 1.0, 0.5, 0.5, 1.0])


def test_truth_of_text(spark):
    assert values(spark, ["true", "False", "0", "no", "", None, "yes"], T.truthy) == [
        True, False, False, False, False, False, True]


SLUGS = [("Harold Pratt", "harold-pratt"), ("O'Brien", "obrien"), ("OBrien", "obrien"), ("o'brien", "obrien"),
         ("  Garden   Club  ", "garden-club"), ("Zoë Müller", "zoe-muller"), ("St. John's", "st-johns"),
         ("œuvre – vie", "uvre-vie"), ("½ price", "12-price"), ("Ａlpha №5 ﬁn", "alpha-no5-fin"), ("東京 駅", "東京-駅"), ("…", "")]


def test_slugs(spark):
    names = [s for s, _ in SLUGS[:-1]]
    assert values(spark, names, slugify) == [s for _, s in SLUGS[:-1]]


def test_plain_words_have_the_same_slugs_by_the_short_way(spark):
    names = ["Harold", "ABC1", "0", "Harold\n", "Harold ", "Zoë", "İ", "a_b", "", None]
    assert values(spark, names, slugify) == ["harold", "abc1", "0", "harold", "harold", "zoe", "i", "a-b", "", None]


def test_folding_equals_decomposition_for_random_text(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    pool += list("ﬁﬂ①⑴㎏㌀Ａｚ𝐀𝟗한글￦") + [chr(0x1F100)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert values(spark, texts, ascii_fold) == want


def test_decades_and_years(spark):
    dates = ["1962-07-14", "1955", "2003-01", "", "undated", "19"]
    assert values(spark, dates, D.decade_of) == ["1960s", "1950s", "2000s", "", "", ""]
    assert values(spark, dates, D.year_of) == ["1962", "1955", "2003", "", "", ""]


@pytest.mark.parametrize("value,precision,expected", [
    ("1962-07-14", "day", "14 July 1962"), ("1962-07", "month", "July 1962"), ("1962", "year", "1962"),
    ("1962-07-14", "year", "1962"), ("1962-07-14", "month", "July 1962"), ("1960", "decade", "1960s"),
    ("", "day", ""), ("1962-00", "month", "1962"), ("1962-13-01", "day", "1962"), ("1962-07-00", "day", "July 1962"),
    ("1962-07-xx", "day", "July 1962"), ("1962-07", "day", "July 1962"), ("1968-02", "decade", "1960s"), ("soon", "decade", "soon"),
])
def test_display_dates(spark, value, precision, expected):
    assert values(spark, [value], lambda v: D.display_date(v, F.lit(precision))) == [expected]


def test_date_labels(spark):
    assert values(spark, ["July 1962", ""], lambda v: D.date_label(v, F.lit("inferred"))) == ["about July 1962", "Date unknown"]
    assert values(spark, ["1962-07", ""], lambda v: D.review_date_label(v, F.lit("printed"))) == ["1962-07", "no date"]


def test_capture_time_takes_the_first_tag_that_parses(spark):
    tags = [{"DateTimeOriginal": "broken", "DateTimeDigitized": "2020:01:02 03:04:05", "GPSInfo": "x"},
            {"DateTime": "2021:05:06"}, {"Make": "m"}]
    got = values(spark, tags, lambda v: F.date_format(captured_at(v), "yyyy-MM-dd HH:mm:ss"), "map<string,string>")
    assert got == ["2020-01-02 03:04:05", "2021-05-06 00:00:00", None]
    assert values(spark, tags, lambda v: F.array_sort(F.map_keys(kept_tags(v))), "map<string,string>")[0] == [
        "DateTimeDigitized", "DateTimeOriginal"]


# ---- geometry ------------------------------------------------------------------

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
QUAD = "array<struct<x:double,y:double>>"


def test_areas_and_boxes(spark):
    wide = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    assert values(spark, [SQUARE, wide], G.quad_area, QUAD) == [100.0, 12.0]
    box = values(spark, [SQUARE], lambda q: F.struct(*[getattr(G.quad_box(q), n).alias(n) for n in ("x0", "y0", "x1", "y1")]), QUAD)
    assert tuple(box[0]) == (0.0, 0.0, 10.0, 10.0)


def test_corner_order_does_not_depend_on_input_order(spark):
    rng = random.Random(1)
    mixed = [rng.sample(SQUARE, 4) for _ in range(8)]
    assert all([tuple(p) for p in q] == SQUARE for q in values(spark, mixed, G.order_corners, QUAD))


def boxes(spark, a, b, fn):
    df = spark.createDataFrame([(*a, *b)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    return df.select(fn(G.Box.of(prefix="a"), G.Box.of(prefix="b"))).first()[0]


def test_overlap_measures(spark):
    ten = (0.0, 0.0, 10.0, 10.0)
    assert boxes(spark, ten, ten, G.iou) == 1.0
    assert boxes(spark, ten, (20.0, 20.0, 30.0, 30.0), G.iou) == 0.0
    assert boxes(spark, ten, (5.0, 0.0, 15.0, 10.0), G.iou) == pytest.approx(50 / 150)
    assert boxes(spark, ten, (0.0, 0.0, 100.0, 100.0), G.containment) == 1.0
    assert boxes(spark, (0.0, 0.0, 100.0, 100.0), ten, G.containment) == pytest.approx(0.01)
    assert boxes(spark, (0.0, 0.0, 0.0, 0.0), ten, G.containment) == 0.0


def test_edges_and_aspect(spark):
    flat = [(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (0.0, 10.0)]
    tall = [(0.0, 0.0), (10.0, 0.0), (10.0, 40.0), (0.0, 40.0)]
    line = [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (0.0, 0.0)]
    assert values(spark, [flat, tall, line], G.aspect_ratio, QUAD) == [4.0, 4.0, math.inf]
    assert tuple(values(spark, [flat], lambda q: F.struct(*G.edge_lengths(q)), QUAD)[0]) == (40.0, 10.0)


def test_clip_scale_expand(spark):
    out = [(-5.0, -5.0), (150.0, 0.0), (150.0, 80.0), (0.0, 80.0)]
    clipped = values(spark, [out], lambda q: G.clip_quad(q, F.lit(100), F.lit(50)), QUAD)[0]
    assert [tuple(p) for p in clipped] == [(0.0, 0.0), (99.0, 0.0), (99.0, 49.0), (0.0, 49.0)]
    assert [tuple(p) for p in values(spark, [SQUARE], lambda q: G.scale_quad(q, F.lit(2.0)), QUAD)[0]][2] == (20.0, 20.0)
    grown = values(spark, [SQUARE], lambda q: G.expand_quad(q, F.lit(math.sqrt(2.0))), QUAD)[0]
    assert tuple(grown[0]) == pytest.approx((-1.0, -1.0)) and tuple(grown[2]) == pytest.approx((11.0, 11.0))


def pixels(spark, box, width, height):
    df = spark.createDataFrame([tuple(map(float, box))], "a double, b double, c double, d double")
    got = df.select(G.grid_to_pixels(*[F.col(c) for c in "abcd"], F.lit(width), F.lit(height))).first()[0]
    return tuple(got) if got else None


def test_grid_boxes(spark):
    assert pixels(spark, (0, 0, 1000, 1000), 1000, 500) == (0.0, 0.0, 999.0, 499.0)
    assert pixels(spark, (500, 500, 1000, 1000), 800, 600)[:2] == (400.0, 300.0)
    assert pixels(spark, (600, 400, 200, 100), 1000, 1000) == (200.0, 100.0, 600.0, 400.0)
    assert pixels(spark, (-200, -50, 1400, 1200), 400, 300) == (0.0, 0.0, 399.0, 299.0)
    for box in [(100, 1200, 500, 1210), (100, 1100, 400, 1500), (1200, 100, 1300, 400), (0, 500, 1000, 503),
                (400, 400, 402, 900), (0, 0, 0, 0), (10, 10, 10.2, 90)]:
        assert pixels(spark, box, 3024, 4032) is None
    for box in [(200, 1400, 600, 900), (-300, -200, 400, 400), (900, 900, 1400, 1400)]:
        x0, y0, x1, y1 = pixels(spark, box, 3024, 4032)
        assert 0 <= x0 < x1 <= 3023 and 0 <= y0 < y1 <= 4031


def test_rotation(spark):
    df = spark.createDataFrame([(270, 180), (None, -90), (0, 45)], "now int, by int")
    assert [r[0] for r in df.select(G.rotated(F.col("now"), F.col("by"))).collect()] == [90, 270, None]


# ---- names -----------------------------------------------------------------------


def test_upload_names(spark):
    good = {"IMG_1234.HEIC": "IMG_1234.HEIC", "holiday snap.jpg": "holiday snap.jpg", "Scan 001.tiff": "Scan 001.tiff",
            "../../../../etc/passwd.jpg": "passwd.jpg", "/etc/hosts.jpg": "hosts.jpg", "..\\..\\windows\\evil.jpg": "evil.jpg"}
    assert values(spark, list(good), safe_name) == list(good.values())
    bad = ["payload.sh", "notes.txt", "archive.db", "x.py", "", "   ", ".", "..", ".hidden.jpg", "jpg"]
    assert values(spark, bad, safe_name) == [None] * len(bad)


def test_names_and_types(spark):
    assert values(spark, ["a/b/c.JPG", "noext", "x.tar.gz"], suffix) == [".jpg", "", ".gz"]
    assert values(spark, ["a\\b\\c.JPG"], base_name) == ["c.JPG"]
    assert values(spark, ["a.heic", "b.PNG", "c.bin"], media_type) == ["image/heic", "image/png", "application/octet-stream"]
    assert values(spark, [".git/config", "a/Thumbs.db", "media/a.tmp", "git.txt", "index.html"],
                  lambda v: excluded(v, [".git", "Thumbs.db", "*.tmp"])) == [True, True, True, False, False]


# ---- search ------------------------------------------------------------------------


def test_search_points(spark):
    assert terms_of("  Polio  polio ") == ["polio", "polio"]
    df = spark.createDataFrame([("polio drive", "harold pratt", "the polio drive of 1962", "1962")],
                               "title string, names string, body string, date string")

    def points(term):
        return term_points(term, *[F.col(c).contains(term) for c in ("title", "names", "body")], F.col("date"))
    assert list(df.select(*[points(t) for t in ("polio", "pratt", "1962", "none")]).first()) == [12, 6, 6, 0]


def test_snippets(spark):
    text = "x" * 100 + "Polio Drive" + "y" * 200
    got = values(spark, [text, "short", "", "polio. POLIO"], lambda v: snippet(v, "polio"))
    start = 100 - 70
    raw = text[start:100 + 130]
    assert got[0] == "…" + re.sub("(polio)", r"<mark>\1</mark>", raw, flags=re.I) + "…"
    assert got[1:] == ["short", "", "<mark>polio</mark>. <mark>POLIO</mark>…"]
    assert values(spark, ["z" * 200], lambda v: snippet(v, "a.b")) == ["z" * 180 + "…"]
