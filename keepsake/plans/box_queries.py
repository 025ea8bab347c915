"""Geometry, candidates, regions and detection results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions import geometry as G
from keepsake.operators import boxes as B
from keepsake.operators import regions as R
from keepsake.operators.workflow import with_item_ids
from keepsake.plans.bindings import BOXES, ITEMS, LINES, Views, by_range, pick
from keepsake.plans.registry import query
from keepsake.session import cut

INTER = """(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"""
AREA = "(({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0))"
IOU = f"(CAST({INTER} AS DOUBLE) / ({AREA.format('a')} + {AREA.format('b')} - {INTER}))"
INSIDE = f"(CAST({INTER} AS DOUBLE) / {AREA.format('a')})"
PAIRS = f""",
pairs AS (SELECT a.photo, a.seq AS a_seq, b.seq AS b_seq, a.area_frac AS a_area, b.area_frac AS b_area, {IOU} AS iou, {INSIDE} AS inside
 FROM boxes a JOIN boxes b ON a.photo = b.photo AND a.seq <> b.seq AND {INTER} > 0)"""
SWALLOW = PAIRS + """,
held AS (SELECT * FROM pairs WHERE inside > 0.85 AND a_area < b_area * 0.65),
swallowers AS (SELECT DISTINCT h.photo, h.b_seq AS seq FROM held h
 JOIN (SELECT photo, b_seq, arg_max(a_seq, (a_area, -a_seq)) AS big FROM held GROUP BY ALL) m USING (photo, b_seq)
 LEFT JOIN pairs p ON p.photo = h.photo AND p.a_seq = h.a_seq AND p.b_seq = m.big
 WHERE h.a_seq <> m.big AND COALESCE(p.iou, 0) < 0.20),
survivors AS (SELECT * FROM boxes ANTI JOIN swallowers USING (photo, seq))"""
GROUPS = SWALLOW.replace(",\npairs AS", ",\npairs AS", 1) + """,
up AS (SELECT p.photo, a_seq AS seq, b_seq AS earlier FROM pairs p
 JOIN survivors x ON x.photo = p.photo AND x.seq = p.a_seq JOIN survivors y ON y.photo = p.photo AND y.seq = p.b_seq
 WHERE p.iou > 0.35 AND (p.b_area > p.a_area OR (p.b_area = p.a_area AND p.b_seq < p.a_seq))),
reach AS (SELECT photo, seq, seq AS top FROM survivors UNION SELECT r.photo, r.seq, u.earlier FROM reach r
 JOIN up u ON u.photo = r.photo AND u.seq = r.top),
lead AS (SELECT r.photo, r.seq, arg_min(r.top, (-b.area_frac, b.seq)) AS lead_seq FROM reach r
 JOIN boxes b ON b.photo = r.photo AND b.seq = r.top GROUP BY ALL),
merged AS (SELECT b.photo, b.seq, b.x0, b.y0, b.x1, b.y1, b.confidence, b.area_frac, count(*) AS members,
 CASE WHEN count(DISTINCT m.method) > 1 THEN 'merged' ELSE b.method END AS method
 FROM lead l JOIN survivors b ON b.photo = l.photo AND b.seq = l.lead_seq JOIN survivors m ON m.photo = l.photo AND m.seq = l.seq
 GROUP BY b.photo, b.seq, b.x0, b.y0, b.x1, b.y1, b.confidence, b.area_frac, b.method)"""
REGIONS = LINES + """,
regions0 AS (SELECT l_orderkey AS photo, CAST(l_linenumber - 1 AS BIGINT) AS pos, partkey % 1200 - 100 AS gx0, suppkey * 37 % 1100 AS gy0,
 CAST(quantity * 8 - 20 AS BIGINT) AS gw, CAST(round(discount * 1000) AS BIGINT) AS gh, CAST(round(tax * 100) AS BIGINT) AS t,
 quantity, returnflag, linestatus FROM lines),
regions1 AS (SELECT *, 2000 + photo % 1000 AS width, 1500 + photo % 500 AS height,
 greatest(0, least(1000, least(gx0, gx0 + gw))) AS cx0, greatest(0, least(1000, greatest(gx0, gx0 + gw))) AS cx1,
 greatest(0, least(1000, least(gy0, gy0 + gh))) AS cy0, greatest(0, least(1000, greatest(gy0, gy0 + gh))) AS cy1 FROM regions0),
regions AS (SELECT *, cx1 - cx0 >= 5 AND cy1 - cy0 >= 5 AS usable,
 CASE linestatus WHEN 'O' THEN 'newsprint' ELSE 'other' END AS medium, CASE returnflag WHEN 'A' THEN 'letter' ELSE 'other' END AS kind,
 CASE WHEN quantity > 1 THEN least(1.0, quantity / 100) ELSE quantity END AS link_confidence,
 CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN 9 ELSE -1 END AS part_of, CASE WHEN t <= 2 THEN 1 ELSE -1 END AS duplicate_of,
 CASE WHEN t >= 5 THEN [CAST(0 AS BIGINT), 2, 7] ELSE [] END AS related FROM regions1),
claims AS (SELECT photo, pos, 'part_of' AS link, CAST(part_of AS BIGINT) AS target FROM regions WHERE usable
 UNION ALL SELECT photo, pos, 'duplicate_of', duplicate_of FROM regions WHERE usable
 UNION ALL SELECT photo, pos, 'related_to', unnest(related) FROM regions WHERE usable),
valid AS MATERIALIZED (SELECT c.* FROM claims c JOIN regions r ON r.photo = c.photo AND r.pos = c.target AND r.usable WHERE c.target <> c.pos),
rlinks AS MATERIALIZED (SELECT photo, pos, link, target FROM (
 SELECT *, bool_or(link = 'part_of') OVER (PARTITION BY photo, pos) AS parted FROM valid) WHERE link <> 'duplicate_of' OR NOT parted)"""


def quads(v: Views) -> DataFrame:
    """Tilted quads from the boxes, corners out of order."""
    b = v.boxes
    c = F.col
    quad = F.array(G.point(c("x1"), c("y1")), G.point(c("x0") + c("shift"), c("y0")), G.point(c("x0"), c("y1") - c("shift")),
                   G.point(c("x1"), c("y0") + 1))
    return b.select("photo", "seq", "shift", quad.alias("quad"))


@query("quad_geometry", f"""WITH {BOXES}, q AS (SELECT *, x0 + shift AS ax, y0 AS ay, x1 AS bx, y0 + 1 AS by_, x1 AS cx, y1 AS cy,
 x0 AS dx, y1 - shift AS dy FROM boxes), e AS (SELECT *, greatest(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)),
  sqrt((cx - dx) * (cx - dx) + (cy - dy) * (cy - dy))) AS w, greatest(sqrt((dx - ax) * (dx - ax) + (dy - ay) * (dy - ay)),
  sqrt((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_))) AS h FROM q)
 SELECT photo, seq, ax || ',' || ay || ' ' || bx || ',' || by_ || ' ' || cx || ',' || cy || ' ' || dx || ',' || dy AS corners,
 abs(ax * by_ - ay * bx + bx * cy - by_ * cx + cx * dy - cy * dx + dx * ay - dy * ax) / 2 AS area,
 CAST(round(w * 1000) AS BIGINT) AS w, CAST(round(h * 1000) AS BIGINT) AS h,
 CAST(round(greatest(w, h) / least(w, h) * 1000) AS BIGINT) AS aspect FROM e""")
def quad_geometry(v: Views) -> DataFrame:
    rows = quads(v).withColumn("q", G.order_corners(F.col("quad")))
    width, height = G.edge_lengths(F.col("q"))
    corner = F.transform("q", lambda p: F.concat(p.x.cast("long").cast("string"), F.lit(","), p.y.cast("long").cast("string")))

    def thousandths(value: Column) -> Column:
        return F.round(value * 1000).cast("long")

    return rows.select("photo", "seq", F.array_join(corner, " ").alias("corners"), G.quad_area(F.col("q")).alias("area"),
                       thousandths(width).alias("w"), thousandths(height).alias("h"),
                       thousandths(G.aspect_ratio(F.col("q"))).alias("aspect"))


@query("quad_adjustment", f"""WITH {BOXES}, s AS (SELECT photo, seq, x0 * 2.0 AS x0, y0 * 2.0 AS y0, x1 * 2.0 AS x1, y1 * 2.0 AS y1 FROM boxes),
 e AS (SELECT *, (x1 - x0) / 2 AS hw, (y1 - y0) / 2 AS hh, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 2 AS len FROM s)
 SELECT photo, seq, CAST(round(greatest(0, least(1099, x0 - hw / len * 4)) * 100) AS BIGINT) AS x0,
 CAST(round(greatest(0, least(999, y0 - hh / len * 4)) * 100) AS BIGINT) AS y0,
 CAST(round(greatest(0, least(1099, x1 + hw / len * 4)) * 100) AS BIGINT) AS x1,
 CAST(round(greatest(0, least(999, y1 + hh / len * 4)) * 100) AS BIGINT) AS y1 FROM e""")
def quad_adjustment(v: Views) -> DataFrame:
    """Scaled to full resolution, pushed outwards, clipped to the frame; compared in hundredths of a pixel."""
    scaled = G.scale_quad(G.rectangle(G.Box.of()), F.lit(2.0))
    final = v.boxes.select("photo", "seq", scaled.alias("s")).select(
        "photo", "seq", G.expand_quad(F.col("s"), F.lit(4.0)).alias("e")).select(
        "photo", "seq", G.clip_quad(F.col("e"), F.lit(1100), F.lit(1000)).alias("q"))
    box = G.quad_box(F.col("q"))
    return final.select("photo", "seq", *[
        F.round(getattr(box, n) * 100).cast("long").alias(n) for n in ("x0", "y0", "x1", "y1")])


@query("overlapping_boxes", f"""WITH {BOXES} {PAIRS} SELECT photo, a_seq, b_seq, iou, inside FROM pairs""")
def overlapping_boxes(v: Views) -> DataFrame:
    slim = cut(v.boxes.select("photo", "seq", *B.COORDS))
    a, b = G.Box.of(prefix="a_"), G.Box.of(prefix="b_")
    return B.overlapping_pairs(slim, slim).where("a_seq != b_seq").select(
        "photo", "a_seq", "b_seq", G.iou(a, b).alias("iou"), G.containment(a, b).alias("inside"))


@query("colliding_boxes", f"WITH {BOXES} {PAIRS} SELECT DISTINCT photo, a_seq AS seq FROM pairs WHERE inside >= 0.70")
def colliding_boxes(v: Views) -> DataFrame:
    return B.collisions(v.boxes).select("photo", "seq")


BEST = BOXES + f""",
best AS (SELECT a.photo, a.seq, max({IOU}) AS iou FROM boxes a JOIN predicted b ON a.photo = b.photo AND {INTER} > 0 GROUP BY ALL),
matched AS (SELECT b.photo, b.seq, COALESCE(iou, 0.0) AS iou FROM boxes b LEFT JOIN best USING (photo, seq))"""


def matched_boxes(v: Views) -> DataFrame:
    """Both sides come from the same lines, which are put together once."""
    boxes = cut(v.boxes.select("photo", "seq", *B.COORDS, "method", "shift"))
    return B.best_matches(boxes.select("photo", "seq", *B.COORDS), v.predicted_of(boxes))


@query("best_box_matches", f"WITH {BEST} SELECT photo, seq, iou FROM matched")
def best_box_matches(v: Views) -> DataFrame:
    got = matched_boxes(v)
    return got.select("photo", "seq", "iou")


@query("detection_evaluation", f"""WITH {BEST}, p AS (SELECT photo, count(*) AS items, count(*) FILTER (iou >= 0.8) AS found FROM matched GROUP BY ALL)
 SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(found) AS BIGINT) AS found, count(*) AS photos,
 count(*) FILTER (items = found) AS complete_photos, round(sum(found) / sum(items), 4) AS recall,
 (SELECT round(median(iou), 4) FROM matched) AS median_iou FROM p""")
def detection_evaluation(v: Views) -> DataFrame:
    got = B.evaluation(matched_boxes(v))
    return got.withColumns({"recall": F.round("recall", 4), "median_iou": F.round("median_iou", 4)})


@query("shape_filter", f"""WITH {BOXES} SELECT photo, seq FROM boxes WHERE area_frac BETWEEN 0.015 AND 0.90 AND confidence >= 0.55
 AND greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) <= 8 AND 1 - shift / 10.0 >= 0.42""")
def shape_filter(v: Views) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = v.boxes.withColumns({"solidity": F.col("confidence"), "aspect": F.greatest(w, h) / F.least(w, h),
                                "fill": 1 - F.col("shift") / 10})
    return B.shape_filter(rows).select("photo", "seq")


@query("confidence_scores", f"""WITH {BOXES}, s AS (SELECT *, round(least(1.0, 0.55 * least(1.0, 1 - shift / 10.0) + 0.30 * least(1.0, confidence)
 + CASE WHEN method = 'edge' THEN 0.15 ELSE 0.05 END), 4) AS shape FROM boxes)
 SELECT photo, seq, shape, round(0.70 * confidence + 0.30 * shape, 4) AS final,
 round(least(1.0, confidence * CASE WHEN method = 'edge' THEN 1.0 ELSE 0.6 END), 4) AS region, least(confidence, 0.45) AS split FROM s""")
def confidence_scores(v: Views) -> DataFrame:
    c = F.col
    fit = F.when(c("method") == "edge", "poly").otherwise("rect")
    rows = v.boxes.withColumn("shape", G.shape_confidence(1 - c("shift") / 10, c("confidence"), fit))
    return rows.select("photo", "seq", "shape",
                       G.final_confidence(c("confidence"), c("shape")).alias("final"),
                       G.region_confidence(c("confidence"), c("method") == "edge").alias("region"),
                       G.split_confidence(c("confidence")).alias("split"))


@query("candidate_union", f"WITH {BOXES} SELECT method, count(*) AS n FROM boxes GROUP BY ALL")
def candidate_union(v: Views) -> DataFrame:
    passes = [v.boxes.where(F.col("method") == m) for m in ("background", "edge", "threshold")]
    return B.candidate_union(*passes).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("without_swallowers", f"WITH {BOXES} {SWALLOW} SELECT photo, seq FROM survivors")
def without_swallowers(v: Views) -> DataFrame:
    return B.drop_swallowers(cut(v.boxes)).select("photo", "seq")


def merged_boxes(v: Views) -> DataFrame:
    return B.merge_groups(cut(B.drop_swallowers(cut(v.boxes))))


@query("merged_candidates", f"WITH RECURSIVE {BOXES} {GROUPS} SELECT photo, seq, method, members FROM merged")
def merged_candidates(v: Views) -> DataFrame:
    return merged_boxes(v).select("photo", "seq", "method", "members")


@query("reading_order", f"""WITH {BOXES}, t AS (SELECT *, greatest(1.0, median(y1 - y0) OVER (PARTITION BY photo) * 0.75) AS tol FROM boxes)
 SELECT photo, seq, row_number() OVER (PARTITION BY photo ORDER BY round_even((y0 + y1) / 2 / tol, 0), (x0 + x1) / 2, seq) AS position FROM t""")
def reading_order(v: Views) -> DataFrame:
    return B.reading_order(cut(v.boxes)).select("photo", "seq", "position")


@query("whole_frame_fallback", f"""WITH {BOXES}, f AS (SELECT o_orderkey AS photo, 1000 + o_custkey % 3000 AS width, 800 + o_custkey % 2000 AS height FROM orders)
 SELECT photo, seq, x0, y0, x1, y1, method, confidence, FALSE AS flagged FROM boxes UNION ALL
 SELECT photo, 0, 0, 0, width - 1, height - 1, 'whole_frame', 0.5, TRUE FROM f WHERE photo NOT IN (SELECT photo FROM boxes)""")
def whole_frame_fallback(v: Views) -> DataFrame:
    photos = v.photos.select(F.col("o_orderkey").alias("photo"), "width", "height")
    return B.at_least_one(photos, v.boxes).select("photo", "seq", *B.COORDS, "method", "confidence", "flagged")


SETTLED = BOXES + """,
n AS (SELECT photo, seq, area_frac, method, confidence, count(*) OVER (PARTITION BY photo) AS n, photo % 9 = 0 AS split FROM boxes),
c AS (SELECT *, CASE WHEN split THEN least(confidence, 0.45) WHEN n = 1 AND area_frac >= 0.3 THEN greatest(confidence, 0.75) ELSE confidence END AS final,
 NOT split AND n = 1 AND area_frac >= 0.3 AS lone FROM n),
every AS (SELECT photo, seq, n, split, lone, FALSE AS bare, final, CASE WHEN lone THEN 'whole_frame' ELSE method END AS how FROM c
 UNION ALL SELECT o_orderkey, 0, NULL, FALSE, FALSE, TRUE, 0.5, 'whole_frame' FROM orders WHERE o_orderkey NOT IN (SELECT photo FROM boxes))"""


def settled_boxes(v: Views) -> tuple[DataFrame, DataFrame]:
    photos = v.photos.select(F.col("o_orderkey").alias("photo"), "width", "height")
    return B.settled(photos, v.boxes, v.boxes.where("photo % 9 = 0"), single_frac=0.3)


@query("photo_notes", f"""WITH {SETTLED}, p AS (SELECT photo, max(final) AS best, max(n) AS n, bool_or(split) AS split, bool_or(lone) AS lone, bool_or(bare) AS bare FROM every GROUP BY ALL)
 SELECT photo, best, CASE WHEN split THEN 'items were touching, so ' || n || ' rough crops were split out - check and adjust each one'
  WHEN bare THEN 'no items detected; using whole frame' WHEN lone THEN 'single item filling the frame' WHEN best < 0.6 THEN 'low-confidence detection' END AS note,
 split OR bare OR best < 0.6 AS needs_review FROM p""")
def photo_notes(v: Views) -> DataFrame:
    return settled_boxes(v)[1]


@query("settled_boxes", f"WITH {SETTLED} SELECT photo, seq, how AS method, final AS confidence FROM every")
def settled_confidence(v: Views) -> DataFrame:
    return settled_boxes(v)[0].select("photo", "seq", "method", "confidence")


@query("detection_summary", f"""WITH {ITEMS} SELECT count(*) AS items, count(*) FILTER (needs_human_review) AS flagged,
 count(*) FILTER (skew <> 0) AS corrected, max(abs(skew)) AS max_skew FROM items""")
def detection_summary(v: Views) -> DataFrame:
    return B.detection_summary(v.items.withColumnRenamed("needs_human_review", "flagged"))


@query("item_ids", f"""WITH {LINES}, o AS (SELECT l_orderkey, max(l_linenumber) - 1 AS last FROM lines WHERE linestatus = 'F' GROUP BY ALL),
 n AS (SELECT l_orderkey, partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY partkey, l_linenumber) AS rn FROM lines WHERE linestatus = 'O')
 SELECT partkey, rn + COALESCE(last, -1) AS seq, left(sha256(CAST(n.l_orderkey AS VARCHAR)), 12) || '-' || printf('%02d', rn + COALESCE(last, -1)) AS id
 FROM n LEFT JOIN o USING (l_orderkey)""")
def item_ids(v: Views) -> DataFrame:
    """Lines still open join the photo after those already filled."""
    rows = cut(v.lines.select(F.sha2(F.col("l_orderkey").cast("string"), 256).alias("photo_sha256"),
                              (F.col("l_linenumber") - 1).cast("long").alias("line"), "partkey", "linestatus"))
    existing = rows.where("linestatus = 'F'").select("photo_sha256", F.col("line").alias("seq"))
    fresh = rows.where("linestatus = 'O'")
    return with_item_ids(fresh, existing, [F.col("partkey"), F.col("line")], by_range("partkey", 1000)).select(
        "partkey", "seq", "id")


# ---- regions -----------------------------------------------------------------


def region_rows(v: Views) -> DataFrame:
    """One reply per line, with the near misses that models make."""
    c = F.col
    x0, y0 = (c("partkey") % 1200 - 100).cast("long"), (c("suppkey") * 37 % 1100).cast("long")
    x1 = x0 + (c("quantity") * 8 - 20).cast("long")
    y1 = y0 + F.round(c("discount") * 1000).cast("long")
    t = F.round(c("tax") * 100).cast("long")
    none = F.array().cast("array<bigint>")
    body = F.to_json(F.struct(
        F.array(x0, y0, x1, y1).alias("box"), pick(c("returnflag"), {"A": "letter", "N": "sculpture"}, "?").alias("kind"),
        F.when(c("linestatus") == "O", "newsprint").alias("medium"), F.lit("Seen").alias("headline"),
        c("quantity").alias("link_confidence"), F.lit("0.9").alias("confidence"),
        F.when(t == 0, "0").when(t == 1, "9").otherwise("none").alias("part_of"),
        F.when(t == 0, "same story").otherwise("").alias("part_reason"),
        F.when(t <= 2, 1).otherwise(-1).alias("duplicate_of"),
        F.when(t >= 5, F.array(F.lit(2), F.lit(0), F.lit(0), F.lit(7), F.lit(-3)).cast("array<bigint>")).otherwise(none).alias("related_to"),
        F.when(c("linestatus") == "F", F.lit(True)).alias("clipped_by_frame"), F.lit("two").alias("panels")))
    return v.lines.select(c("l_orderkey").alias("photo"), (c("l_linenumber") - 1).cast("int").alias("pos"),
                          (2000 + c("l_orderkey") % 1000).alias("width"), (1500 + c("l_orderkey") % 500).alias("height"),
                          F.parse_json(body).alias("region"))


@query("parsed_regions", f"""WITH {REGIONS} SELECT photo, pos, kind, medium, usable, CASE WHEN usable THEN round(cx0 * width / 1000.0, 3) END AS x0,
 CASE WHEN usable THEN round(least(height - 1, cy1 * height / 1000.0), 3) END AS y1, linestatus = 'F' AS clipped, CAST(1 AS BIGINT) AS panels,
 CAST(part_of AS BIGINT) AS part_of, CASE WHEN len(related) > 0 THEN '0,2,7' ELSE '' END AS related, link_confidence, CAST(0.9 AS DOUBLE) AS confidence FROM regions""")
def parsed_regions(v: Views) -> DataFrame:
    p = R.parse_regions(region_rows(v))
    return p.select("photo", F.col("pos").cast("long").alias("pos"), "kind", "medium", F.col("box").isNotNull().alias("usable"),
                    F.round("box.x0", 3).alias("x0"), F.round("box.y1", 3).alias("y1"),
                    F.col("clipped_by_frame").alias("clipped"), "panels", "part_of",
                    F.array_join(F.col("related_to").cast("array<string>"), ",").alias("related"), "link_confidence", "confidence")


@query("dropped_regions", f"""WITH {REGIONS} SELECT photo, count(*) FILTER (usable) AS regions, count(*) FILTER (NOT usable) AS dropped
 FROM regions GROUP BY ALL""")
def dropped_regions(v: Views) -> DataFrame:
    return R.dropped_per_photo(R.parse_regions(region_rows(v)))


@query("sibling_links", f"WITH {REGIONS} SELECT photo, pos, link, target FROM rlinks")
def sibling_links(v: Views) -> DataFrame:
    return R.sibling_links(cut(R.parse_regions(region_rows(v))))


@query("item_notes", f"""WITH {REGIONS}, {BOXES.replace('lines AS', 'lines2 AS').replace('FROM lines)', 'FROM lines2)')} {PAIRS},
 hit AS (SELECT DISTINCT photo, a_seq AS seq FROM pairs WHERE inside >= 0.70),
 k AS (SELECT photo, pos, bool_or(link = 'part_of') AS p, bool_or(link = 'duplicate_of') AS d, bool_or(link = 'related_to') AS r FROM rlinks GROUP BY ALL),
 n AS (SELECT b.photo, b.seq, b.confidence, list_filter([
  CASE WHEN b.method = 'threshold' THEN 'no paper found under this box - the item is real but the crop may be pointing at the wrong part of the photo' END,
  CASE WHEN g.linestatus = 'F' THEN 'runs off the edge of the photograph - reshoot to capture all of it' END,
  CASE WHEN (b.photo, b.seq) IN (SELECT (photo, seq) FROM hit) THEN
   'this crop sits almost entirely inside another item''s crop - one of the two is on the wrong piece of paper' END,
  CASE WHEN (p OR d OR r) AND link_confidence < 0.80 THEN 'model says this ' || CASE WHEN p THEN 'belongs with another item'
   WHEN d THEN 'is a duplicate, so would not be published' ELSE 'is linked to another item' END || ' but is only '
   || CAST(round_even(link_confidence * 100, 0) AS BIGINT) || '% sure' || CASE WHEN p AND t = 0 THEN ': same story' ELSE '' END END],
  lambda x: x IS NOT NULL) AS notes
  FROM boxes b JOIN regions g ON g.photo = b.photo AND g.pos = b.seq - 1 LEFT JOIN k ON k.photo = b.photo AND k.pos = b.seq - 1)
 SELECT photo, seq, array_to_string(notes, '|') AS notes, confidence < 0.80 OR len(notes) > 0 AS flagged,
 CASE WHEN len(notes) > 0 THEN array_to_string(notes, '; ') WHEN confidence < 0.80
  THEN 'detection confidence ' || printf('%.2f', confidence) || ' below 0.80' END AS reason FROM n""")
def item_notes(v: Views) -> DataFrame:
    boxes = cut(v.boxes)
    parsed = cut(R.parse_regions(region_rows(v)))
    found = R.sibling_links(parsed).groupBy("photo", "pos").agg(
        F.max(F.when(F.col("link") == "part_of", F.col("target"))).alias("p"),
        F.max(F.when(F.col("link") == "duplicate_of", F.col("target"))).alias("d"),
        F.count_if(F.col("link") == "related_to").alias("r"))
    regions = parsed.select("photo", F.col("pos").cast("long").alias("pos"), "clipped_by_frame", "link_confidence",
                            F.col("part_reason").alias("__why")).join(found, ["photo", "pos"], "left").select(
        "photo", (F.col("pos") + 1).alias("seq"), "clipped_by_frame", "link_confidence",
        F.coalesce("p", F.lit(-1)).alias("part_of"), F.coalesce("d", F.lit(-1)).alias("duplicate_of"),
        F.array_repeat(F.lit(0), F.coalesce("r", F.lit(0)).cast("int")).alias("related_to"),
        # A reason goes with its link: without a valid parent there is none.
        F.when(F.col("p").isNotNull(), F.col("__why")).otherwise("").alias("part_reason"), F.lit("").alias("related_reason"))
    hits = B.collisions(boxes).select("photo", "seq", F.lit(True).alias("__hit"))
    rows = boxes.join(regions, ["photo", "seq"]).join(hits, ["photo", "seq"], "left").withColumns({
        "method": F.when(F.col("method") == "threshold", "vision_raw").otherwise("vision"),
        "collides": F.coalesce("__hit", F.lit(False)), "photo_flagged": F.lit(False),
        "photo_note": F.lit(None).cast("string")})
    out = R.item_notes(0.80)
    return rows.select("photo", "seq", F.array_join(out["notes"], "|").alias("notes"), out["flagged"].alias("flagged"),
                       out["reason"].alias("reason"))
