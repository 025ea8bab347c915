"""Published snapshots, transfer logs and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.operators import manifest as M
from keepsake.plans.bindings import FILES, Views
from keepsake.plans.registry import query

DIFF = FILES + """,
d AS (SELECT COALESCE(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'new' WHEN l.path IS NULL THEN '{gone}'
 WHEN l.size = r.size AND l.hash = r.hash THEN 'unchanged' ELSE 'changed' END AS change
 FROM local_files l FULL JOIN remote_files r ON l.path = r.path)"""


@query("snapshot_diff", f"WITH {DIFF.format(gone='kept')} SELECT path, change FROM d")
def snapshot_diff(v: Views) -> DataFrame:
    return M.diff(v.local_files, v.remote_files)


@query("snapshot_diff_with_delete", f"WITH {DIFF.format(gone='deleted')} SELECT path, change FROM d WHERE NOT regexp_matches(path, '/1[^/]*\\.txt$')")
def snapshot_diff_with_delete(v: Views) -> DataFrame:
    """Deleting what only the target has, but never an excluded note."""
    return M.diff(v.local_files, v.remote_files, delete=True, exclude=["1*.txt", ".git", "1*.txt"])


@query("manifest_stats", f"WITH {FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM local_files")
def manifest_stats(v: Views) -> DataFrame:
    return M.stats(v.local_files)


@query("staleness", """SELECT (SELECT max(l_shipdate) FROM lineitem) AS data_at, (SELECT max(o_orderdate) FROM orders) AS built_at,
 (SELECT max(l_shipdate) FROM lineitem) > (SELECT max(o_orderdate) FROM orders) AS stale""")
def staleness(v: Views) -> DataFrame:
    return M.staleness(v.t("lineitem"), "l_shipdate", v.t("orders"), "o_orderdate")


@query("transfer_log", f"""WITH {FILES} SELECT path, CASE WHEN size > 5000 THEN 'changed' ELSE 'deleted' END AS change FROM local_files""")
def transfer_log(v: Views) -> DataFrame:
    """A log written from the manifest: folders and headers among the files."""
    kind = F.when(F.col("size") > 5000, ">f+++++++++ ").otherwise("*deleting   ")
    lines = v.local_files.select(F.explode(F.array(
        F.concat(kind, F.col("path"), F.lit("  ")), F.lit("cd+++++++++ pages/"), F.lit("sending incremental file list"),
        F.lit(""))).alias("value"))
    return M.parse_transfer_log(lines)


@query("cost_estimate", """WITH prices AS (SELECT * FROM (VALUES ('highest', 5.0, 25.0), ('middle', 3.0, 15.0), ('lowest', 1.0, 5.0)) AS p(model, i, o)),
 j AS (SELECT CASE source WHEN 'src1' THEN 'highest' WHEN 'src2' THEN 'middle' ELSE 'lowest' END AS model, count(*) AS items FROM documents GROUP BY ALL),
 c AS (SELECT model, items, (((items - 1) * 1600 * 0.1 + 1600 * 1.25 + items * 2200) / 1000000 * i + items * 900.0 / 1000000 * o) * 0.5 AS usd FROM j JOIN prices USING (model))
 SELECT model, items, CAST(round(usd, 2) AS DOUBLE) AS usd, CAST(round(usd / items, 4) AS DOUBLE) AS usd_per_item FROM c""")
def cost_estimate(v: Views) -> DataFrame:
    # List prices per million tokens of the three tiers.
    prices = v.spark.createDataFrame([("highest", 5.0, 25.0), ("middle", 3.0, 15.0), ("lowest", 1.0, 5.0)],
                                     "model string, input_rate double, output_rate double")
    tier = F.when(F.col("source") == "src1", "highest").when(F.col("source") == "src2", "middle").otherwise("lowest")
    return M.cost(v.t("documents").select(tier.alias("model")), prices)
