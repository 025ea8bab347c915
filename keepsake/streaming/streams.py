"""Arrivals, review decisions and live counts as Structured Streaming queries.

State is kept by key: in built-in aggregates for arrivals and counts, in a processor of its own for review. What one batch brings of a hot
item or content is combined before it is shuffled, and a batch writes the keys that it touched only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from keepsake.operators.workflow import STATUS_AFTER


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def inbox_stream(arrivals: DataFrame, ledger_path: str, state: str,
                 known: DataFrame | None = None) -> StreamingQuery:
    """Follow the arrivals (path, hash, readable, ...) and write each content's first path to the table below ``ledger_path``.

    The state is the least path of each content met so far, kept by an aggregate that combines before it shuffles; a batch touches the
    contents that it brings only. Each batch's touched contents go to a folder of their own, which a replay overwrites with the same
    rows. Contents in ``known`` (hash) stay out. ``ledger`` reads the table: the winner of a content is the least of all its paths, however the files are cut into batches.
    """
    first = first_arrivals(arrivals)

    def take(batch: DataFrame, batch_id: int) -> None:
        fresh = batch if known is None else batch.join(known.select("hash"), "hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")

    return (first.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", state)
            .trigger(availableNow=True).start())


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """The row of the least path of each readable content."""
    row = F.struct("path", *[c for c in arrivals.columns if c not in ("path", "hash")])
    return (arrivals.where("readable and hash is not null").groupBy("hash").agg(F.min(row).alias("first"))
            .select(*[F.col("hash") if c == "hash" else F.col(f"first.{c}") for c in arrivals.columns]))


def ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """One row per content: that of its least path in any batch."""
    return first_arrivals(spark.read.parquet(ledger_path).drop("batch"))


_STEP = "item_id string, at timestamp, status_at long, status_seq long, status string, turned long, cleared boolean, deleted boolean, n long"
_STATE = "status_at long, status_seq long, status string, turned long, cleared boolean, deleted boolean, n long"
_REVIEW = "item_id string, status string, rotation long, flag_cleared boolean, deleted boolean, n_actions long"


def steps(actions: DataFrame, within: str = "1h") -> DataFrame:
    """What each item's actions (item_id, at, seq, action, degrees) within a span of time come to, worked out where they are read.

    An item that everyone decides on sends one row per task and span to its state instead of every action.
    """
    key = ["item_id", "span"]

    def run(frames):
        for rows in frames:
            action = rows["action"]
            rows = rows.assign(span=rows["at"].dt.floor(within), status=action.map(STATUS_AFTER), turned=rows["degrees"].where(action == "rotate", 0).fillna(0).astype("int64"),
                               cleared=action.isin(["approve", "reject"]), deleted=action == "delete")
            out = rows.groupby(key, dropna=False, sort=False).agg(at=("at", "max"), turned=("turned", "sum"), cleared=("cleared", "any"),
                                                                  deleted=("deleted", "any"), n=("action", "size")).reset_index()
            setting = rows[rows["status"].notna()].sort_values(["micros", "seq"], na_position="first").drop_duplicates(key, keep="last")
            latest = setting[[*key, "micros", "seq", "status"]].rename(columns={"micros": "status_at", "seq": "status_seq"}).astype({"status_at": "Int64", "status_seq": "Int64"})
            yield out.merge(latest, on=key, how="left")[[f.split()[0] for f in _STEP.split(", ")]]

    micros = F.unix_micros(F.col("at").cast("timestamp")).alias("micros")
    return actions.select("item_id", "at", micros, "seq", "action", "degrees").mapInPandas(run, _STEP)


def _order(at, seq) -> tuple:
    """Sorts by time, then number; what has none comes first."""
    return at is not None, at, seq is not None, seq


class ReviewFold(StatefulProcessor):
    """An item's state: its latest status by the time of the action (not of its arrival), turns, flags and number of actions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, seq, status, turned, cleared, deleted, n = self.state.get() or (None, None, None, 0, False, False, 0)
        for r in rows:
            if r.status is not None and (status is None or _order(r.status_at, r.status_seq) >= _order(at, seq)):
                at, seq, status = r.status_at, r.status_seq, r.status
            turned, cleared, deleted, n = turned + r.turned, cleared or r.cleared, deleted or r.deleted, n + r.n
        self.state.update((at, seq, status, turned, cleared, deleted, n))
        yield Row(item_id=key[0], status=status, rotation=turned % 360, flag_cleared=cleared, deleted=deleted, n_actions=n)

    def close(self) -> None:
        pass


def review_stream(actions: DataFrame, delay: str = "3650 days") -> DataFrame:
    """The state of each item that an action touches, as the batch fold gives it, in any order of arrival.

    State is kept by item; actions that come more than ``delay`` after later ones are left out (``late_rows`` counts them). Decisions hardly expire, so it is ten years
    by default. Needs a state store on RocksDB, see ``session.KEYED_STATE``.
    """
    return steps(actions).withWatermark("at", delay).groupBy("item_id").transformWithState(
        ReviewFold(), outputStructType=_REVIEW, outputMode="Update", timeMode="EventTime")


def late_rows(progress: list) -> int:
    """Rows that came after the watermark, over all batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def count_stream(rows: DataFrame, by: str | Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(result: DataFrame, path: str, state: str, keys: Sequence[str]) -> tuple[DataFrame, list]:
    """Drain a stream in update mode now: the last row of each key, and the progress of all batches.

    Each batch writes the keys that it touched to a folder of its own, nothing else.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (result.writeStream.outputMode("update").foreachBatch(save)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    spark = result.sparkSession
    rows = spark.read.schema(StructType([*result.schema, StructField("batch", LongType())])).option("basePath", path).parquet(f"{path}/batch=*") \
        if query.recentProgress else spark.createDataFrame([], result.schema).withColumn("batch", F.lit(0))
    rest = F.struct("batch", *[c for c in result.columns if c not in keys])
    last = rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in result.columns]), query.recentProgress
