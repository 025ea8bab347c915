"""Batch inference with any function, several calls in flight, failures kept to their own row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = ("item_id string, ok boolean, reply string, usage struct<input_tokens: long, output_tokens: long>, "
          "provider string, model string, error string")
_COLUMNS = ["item_id", "ok", "reply", "usage", "provider", "model", "error"]
_AT_A_TIME = 500


class ProviderError(RuntimeError):
    """A failure that would hit every job (credentials, endpoint): it stops the run."""


class Reply(NamedTuple):
    """What a call gave, what it used, and who answered."""

    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    provider: str | None = None
    model: str | None = None


def run_jobs(jobs: DataFrame, connect: Callable[[], Callable[[str, str], Reply | str]],
             partitions: int | None = None, in_flight: int = 4) -> DataFrame:
    """One result row per job (item_id, context), in any order.

    ``connect`` is called once per partition and returns ``fn(item_id, context)``, which gives a ``Reply`` or just its text and may be called from several
    threads. Each partition keeps up to ``in_flight`` calls going: a job starts as soon as any other ends, and no more jobs are read ahead than that.
    """

    def one(answer, item_id: str, context: str) -> tuple:
        try:
            got = answer(item_id, context)
        except ProviderError:
            raise
        except Exception as problem:  # one item's failure is its own
            return item_id, False, None, None, None, None, f"{type(problem).__name__}: {problem}"
        got = got if isinstance(got, Reply) else Reply(got)
        usage = None if got.input_tokens is None and got.output_tokens is None else {"input_tokens": got.input_tokens, "output_tokens": got.output_tokens}
        return item_id, True, got.text, usage, got.provider, got.model, None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = connect()
        every = ((i, c) for batch in batches for i, c in zip(batch["item_id"], batch["context"]))
        pool, going, rows = ThreadPoolExecutor(in_flight), set(), []
        try:
            for job in every:
                going.add(pool.submit(one, answer, *job))
                if len(going) >= in_flight:
                    done, going = wait(going, return_when=FIRST_COMPLETED)
                    rows += [f.result() for f in done]
                if len(rows) >= _AT_A_TIME:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            rows += [f.result() for f in going]
        finally:
            pool.shutdown(cancel_futures=True)
        yield pd.DataFrame(rows, columns=_COLUMNS)

    spread = jobs.repartition(partitions, "item_id") if partitions else jobs
    return spread.select("item_id", "context").mapInPandas(work, RESULT)


def reconcile(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Match results to jobs by id; a job without a result becomes a failed row."""
    joined = jobs.select("item_id").join(results, "item_id", "left")
    ok = F.coalesce("ok", F.lit(False))
    error = F.when(F.col("ok").isNull(), "missing from batch results").otherwise(F.col("error"))
    return joined.select("item_id", ok.alias("ok"), "reply", "usage", "provider", "model", error.alias("error"))


def failures(outcomes: DataFrame) -> DataFrame:
    """(item_id, error) of each item that failed, of rows (item_id, has_image, ok, error); one without an image was never tried."""
    reason = F.when(~F.col("has_image"), "no image").otherwise(F.coalesce("error", F.lit("missing from batch results")))
    return outcomes.where(~F.col("has_image") | ~F.coalesce("ok", F.lit(False))).select("item_id", reason.alias("error"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a run over rows (has_image, ok, flagged). No image: failed, but not attempted."""
    tried = F.col("has_image")
    good = tried & F.coalesce("ok", F.lit(False))
    return outcomes.agg(
        F.count_if(tried).alias("attempted"), F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"), F.count_if(good & F.col("flagged")).alias("flagged"))
