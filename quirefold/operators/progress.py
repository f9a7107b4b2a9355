"""Progress metrics: rates, throttling, running totals, the latest state, retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quirefold.config import DESCRIPTION_LENGTHS
from quirefold.functions import text as t


def rolling_rate(events: DataFrame, key: str, ts: str, amount: str, window: str, order: str) -> DataFrame:
    """``events`` with ``in_window`` and ``per_second``: the change of ``amount`` over the events of the last ``window`` (inclusive), per ``key``.

    Fewer than two events or no time between them give 0. Of events at one time all belong to the frame.
    """
    frame = events.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp")))
    by = Window.partitionBy(key).orderBy("__s").rangeBetween(-int(pd.Timedelta(window).total_seconds() * 1e6), 0)
    first = F.min(F.struct(F.col(ts), F.col(order), F.col(amount).alias("v"))).over(by)
    last = F.max(F.struct(F.col(ts), F.col(order), F.col(amount).alias("v"))).over(by)
    out = frame.withColumns({"in_window": F.count(F.lit(1)).over(by), "__a": first, "__b": last})
    took = (F.unix_micros(F.col(f"__b.{ts}").cast("timestamp")) - F.unix_micros(F.col(f"__a.{ts}").cast("timestamp"))) / 1e6
    return out.withColumn("per_second", F.when((F.col("in_window") < 2) | (took <= 0), 0.0).otherwise((F.col("__b.v") - F.col("__a.v")) / took)).drop("__s", "__a", "__b")


def _throttle(key: str, gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        current = object()
        for batch in batches:
            keep = []
            for k, s in zip(batch[key].tolist(), batch["__s"].tolist()):
                if k != current:
                    current, state["last"] = k, None
                go = state["last"] is None or s - state["last"] >= gap
                if go:
                    state["last"] = s
                keep.append(go)
            yield batch[keep].drop(columns="__s")

    return run


def throttled(events: DataFrame, key: str, ts: str, order: str, gap_seconds: float) -> DataFrame:
    """The events at least ``gap_seconds`` after the last one let through, per ``key``; state is one time, whatever a key's length."""
    timed = events.withColumn("__s", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, ts, order)
    return timed.mapInPandas(_throttle(key, round(gap_seconds * 1_000_000)), events.schema)


def cumulative(events: DataFrame, key: str, order: list[str], amount: str) -> DataFrame:
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"done": F.row_number().over(running).cast("long"), "total": F.sum(amount).over(running)})


def latest(events: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The last state of each ``key``."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(key).agg(last.alias("__v")).select(key, *(F.col(f"__v.{v}").alias(v) for v in values))


def best_attempt(attempts: DataFrame, low: int = DESCRIPTION_LENGTHS[0], high: int = DESCRIPTION_LENGTHS[1]) -> DataFrame:
    """``attempts(image, attempt, description)`` -> per image the first description of a fitting length (null: none, and nothing is saved), the attempts it took, and its class."""
    size = F.length("description")
    fits = F.coalesce(size.between(low, high), F.lit(False))
    found = attempts.groupBy("image").agg(
        F.min_by(F.when(fits, F.col("description")), F.when(fits, F.col("attempt"))).alias("description"),
        F.min(F.when(fits, F.col("attempt"))).alias("at"), F.count(F.lit(1)).alias("n"), F.max(size).alias("longest"))
    kind = F.when(F.col("at").isNotNull(), "valid").when(F.coalesce("longest", F.lit(0)) < low, "short").otherwise("long")
    return found.select("image", "description", F.coalesce("at", F.col("n").cast("int")).cast("int").alias("attempts"), kind.alias("outcome"))


def run_summary(best: DataFrame) -> DataFrame:
    """Counts of a describing run and the names that failed."""
    return best.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("outcome") == "valid").alias("valid"), F.count_if(F.col("outcome") == "short").alias("short"),
        F.count_if(F.col("outcome") == "long").alias("long"), F.array_sort(F.collect_list(F.when(F.col("outcome") != "valid", F.col("image")))).alias("failed"))


def eligible_files(state: DataFrame) -> DataFrame:
    """Files that may be converted: ready ones, and those done before."""
    return state.where(F.col("status").isin("Ready", "Done"))


def scan_totals(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


def progress_totals(events: DataFrame) -> DataFrame:
    """The sums of each file's latest event: pages done and in all, images, drawings, and the share done in percent."""
    values = ("pages_done", "total_pages", "images", "drawings")
    sums = latest(events, "file", ["ts", "seq"], *values).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values))
    return sums.withColumn("percent", t.percent(F.col("pages_done"), F.col("total_pages")))
