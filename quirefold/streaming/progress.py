"""Progress as a stream: page results arrive as files, totals and throttled events leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def results(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of page results as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def totals(pages: DataFrame, *counters: str) -> DataFrame:
    """Running totals of each document (complete or update mode)."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_done"), *(F.sum(c).alias(c) for c in counters))


def windowed(events: DataFrame, ts: str, delay: str, length: str, *keys: str) -> DataFrame:
    """An extension: event-time windows with a watermark, for sinks in append mode."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n"))


def throttled(events: DataFrame, key: str, ts: str, order: str, gap_seconds: float) -> DataFrame:
    """Events at least ``gap_seconds`` after the last one let through, per key; the state is that one time.

    Events of a micro-batch are put in order; one that is older than the last let through is dropped.
    """
    names, gap = events.columns, round(gap_seconds * 1_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(frames), ignore_index=True).sort_values([ts, order], kind="stable")
        keep = []
        for s in batch[ts].astype("datetime64[us]").astype("int64").tolist():
            go = last is None or s - last >= gap
            if go:
                last = s
            keep.append(go)
        if last is not None:
            state.update((last,))
        yield batch.loc[keep, names]

    return events.groupBy(key).applyInPandasWithState(step, events.schema, "last long", "append", GroupStateTimeout.NoTimeout)
