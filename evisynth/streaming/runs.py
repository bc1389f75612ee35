"""Streams over append-only logs and record batches. Windows with watermarks are Spark's own and go beyond what reviews need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def firsts(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Of a stream's records those whose key no earlier batch has had, of a batch's equal keys the first by order, nulls last. A key that is null is a key too.

    What has been seen is keyed state, dealt out over tasks and kept with the checkpoint, so no batch reads the table."""

    def first(_, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            for _ in rows:
                pass
            return
        best = None
        for some in rows:
            some = some.sort_values(order, kind="stable").iloc[:1]
            best = some if best is None or pd.isna(best[order].iloc[0]) or some[order].iloc[0] < best[order].iloc[0] else best
        if best is not None:
            state.update((True,))
            yield best

    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def additive(stream: DataFrame, key: str, order: str, out: str, checkpoint: str, keep: Column | None = None) -> StreamingQuery:
    """Appends to the table at `out` the records that hold `keep` (such as having an abstract) and whose key it does not hold.

    The table's files are committed with the checkpoint: a query that is stopped or lost goes on behind its last whole batch, and a batch that is run again adds nothing twice."""
    rows = stream if keep is None else stream.where(keep)
    return firsts(rows, key, order).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def complete(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table at `out` equal to all of a stream's groups: each batch writes them anew."""
    return counts.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def until(step: Callable[[int], int], max_rounds: int, least_yield: int) -> int:
    """Rounds of step(i), which returns new relevant records, until one brings fewer than least_yield; the number of rounds."""
    for i in range(1, max_rounds + 1):
        if step(i) < least_yield:
            return i
    return max_rounds
