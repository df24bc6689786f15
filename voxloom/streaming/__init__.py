"""Voxel operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def voxel_sums(stream: DataFrame, axes: Sequence[str], feats: Sequence[str], batch: str = "b", time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Running sums and counts of each voxel, over all time or by event-time windows with a watermark.

    The state holds one row for each voxel (and open window); windows close when the watermark passes them.
    """
    keys = [batch, *axes]
    if (time is None) != (window is None):
        raise ValueError("windows need both a time column and a length")
    if time is not None:
        stream = stream.withWatermark(time, late)
        keys.append(F.window(time, window).alias("window"))
    return stream.groupBy(*keys).agg(*(F.sum(f).alias(f) for f in feats), F.count(F.lit(1)).alias("n"))


def for_each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends ``operator`` of every micro-batch to a Parquet table; any operator of this package will do.

    A micro-batch that is run again after a failure overwrites its own folder, so it counts once.
    """

    def write(df: DataFrame, epoch: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
