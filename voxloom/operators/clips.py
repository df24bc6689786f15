"""Clips of consecutive frames: islands, sliding windows, scaling and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(frames: DataFrame, index: str = "frame", key: Sequence[str] = ()) -> DataFrame:
    """``frames`` (distinct by key and index) with ``island``: runs of consecutive indexes within each key."""
    w = Window.partitionBy(*key).orderBy(index)
    return frames.withColumn("island", F.col(index) - F.row_number().over(w))


def sliding(frames: DataFrame, length: int, index: str = "frame", key: Sequence[str] = ()) -> DataFrame:
    """(key, start, frames): each window of ``length`` consecutive frames, by its first one."""
    distinct = frames.select(*key, index).distinct()
    w = Window.partitionBy(*key, "island").orderBy(index).rowsBetween(0, length - 1)
    rows = islands(distinct, index, key).withColumn("frames", F.collect_list(index).over(w))
    return rows.filter(F.size("frames") == length).select(*key, F.col(index).alias("start"), "frames")


def clips(frames: DataFrame, length: int, most_skip: int = 8, index: str = "frame", key: Sequence[str] = ()) -> DataFrame:
    """Distinct clips of ``length`` frames: consecutive ones, and ones that skip up to ``most_skip`` frames between."""
    out = None
    for skip in range(most_skip + 1):
        phase = frames.select(*key, F.col(index).alias("__i")).distinct()
        phase = phase.select(*key, F.pmod(F.col("__i"), F.lit(skip + 1)).alias("__phase"), F.floor(F.col("__i") / (skip + 1)).cast("long").alias("__step"))
        part = sliding(phase, length, "__step", [*key, "__phase"])
        part = part.select(*key, F.transform("frames", lambda s: s * (skip + 1) + F.col("__phase")).alias("frames"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def scaled(rows: DataFrame, clip: str = "clip", intensity: str = "intensity", cameras: str = "cameras", step: str = "t", length: int = 10) -> DataFrame:
    """Features of a clip's voxels: z-scored intensity, cameras up to 10 over 10, and the place in the clip."""
    w = Window.partitionBy(clip)
    deviation = F.stddev_pop(intensity).over(w)
    z = F.when(deviation > 1e-12, (F.col(intensity) - F.avg(intensity).over(w)) / deviation).otherwise(F.lit(0.0))
    return rows.withColumns({"f0": z, "f1": F.least(F.col(cameras), F.lit(10)) / 10, "f2": F.col(step) / max(length - 1, 1)})


def radius_labels(voxels: DataFrame, targets: DataFrame, radius: float, key: Sequence[str] = ("frame",), axes: Sequence[str] = ("x", "y", "z"), of: Sequence[str] = ("tx", "ty", "tz")) -> DataFrame:
    """``voxels`` with ``label`` 1 where a target of the same key is within ``radius``, else 0.

    Targets are filed under every grid cell of side ``radius`` that their ball may touch; a voxel looks into its own
    cell only, so the pairs are those of neighbouring cells.
    """
    cell = lambda c: F.floor(c / F.lit(float(radius))).cast("long")
    filed = targets
    for i, t in enumerate(of):
        filed = filed.withColumn(f"__c{i}", F.explode(F.sequence(cell(F.col(t)) - 1, cell(F.col(t)) + 1)))
    own = voxels.withColumns({f"__c{i}": cell(F.col(a)) for i, a in enumerate(axes)})
    d2 = sum(((F.col(a) - F.col(t)) * (F.col(a) - F.col(t)) for a, t in zip(axes, of, strict=True)), F.lit(0.0))
    near = own.join(filed, [*key, *(f"__c{i}" for i in range(len(axes)))]).filter(d2 <= radius * radius).select(*key, *axes).distinct()
    return voxels.join(near.withColumn("__hit", F.lit(1)), [*key, *axes], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, rows, and the weight of positives (negatives for each positive)."""
    return rows.agg(F.sum(label).cast("long").alias("positives"), F.count(F.lit(1)).alias("n")).withColumn("pos_weight", (F.col("n") - F.col("positives")) / F.greatest(F.col("positives"), F.lit(1)))


def recall(rows: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """One row: predicted positives among the positives."""
    return rows.agg((F.sum(F.col(predicted) * F.col(label)) / F.greatest(F.sum(label), F.lit(1))).alias("recall"))
