"""JSON frames of voxels with targets, and the JSON form of octree leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.model import Leaves
from voxloom.operators.octree import bounds

_SCHEMA = "grid_info struct<origin_m: array<double>, voxel_size_m: double>, voxels array<struct<coordinates: array<int>, intensity: double, num_cameras: int>>, targets array<struct<position_m: array<double>>>"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: frame (the first number in its name), origin, voxel size, voxels and targets."""
    df = spark.read.schema(_SCHEMA).option("multiLine", True).json(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)", 1)
    return df.select(number.try_cast("long").alias("frame"), "grid_info", "voxels", "targets")


def voxels_of(frames: DataFrame) -> DataFrame:
    """(frame, x, y, z, intensity, cameras)."""
    v = frames.select("frame", F.explode("voxels").alias("v"))
    return v.select("frame", *(F.col("v.coordinates")[i].cast("long").alias(a) for i, a in enumerate("xyz")), F.col("v.intensity").alias("intensity"), F.col("v.num_cameras").alias("cameras"))


def targets_of(frames: DataFrame) -> DataFrame:
    """(frame, tx, ty, tz): targets in units of voxels."""
    t = frames.select("frame", "grid_info", F.explode("targets").alias("t"))
    return t.select("frame", *(((F.col("t.position_m")[i] - F.col("grid_info.origin_m")[i]) / F.col("grid_info.voxel_size_m")).alias(f"t{a}") for i, a in enumerate("xyz")))


def leaves_json(x: Leaves) -> DataFrame:
    """(value): a JSON text for each leaf with its cell, level, bounds, centre, size and whether it is occupied."""
    size = x.config.size(F.col(x.level))
    boxes = [bounds(x, i) for i in range(x.config.dim)]
    row = F.struct(
        F.array(*(F.col(a) for a in x.axes)).alias("coordinates"),
        F.col(x.level).alias("level"),
        F.array(*(lo for lo, _ in boxes)).alias("min"),
        F.array(*(hi for _, hi in boxes)).alias("max"),
        F.array(*(lo + size / 2 for lo, _ in boxes)).alias("center"),
        size.alias("size"),
        (F.col(x.feats[0]) > 0).alias("occupied"),
    )
    return x.df.select(F.to_json(row).alias("value"))
