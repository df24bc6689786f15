"""The driver's tables seen as points, voxels and splats; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.offsets import Offset
from voxloom.model import Points, Voxels
from voxloom.operators import pool

XYZ = ("x", "y", "z")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voxel cloud of line items: batch by line number, axes quantity, discount and tax, feature price in cents."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") - 1).cast("int").alias("b"),
        F.floor("l_quantity").cast("long").alias("x"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("y"),
        F.floor(F.col("l_tax") * 100 + 0.5).cast("long").alias("z"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("f"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * (1 << 24) + F.round(F.col("l_extendedprice") * 100).cast("long")).cast("long").alias("pid"),
        "l_returnflag",
        "l_linestatus",
    )


CELLS = """cells AS (SELECT CAST(l_linenumber - 1 AS INTEGER) AS b, CAST(floor(l_quantity) AS BIGINT) AS x,
  CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS y, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS z,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS f, CAST((l_orderkey * 8 + l_linenumber) * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS BIGINT) AS pid,
  l_returnflag, l_linestatus FROM lineitem)"""

#: Order lines can repeat; a point is a distinct one.
POINTS = CELLS + ", pts AS (SELECT DISTINCT pid, b, x, y, z, f FROM cells)"

VOX = CELLS + """, vox AS (SELECT b, x, y, z, CAST(sum(f) AS BIGINT) AS f FROM cells GROUP BY b, x, y, z)"""


def voxels(spark: SparkSession, sf_dir: str, where=None, origin: str = "input") -> Voxels:
    """cells(), summed by voxel."""
    df = cells(spark, sf_dir)
    return pool.voxelise(df if where is None else df.filter(where), XYZ, ["f"], "sum", origin=origin)


def points(spark: SparkSession, sf_dir: str) -> Points:
    """Line items as continuous points, half a cell off the grid on each axis."""
    df = cells(spark, sf_dir).select("pid", "b", *XYZ, "f").distinct()
    return Points(df.select("pid", "b", *((F.col(a) + 0.5).alias(a) for a in XYZ), F.col("f").cast("double").alias("f")), XYZ, ("f",))


def taps_sql(taps: list[Offset], unit: int = 1, name: str = "taps") -> str:
    """A CTE of kernel slots (k, ox, oy, oz, w) with the weight that queries use."""
    rows = ", ".join(f"({k}, {', '.join(str(o * unit) for o in off)}, {weight(k)})" for k, off in enumerate(taps))
    return f"{name}(k, ox, oy, oz, w) AS (VALUES {rows})"


def weight(k: int) -> int:
    """The weight of slot k in convolution queries."""
    return (k * 7) % 11 - 5
