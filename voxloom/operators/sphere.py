"""Octree approximation of a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.offsets import corners
from voxloom.model import Leaves, OctreeConfig

from .octree import volume

XYZ = ("x", "y", "z")
_COLUMNS = 8  # midpoints along x and along y in the quadrature of a cell


class _Ball:
    """Expressions for cells (level, x, y, z) of the cube around a ball of radius r whose corner is the origin."""

    def __init__(self, r: float):
        self.r, self.exact = r, 4 / 3 * math.pi * r**3
        self.size = F.lit(2 * r) / F.pow(F.lit(2.0), F.col("level"))

    def _sum(self, each) -> Column:
        return sum((each(F.col(a) * self.size - self.r) for a in XYZ), F.lit(0.0))

    def boundary(self) -> Column:
        """Neither all inside nor all outside."""
        nearest = self._sum(lambda lo: F.pow(F.greatest(lo, -(lo + self.size), F.lit(0.0)), F.lit(2)))
        farthest = self._sum(lambda lo: F.pow(F.greatest(F.abs(lo), F.abs(lo + self.size)), F.lit(2)))
        return (nearest < self.r**2) & (farthest > self.r**2)

    def occupied(self) -> Column:
        return self._sum(lambda lo: F.pow(lo + self.size / 2, F.lit(2))) <= self.r**2

    def contribution(self) -> Column:
        return F.when(self.occupied(), F.pow(self.size, F.lit(3))).otherwise(F.lit(0.0))

    def inside(self) -> Column:
        """The volume of the cell within the ball: exact along z, midpoints over x and y."""
        step = self.size / _COLUMNS
        z0 = F.col("z") * self.size - self.r
        places = F.sequence(F.lit(0), F.lit(_COLUMNS * _COLUMNS - 1))

        def column(acc: Column, k: Column) -> Column:
            dx = F.col("x") * self.size + (F.floor(k / _COLUMNS) + 0.5) * step - self.r
            dy = F.col("y") * self.size + (k % _COLUMNS + 0.5) * step - self.r
            h = F.sqrt(F.greatest(self.r**2 - dx * dx - dy * dy, F.lit(0.0)))
            return acc + F.greatest(F.least(z0 + self.size, h) - F.greatest(z0, -h), F.lit(0.0))

        return F.aggregate(places, F.lit(0.0), column) * step * step

    def wrong(self) -> Column:
        """The volume that the cell counts to the wrong side; 0 off the boundary."""
        inside = self.inside()
        return F.when(self.boundary(), F.when(self.occupied(), F.pow(self.size, F.lit(3)) - inside).otherwise(inside)).otherwise(F.lit(0.0))


def voxelise_sphere(spark: SparkSession, radius: float, target: float, center: tuple[float, float, float] = (0.0, 0.0, 0.0), max_voxels: int = 1 << 20, depth: int = 10, geometric: bool = False) -> tuple[Leaves, float]:
    """Leaves of the cube around a sphere that give its volume to ``target`` percent, and the percentage reached.

    Boundary cells are split level by level, within a level in the order in which they came to be, and the
    splitting stops at the first cell after which the accuracy suffices. A level's cells are all split at once; a
    running sum over them in order finds the stop, and later cells stay unsplit. A feature ``f`` is 1 where a
    leaf's centre is inside. Accuracy is that of the signed volume; with ``geometric`` also that of the volume on
    the wrong side, whichever is worse. Raises if the limits don't allow the target.
    """
    if not radius > 0 or not 0 < target <= 100 or max_voxels < 1 or not 0 <= depth <= 30:
        raise ValueError("radius, target, max_voxels or depth is out of range")
    ball = _Ball(radius)
    cells = spark.range(1).select(F.lit(0).cast("int").alias("level"), *(F.lit(0).cast("long").alias(a) for a in XYZ), F.lit("").alias("order"))

    def accuracy(vol: Column, wrong: Column) -> Column:
        signed = 100 * (1 - F.abs(vol - ball.exact) / ball.exact)
        return F.least(signed, 100 * (1 - wrong / ball.exact)) if geometric else signed

    zero = F.lit(0.0)
    weigh = lambda df: df.withColumns({"vol": ball.contribution(), "wrong": ball.wrong() if geometric else zero, "edge": ball.boundary()})
    cells = weigh(cells)
    done: DataFrame | None = None
    first = cells.select("vol", "wrong", accuracy(F.col("vol"), F.col("wrong")).alias("a")).first()
    vol, wrong, reached, count = first.vol, first.wrong, first.a, 1
    while reached < target:
        queue = cells.filter("edge")
        level = cells.agg(F.max("level")).first()[0]
        if level >= depth or not queue.limit(1).count():
            raise RuntimeError("the target accuracy is out of reach within the limits")
        kids = F.array(*(F.struct(*((F.col(a) * 2 + o).alias(a) for a, o in zip(XYZ, off, strict=True)), F.lit(str(c)).alias("c")) for c, off in enumerate(corners(3))))
        split = queue.select("order", F.col("vol").alias("__vol"), F.col("wrong").alias("__wrong"), (F.col("level") + 1).cast("int").alias("level"), F.explode(kids).alias("k"))
        split = weigh(split.select("level", *(F.col(f"k.{a}").alias(a) for a in XYZ), F.concat("order", F.col("k.c")).alias("child"), "order", "__vol", "__wrong"))
        gain = split.groupBy("order", "__vol", "__wrong").agg(F.sum("vol").alias("vol"), F.sum("wrong").alias("wrong"))
        ordered = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
        run = gain.select("order", (F.lit(vol) + F.sum(F.col("vol") - F.col("__vol")).over(ordered)).alias("vol"), (F.lit(wrong) + F.sum(F.col("wrong") - F.col("__wrong")).over(ordered)).alias("wrong"), F.count(F.lit(1)).over(ordered).alias("n"))
        run = run.withColumn("a", accuracy(F.col("vol"), F.col("wrong"))).cache()
        stop = run.filter(F.col("a") >= target).orderBy("order").limit(1).collect()
        last = stop[0] if stop else run.orderBy(F.desc("order")).first()
        if count + 7 * last.n > max_voxels:
            raise RuntimeError("the target accuracy is out of reach within the limits")
        run.unpersist()
        vol, wrong, reached, count = last.vol, last.wrong, last.a, count + 7 * last.n
        made = split.filter(F.col("order") <= last.order).select("level", *XYZ, F.col("child").alias("order"), "vol", "wrong", "edge")
        rest = cells.filter(~F.col("edge") | (F.col("order") > last.order))
        done = rest if done is None else done.unionByName(rest)
        cells = made.cache()
    df = cells if done is None else done.unionByName(cells)
    config = OctreeConfig(2 * radius, 2 * radius / 2**depth, depth, tuple(c - radius for c in center))
    leaves = df.select("level", *XYZ, F.when(ball.occupied(), 1.0).otherwise(0.0).alias("f"))
    return Leaves(leaves, config, XYZ, ("f",)), reached


def volume_estimate(x: Leaves) -> DataFrame:
    """One row: the volume of the occupied leaves."""
    return x.df.agg(F.coalesce(F.sum(F.when(F.col(x.feats[0]) > 0, volume(x))), F.lit(0.0)).alias("volume"))
