"""Aggregation of rows into voxels, and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.offsets import Kernel, corners, per_axis
from voxloom.model import Points, Voxels

from . import coords
from .conv import filled, gathered, reaches
from .coords import quantise, scattered

QUANTISE = ("none", "first", "sum", "average", "max")


def _aggregate(mode: str, feat: str, row_id: str | None) -> Column:
    if mode == "first":
        if row_id is None:
            raise ValueError("the first row needs a row id")
        return F.min_by(feat, row_id).alias(feat)
    named = {"sum": F.sum, "average": F.avg, "max": F.max}
    if mode not in named:
        raise ValueError(f"no mode {mode!r}; there are {', '.join(QUANTISE)}")
    return named[mode](feat).alias(feat)


def voxelise(df: DataFrame, axes: Sequence[str], feats: Sequence[str], mode: str = "average", row_id: str | None = None, batch: str = "b", stride: int | Sequence[int] = 1, origin: str = "input") -> Voxels:
    """Voxels of rows with integer coordinates; rows of the same voxel become one by ``mode``.

    ``none`` leaves all rows, ``first`` takes the row with the smallest id, the others aggregate each channel.
    """
    steps = per_axis(stride, len(axes), "stride")
    if mode != "none":
        df = df.groupBy(batch, *axes).agg(*(_aggregate(mode, f, row_id) for f in feats))
    return Voxels(df.select(batch, *axes, *feats), tuple(axes), tuple(feats), steps, origin, batch)


def sparse(p: Points, stride: int | Sequence[int] = 1, mode: str = "average", origin: str = "field") -> Voxels:
    """Voxels of continuous points on a grid of spacing ``stride``."""
    steps = per_axis(stride, len(p.axes), "stride")
    return voxelise(quantise(p, list(steps)), p.axes, p.feats, mode, p.pid, p.batch, steps, origin)


def _corners(p: Points, stride: Sequence[int], nowhere: bool = False) -> DataFrame:
    """Each point once for every corner of its cell, with the multilinear weight ``w``; weights of 0 go.

    Points without a place go too, unless ``nowhere``.
    """
    cells = F.array(*(F.struct(*(F.lit(v).alias(f"o{a}") for a, v in enumerate(off))) for off in corners(len(p.axes))))
    out = p.df.withColumn("__c", F.explode(cells))
    weight, moved = F.lit(1.0), {}
    for i, (a, s) in enumerate(zip(p.axes, stride, strict=True)):
        corner = ((F.floor(F.col(a) / F.lit(s)) + F.col(f"__c.o{i}")) * F.lit(s)).cast("long")
        weight = weight * (F.lit(1.0) - F.abs(F.col(a) - corner) / F.lit(float(s)))
        moved[a] = corner
    out = out.withColumn("w", weight).filter("w > 0 or w is null" if nowhere else "w > 0").withColumns(moved)
    return out.withColumn(p.batch, F.round(F.col(p.batch)).cast("int")).drop("__c")


def splat(p: Points, stride: int | Sequence[int] = 1) -> Voxels:
    """Spreads each point over the corners of its cell by multilinear weights, and sums."""
    steps = per_axis(stride, len(p.axes), "stride")
    sums = _corners(p, steps).groupBy(*p.keys).agg(*(F.sum(F.col(f) * F.col("w")).alias(f) for f in p.feats))
    return Voxels(sums, p.axes, p.feats, steps, "splat", p.batch)


def interpolate(v: Voxels, queries: Points) -> DataFrame:
    """(pid, features): multilinear interpolation at the queries; corners that ``v`` lacks count as 0."""
    weighted = _corners(Points(queries.df.select(queries.pid, *queries.keys), queries.axes, (), queries.batch, queries.pid), v.stride, nowhere=True)
    # every query has a corner, so no join back to the queries is needed
    values = [F.coalesce(F.sum(F.col(f) * F.col("w")), F.lit(0.0)).alias(f) for f in v.feats]
    return weighted.join(v.df, v.keys, "left").groupBy(queries.pid).agg(*values)


def interpolation_map(v: Voxels, queries: Points) -> DataFrame:
    """(pid, keys, w): which rows interpolate() reads, and their weights."""
    return _corners(queries, v.stride).select(queries.pid, *v.keys, "w").join(v.coords(), v.keys)


def interpolate_backward(v: Voxels, grad: Points) -> Voxels:
    """The gradient of interpolate() for ``v``: each query's gradient (the features of ``grad``) by the corners' weights.

    Corners that ``v`` lacks get nothing; rows that no query reads have 0.
    """
    sums = _corners(grad, v.stride).groupBy(*v.keys).agg(*(F.sum(F.col(f) * F.col("w")).alias(f) for f in grad.feats))
    return v.with_df(filled(v, sums, grad.feats), grad.feats)


def slice_back(p: Points, v: Voxels) -> DataFrame:
    """(pid, features of the voxel that holds the point)."""
    return coords.field_map(p, v).join(v.df, v.keys).select(p.pid, *v.feats)


# -- local pooling


def pool(v: Voxels, kernel: Kernel, stride: int | Sequence[int] = 1, mode: str = "sum", out: Voxels | None = None) -> Voxels:
    """Sum, average (over the cells that are occupied) or max over each output's kernel; 0 where no cell is.

    Where the kernel is a box as large as the stride, boxes tile the grid: then the output's coordinate is computed
    and one grouped aggregate does all, without taps or join.
    """
    step = per_axis(stride, v.dim, "stride")
    aggregate = {"sum": F.sum, "average": F.avg, "max": F.max}[mode]
    if out is None and kernel.shape == "cube" and set(per_axis(kernel.dilation, v.dim)) == {1} and per_axis(kernel.size, v.dim) == step and set(step) != {1}:
        keys, new = coords.strided_keys(v, step)
        df = v.df.select(*keys, *v.feats).groupBy(*v.keys).agg(*(aggregate(f).alias(f) for f in v.feats))
        return v.with_df(df, stride=new, origin=f"{v.origin}/stride{new}")
    reached = out is None and reaches(kernel, v.dim, step)
    out = out or (v if set(step) == {1} else coords.stride(v, step))
    df = gathered(v, kernel, out, False, lambda k: [aggregate(f).alias(f) for f in v.feats], v.feats, reached)
    return v.with_df(df, stride=out.stride, origin=out.origin)


def max_pool_with_source(v: Voxels, kernel: Kernel, stride: int | Sequence[int] = 1) -> DataFrame:
    """Max pooling of the first channel and the coordinates (``in_<axis>``) it came from; of equals the smallest.

    An output that nothing reaches has 0 and no source.
    """
    step = per_axis(stride, v.dim, "stride")
    out = v if set(step) == {1} else coords.stride(v, step)
    kept = v.with_df(v.df.withColumns({f"__in_{a}": F.col(a) for a in v.axes}))
    f = v.feats[0]
    best = F.max(F.struct(F.col(f), F.struct(*((-F.col(f"__in_{a}")).alias(a) for a in v.axes)).alias("place"))).alias("best")
    df = gathered(kept, kernel, out, False, lambda k: [best], (), reaches(kernel, v.dim, step))
    value = F.when(F.col("best").isNull(), F.lit(0)).otherwise(F.col(f"best.{f}"))
    return df.select(*v.keys, value.alias(f), *((-F.col(f"best.place.{a}")).alias(f"in_{a}") for a in v.axes))


def pool_transpose(v: Voxels, kernel: Kernel, out: Voxels) -> Voxels:
    """Unpooling: each coordinate of the finer ``out`` sums the rows whose kernel covers it; 0 where none does."""
    df = gathered(v, kernel, out, True, lambda k: [F.sum(f).alias(f) for f in v.feats], v.feats)
    return v.with_df(df, stride=out.stride, origin=out.origin)


def pool_backward(v: Voxels, grad: Voxels, kernel: Kernel, mode: str = "sum") -> Voxels:
    """The gradient of pool() for its input, 0 for rows that no output reads.

    For ``max`` it goes to the row that max_pool_with_source() names.
    """
    if mode == "max":
        step = [g // s for g, s in zip(grad.stride, v.stride, strict=True)]
        won = max_pool_with_source(v.with_df(v.df, v.feats[:1]), kernel, step).drop(v.feats[0]).filter(F.col(f"in_{v.axes[0]}").isNotNull())
        sent = won.join(grad.df, v.keys).select(v.batch, *(F.col(f"in_{a}").alias(a) for a in v.axes), *grad.feats)
        return v.with_df(filled(v, sent.groupBy(*v.keys).agg(*(F.sum(f).alias(f) for f in grad.feats)), grad.feats), grad.feats)
    if mode == "average":
        counts = gathered(v, kernel, grad, False, lambda k: [F.count(F.lit(1)).alias("__n")], ("__n",)).filter("__n > 0")
        shared = grad.df.join(counts, v.keys).select(*v.keys, *((F.col(f) / F.col("__n")).alias(f) for f in grad.feats))
        grad = grad.with_df(shared)
    moved = scattered(grad.df, v.axes, kernel.taps(v.dim), v.stride, 1, v.stride)
    sums = moved.groupBy(*v.keys).agg(*(F.sum(f).alias(f) for f in grad.feats))
    return v.with_df(filled(v, sums, grad.feats), grad.feats)


# -- global pooling


def global_pool(v: Voxels, mode: str = "average") -> DataFrame:
    """One row for each batch."""
    aggregate = {"sum": F.sum, "average": F.avg, "max": F.max}[mode]
    return v.df.groupBy(v.batch).agg(*(aggregate(f).alias(f) for f in v.feats))


def direct_max_pool(features: DataFrame, pairs: DataFrame, feats: Sequence[str], in_id: str = "in_id", out_id: str = "out_id", from_zero: bool = True) -> DataFrame:
    """Max by an explicit map of pairs; ``from_zero`` starts each maximum at 0, so none is negative."""
    best = [F.max(f).alias(f) for f in feats]
    out = pairs.join(features, in_id).groupBy(out_id).agg(*best)
    return out.select(out_id, *(F.greatest(F.col(f), F.lit(0)).alias(f) for f in feats)) if from_zero else out
