"""Convolution over octree leaves of mixed levels, and interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.offsets import corners, cube_first_axis_slowest
from voxloom.model import Leaves, Points

from .conv import contributions
from .coords import taps_column
from .octree import ancestors, bounds, cell_at, down, locate, present_levels, up

MODES = ("center", "volume", "overlap")


def strided(x: Leaves, shift: int) -> Leaves:
    """The leaves' ancestors ``shift`` levels above (level 0 at most), without those under another of them."""
    if shift < 0:
        raise ValueError("outputs can only be coarser")
    lift = F.least(F.col(x.level), F.lit(shift))
    keys = x.df.select((F.col(x.level) - lift).cast("int").alias(x.level), *(up(F.col(a), lift).alias(a) for a in x.axes)).distinct()
    out = Leaves(keys, x.config, x.axes, ())
    same = [F.col(k).alias(f"__{k}") for k in x.keys]
    under = ancestors(keys.select(*x.keys, *same), out).join(keys, x.keys, "left_semi").select(*(F.col(f"__{k}").alias(k) for k in x.keys)).distinct()
    return out.with_df(keys.join(under, x.keys, "left_anti"))


def _tapped(out: Leaves, size: int) -> DataFrame:
    """Output keys as ``out_<key>`` and, for each slot k, the cell of the same level that the tap covers.

    A tap lies a whole number of cells from its output, so what it covers is a cell of the output's own level.
    """
    taps = cube_first_axis_slowest(size, out.config.dim)
    df = out.df.select(*(F.col(k).alias(f"out_{k}") for k in out.keys), F.explode(taps_column(taps)).alias("__tap"))
    moved = [(F.col(f"out_{a}") + F.col(f"__tap.o{i}")).alias(a) for i, a in enumerate(out.axes)]
    return df.select(*(f"out_{k}" for k in out.keys), F.col("__tap.k").alias("k"), F.col(f"out_{out.level}").alias(out.level), *moved)


def kernel_map(x: Leaves, size: int = 3, mode: str = "center", out: Leaves | None = None) -> DataFrame:
    """(k, out_<keys>, in_<keys>, w): which leaves each tap of each output reads, and with what weight.

    ``center`` reads the leaf at the tap's centre with weight 1, ``volume`` the same with the ratio of volumes,
    ``overlap`` all leaves that the tap's cell meets with their share of its volume. Taps meet leaves that cover
    them through the ancestors of their cell, and finer leaves through the ancestors of those (overlap) or at the
    centre's cell of each level that occurs: equi-joins all.
    """
    if mode not in MODES:
        raise ValueError(f"the mode is one of {', '.join(MODES)}")
    out = out or x
    dim, level = x.config.dim, F.col(x.level)
    taps = _tapped(out, size)
    outs = [f"out_{k}" for k in out.keys]
    mine = [F.col(k).alias(f"in_{k}") for k in x.keys]
    leaves = x.df.select(*x.keys, *mine)
    covering = ancestors(taps, x, own=True).join(leaves, x.keys)
    ratio = F.pow(F.lit(2.0), (F.col(f"out_{x.level}") - F.col(f"in_{x.level}")) * dim)  # input volume over output volume
    one = F.lit(1.0)
    near = covering.select("k", *outs, *(f"in_{k}" for k in x.keys), (ratio if mode == "volume" else one).alias("w"))
    if mode == "overlap":
        finer = ancestors(x.df.select(*x.keys, *mine), x).join(taps, x.keys)
        return near.unionByName(finer.select("k", *outs, *(f"in_{k}" for k in x.keys), ratio.alias("w")))
    levels = [v for v in present_levels(x) if v > 0]
    if not levels:
        return near
    below = taps.withColumn("__l", F.explode(F.filter(F.array(*(F.lit(v).cast("int") for v in levels)), lambda v: v > level)))
    gap = F.col("__l") - level
    center = [down(F.col(a) * 2 + 1, gap - 1).alias(a) for a in x.axes]
    finer = below.select("k", *outs, F.col("__l").alias(x.level), *center).join(leaves, x.keys)
    return near.unionByName(finer.select("k", *outs, *(f"in_{k}" for k in x.keys), (ratio if mode == "volume" else one).alias("w")))


def _sums(pairs: DataFrame, source: Leaves, weights: np.ndarray, from_: str, to: str, keys: Sequence[str], bias: Sequence[float] | None) -> DataFrame:
    joined = pairs.select("k", "w", *(F.col(f"{from_}_{k}").alias(k) for k in keys), *(F.col(f"{to}_{k}").alias(f"__{k}") for k in keys)).join(source.df, list(keys))
    names = [f"f{i}" for i in range(weights.shape[2])]
    sums = [F.sum(F.col("w") * c).alias(n) for c, n in zip(contributions(source, weights, F.col("k")), names, strict=True)]
    out = joined.groupBy(*(f"__{k}" for k in keys)).agg(*sums)
    bias = [0.0] * len(names) if bias is None else bias
    return out.select(*(F.col(f"__{k}").alias(k) for k in keys), *((F.col(n) + F.lit(b)).alias(n) for n, b in zip(names, bias, strict=True)))


def _on(out: Leaves, sums: DataFrame, names: int, bias: Sequence[float] | None) -> Leaves:
    feats = [f"f{i}" for i in range(names)]
    bias = [0.0] * names if bias is None else bias
    df = out.df.select(*out.keys).join(sums, out.keys, "left")
    return out.with_df(df.select(*out.keys, *(F.coalesce(f, F.lit(float(b))).alias(f) for f, b in zip(feats, bias, strict=True))), feats)


def convolve(x: Leaves, weights: np.ndarray, size: int = 3, mode: str = "center", shift: int = 0, bias: Sequence[float] | None = None) -> Leaves:
    """Convolution over mixed levels; outputs are the leaves, or their ancestors ``shift`` levels above."""
    out = x if shift == 0 else strided(x, shift)
    pairs = kernel_map(x, size, mode, out)
    return _on(out, _sums(pairs, x, weights, "in", "out", x.keys, bias), weights.shape[2], bias)


def convolve_transpose(x: Leaves, weights: np.ndarray, reference: Leaves, size: int = 3, mode: str = "center", shift: int = 0, bias: Sequence[float] | None = None) -> Leaves:
    """The reverse of a convolution whose input had the leaves of ``reference`` and whose output had those of ``x``."""
    pairs = kernel_map(reference, size, mode, reference if shift == 0 else strided(reference, shift))
    return _on(reference, _sums(pairs, x, weights, "out", "in", x.keys, bias), weights.shape[2], bias)


def fallback(x: Leaves, missed: DataFrame, spots: Sequence[str]) -> DataFrame:
    """(spots, features): for places outside all leaves, the volume-weighted mean of the leaves in the finest cell around
    the place that holds a strictly finer leaf."""
    w = F.pow(F.lit(2.0), -F.col("__level") * x.config.dim)
    lifted = ancestors(x.df.withColumn("__level", F.col(x.level)), x)
    means = lifted.groupBy(*x.keys).agg(*((F.sum(F.col(f) * w) / F.sum(w)).alias(f) for f in x.feats))
    cells = missed.select(*spots, F.explode(F.sequence(F.lit(0), F.lit(x.config.depth))).alias(x.level))
    cells = cells.select(*spots, x.level, *(cell_at(x.config, i, F.col(s), F.col(x.level)).alias(a) for i, (a, s) in enumerate(zip(x.axes, spots, strict=True))))
    found = cells.join(means, x.keys)
    return found.groupBy(*spots).agg(*(F.max_by(f, x.level).alias(f) for f in x.feats))


def interpolate(x: Leaves, p: Points, mode: str = "nearest", coarser_ancestor: bool = False) -> DataFrame:
    """(pid, features) at points.

    ``nearest`` takes the containing leaf. ``multilinear`` lays a box of that leaf's size around the point and
    weighs the leaves that it meets by overlap. Points outside all leaves give 0, or fallback() does. Values are found
    once for each place, and points meet them by their place: ids may repeat or be null.
    """
    spots = [f"at__{i}" for i in range(len(p.axes))]
    points = p.df.select(p.pid, *(F.col(a).alias(s) for a, s in zip(p.axes, spots, strict=True)))
    places = points.select(*spots).distinct()
    at = locate(places, x, spots, present_levels(x))
    if mode == "nearest":
        keyed = at.select(*spots, *(F.col(f"leaf_{k}").alias(k) for k in x.keys))
        found = keyed.join(x.df, x.keys).select(*spots, *x.feats)
    elif mode == "multilinear":
        found = _multilinear(x, at, spots)
    else:
        raise ValueError("the mode is nearest or multilinear")
    if coarser_ancestor:
        missed = places.join(at.select(*spots), spots, "left_anti")
        found = found.unionByName(fallback(x, missed, spots))
    zeros = [F.coalesce(f, F.lit(0.0)).alias(f) for f in x.feats]
    return points.join(found, spots, "left").select(p.pid, *zeros)


def _multilinear(x: Leaves, at: DataFrame, spots: Sequence[str]) -> DataFrame:
    size = x.config.size(F.col(f"leaf_{x.level}"))
    box = at.select(*spots, F.col(f"leaf_{x.level}").alias(x.level), *(c for i, a in enumerate(spots) for c in ((F.col(a) - size / 2).alias(f"__lo{i}"), (F.col(a) + size / 2).alias(f"__hi{i}"))))
    # the box meets up to 2 cells of its own level along each axis
    off = F.explode(taps_column(corners(x.config.dim)))
    cells = box.withColumn("__c", off)
    cells = cells.select(*spots, x.level, *(c for c in box.columns if c.startswith("__")), *((cell_at(x.config, i, F.col(f"__lo{i}"), F.col(x.level)) + F.col(f"__c.o{i}")).alias(a) for i, a in enumerate(x.axes)))
    edges = [c for c in box.columns if c.startswith("__")]
    mine = x.df.select(*x.keys, *(F.col(k).alias(f"in_{k}") for k in x.keys), *x.feats)
    # leaves that cover a cell, once each; and finer leaves inside it
    covering = ancestors(cells, x, own=True).dropDuplicates([*spots, *x.keys]).join(mine, x.keys)
    finer = ancestors(mine, x).join(cells, x.keys)
    names = [*spots, *edges, *(f"in_{k}" for k in x.keys), *x.feats]
    hits = covering.select(*names).unionByName(finer.select(*names))
    leaf = Leaves(hits, x.config, tuple(f"in_{a}" for a in x.axes), x.feats, level=f"in_{x.level}")
    overlap = F.lit(1.0)
    for i in range(x.config.dim):
        lo, hi = bounds(leaf, i)
        own = F.least(F.col(f"__hi{i}"), hi) - F.greatest(F.col(f"__lo{i}"), lo)
        overlap = overlap * F.when(own > 1e-9 * (hi - lo), own).otherwise(F.lit(0.0))
    hits = hits.withColumn("__w", overlap).filter("__w > 0")
    return hits.groupBy(*spots).agg(*((F.sum(F.col(f) * F.col("__w")) / F.sum("__w")).alias(f) for f in x.feats))
