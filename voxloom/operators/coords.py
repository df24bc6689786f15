"""Operators on sets of coordinates: de-duplication, striding, neighbour maps, collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.functions.offsets import Kernel, Offset, per_axis
from voxloom.model import AXES, Points, Voxels


def snapped(c: Column, step: int) -> Column:
    """``c`` rounded down to a multiple of ``step``, also below zero."""
    return c.cast("long") if step == 1 else ((c - F.pmod(c, F.lit(step))).cast("long"))


def taps_column(taps: Sequence[Offset]) -> Column:
    """The slots of a kernel as an array literal of (k, o0, o1, ...); explode it, never join it."""
    return F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(v).cast("long").alias(f"o{a}") for a, v in enumerate(off))) for k, off in enumerate(taps)))


def scattered(df: DataFrame, axes: Sequence[str], taps: Sequence[Offset], step: Sequence[int], sign: int, align: Sequence[int] | None = None) -> DataFrame:
    """Each row once for every slot, moved by ``sign`` times the slot's offset in units of ``step``.

    The column ``k`` has the slot. With ``align`` rows that miss the grid of that spacing go before they are
    shuffled. A kernel of one slot needs no explode.
    """
    rest = [c for c in df.columns if c not in axes]
    if len(taps) == 1:
        moved = [(F.col(a) + F.lit(sign * o * s)).cast("long").alias(a) for a, o, s in zip(axes, taps[0], step, strict=True)]
        out = df.select(*rest, *moved, F.lit(0).alias("k"))
    else:
        tapped = df.withColumn("__tap", F.explode(taps_column(taps)))
        moved = [(F.col(a) + F.col(f"__tap.o{i}") * F.lit(sign * s)).alias(a) for i, (a, s) in enumerate(zip(axes, step, strict=True))]
        out = tapped.select(*rest, *moved, F.col("__tap.k").alias("k"))
    if align:
        for a, s in zip(axes, align, strict=True):
            if s > 1:
                out = out.filter(F.pmod(F.col(a), F.lit(s)) == 0)
    return out


# -- sets of coordinates


def unique_map(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """(keys, unique_index): the first row of each coordinate."""
    return df.groupBy(*keys).agg(F.min(row_id).alias("unique_index"))


def inverse_map(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """(row_id, unique_index): the first row that has the same coordinate."""
    return df.select(row_id, *keys).join(unique_map(df, keys, row_id), list(keys)).select(row_id, "unique_index")


def find(v: Voxels, queries: DataFrame) -> DataFrame:
    """The queries whose coordinate ``v`` has, with the features found there."""
    return queries.join(v.df, v.keys)


def strided_keys(v: Voxels, step: int | Sequence[int]) -> tuple[list[Column], tuple[int, ...]]:
    new = tuple(s * t for s, t in zip(v.stride, per_axis(step, v.dim, "stride"), strict=True))
    return [F.col(v.batch), *(snapped(F.col(a), s).alias(a) for a, s in zip(v.axes, new, strict=True))], new


def stride(v: Voxels, step: int | Sequence[int]) -> Voxels:
    """The set of coordinates on the coarser grid."""
    keys, new = strided_keys(v, step)
    return Voxels(v.df.select(*keys).distinct(), v.axes, (), new, f"{v.origin}/stride{new}", v.batch)


def stride_map(v: Voxels, step: int | Sequence[int]) -> DataFrame:
    """(keys, out_<axis>): the coarse coordinate of each row. The key is computed, so nothing is joined."""
    keys, _ = strided_keys(v, step)
    return v.df.select(*v.keys, *(k.alias(f"out_{a}") for k, a in zip(keys[1:], v.axes, strict=True)))


def stride_region(v: Voxels, kernel: Kernel, step: int | Sequence[int] = 1, transposed: bool = False) -> Voxels:
    """All coordinates that the kernel reaches from ``v``; unless transposed, those on the coarser grid."""
    step = per_axis(step, v.dim, "stride")
    if transposed:
        if any(s % t for s, t in zip(v.stride, step, strict=True)):
            raise ValueError("the stride of a transposed kernel must divide the tensor's")
        new = tuple(s // t for s, t in zip(v.stride, step, strict=True))
    else:
        new = tuple(s * t for s, t in zip(v.stride, step, strict=True))
    unit = new if transposed else v.stride
    reached = scattered(v.coords(), v.axes, kernel.taps(v.dim), unit, 1, None if transposed else new)
    return Voxels(reached.select(*v.keys).distinct(), v.axes, (), new, f"{v.origin}/region{new}", v.batch)


def origin(v: Voxels | Points) -> DataFrame:
    """One row for each batch, all axes 0."""
    return v.df.select(v.batch).distinct().select(v.batch, *(F.lit(0).cast("long").alias(a) for a in v.axes))


def origin_map(v: Voxels) -> DataFrame:
    """(keys, out_<batch>): the batch row of each row."""
    return v.df.select(*v.keys, F.col(v.batch).alias(f"out_{v.batch}"))


def prune(v: Voxels, mask: Column | DataFrame) -> Voxels:
    """Rows for which ``mask`` holds: an expression, or a table of the coordinates that stay."""
    kept = v.df.filter(mask) if isinstance(mask, Column) else v.df.join(mask.select(*v.keys), v.keys, "left_semi")
    return v.with_df(kept, origin=f"{v.origin}/pruned")


def prune_backward(v: Voxels, grad: Voxels) -> Voxels:
    """The gradient of prune() for its input: that of the rows that stayed, 0 for those that went."""
    mine = grad.df.select(*v.keys, *grad.feats, F.lit(True).alias("__kept"))
    df = v.coords().join(mine, v.keys, "left").select(*v.keys, *(F.when(F.col("__kept"), F.col(f)).otherwise(F.lit(0)).alias(f) for f in grad.feats))
    return v.with_df(df, grad.feats)


def merge(*parts: Voxels) -> Voxels:
    """The union of sets of coordinates; the spacing is the least by axis."""
    first = parts[0]
    df = first.coords()
    for p in parts[1:]:
        df = df.unionByName(p.coords())
    return Voxels(df.distinct(), first.axes, (), tuple(map(min, zip(*(p.stride for p in parts), strict=True))), "+".join(p.origin for p in parts), first.batch)


def union_map(*parts: Voxels) -> DataFrame:
    """(part, keys): which parts hold each coordinate of the union."""
    out = None
    for i, p in enumerate(parts):
        rows = p.coords().withColumn("part", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- neighbour maps


def kernel_map(v: Voxels, kernel: Kernel, out: Voxels | None = None, transposed: bool = False) -> DataFrame:
    """(k, out keys, in_<axis>): pairs of rows that a kernel slot relates.

    Slot k of an output reads the input at ``out + offset * v.stride``; transposed, the output lies at ``in +
    offset * out.stride``. Inputs are exploded over the slots and meet the outputs by an equi-join.
    """
    out = out or v
    source = v.df.select(*v.keys, *(F.col(a).alias(f"in_{a}") for a in v.axes))
    unit, sign = (out.stride, 1) if transposed else (v.stride, -1)
    moved = scattered(source, v.axes, kernel.taps(v.dim), unit, sign, out.stride)
    return moved.join(out.coords(), v.keys).select("k", *v.keys, *(f"in_{a}" for a in v.axes))


# -- continuous points


def quantise(p: Points, step: int | float | Sequence[float]) -> DataFrame:
    """The points with their voxel's coordinates in place of their own: round(batch), floor(place / step) * step."""
    steps = [step] * len(p.axes) if isinstance(step, (int, float)) else list(step)
    cell = lambda a, s: (F.floor(F.col(a) / F.lit(s)) * F.lit(s)).cast("long")
    rest = [c for c in p.df.columns if c not in (p.batch, *p.axes)]
    return p.df.select(F.round(F.col(p.batch)).cast("int").alias(p.batch), *(cell(a, s).alias(a) for a, s in zip(p.axes, steps, strict=True)), *rest)


def field_map(p: Points, v: Voxels) -> DataFrame:
    """(pid, keys): the voxel of ``v`` that holds each point; points outside all voxels go."""
    return quantise(p, list(v.stride)).select(p.pid, *p.keys).join(v.coords(), v.keys).select(p.pid, *v.keys)


def sparse_quantise(df: DataFrame, axes: Sequence[str], size: float, feats: Sequence[str] = (), label: str | None = None, row_id: str = "pid", batch: str | None = None, ignore_label: int = -100) -> DataFrame:
    """One row for each occupied cell of ``size``: features of the first point, and the label if all points agree.

    Returns the cell, ``unique_index`` (the first point), the features and the label (``ignore_label`` on conflict).
    """
    keys = ([batch] if batch else []) + list(axes)
    cells = df.withColumns({a: F.floor(F.col(a) / F.lit(size)).cast("long") for a in axes})
    aggs = [F.min(row_id).alias("unique_index"), *(F.min_by(f, row_id).alias(f) for f in feats)]
    if label:
        aggs.append(F.when(F.min(label) == F.max(label), F.min(label)).otherwise(F.lit(ignore_label)).cast("int").alias(label))
    return cells.groupBy(*keys).agg(*aggs)


# -- batches


def batched(samples: Sequence[DataFrame], axes: Sequence[str] = AXES[:3], batch: str = "b", floor: bool = True) -> DataFrame:
    """Samples one below the other, with the sample's number as the batch."""
    out = None
    for i, s in enumerate(samples):
        place = [(F.floor(F.col(a)).cast("long") if floor else F.col(a).cast("double")).alias(a) for a in axes]
        rows = s.select(F.lit(i).cast("int").alias(batch), *place, *(c for c in s.columns if c not in axes))
        out = rows if out is None else out.unionByName(rows)
    return out


def limit_points(samples: DataFrame, sample: str, limit: int, batch: str = "b") -> DataFrame:
    """Whole samples in order, up to the first whose points would take the sum over ``limit``."""
    sizes = samples.groupBy(sample).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy(sample)
    kept = sizes.withColumn("sum", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn(batch, (F.row_number().over(ordered) - 1).cast("int")).filter(F.col("sum") <= limit)
    return samples.join(kept.select(sample, batch), sample)


def decomposed(v: Voxels, i: int) -> Voxels:
    """The rows of one batch; none if the batch is empty."""
    return v.with_df(v.df.filter(F.col(v.batch) == i), origin=f"{v.origin}/batch{i}")


def decomposed_sizes(v: Voxels) -> DataFrame:
    """(batch, n) for every batch from 0 to the last, empty ones too."""
    last = v.df.agg(F.max(v.batch).alias("last"))
    every = last.filter("last is not null").select(F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias(v.batch))
    sizes = v.df.groupBy(F.col(v.batch).cast("int").alias(v.batch)).agg(F.count(F.lit(1)).alias("n"))
    return every.join(sizes, v.batch, "left").select(v.batch, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
