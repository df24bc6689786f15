"""Operations on several sets of voxels, and row-wise operations on one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.model import Voxels


def _zipped(a: Voxels, b: Voxels, fn) -> Voxels:
    """``fn`` of the channels of rows with the same coordinate; both must be on one coordinate set."""
    if a.origin != b.origin or a.stride != b.stride or len(a.feats) != len(b.feats):
        raise ValueError("element-wise operations need the same coordinates and channels; use union() for others")
    other = b.df.select(*b.keys, *(F.col(f).alias(f"__b{i}") for i, f in enumerate(b.feats)))
    cols = [fn(F.col(f), F.col(f"__b{i}")).alias(f) for i, f in enumerate(a.feats)]
    return a.with_df(a.df.join(other, a.keys).select(*a.keys, *cols))


def _shifted(v: Voxels, s: float, fn) -> Voxels:
    return v.map(lambda c: fn(c, F.lit(s)))


def add(a: Voxels, b: Voxels | float) -> Voxels:
    return _zipped(a, b, lambda x, y: x + y) if isinstance(b, Voxels) else _shifted(a, b, lambda x, y: x + y)


def subtract(a: Voxels, b: Voxels) -> Voxels:
    return _zipped(a, b, lambda x, y: x - y)


def multiply(a: Voxels, b: Voxels | float) -> Voxels:
    return _zipped(a, b, lambda x, y: x * y) if isinstance(b, Voxels) else _shifted(a, b, lambda x, y: x * y)


def divide(a: Voxels, b: Voxels) -> Voxels:
    """Quotients; null where the divisor is 0."""
    return _zipped(a, b, lambda x, y: x / F.nullif(y, F.lit(0)))


def cat(*parts: Voxels) -> Voxels:
    """The channels of all parts side by side."""
    first, df, names = parts[0], parts[0].df, list(parts[0].feats)
    for i, p in enumerate(parts[1:], 1):
        if p.origin != first.origin:
            raise ValueError("cat needs the same coordinates")
        own = [f"{f}_{i}" for f in p.feats]
        df = df.join(p.df.select(*p.keys, *(F.col(f).alias(n) for f, n in zip(p.feats, own, strict=True))), first.keys)
        names += own
    return first.with_df(df.select(*first.keys, *names), names)


def _stacked(parts: tuple[Voxels, ...]) -> DataFrame:
    first = parts[0]
    renamed = [p.df.select(*p.keys, *(F.col(f).alias(n) for f, n in zip(p.feats, first.feats, strict=True))) for p in parts]
    return reduce(DataFrame.unionByName, renamed)


def _grouped(parts: tuple[Voxels, ...], aggregate) -> Voxels:
    first = parts[0]
    if any(p.origin != first.origin for p in parts):
        raise ValueError("the parts must have the same coordinates; use union() for others")
    return first.with_df(_stacked(parts).groupBy(*first.keys).agg(*(aggregate(f).alias(f) for f in first.feats)))


def total(*parts: Voxels) -> Voxels:
    return _grouped(parts, F.sum)


def mean(*parts: Voxels) -> Voxels:
    return _grouped(parts, F.avg)


def variance(*parts: Voxels) -> Voxels:
    """Population variance over the parts."""
    return _grouped(parts, F.var_pop)


def union(*parts: Voxels) -> Voxels:
    """All coordinates of the parts; features of the same coordinate are summed. One shuffle, no join."""
    first = parts[0]
    df = _stacked(parts).groupBy(*first.keys).agg(*(F.sum(f).alias(f) for f in first.feats))
    return first.with_df(df, stride=tuple(map(min, zip(*(p.stride for p in parts), strict=True))), origin="+".join(p.origin for p in parts))


def select_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows that ``ids`` lists; as often as they are listed."""
    return ids.select(key).join(df, key).select(*df.columns)


def remove_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def append(*parts: DataFrame) -> DataFrame:
    """One table below the other; the columns must agree."""
    names = sorted(parts[0].columns)
    if any(sorted(p.columns) != names for p in parts[1:]):
        raise ValueError("the tables have different columns")
    return reduce(DataFrame.unionByName, parts)


# -- one row for each batch to all its rows


def _broadcast(v: Voxels, per_batch: DataFrame, cols) -> tuple[DataFrame, list[Column]]:
    """Rows with their batch's row beside them; Spark broadcasts the batches if they are few, else shuffles."""
    feats = [c for c in per_batch.columns if c != v.batch]
    side = per_batch.select(v.batch, *(F.col(f).alias(f"__g{i}") for i, f in enumerate(feats)))
    return v.df.join(side, v.batch), cols([F.col(f"__g{i}") for i in range(len(feats))])


def broadcast_add(v: Voxels, per_batch: DataFrame) -> Voxels:
    df, cols = _broadcast(v, per_batch, lambda g: [(F.col(f) + x).alias(f) for f, x in zip(v.feats, g, strict=True)])
    return v.with_df(df.select(*v.keys, *cols))


def broadcast_multiply(v: Voxels, per_batch: DataFrame) -> Voxels:
    df, cols = _broadcast(v, per_batch, lambda g: [(F.col(f) * x).alias(f) for f, x in zip(v.feats, g, strict=True)])
    return v.with_df(df.select(*v.keys, *cols))


def broadcast_copy(v: Voxels, per_batch: DataFrame) -> Voxels:
    df, cols = _broadcast(v, per_batch, lambda g: [x.alias(f"g{i}") for i, x in enumerate(g)])
    return v.with_df(df.select(*v.keys, *cols), [f"g{i}" for i in range(len(cols))])


def broadcast_cat(v: Voxels, per_batch: DataFrame) -> Voxels:
    df, cols = _broadcast(v, per_batch, lambda g: [x.alias(f"g{i}") for i, x in enumerate(g)])
    return v.with_df(df.select(*v.keys, *v.feats, *cols), [*v.feats, *(f"g{i}" for i in range(len(cols)))])


def broadcast_backward(v: Voxels, grad: Voxels, per_batch: DataFrame | None = None) -> DataFrame:
    """The gradient for the batch rows: sums of ``grad``, or of grad * features if the operation multiplied."""
    if per_batch is None:
        return grad.df.groupBy(grad.batch).agg(*(F.sum(f).alias(f) for f in grad.feats))
    product = multiply(grad, v.with_df(v.df, origin=grad.origin))
    return product.df.groupBy(v.batch).agg(*(F.sum(f).alias(f) for f in product.feats))
