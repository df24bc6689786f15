"""Normalisation of channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.model import Voxels


def _moments(v: Voxels, keys: list[str]) -> DataFrame:
    aggs = [a for i, f in enumerate(v.feats) for a in (F.avg(f).alias(f"__m{i}"), F.var_pop(f).alias(f"__v{i}"))]
    return v.df.groupBy(*keys).agg(*aggs) if keys else v.df.agg(*aggs)


def _scaled(v: Voxels, df: DataFrame, eps: float, weight: Sequence[float] | None, bias: Sequence[float] | None) -> Voxels:
    cols = []
    for i, f in enumerate(v.feats):
        c = (F.col(f) - F.col(f"__m{i}")) / F.sqrt(F.col(f"__v{i}") + F.lit(eps))
        c = c * F.lit(float(weight[i])) if weight is not None else c
        cols.append((c + F.lit(float(bias[i])) if bias is not None else c).alias(f))
    return v.with_df(df.select(*v.keys, *cols))


def batch_norm(v: Voxels, weight: Sequence[float] | None = None, bias: Sequence[float] | None = None, eps: float = 1e-5, running: tuple[Sequence[float], Sequence[float]] | None = None) -> Voxels:
    """Each channel to mean 0 and variance 1 over all rows, or by the ``running`` mean and variance."""
    if running is not None:
        consts = {f"__{k}{i}": F.lit(float(x)) for k, values in zip("mv", running, strict=True) for i, x in enumerate(values)}
        return _scaled(v, v.df.withColumns(consts), eps, weight, bias)
    one = _moments(v, [])
    return _scaled(v, v.df.join(F.broadcast(one)), eps, weight, bias)  # one row, whatever the input


#: Statistics are over all partitions anyway.
sync_batch_norm = batch_norm


def running_moments(v: Voxels, mean: Sequence[float], var: Sequence[float], momentum: float = 0.1) -> tuple[list[float], list[float]]:
    """Running mean and (unbiased) variance after one more batch."""
    n = F.count(F.lit(1))
    row = v.df.agg(n.alias("n"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(v.feats)), *(F.var_pop(f).alias(f"v{i}") for i, f in enumerate(v.feats))).first()
    if not row.n:
        return list(mean), list(var)
    grow = row.n / max(row.n - 1, 1)
    return (
        [(1 - momentum) * m + momentum * row[f"m{i}"] for i, m in enumerate(mean)],
        [(1 - momentum) * s + momentum * row[f"v{i}"] * grow for i, s in enumerate(var)],
    )


def instance_norm(v: Voxels, weight: Sequence[float] | None = None, bias: Sequence[float] | None = None, eps: float = 1e-8) -> Voxels:
    """Each channel to mean 0 and variance 1 within its batch."""
    return _scaled(v, v.df.join(_moments(v, [v.batch]), v.batch), eps, weight, bias)


def stable_instance_norm(v: Voxels, weight: Sequence[float] | None = None, bias: Sequence[float] | None = None, eps: float = 1e-6) -> Voxels:
    return instance_norm(v, weight, bias, eps)


def instance_norm_backward(v: Voxels, grad: Voxels, eps: float = 1e-8) -> Voxels:
    """The gradient of instance_norm() without weights: (g - mean(g) - y * mean(g * y)) / deviation, by batch."""
    other = grad.df.select(*grad.keys, *(F.col(f).alias(f"__g{i}") for i, f in enumerate(grad.feats)))
    joined = v.df.join(_moments(v, [v.batch]), v.batch).join(other, v.keys)
    ys = {f"__y{i}": (F.col(f) - F.col(f"__m{i}")) / F.sqrt(F.col(f"__v{i}") + F.lit(eps)) for i, f in enumerate(v.feats)}
    joined = joined.withColumns(ys)
    aggs = [a for i in range(len(v.feats)) for a in (F.avg(f"__g{i}").alias(f"__a{i}"), F.avg(F.col(f"__g{i}") * F.col(f"__y{i}")).alias(f"__c{i}"))]
    full = joined.join(joined.groupBy(v.batch).agg(*aggs), v.batch)
    cols = [((F.col(f"__g{i}") - F.col(f"__a{i}") - F.col(f"__y{i}") * F.col(f"__c{i}")) / F.sqrt(F.col(f"__v{i}") + F.lit(eps))).alias(f) for i, f in enumerate(v.feats)]
    return v.with_df(full.select(*v.keys, *cols))


def normalise_rows(v: Voxels, p: float = 2.0, eps: float = 1e-12) -> Voxels:
    """Each row divided by its Lp norm, or by ``eps`` if that is larger."""
    norm = sum((F.pow(F.abs(F.col(f)), F.lit(p)) for f in v.feats), F.lit(0.0))
    norm = F.greatest(F.pow(norm, F.lit(1 / p)), F.lit(eps))
    return v.map(lambda c: c / norm)
