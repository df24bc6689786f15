"""Sparse convolution and its relatives: scatter over kernel slots, one grouped sum, one join with the outputs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.offsets import Kernel, per_axis
from voxloom.model import Voxels

from . import coords
from .coords import scattered


def weight_of(values: Sequence[float], k: Column, integral: bool) -> Column:
    """The weight of slot ``k``: an array literal that is indexed, so no weight table is joined."""
    kind = "long" if integral else "double"
    if len(values) == 1:
        return F.lit(values[0]).cast(kind)
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), k + 1)


def contributions(v: Voxels, weights: np.ndarray, k: Column) -> list[Column]:
    """For each output channel the sum of weighted input channels of one row; weights are [slots, in, out]."""
    integral = np.issubdtype(weights.dtype, np.integer)
    if weights.shape[1] != len(v.feats):
        raise ValueError(f"the weights are for {weights.shape[1]} channels, not {len(v.feats)}")
    out = []
    for co in range(weights.shape[2]):
        terms = [F.col(f) * weight_of(weights[:, ci, co].tolist(), k, integral) for ci, f in enumerate(v.feats)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total)
    return out


def linear(v: Voxels, weight: np.ndarray, bias: Sequence[float] | None = None) -> Voxels:
    """f W + b for each row; ``weight`` is [in, out]."""
    cols = contributions(v, weight[None], F.lit(0))
    names = [f"f{i}" for i in range(weight.shape[1])]
    cols = [c + F.lit(b) for c, b in zip(cols, bias, strict=True)] if bias is not None else cols
    return v.with_df(v.df.select(*v.keys, *(c.alias(n) for c, n in zip(cols, names, strict=True))), names)


def reaches(kernel: Kernel, dim: int, step: Sequence[int]) -> bool:
    """Whether the kernel covers every place that ``step`` maps to an output, so that outputs from striding are all reached."""
    return set(product(*(range(s) for s in step))) <= set(kernel.taps(dim))


def gathered(v: Voxels, kernel: Kernel, out: Voxels, transposed: bool, aggregates, names: Sequence[str], reached: bool = False) -> DataFrame:
    """Aggregates of what reaches each coordinate of ``out``; of outputs that nothing reaches ``names`` are 0.

    Every input row is sent to all the outputs that its slots relate it to, those off the output's grid being dropped
    at once. Partial sums form before the only shuffle, which is by output coordinate; the output set then
    meets them on the same key. With ``reached``, all outputs are known to be reached.
    """
    unit, sign = (out.stride, 1) if transposed else (v.stride, -1)
    moved = scattered(v.df, v.axes, kernel.taps(v.dim), unit, sign, out.stride)
    sums = moved.groupBy(*v.keys).agg(*aggregates(F.col("k")))
    return sums.join(out.coords(), v.keys, "left_semi") if reached else filled(out, sums, names)


def filled(out: Voxels, sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """``sums`` for every coordinate of ``out``; ``names`` are 0 where there are none."""
    zero = lambda c: F.when(F.col("__hit").isNull(), F.lit(0)).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
    rest = [c for c in sums.columns if c not in out.keys]
    return out.coords().join(sums.withColumn("__hit", F.lit(True)), out.keys, "left").select(*out.keys, *map(zero, rest))


def _bias(df: DataFrame, keys: list[str], names: list[str], bias: Sequence[float] | None) -> DataFrame:
    return df if bias is None else df.select(*keys, *((F.col(n) + F.lit(b)).alias(n) for n, b in zip(names, bias, strict=True)))


def convolve(v: Voxels, weights: np.ndarray, kernel: Kernel, stride: int | Sequence[int] = 1, bias: Sequence[float] | None = None, expand: bool = False, out: Voxels | None = None) -> Voxels:
    """y at o = sum over slots of x at (o + offset * stride of v) times the slot's weights.

    Outputs are the strided coordinates; with ``expand`` all that the kernel reaches; or those of ``out``. An output that no
    input reaches is 0, and has the bias. A kernel of one cell and stride 1 is a linear map without shuffle.
    """
    step = per_axis(stride, v.dim, "stride")
    if kernel.volume(v.dim) == 1 and set(step) == {1} and not any(kernel.taps(v.dim)[0]) and out is None:
        return linear(v, weights[0], bias)
    reached = out is None and (expand or reaches(kernel, v.dim, step))
    if out is None:
        out = coords.stride_region(v, kernel, step) if expand else v if set(step) == {1} else coords.stride(v, step)
    return _apply(v, weights, kernel, out, False, bias, reached)


def convolve_transpose(v: Voxels, weights: np.ndarray, kernel: Kernel, stride: int | Sequence[int] = 1, bias: Sequence[float] | None = None, out: Voxels | None = None) -> Voxels:
    """y at (i + offset * finer stride) sums x at i; onto ``out``, or onto new coordinates (generative)."""
    reached = out is None
    if out is None:
        out = coords.stride_region(v, kernel, stride, transposed=True)
    return _apply(v, weights, kernel, out, True, bias, reached)


def _apply(v: Voxels, weights: np.ndarray, kernel: Kernel, out: Voxels, transposed: bool, bias: Sequence[float] | None, reached: bool) -> Voxels:
    if weights.shape[0] != kernel.volume(v.dim):
        raise ValueError(f"the kernel has {kernel.volume(v.dim)} slots, the weights {weights.shape[0]}")
    names = [f"f{i}" for i in range(weights.shape[2])]
    sums = gathered(v, kernel, out, transposed, lambda k: [F.sum(c).alias(n) for c, n in zip(contributions(v, weights, k), names, strict=True)], names, reached)
    return Voxels(_bias(sums, v.keys, names, bias), v.axes, tuple(names), out.stride, out.origin, v.batch)


def convolve_backward(v: Voxels, grad: Voxels, weights: np.ndarray, kernel: Kernel, transposed: bool = False) -> tuple[Voxels, DataFrame]:
    """Gradients of a convolution for its input and its weights.

    The input's gradient is the transposed convolution of ``grad`` with the weights of each slot transposed; rows that reach no
    output have 0. The
    weights' is a table (k, ci, co, value): sums of products over all pairs of the kernel map.
    """
    flipped = np.ascontiguousarray(weights.transpose(0, 2, 1))
    unit, sign = (v.stride, 1) if not transposed else (grad.stride, -1)
    moved = scattered(grad.df, grad.axes, kernel.taps(v.dim), unit, sign, v.stride)
    names = list(v.feats)
    sums = moved.groupBy(*v.keys).agg(*(F.sum(c).alias(n) for c, n in zip(contributions(grad, flipped, F.col("k")), names, strict=True)))
    gx = v.with_df(filled(v, sums, names))

    mine = v.df.select(*v.keys, *(F.col(f).alias(f"__x{i}") for i, f in enumerate(v.feats)))
    theirs = moved.select(*v.keys, "k", *(F.col(f).alias(f"__g{i}") for i, f in enumerate(grad.feats)))
    products = [F.sum(F.col(f"__x{i}") * F.col(f"__g{o}")).alias(f"w_{i}_{o}") for i in range(len(v.feats)) for o in range(len(grad.feats))]
    wide = theirs.join(mine, v.keys).groupBy("k").agg(*products)
    cells = F.array(*(F.struct(F.lit(i).alias("ci"), F.lit(o).alias("co"), F.col(f"w_{i}_{o}").alias("value")) for i in range(len(v.feats)) for o in range(len(grad.feats))))
    return gx, wide.select("k", F.explode(cells).alias("c")).select("k", "c.ci", "c.co", "c.value")


# -- products with sparse matrices


def spmm(matrix: DataFrame, dense: DataFrame, feats: Sequence[str], row: str = "row", col: str = "col", value: str = "value", key: str = "col") -> DataFrame:
    """Rows of S X: the sum of value * features over the entries of each row of S."""
    joined = matrix.join(dense.select(F.col(key).alias("__key"), *feats), F.col(col) == F.col("__key"))
    return joined.groupBy(row).agg(*(F.sum(F.col(value) * F.col(f)).alias(f) for f in feats))


def spmm_average(matrix: DataFrame, dense: DataFrame, feats: Sequence[str], row: str = "row", col: str = "col", key: str = "col") -> DataFrame:
    """spmm() in which each entry weighs one over the number of entries of its row."""
    joined = matrix.join(dense.select(F.col(key).alias("__key"), *feats), F.col(col) == F.col("__key"))
    return joined.groupBy(row).agg(*((F.sum(f) / F.count(F.lit(1))).alias(f) for f in feats))


def spmm_average_backward(matrix: DataFrame, grad: DataFrame, feats: Sequence[str], row: str = "row", col: str = "col") -> DataFrame:
    """The gradient of spmm_average() for the dense side: each entry passes its row's gradient on, over the row's entries."""
    n = matrix.groupBy(row).agg(F.count(F.lit(1)).alias("__n"))
    share = grad.join(n, row).select(row, *((F.col(f) / F.col("__n")).alias(f) for f in feats))
    return spmm(matrix.withColumn("__one", F.lit(1)), share, feats, row=col, col=row, value="__one", key=row)


def spmm_backward(matrix: DataFrame, grad: DataFrame, feats: Sequence[str], row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """The gradient of spmm() for the dense side: S transposed times ``grad``."""
    return spmm(matrix, grad, feats, row=col, col=row, value=value, key=row)
