"""Functions of single channels and of rows of channels, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.model import Voxels

#: Fixed values of the self-normalising unit.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772

#: Fixed values of the error function's approximation (Abramowitz and Stegun 7.1.26, error up to 1.5e-7).
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def relu6(x: Column) -> Column:
    return clamp(x, 0, 6)


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * F.expm1(x))


def selu(x: Column) -> Column:
    return SELU_SCALE * F.when(x > 0, x).otherwise(SELU_ALPHA * F.expm1(x))


def celu(x: Column, alpha: float = 1.0) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.least(F.lit(0.0), alpha * F.expm1(x / alpha))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / F.sqrt(F.lit(2.0))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def hardshrink(x: Column, bound: float = 0.5) -> Column:
    return F.when(F.abs(x) > bound, x).otherwise(F.lit(0))


def hardtanh(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return clamp(x, lo, hi)


def hardsigmoid(x: Column) -> Column:
    return relu6(x + 3) / 6


def hardswish(x: Column) -> Column:
    return x * relu6(x + 3) / 6


def logsigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def rrelu(x: Column, lower: float = 1 / 8, upper: float = 1 / 3, seed: int | None = None) -> Column:
    """In evaluation (no seed) the slope is the middle; in training it is drawn for each value."""
    slope = F.lit((lower + upper) / 2) if seed is None else lower + (upper - lower) * F.rand(seed)
    return F.when(x >= 0, x).otherwise(x * slope)


def softplus(x: Column, beta: float = 1.0, linear_from: float = 20.0) -> Column:
    return F.when(x * beta > linear_from, x).otherwise(F.log1p(F.exp(F.least(x * beta, F.lit(linear_from)))) / beta)


def softshrink(x: Column, bound: float = 0.5) -> Column:
    return F.when(x > bound, x - bound).when(x < -bound, x + bound).otherwise(F.lit(0))


def softsign(x: Column) -> Column:
    return x / (1 + F.abs(x))


def tanhshrink(x: Column) -> Column:
    return x - F.tanh(x)


def threshold(x: Column, bound: float, value: float) -> Column:
    return F.when(x > bound, x).otherwise(F.lit(value))


def dropout(x: Column, p: float = 0.5, seed: int | None = None) -> Column:
    """Identity without a seed; else values go to 0 with chance ``p`` and the others grow to make up for it."""
    return x if seed is None else F.when(F.rand(seed) >= p, x / (1 - p)).otherwise(F.lit(0.0))


def alpha_dropout(x: Column, p: float = 0.5, seed: int | None = None) -> Column:
    """Dropout to the lower bound of the self-normalising unit, rescaled to keep mean 0 and variance 1."""
    if seed is None:
        return x
    low = -SELU_SCALE * SELU_ALPHA
    a = 1 / ((1 - p) * (1 + p * low**2)) ** 0.5
    return a * F.when(F.rand(seed) >= p, x).otherwise(F.lit(low)) - a * low * p


#: Functions of one value, by name.
ELEMENTWISE = {
    f.__name__: f
    for f in (relu, relu6, leaky_relu, elu, selu, celu, gelu, silu, sigmoid, hardshrink, hardtanh, hardsigmoid, hardswish, logsigmoid, rrelu, softplus, softshrink, softsign, tanhshrink, threshold, dropout, alpha_dropout)
} | {"tanh": F.tanh}


def activate(v: Voxels, name: str, **parameters) -> Voxels:
    """A function of ELEMENTWISE of every channel."""
    return v.map(lambda c: ELEMENTWISE[name](c, **parameters))


def prelu(v: Voxels, slopes: Sequence[float]) -> Voxels:
    """A slope for each channel, or one for all."""
    slopes = list(slopes) * (len(v.feats) if len(slopes) == 1 else 1)
    cols = [F.when(F.col(f) >= 0, F.col(f)).otherwise(F.col(f) * F.lit(s)).alias(f) for f, s in zip(v.feats, slopes, strict=True)]
    return v.with_df(v.df.select(*v.keys, *cols))


def _peak(feats: Sequence[str]) -> Column:
    return F.greatest(*(F.col(f) for f in feats)) if len(feats) > 1 else F.col(feats[0])


def log_softmax(v: Voxels) -> Voxels:
    """Over the channels of a row."""
    m = _peak(v.feats)
    norm = F.log(sum((F.exp(F.col(f) - m) for f in v.feats), F.lit(0.0)))
    return v.map(lambda c: c - m - norm)


def softmax(v: Voxels, over_rows: bool = False) -> Voxels:
    """Over the channels of a row, or of each channel over all rows."""
    if over_rows:
        top = v.df.agg(*(F.max(f).alias(f"__t{i}") for i, f in enumerate(v.feats)))
        shifted = v.df.join(F.broadcast(top)).select(*v.keys, *(F.exp(F.col(f) - F.col(f"__t{i}")).alias(f) for i, f in enumerate(v.feats)))
        sums = shifted.agg(*(F.sum(f).alias(f"__s{i}") for i, f in enumerate(v.feats)))
        return v.with_df(shifted.join(F.broadcast(sums)).select(*v.keys, *((F.col(f) / F.col(f"__s{i}")).alias(f) for i, f in enumerate(v.feats))))
    m = _peak(v.feats)
    norm = sum((F.exp(F.col(f) - m) for f in v.feats), F.lit(0.0))
    return v.map(lambda c: F.exp(c - m) / norm)


def softmin(v: Voxels) -> Voxels:
    return softmax(v.map(lambda c: -c))


def glu(v: Voxels) -> Voxels:
    """The first half of the channels, each gated by the sigmoid of its partner in the second."""
    if len(v.feats) % 2:
        raise ValueError("glu needs an even number of channels")
    half = len(v.feats) // 2
    cols = [(F.col(a) * sigmoid(F.col(b))).alias(a) for a, b in zip(v.feats[:half], v.feats[half:], strict=True)]
    return v.with_df(v.df.select(*v.keys, *cols), v.feats[:half])


def sinusoidal(v: Voxels, weight, bias: Sequence[float], scale: Sequence[float]) -> Voxels:
    """sin(f W + b) times a factor for each output channel."""
    from voxloom.operators.conv import linear

    out = linear(v, weight, bias)
    return out.with_df(out.df.select(*out.keys, *((F.sin(F.col(f)) * F.lit(s)).alias(f) for f, s in zip(out.feats, scale, strict=True))))
