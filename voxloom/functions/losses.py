"""Losses: a value for each row from Columns, and its mean over a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .channels import logsigmoid


def mean_of(df: DataFrame, loss: Column, weight: Column | None = None) -> DataFrame:
    """One row: the (weighted) mean of ``loss``."""
    return df.agg((F.avg(loss) if weight is None else F.sum(loss * weight) / F.sum(weight)).alias("loss"))


def total_of(df: DataFrame, loss: Column) -> DataFrame:
    return df.agg(F.sum(loss).alias("loss"))


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def binary_cross_entropy(p: Column, y: Column) -> Column:
    """Logarithms are cut off at -100."""
    log = lambda c: F.greatest(F.when(c > 0, F.log(c)).otherwise(F.lit(-100.0)), F.lit(-100.0))
    return -(y * log(p) + (1 - y) * log(1 - p))


def binary_cross_entropy_with_logits(x: Column, y: Column, pos_weight: float = 1.0) -> Column:
    return -(pos_weight * y * logsigmoid(x) + (1 - y) * logsigmoid(-x))


def _picked(cols: Sequence[Column], label: Column) -> Column:
    return F.element_at(F.array(*cols), label.cast("int") + 1)


def nll(log_probabilities: Sequence[Column], label: Column) -> Column:
    return -_picked(log_probabilities, label)


def cross_entropy(logits: Sequence[Column], label: Column) -> Column:
    m = F.greatest(*logits)
    return m + F.log(_sum([F.exp(c - m) for c in logits])) - _picked(logits, label)


def class_weight(weights: Sequence[float], label: Column) -> Column:
    """The weight of a row's class, for weighted means of cross_entropy()."""
    return _picked([F.lit(float(w)) for w in weights], label)


def mse(x: Column, y: Column) -> Column:
    return (x - y) * (x - y)


def l1(x: Column, y: Column) -> Column:
    return F.abs(x - y)


def smooth_l1(x: Column, y: Column, beta: float = 1.0) -> Column:
    d = F.abs(x - y)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def kl_div(log_p: Column, target: Column) -> Column:
    return F.when(target > 0, target * (F.log(target) - log_p)).otherwise(F.lit(0.0))


def hinge_embedding(x: Column, y: Column, margin: float = 1.0) -> Column:
    return F.when(y == 1, x).otherwise(F.greatest(F.lit(0.0), margin - x))


def poisson_nll(x: Column, y: Column, log_input: bool = True, full: bool = False, eps: float = 1e-8) -> Column:
    loss = F.exp(x) - y * x if log_input else x - y * F.log(x + eps)
    stirling = y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y)
    return loss + F.when(y > 1, stirling).otherwise(F.lit(0.0)) if full else loss


def multi_margin(scores: Sequence[Column], label: Column, margin: float = 1.0, p: int = 1) -> Column:
    own = _picked(scores, label)
    terms = [F.when(label == i, F.lit(0.0)).otherwise(F.pow(F.greatest(F.lit(0.0), margin - own + s), F.lit(p))) for i, s in enumerate(scores)]
    return _sum(terms) / len(scores)


def multilabel_margin(scores: Sequence[Column], labels: Column) -> Column:
    """``labels`` is an array of classes, ended by the first -1."""
    cut = F.array_position(labels, F.lit(-1))
    own = F.when(cut > 0, F.slice(labels, F.lit(1), (cut - 1).cast("int"))).otherwise(labels)

    def gaps(score: Column) -> Column:
        return F.aggregate(own, F.lit(0.0), lambda acc, j: acc + F.greatest(F.lit(0.0), 1 - _picked(scores, j) + score))

    terms = [F.when(F.array_contains(own, F.lit(i)), F.lit(0.0)).otherwise(gaps(s)) for i, s in enumerate(scores)]
    return _sum(terms) / len(scores)


def multilabel_soft_margin(scores: Sequence[Column], targets: Sequence[Column]) -> Column:
    return _sum([binary_cross_entropy_with_logits(s, t) for s, t in zip(scores, targets, strict=True)]) / len(scores)


def soft_margin(x: Column, y: Column) -> Column:
    return F.log1p(F.exp(-y * x))
