"""Operators on tables of anisotropic 3-D Gaussians.

An activated table has gid, px py pz, qw qx qy qz, sx sy sz, opacity, r g b and optionally vx vy vz and other columns. A raw
table, as training stores it, has unnormalised quaternions, logarithms of scales, logits of opacities (``opacity_raw``)
and spherical harmonics: ``dc0..2`` and ``rest`` (an array of coefficients, each an array of three channels).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import spherical
from voxloom.functions.channels import sigmoid

from .neighbours import with_nearest

P, Q, S, RGB, V = ("px", "py", "pz"), ("qw", "qx", "qy", "qz"), ("sx", "sy", "sz"), ("r", "g", "b"), ("vx", "vy", "vz")
LEAST_SCALE = 1e-6
Matrix = list[list[Column]]


def _total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


# -- filters


def filter_opacity(df: DataFrame, least: float) -> DataFrame:
    if not 0 <= least <= 1:
        raise ValueError("an opacity is from 0 to 1")
    return df.filter(F.col("opacity") >= least)


def filter_bounds(df: DataFrame, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Gaussians whose centre is in the half-open box."""
    if any(not a < b for a, b in zip(lo, hi, strict=True)):
        raise ValueError("the lower bound must be below the upper")
    for p, a, b in zip(P, lo, hi, strict=True):
        df = df.filter((F.col(p) >= a) & (F.col(p) < b))
    return df


def validated(df: DataFrame) -> DataFrame:
    """``df``; a row with a value that isn't finite or out of range raises when it is computed."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in (*P, *Q, *S, *RGB, "opacity")])
    ok = ok & (F.least(*_cols(S)) >= LEAST_SCALE) & F.col("opacity").between(0, 1) & (_total([F.col(q) * F.col(q) for q in Q]) > 0)
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a Gaussian has a value out of range")).cast("boolean")))


def project_constraints(df: DataFrame) -> DataFrame:
    return df.withColumns({s: F.greatest(F.col(s), F.lit(LEAST_SCALE)) for s in S} | {"opacity": F.least(F.greatest(F.col("opacity"), F.lit(0.0)), F.lit(1.0))})


# -- geometry


def unit_quaternion(q: Sequence[Column]) -> list[Column]:
    norm = F.sqrt(_total([c * c for c in q]))
    bad = F.raise_error(F.lit("a quaternion must be finite and not 0")).cast("double")
    return [F.when((norm > 0) & (norm < float("inf")), c / norm).otherwise(bad) for c in q]


def rotation(q: Sequence[Column]) -> Matrix:
    """The rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def settled(df: DataFrame, prefix: str = "__") -> DataFrame:
    """``df`` with its columns of that prefix as they are: later filters and projections refer to them.

    Without this the optimiser would put each column's expression wherever the column is used, again and again, and
    the plan would grow beyond all bounds. A generator of one row stops that and stays in generated code.
    """
    own = [c for c in df.columns if c.startswith(prefix)]
    rest = [c for c in df.columns if not c.startswith(prefix)]
    return df.select(*rest, F.explode(F.array(F.struct(*own))).alias("__s")).select(*rest, *(F.col(f"__s.{c}").alias(c) for c in own))


def _with_rotation(df: DataFrame) -> tuple[DataFrame, Matrix]:
    """The rotation as nine columns, so that expressions refer to them instead of growing."""
    df = df.withColumns({f"__u{i}": c for i, c in enumerate(unit_quaternion(_cols(Q)))})
    matrix = rotation([F.col(f"__u{i}") for i in range(4)])
    df = settled(df.withColumns({f"__r{i}{j}": matrix[i][j] for i in range(3) for j in range(3)}))
    return df, [[F.col(f"__r{i}{j}") for j in range(3)] for i in range(3)]


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def _form(r: Matrix, weights: Sequence[Column]) -> dict[str, Column]:
    """R diag(weights) R^T as columns xx, xy, xz, yy, yz, zz."""
    return {f"{'xyz'[i]}{'xyz'[j]}": _total([r[i][k] * weights[k] * r[j][k] for k in range(3)]) for i in range(3) for j in range(i, 3)}


def covariances(df: DataFrame) -> DataFrame:
    """gid and the covariance cxx, cxy, cxz, cyy, cyz, czz: R diag(s^2) R^T."""
    df, r = _with_rotation(df)
    return df.select("gid", *(c.alias(f"c{n}") for n, c in _form(r, [F.col(s) * F.col(s) for s in S]).items()))


def inverse_covariances(df: DataFrame) -> DataFrame:
    df, r = _with_rotation(df)
    return df.select("gid", *(c.alias(f"i{n}") for n, c in _form(r, [1 / (F.col(s) * F.col(s)) for s in S]).items()))


def determinant() -> Column:
    return reduce(lambda a, b: a * b, [F.col(s) * F.col(s) for s in S])


def with_mahalanobis(df: DataFrame, point: Sequence[Column | float], name: str = "mahalanobis2") -> DataFrame:
    """The squared Mahalanobis distance of a point: the offset in the Gaussian's own axes over its scales."""
    df, r = _with_rotation(df)
    d = [(c if isinstance(c, Column) else F.lit(float(c))) - F.col(p) for c, p in zip(point, P, strict=True)]
    own = [_total([r[i][k] * d[i] for i in range(3)]) / F.col(S[k]) for k in range(3)]
    return _clean(df.withColumn(name, _total([o * o for o in own])))


def with_density(df: DataFrame, point: Sequence[Column | float], name: str = "density") -> DataFrame:
    df = with_mahalanobis(df, point, "mahalanobis2")
    return df.withColumn(name, F.exp(-0.5 * F.col("mahalanobis2")) / F.sqrt(F.lit((2 * math.pi) ** 3) * determinant())).drop("mahalanobis2")


def overlap_integrals(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gid_a, gid_b, overlap) for given pairs: the integral of the product of two densities."""
    wide = lambda df, tag: covariances(df).join(df.select("gid", *P), "gid").select(*(F.col(c).alias(f"{tag}_{c}") for c in ("gid", *P, "cxx", "cxy", "cxz", "cyy", "cyz", "czz")))
    j = pairs.join(wide(a, "a"), F.col("gid_a") == F.col("a_gid")).join(wide(b, "b"), F.col("gid_b") == F.col("b_gid"))
    j = j.withColumns({f"__{n}": F.col(f"a_c{n}") + F.col(f"b_c{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz")} | {f"__d{i}": F.col(f"a_{p}") - F.col(f"b_{p}") for i, p in enumerate(P)})
    xx, xy, xz, yy, yz, zz = (F.col(f"__{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    cof = [yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy]
    j = j.withColumns({f"__k{i}": c for i, c in enumerate(cof)})
    k = [F.col(f"__k{i}") for i in range(6)]
    det = xx * k[0] + xy * k[1] + xz * k[2]
    d = [F.col(f"__d{i}") for i in range(3)]
    form = k[0] * d[0] * d[0] + k[3] * d[1] * d[1] + k[5] * d[2] * d[2] + 2 * (k[1] * d[0] * d[1] + k[2] * d[0] * d[2] + k[4] * d[1] * d[2])
    return j.select("gid_a", "gid_b", (F.exp(-0.5 * form / det) / F.sqrt(F.lit((2 * math.pi) ** 3) * det)).alias("overlap"))


def axis_bounds(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """gid and the box lo_, hi_ that holds ``sigmas`` deviations along each axis."""
    c = covariances(df).join(df.select("gid", *P), "gid")
    return c.select("gid", *(x for a, p in zip("xyz", P, strict=True) for x in ((F.col(p) - sigmas * F.sqrt(F.col(f"c{a}{a}"))).alias(f"lo_{a}"), (F.col(p) + sigmas * F.sqrt(F.col(f"c{a}{a}"))).alias(f"hi_{a}"))))


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points of each Gaussian: gid, i, x, y, z."""
    df, r = _with_rotation(df)
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({f"__n{k}": F.randn(seed + k) * F.col(S[k]) for k in range(3)})
    place = [F.col(P[i]) + _total([r[i][k] * F.col(f"__n{k}") for k in range(3)]) for i in range(3)]
    return df.select("gid", "i", *(c.alias(a) for c, a in zip(place, "xyz", strict=True)))


def transform(df: DataFrame, q: Sequence[float] | Sequence[str], t: Sequence[float] | Sequence[str]) -> DataFrame:
    """A rigid motion: rotates places, orientations and velocities, then moves places.

    ``q`` (w, x, y, z) and ``t`` are numbers for all rows, or names of columns.
    """
    value = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    df = df.withColumns({f"__m{i}": c for i, c in enumerate(unit_quaternion([value(v) for v in q]))})
    m = [F.col(f"__m{i}") for i in range(4)]
    r = rotation(m)
    turned = lambda names: [_total([r[i][k] * F.col(names[k]) for k in range(3)]) for i in range(3)]
    places = {p: c + value(v) for p, c, v in zip(P, turned(P), t, strict=True)}
    (a, b, c, d), (w, x, y, z) = m, _cols(Q)
    product = [a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w]
    speeds = dict(zip(V, turned(V), strict=True)) if set(V) <= set(df.columns) else {}
    return _clean(df.withColumns(places | dict(zip(Q, product, strict=True)) | speeds))


# -- raw parameters


def activate(raw: DataFrame) -> DataFrame:
    """Activated columns of a raw table; the colour is that of the constant harmonic."""
    quats = {q: c for q, c in zip(Q, _unit_or_identity(_cols(Q)), strict=True)}
    return raw.withColumns({"opacity": sigmoid(F.col("opacity_raw"))} | {s: F.exp(s) for s in S} | quats | {c: 0.5 + spherical.C0 * F.col(f"dc{i}") for i, c in enumerate(RGB)})


def _unit_or_identity(q: Sequence[Column]) -> list[Column]:
    norm = F.sqrt(_total([c * c for c in q]))
    return [F.when(norm > 1e-12, c / norm).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, c in enumerate(q)]


def deactivate(df: DataFrame) -> DataFrame:
    """The raw table of an activated one; probabilities are kept 1e-6 off their ends, scales above 1e-7."""
    p = F.least(F.greatest(F.col("opacity"), F.lit(1e-6)), F.lit(1 - 1e-6))
    raw = {"opacity_raw": F.log(p / (1 - p))} | {s: F.log(F.greatest(F.col(s), F.lit(1e-7))) for s in S} | {f"dc{i}": (F.col(c) - 0.5) / spherical.C0 for i, c in enumerate(RGB)}
    return df.withColumns(raw | {"rest": F.array().cast("array<array<double>>")}).drop("opacity", *RGB)


def knn(points: DataFrame, k: int, cell: float, key: str = "gid", axes: Sequence[str] = P) -> DataFrame:
    """(key, other, d2): the ``k`` nearest other points of each point, the smaller key first where they are as near.

    The search goes by blocks that follow the points (see with_nearest()), so ``cell`` doesn't bear on it.
    """
    near = with_nearest(points.select(key, *axes), k, key, axes, "__near").select(key, F.explode("__near").alias("__n"))
    return near.select(key, F.col("__n.other").alias("other"), F.col("__n.d2").alias("d2"))


def from_points(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """A raw table of coloured points: scale from the mean squared distance of the three nearest others, no rotation."""
    near = with_nearest(points, 3, "gid", P, "__near")
    d2 = F.when(F.size("__near") > 0, F.aggregate("__near", F.lit(0.0), lambda s, e: s + e["d2"]) / F.size("__near"))
    df = near.withColumn("__s", 0.5 * F.log(F.greatest(F.coalesce(d2, F.lit(1e-7)), F.lit(1e-7))))
    return _clean(df.withColumns({s: F.col("__s") for s in S} | {q: F.lit(1.0 if q == "qw" else 0.0) for q in Q} | {"opacity_raw": F.lit(math.log(0.1 / 0.9))} | {f"dc{i}": (F.col(c) - 0.5) / spherical.C0 for i, c in enumerate(RGB)} | {"rest": F.array().cast("array<array<double>>")}).drop(*RGB))


def view_colour(raw: DataFrame, eye: Sequence[float], degree: int) -> DataFrame:
    """Activated columns with the colour that a raw table shows from ``eye``."""
    d = [F.col(p) - F.lit(float(e)) for p, e in zip(P, eye, strict=True)]
    norm = F.greatest(F.sqrt(_total([c * c for c in d])), F.lit(1e-12))
    df = activate(raw).withColumns({f"__d{i}": c / norm for i, c in enumerate(d)})
    x, y, z = (F.col(f"__d{i}") for i in range(3))
    n = spherical.coefficients(degree)
    cols = {}
    for c, name in enumerate(RGB):
        sh = [F.col(f"dc{c}"), *(F.coalesce(F.try_element_at(F.try_element_at("rest", F.lit(k)), F.lit(c + 1)), F.lit(0.0)) for k in range(1, n))]
        cols[name] = spherical.colour(sh, x, y, z, degree)
    return _clean(df.withColumns(cols))
