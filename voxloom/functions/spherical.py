"""Spherical harmonics up to degree 3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed constants of the real spherical harmonics.
C0 = 0.28209479177387814
C1 = 0.4886025119029199
C2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
C3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def coefficients(degree: int) -> int:
    if not 0 <= degree <= 3:
        raise ValueError("degrees 0 to 3 are supported")
    return (degree + 1) ** 2


def basis(x: Column, y: Column, z: Column, degree: int) -> list[Column]:
    """The basis functions at a unit direction, in coefficient order."""
    return [F.lit(C0), *directed(x, y, z, degree)]


def directed(x, y, z, degree: int) -> list:
    """The basis functions after the constant one, for columns or NumPy arrays."""
    out = []
    if degree >= 1:
        out += [-C1 * y, C1 * z, -C1 * x]
    if degree >= 2:
        xx, yy, zz = x * x, y * y, z * z
        polys = (x * y, y * z, 2 * zz - xx - yy, x * z, xx - yy)
        out += [c * p for c, p in zip(C2, polys, strict=True)]
    if degree >= 3:
        polys = (y * (3 * xx - yy), x * y * z, y * (4 * zz - xx - yy), z * (2 * zz - 3 * xx - 3 * yy), x * (4 * zz - xx - yy), z * (xx - yy), x * (xx - 3 * yy))
        out += [c * p for c, p in zip(C3, polys, strict=True)]
    return out[: coefficients(degree) - 1]


def colour(sh: Sequence[Column], x: Column, y: Column, z: Column, degree: int) -> Column:
    """One colour channel: the coefficients' sum over the basis plus a half, not below 0."""
    terms = [c * b for c, b in zip(sh, basis(x, y, z, degree), strict=False)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total + 0.5, F.lit(0.0))
