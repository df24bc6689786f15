"""What the operators pass around: a DataFrame and the roles of its columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z", "t")


@dataclass(frozen=True)
class Voxels:
    """Feature rows keyed by batch and integer coordinates.

    ``df`` has the columns ``batch``, ``axes`` (all BIGINT) and ``feats`` (one column for each channel, so that sums
    and products stay inside generated code). ``stride`` is the spacing of the grid by axis. ``origin`` names the
    coordinate set: two values with the same origin have the same rows.
    """

    df: DataFrame
    axes: tuple[str, ...]
    feats: tuple[str, ...]
    stride: tuple[int, ...]
    origin: str = ""
    batch: str = "b"

    @property
    def keys(self) -> list[str]:
        return [self.batch, *self.axes]

    @property
    def dim(self) -> int:
        return len(self.axes)

    def coords(self) -> DataFrame:
        return self.df.select(*self.keys)

    def features(self) -> DataFrame:
        return self.df.select(*self.feats)

    def with_df(self, df: DataFrame, feats: Sequence[str] | None = None, **changes) -> Voxels:
        return replace(self, df=df, feats=self.feats if feats is None else tuple(feats), **changes)

    def map(self, fn) -> Voxels:
        """``fn`` of each channel; the coordinates stay."""
        return self.with_df(self.df.select(*self.keys, *(fn(F.col(c)).alias(c) for c in self.feats)))

    def cast(self, kind: str) -> Voxels:
        return self.map(lambda c: c.cast(kind))


@dataclass(frozen=True)
class Points:
    """Continuous points; several may have the same place. ``pid`` identifies a row."""

    df: DataFrame
    axes: tuple[str, ...]
    feats: tuple[str, ...]
    batch: str = "b"
    pid: str = "pid"

    @property
    def keys(self) -> list[str]:
        return [self.batch, *self.axes]


@dataclass(frozen=True)
class OctreeConfig:
    """Geometry of an octree: level 0 has cells of ``base``, each level below halves them down to ``least``."""

    base: float
    least: float
    depth: int
    origin: tuple[float, ...] = (0.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        if not self.base > 0 or not self.least > 0:
            raise ValueError("cell sizes must be positive")
        if not 0 <= self.depth <= 30:
            raise ValueError("the depth must be from 0 to 30")
        if not 1 <= len(self.origin) <= 4:
            raise ValueError("one to four dimensions are supported")
        if abs(self.base / 2**self.depth - self.least) > 1e-9 * self.base:
            raise ValueError("the least cell must be the base cell halved once for each level")

    @property
    def dim(self) -> int:
        return len(self.origin)

    def size(self, level: int | Column):
        return self.base / 2.0**level if isinstance(level, int) else F.lit(self.base) / F.pow(F.lit(2.0), level)


@dataclass(frozen=True)
class Leaves:
    """Non-overlapping octree cells of mixed levels; ``points`` are the points that they were made from, if any."""

    df: DataFrame
    config: OctreeConfig
    axes: tuple[str, ...]
    feats: tuple[str, ...]
    points: Points | None = None
    level: str = "level"

    @property
    def keys(self) -> list[str]:
        return [self.level, *self.axes]

    def with_df(self, df: DataFrame, feats: Sequence[str] | None = None, **changes) -> Leaves:
        return replace(self, df=df, feats=self.feats if feats is None else tuple(feats), **changes)
