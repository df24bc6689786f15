"""Operators on octree leaves: building, refining, coarsening, locating, resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.offsets import corners
from voxloom.model import Leaves, OctreeConfig, Points

#: A box as (lower, upper) corners; None stands for all of space.
Region = tuple[Sequence[float], Sequence[float]] | None
_LIMIT = 4e18  # larger places have no cell


def up(c: Column, levels: Column | int) -> Column:
    """The coordinate of the ancestor ``levels`` above."""
    n = F.lit(levels) if isinstance(levels, int) else levels
    return F.call_function("shiftright", c, n.cast("int"))


def down(c: Column, levels: Column | int) -> Column:
    """The first coordinate among the descendants ``levels`` below."""
    n = F.lit(levels) if isinstance(levels, int) else levels
    return F.call_function("shiftleft", c, n.cast("int"))


def cell_at(config: OctreeConfig, axis: int, place: Column, level: Column | int) -> Column:
    size = config.size(level)
    size = F.lit(size) if isinstance(size, float) else size
    return F.floor((place - F.lit(float(config.origin[axis]))) / size).cast("long")


def bounds(x: Leaves, axis: int) -> tuple[Column, Column]:
    """Lower and upper bound of a leaf along an axis; boxes are half-open."""
    size = x.config.size(F.col(x.level))
    low = F.lit(float(x.config.origin[axis])) + F.col(x.axes[axis]) * size
    return low, low + size


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _intersects(x: Leaves, region: Region) -> Column:
    if region is None:
        return F.lit(True)
    _check_region(x, region)
    boxes = [bounds(x, a) for a in range(x.config.dim)]
    return _all([(lo < region[1][a]) & (hi > region[0][a]) for a, (lo, hi) in enumerate(boxes)])


def _inside(x: Leaves, region: Region) -> Column:
    if region is None:
        return F.lit(True)
    _check_region(x, region)
    boxes = [bounds(x, a) for a in range(x.config.dim)]
    return _all([(lo >= region[0][a]) & (hi <= region[1][a]) for a, (lo, hi) in enumerate(boxes)])


def _check_region(x: Leaves, region: Region) -> None:
    if len(region[0]) != x.config.dim or len(region[1]) != x.config.dim:
        raise ValueError("the region has another dimension than the leaves")


# -- building


def from_points(p: Points, config: OctreeConfig) -> Leaves:
    """Level-0 leaves with the mean features of their points. Places that aren't finite or too large raise."""
    fine = _all([c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LIMIT) for c in (F.col(a).cast("double") for a in p.axes)])
    checked = p.df.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("a point has a place without a cell")).cast("boolean")))
    cells = [cell_at(config, i, F.col(a), 0).alias(a) for i, a in enumerate(p.axes)]
    df = checked.select(*cells, *p.feats).groupBy(*p.axes).agg(*(F.avg(f).alias(f) for f in p.feats))
    return Leaves(df.select(F.lit(0).cast("int").alias("level"), *p.axes, *p.feats), config, p.axes, p.feats, p)


def from_voxels(df: DataFrame, config: OctreeConfig, axes: Sequence[str], feats: Sequence[str], points: Points | None = None, check: bool = True) -> Leaves:
    """Explicit leaves; with ``check`` their integrity is verified at once."""
    x = Leaves(df.select(F.col("level").cast("int").alias("level"), *(F.col(a).cast("long").alias(a) for a in axes), *feats), config, tuple(axes), tuple(feats), points)
    if check and (bad := violations(x).limit(1).collect()):
        raise ValueError(f"not a set of leaves: {bad[0].asDict()}")
    return x


def violations(x: Leaves) -> DataFrame:
    """(keys, problem) of leaves that break the rules: level, repeated key, or overlap with another leaf."""
    level = F.col(x.level)
    bad_level = x.df.filter((level < 0) | (level > x.config.depth) | level.isNull()).select(*x.keys, F.lit("level").alias("problem"))
    repeated = x.df.groupBy(*x.keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*x.keys, F.lit("repeated").alias("problem"))
    return bad_level.unionByName(repeated).unionByName(overlaps(x).withColumn("problem", F.lit("overlap")))


def overlaps(x: Leaves) -> DataFrame:
    """The leaves that have an ancestor among the leaves."""
    valid = x.df.filter(F.col(x.level).between(1, x.config.depth))
    lifted = ancestors(valid.select(*x.keys, *(F.col(k).alias(f"__{k}") for k in x.keys)), x)
    return lifted.join(x.df.select(*x.keys), x.keys, "left_semi").select(*(F.col(f"__{k}").alias(k) for k in x.keys)).distinct()


def ancestors(df: DataFrame, x: Leaves, own: bool = False) -> DataFrame:
    """``df`` once for each ancestor of its key (and for the key itself), which replaces the key."""
    level = F.col(x.level)
    first = F.sequence(F.lit(0), level) if own else F.when(level > 0, F.sequence(F.lit(0), level - 1)).otherwise(F.array().cast("array<int>"))
    rest = [c for c in df.columns if c not in x.keys]
    out = df.withColumn("__up", F.explode(first))
    return out.select(F.col("__up").alias(x.level), *(up(F.col(a), level - F.col("__up")).alias(a) for a in x.axes), *rest)


def has_overlapping_leaves(x: Leaves) -> bool:
    return bool(overlaps(x).limit(1).count())


def with_features(x: Leaves, features: DataFrame, feats: Sequence[str]) -> Leaves:
    """Other features, by key, on the same leaves."""
    return x.with_df(x.df.select(*x.keys).join(features.select(*x.keys, *feats), x.keys), feats)


# -- geometry


def geometry(x: Leaves) -> DataFrame:
    """keys, size, volume and for each axis lo_, hi_ and center_."""
    size = x.config.size(F.col(x.level))
    cols = [size.alias("size"), F.pow(size, F.lit(x.config.dim)).alias("volume")]
    for i, a in enumerate(x.axes):
        lo, hi = bounds(x, i)
        cols += [lo.alias(f"lo_{a}"), hi.alias(f"hi_{a}"), (lo + size / 2).alias(f"center_{a}")]
    return x.df.select(*x.keys, *cols)


def volume(x: Leaves) -> Column:
    return F.pow(x.config.size(F.col(x.level)), F.lit(x.config.dim))


def parents(x: Leaves) -> DataFrame:
    """The distinct parents of the leaves below level 0."""
    below = x.df.filter(F.col(x.level) > 0)
    return below.select((F.col(x.level) - 1).alias(x.level), *(up(F.col(a), 1).alias(a) for a in x.axes)).distinct()


def children_of(x: Leaves) -> Column:
    """The keys of a leaf's children as an array of structs, first axis fastest."""
    kids = [F.struct((F.col(x.level) + 1).cast("int").alias(x.level), *((F.col(a) * 2 + o).alias(a) for a, o in zip(x.axes, off, strict=True))) for off in corners(x.config.dim)]
    return F.array(*kids)


def counts_by_level(x: Leaves) -> DataFrame:
    """(level, n) for all levels, unused ones too."""
    every = x.df.sparkSession.range(x.config.depth + 1).select(F.col("id").cast("int").alias(x.level))
    n = x.df.groupBy(x.level).agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(n), x.level, "left").select(x.level, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def present_levels(x: Leaves) -> list[int]:
    """The levels that have leaves: 31 at most, so the driver may hold them."""
    return sorted(r[0] for r in x.df.select(x.level).distinct().collect())


def index_of(x: Leaves, queries: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Queries with the id of the leaf that has exactly their key, or -1. ``ids`` holds keys and ids."""
    return queries.join(ids.select(*x.keys, id_col), x.keys, "left").withColumn(id_col, F.coalesce(id_col, F.lit(-1)))


# -- points and leaves


def locate(points: DataFrame, x: Leaves, axes: Sequence[str], levels: Sequence[int] | None = None) -> DataFrame:
    """``points`` that lie in a leaf, with its key as ``leaf_<key>``.

    Each point is exploded over the levels that occur and meets the leaves by an equi-join. As leaves don't overlap
    it matches once at most.
    """
    levels = present_levels(x) if levels is None else list(levels)
    if not levels:
        return points.limit(0).select("*", *(F.lit(0).cast("int" if k == x.level else "long").alias(f"leaf_{k}") for k in x.keys))
    keyed = points.withColumn(f"leaf_{x.level}", F.explode(F.array(*(F.lit(v).cast("int") for v in levels))))
    keyed = keyed.withColumns({f"leaf_{a}": cell_at(x.config, i, F.col(p), F.col(f"leaf_{x.level}")) for i, (a, p) in enumerate(zip(x.axes, axes, strict=True))})
    own = x.df.select(*(F.col(k).alias(f"leaf_{k}") for k in x.keys))
    return keyed.join(own, [f"leaf_{k}" for k in x.keys]).select(*points.columns, *(f"leaf_{k}" for k in x.keys))


def cell_statistics(p: Points, config: OctreeConfig, first: int = 0) -> DataFrame:
    """For every cell of every level that holds a point: n, and sum and sum of squares of each feature.

    One pass: points are exploded over the levels and partial sums form before the shuffle. Squares are summed as doubles,
    since those of whole numbers soon pass the largest long.
    """
    levelled = p.df.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(config.depth))))
    cells = [cell_at(config, i, F.col(a), F.col("level")).alias(a) for i, a in enumerate(p.axes)]
    sums = [s for f in p.feats for s in (F.sum(f).alias(f"sum_{f}"), F.sum(F.col(f).cast("double") * F.col(f)).alias(f"sq_{f}"))]
    return levelled.select("level", *cells, *p.feats).groupBy("level", *p.axes).agg(F.count(F.lit(1)).alias("n"), *sums)


# -- refining and coarsening


def _split(x: Leaves, chosen: Column, policy: str) -> Leaves:
    """The chosen leaves replaced by all their children. No shuffle."""
    if policy not in ("replicate", "split"):
        raise ValueError("the policy is replicate or split")
    self_ = F.array(F.struct(F.col(x.level).cast("int").alias(x.level), *(F.col(a).alias(a) for a in x.axes)))
    share = 1 / 2**x.config.dim if policy == "split" else 1.0
    picked = x.df.withColumn("__on", F.coalesce(chosen, F.lit(False)))
    feats = [(F.when(F.col("__on"), F.col(f) * share).otherwise(F.col(f)) if policy == "split" else F.col(f)).alias(f) for f in x.feats]
    out = picked.select(*feats, F.explode(F.when(F.col("__on"), children_of(x)).otherwise(self_)).alias("__k"))
    return x.with_df(out.select(*(F.col(f"__k.{k}").alias(k) for k in x.keys), *x.feats))


def _split_occupied(x: Leaves, chosen: Column, policy: str, occupied: DataFrame) -> Leaves:
    """As _split(), but only children that hold a point are made; a leaf without one stays."""
    picked = x.df.withColumn("__on", F.coalesce(chosen, F.lit(False)))
    stay = picked.filter(~F.col("__on")).drop("__on")
    parent = [F.col(k).alias(f"__{k}") for k in x.keys]
    split = picked.filter("__on").select(*parent, *x.feats, F.explode(children_of(x)).alias("__k"))
    split = split.select(*(f"__{k}" for k in x.keys), *x.feats, *(F.col(f"__k.{k}").alias(k) for k in x.keys))
    held = split.join(occupied.select(*x.keys), x.keys, "left_semi")
    n = held.groupBy(*(f"__{k}" for k in x.keys)).agg(F.count(F.lit(1)).alias("__n"))
    share = (lambda f: (F.col(f) / F.col("__n")).alias(f)) if policy == "split" else F.col
    made = held.join(n, [f"__{k}" for k in x.keys]).select(*x.keys, *(share(f) for f in x.feats))
    parents_ = n.select(*(F.col(f"__{k}").alias(k) for k in x.keys))
    bare = picked.filter("__on").drop("__on").join(parents_, x.keys, "left_anti")
    return x.with_df(stay.unionByName(made).unionByName(bare))


def refine(x: Leaves, target: int, region: Region = None, policy: str = "replicate", drop_empty: bool = False) -> Leaves:
    """Leaves above level ``target`` that meet ``region`` are split, and their children that meet it, down to the target.

    ``replicate`` copies features to children, ``split`` divides them among those that are made.
    """
    if not 0 <= target <= x.config.depth:
        raise ValueError("the target level is outside the tree")
    occupied = None
    if drop_empty:
        if x.points is None:
            raise ValueError("drop_empty needs the points that the leaves were made from")
        occupied = cell_statistics(x.points, x.config, 1).select(*x.keys)
    for level in range(target):
        chosen = (F.col(x.level) == level) & _intersects(x, region)
        x = _split(x, chosen, policy) if occupied is None else _split_occupied(x, chosen, policy, occupied)
    return x


_REDUCE = {"mean": F.avg, "sum": F.sum, "max": F.max}


def coarsen(x: Leaves, target: int, region: Region = None, reduction: str = "mean") -> Leaves:
    """From the finest level up to ``target``: leaves whose parent lies inside ``region`` merge into it.

    Levels are merged one after the other, so a mean over several levels is a mean of means.
    """
    if not 0 <= target <= x.config.depth:
        raise ValueError("the target level is outside the tree")
    reduce = _REDUCE[reduction]
    top = max(present_levels(x), default=0)
    for level in range(top, target, -1):
        size = x.config.size(level - 1)
        within = F.lit(True)
        if region is not None:
            _check_region(x, region)
            for i, a in enumerate(x.axes):
                low = F.lit(float(x.config.origin[i])) + up(F.col(a), 1) * F.lit(size)
                within = within & (low >= region[0][i]) & (low + size <= region[1][i])
        merges = (F.col(x.level) == level) & within
        keys = [F.when(merges, F.col(x.level) - 1).otherwise(F.col(x.level)).cast("int").alias(x.level), *(F.when(merges, up(F.col(a), 1)).otherwise(F.col(a)).alias(a) for a in x.axes)]
        x = x.with_df(x.df.select(*keys, *x.feats).groupBy(*x.keys).agg(*(reduce(f).alias(f) for f in x.feats)))
    return x


def refine_if(x: Leaves, predicate: Callable[[Leaves], Column], policy: str = "replicate") -> Leaves:
    """Splits leaves for which ``predicate`` gives true, level by level, down to the depth of the tree."""
    for level in range(x.config.depth):
        x = _split(x, (F.col(x.level) == level) & predicate(x), policy)
    return x


def _refine_by_cells(x: Leaves, condition: Column, policy: str) -> Leaves:
    if x.points is None:
        raise ValueError("this needs the points that the leaves were made from")
    hot = cell_statistics(x.points, x.config).filter(condition).select(*x.keys, F.lit(True).alias("__hot"))
    for level in range(x.config.depth):
        marked = x.with_df(x.df.join(hot.filter(F.col("level") == level), x.keys, "left"))
        x = _split(marked, F.coalesce("__hot", F.lit(False)), policy)
    return x


def refine_by_density(x: Leaves, most: int, policy: str = "replicate") -> Leaves:
    """Splits leaves that hold more than ``most`` points, until none does or the depth is reached."""
    return _refine_by_cells(x, F.col("n") > most, policy)


def refine_by_variance(x: Leaves, most: float, policy: str = "replicate") -> Leaves:
    """Splits leaves whose points' population variance, averaged over the channels, is over ``most``."""
    n, feats = F.col("n"), x.points.feats if x.points else ()
    each = [F.greatest(F.lit(0.0), F.col(f"sq_{f}") / n - (F.col(f"sum_{f}") / n) * (F.col(f"sum_{f}") / n)) for f in feats]
    return _refine_by_cells(x, sum(each, F.lit(0.0)) / max(len(each), 1) > most, policy)


def revoxelise(x: Leaves) -> Leaves:
    """The same leaves with the mean features of their points, 0 where there is none."""
    p = x.points
    if p is None:
        raise ValueError("this needs the points that the leaves were made from")
    held = locate(p.df, x, p.axes).groupBy(*(f"leaf_{k}" for k in x.keys)).agg(*(F.avg(f).alias(f) for f in p.feats))
    held = held.select(*(F.col(f"leaf_{k}").alias(k) for k in x.keys), *p.feats)
    df = x.df.select(*x.keys).join(held, x.keys, "left")
    return x.with_df(df.select(*x.keys, *(F.coalesce(f, F.lit(0.0)).alias(f) for f in p.feats)), p.feats)


def resample_uniform(x: Leaves, level: int, policy: str = "replicate", reduction: str = "mean") -> Leaves:
    """All leaves at one level."""
    return coarsen(refine(x, level, None, policy), level, None, reduction)


def resample_to(x: Leaves, reference: Leaves, reduction: str = "mean") -> Leaves:
    """The features of ``x`` on the leaves of ``reference``.

    A leaf of ``x`` that covers a reference leaf is copied to it; finer ones are reduced in one step; uncovered
    leaves get 0.
    """
    same = [F.col(k).alias(f"__{k}") for k in x.keys]
    lifted = ancestors(reference.df.select(*x.keys, *same), x, own=True)
    copied = lifted.join(x.df, x.keys).select(*(F.col(f"__{k}").alias(k) for k in x.keys), *x.feats)
    finer = ancestors(x.df, x).join(reference.df.select(*x.keys), x.keys).select(*x.keys, *x.feats)
    reduce = _REDUCE[reduction]
    got = copied.unionByName(finer).groupBy(*x.keys).agg(*(reduce(f).alias(f) for f in x.feats))
    df = reference.df.select(*x.keys).join(got, x.keys, "left")
    return reference.with_df(df.select(*x.keys, *(F.coalesce(f, F.lit(0)).alias(f) for f in x.feats)), x.feats)


# -- pooling and arithmetic


def global_average(x: Leaves, by_volume: bool = True) -> DataFrame:
    """One row: the mean features, weighted by volume or not; 0 without leaves."""
    w = volume(x) if by_volume else F.lit(1.0)
    return x.df.agg(*(F.coalesce(F.sum(F.col(f) * w) / F.sum(w), F.lit(0.0)).alias(f) for f in x.feats))


def pool(x: Leaves, target: int, reduction: str = "mean") -> Leaves:
    return coarsen(x, target, None, reduction)


def add(a: Leaves, b: Leaves) -> Leaves:
    """The sum of features on the same leaves."""
    other = b.df.select(*b.keys, *(F.col(f).alias(f"__b{i}") for i, f in enumerate(b.feats)))
    return a.with_df(a.df.join(other, a.keys).select(*a.keys, *((F.col(f) + F.col(f"__b{i}")).alias(f) for i, f in enumerate(a.feats))))


def concatenate(a: Leaves, b: Leaves) -> Leaves:
    names = [f"{f}_1" for f in b.feats]
    other = b.df.select(*b.keys, *(F.col(f).alias(n) for f, n in zip(b.feats, names, strict=True)))
    return a.with_df(a.df.join(other, a.keys).select(*a.keys, *a.feats, *names), [*a.feats, *names])
