"""Queries of the octree operators, on line items as integer points in cells of 8 that are halved three times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxloom.functions.offsets import cube_first_axis_slowest
from voxloom.model import Leaves, OctreeConfig, Points
from voxloom.operators import octree, octree_conv, sphere
from voxloom.operators.clips import class_balance, clips, islands, radius_labels, recall, scaled, sliding
from voxloom.sources.frames import leaves_json

from .registry import Registry
from .views import CELLS, XYZ, cells, table, weight

REGISTRY = query = Registry()
CONFIG = OctreeConfig(8.0, 1.0, 3)

#: Line items as distinct points, whatever their batch.
_PTS = f"{CELLS}, pts AS (SELECT DISTINCT pid, x, y, z, f FROM cells)"


def _points(spark, d) -> Points:
    df = cells(spark, d).select("pid", F.lit(0).alias("b"), *(F.col(a).cast("double").alias(a) for a in XYZ), "f").distinct()
    return Points(df, XYZ, ("f",))


def _level0(spark, d) -> Leaves:
    """Level-0 leaves with the sum of cents, which stays exact; their points count for density."""
    p = _points(spark, d)
    sums = p.df.select(*(octree.cell_at(CONFIG, i, F.col(a), 0).alias(a) for i, a in enumerate(XYZ)), "f").groupBy(*XYZ).agg(F.sum("f").alias("f"))
    return Leaves(sums.select(F.lit(0).cast("int").alias("level"), *XYZ, "f"), CONFIG, XYZ, ("f",), p)


def _cell(level: int, div: str = "") -> str:
    return ", ".join(f"CAST(floor({a} / {8.0 / 2**level}) AS BIGINT) AS {a}" for a in XYZ)


#: Leaves by density, unrolled: a cell of level l is there if all its ancestors hold more than 60 points; it is a leaf if it
#: doesn't itself, or is of the last level. Cells without points come from splitting and hold none.
_DENSE = 60
_TREE = f"""{_PTS}, c0 AS (SELECT {_cell(0)}, count(*) AS n, CAST(sum(f) AS BIGINT) AS s FROM pts GROUP BY 1, 2, 3),
n1 AS (SELECT {_cell(1)}, count(*) AS n FROM pts GROUP BY 1, 2, 3), n2 AS (SELECT {_cell(2)}, count(*) AS n FROM pts GROUP BY 1, 2, 3),
kid(i, j, k) AS (VALUES (0,0,0),(1,0,0),(0,1,0),(1,1,0),(0,0,1),(1,0,1),(0,1,1),(1,1,1)),
t1 AS (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, s FROM c0, kid WHERE n > {_DENSE}),
m1 AS (SELECT t1.*, coalesce(n, 0) AS n FROM t1 LEFT JOIN n1 USING (x, y, z)),
t2 AS (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, s FROM m1, kid WHERE n > {_DENSE}),
m2 AS (SELECT t2.*, coalesce(n, 0) AS n FROM t2 LEFT JOIN n2 USING (x, y, z)),
t3 AS (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, s FROM m2, kid WHERE n > {_DENSE}),
leaf AS (SELECT CAST(0 AS INTEGER) AS level, x, y, z, s AS f FROM c0 WHERE n <= {_DENSE} UNION ALL SELECT CAST(1 AS INTEGER), x, y, z, s FROM m1 WHERE n <= {_DENSE}
  UNION ALL SELECT CAST(2 AS INTEGER), x, y, z, s FROM m2 WHERE n <= {_DENSE} UNION ALL SELECT CAST(3 AS INTEGER), x, y, z, s FROM t3)"""


def _dense(spark, d) -> Leaves:
    return octree.refine_by_density(_level0(spark, d), _DENSE)


@query("octree_from_points", f"WITH {_PTS} SELECT CAST(0 AS INTEGER) AS level, {_cell(0)}, CAST(sum(f) AS DOUBLE) / count(*) AS f FROM pts GROUP BY 2, 3, 4")
def _(spark, d):
    return octree.from_points(_points(spark, d), CONFIG).df


query("refine_density", f"WITH {_TREE} SELECT level, x, y, z, f FROM leaf")(lambda s, d: _dense(s, d).df)
query("counts_by_level", f"WITH {_TREE} SELECT CAST(l AS INTEGER) AS level, count(f) AS n FROM range(4) r(l) LEFT JOIN leaf ON level = l GROUP BY l")(lambda s, d: octree.counts_by_level(_dense(s, d)))


@query("refine_region", f"WITH {_PTS}, c0 AS (SELECT {_cell(0)}, CAST(sum(f) AS BIGINT) AS f FROM pts GROUP BY 1, 2, 3), kid(i, j, k) AS (VALUES (0,0,0),(1,0,0),(0,1,0),(1,1,0),(0,0,1),(1,0,1),(0,1,1),(1,1,1)) SELECT CAST(1 AS INTEGER) AS level, x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, f FROM c0, kid WHERE x < 2 UNION ALL SELECT CAST(0 AS INTEGER), x, y, z, f FROM c0 WHERE x >= 2")
def _(spark, d):
    return octree.refine(_level0(spark, d), 1, ((0.0, 0.0, 0.0), (16.0, 100.0, 100.0))).df


@query("refine_drop_empty", f"WITH {_PTS}, c0 AS (SELECT {_cell(0)}, CAST(sum(f) AS BIGINT) AS f FROM pts GROUP BY 1, 2, 3), c2 AS (SELECT DISTINCT {_cell(2)} FROM pts) SELECT CAST(2 AS INTEGER) AS level, c2.x, c2.y, c2.z, c0.f FROM c2 JOIN c0 ON c0.x = c2.x // 4 AND c0.y = c2.y // 4 AND c0.z = c2.z // 4")
def _(spark, d):
    return octree.refine(_level0(spark, d), 2, drop_empty=True).df


@query("coarsen_sum", f"WITH {_TREE}, lifted AS (SELECT CASE WHEN level > 1 THEN 1 ELSE level END AS level, CASE WHEN level > 1 THEN x // (1 << (level - 1)) ELSE x END AS x, CASE WHEN level > 1 THEN y // (1 << (level - 1)) ELSE y END AS y, CASE WHEN level > 1 THEN z // (1 << (level - 1)) ELSE z END AS z, f FROM leaf) SELECT CAST(level AS INTEGER) AS level, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, CAST(sum(f) AS BIGINT) AS f FROM lifted GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return octree.coarsen(_dense(spark, d), 1, reduction="sum").df


@query("octree_pool_max", f"WITH {_TREE} SELECT CAST(0 AS INTEGER) AS level, CAST(x // (1 << level) AS BIGINT) AS x, CAST(y // (1 << level) AS BIGINT) AS y, CAST(z // (1 << level) AS BIGINT) AS z, max(f) AS f FROM leaf GROUP BY 2, 3, 4")
def _(spark, d):
    return octree.pool(_dense(spark, d), 0, "max").df


_LOCATED = "SELECT p.pid, level AS leaf_level, l.x AS leaf_x, l.y AS leaf_y, l.z AS leaf_z, l.f FROM pts p JOIN leaf l ON floor(p.x / (8.0 / (1 << level))) = l.x AND floor(p.y / (8.0 / (1 << level))) = l.y AND floor(p.z / (8.0 / (1 << level))) = l.z"


@query("locate", f"WITH {_TREE} SELECT pid, leaf_level, leaf_x, leaf_y, leaf_z FROM ({_LOCATED})")
def _(spark, d):
    x = _dense(spark, d)
    return octree.locate(x.points.df, x, XYZ).select("pid", *(f"leaf_{k}" for k in x.keys))


@query("interpolate_nearest", f"WITH {_TREE} SELECT pid, f FROM ({_LOCATED})")
def _(spark, d):
    x = _dense(spark, d)
    return octree_conv.interpolate(x, x.points).select("pid", F.col("f").cast("long").alias("f"))


@query("revoxelise", f"WITH {_TREE} SELECT l.level, l.x, l.y, l.z, coalesce(m, 0) AS f FROM leaf l LEFT JOIN (SELECT leaf_level AS level, leaf_x AS x, leaf_y AS y, leaf_z AS z, CAST(sum(pf) AS DOUBLE) / count(*) AS m FROM (SELECT q.*, p.f AS pf FROM ({_LOCATED}) q JOIN pts p USING (pid)) GROUP BY 1, 2, 3, 4) USING (level, x, y, z)")
def _(spark, d):
    return octree.revoxelise(_dense(spark, d)).df


def _overlapping(spark, d) -> Leaves:
    """The leaves by density, with the cells of level 1 that hold points beside them."""
    x = _dense(spark, d)
    more = octree.from_points(_points(spark, d), CONFIG)
    coarse = more.points.df.select(F.lit(1).alias("level"), *(octree.cell_at(CONFIG, i, F.col(a), 1).alias(a) for i, a in enumerate(XYZ)), F.lit(0).cast("long").alias("f")).distinct()
    return x.with_df(x.df.select("level", *XYZ, "f").unionByName(coarse))


_MIXED = f"{_TREE}, mixed AS (SELECT level, x, y, z FROM leaf UNION ALL SELECT DISTINCT CAST(1 AS INTEGER), {_cell(1)} FROM pts)"
_COVERED = "SELECT DISTINCT m.level, m.x, m.y, m.z FROM mixed m JOIN mixed a ON a.level < m.level AND m.x >> (m.level - a.level) = a.x AND m.y >> (m.level - a.level) = a.y AND m.z >> (m.level - a.level) = a.z"
query("octree_overlaps", f"WITH {_MIXED} {_COVERED}")(lambda s, d: octree.overlaps(_overlapping(s, d)))
query("octree_violations", f"WITH {_MIXED} SELECT *, 'overlap' AS problem FROM ({_COVERED}) UNION ALL SELECT level, x, y, z, 'repeated' FROM mixed GROUP BY ALL HAVING count(*) > 1")(lambda s, d: octree.violations(_overlapping(s, d)))


@query("octree_from_voxels", f"WITH {_PTS} SELECT CAST(2 AS INTEGER) AS level, {_cell(2)}, max(f) AS f FROM pts GROUP BY 2, 3, 4")
def _(spark, d):
    p = _points(spark, d).df.select(F.lit(2).alias("level"), *(octree.cell_at(CONFIG, i, F.col(a), 2).alias(a) for i, a in enumerate(XYZ)), "f")
    return octree.from_voxels(p.groupBy("level", *XYZ).agg(F.max("f").alias("f")), CONFIG, XYZ, ["f"]).df


_KEYS = "level, x, y, z"
query("octree_parents", f"WITH {_TREE} SELECT DISTINCT CAST(level - 1 AS INTEGER) AS level, x // 2 AS x, y // 2 AS y, z // 2 AS z FROM leaf WHERE level > 0")(lambda s, d: octree.parents(_dense(s, d)))


@query("octree_children", f"WITH {_TREE} SELECT CAST(level + 1 AS INTEGER) AS level, x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z FROM leaf, kid")
def _(spark, d):
    x = _dense(spark, d)
    return x.df.select(F.explode(octree.children_of(x)).alias("c")).select("c.*")


@query("octree_index_of", f"WITH {_TREE}, q AS (SELECT DISTINCT CAST(1 AS INTEGER) AS level, {_cell(1)} FROM pts) SELECT {_KEYS}, coalesce(l.f, -1) AS id FROM q LEFT JOIN leaf l USING (level, x, y, z)")
def _(spark, d):
    x = _dense(spark, d)
    q = x.points.df.select(F.lit(1).alias("level"), *(octree.cell_at(CONFIG, i, F.col(a), 1).alias(a) for i, a in enumerate(XYZ))).distinct()
    return octree.index_of(x, q, x.df.withColumnRenamed("f", "id")).select("level", *XYZ, "id")


@query("octree_with_features", f"WITH {_TREE} SELECT {_KEYS}, x + 10 * y + 100 * z AS g FROM leaf")
def _(spark, d):
    x = _dense(spark, d)
    return octree.with_features(x, x.df.withColumn("g", F.col("x") + 10 * F.col("y") + 100 * F.col("z")), ["g"]).df


_STATS = ", ".join(f"v{l} AS (SELECT {_cell(l)}, CAST(sum(CAST(f AS DOUBLE) * f) AS DOUBLE) / count(*) - pow(CAST(sum(f) AS DOUBLE) / count(*), 2) > 5e11 AS hot FROM pts GROUP BY 1, 2, 3)" for l in range(3))
_KID = "kid(i, j, k) AS (VALUES (0,0,0),(1,0,0),(0,1,0),(1,1,0),(0,0,1),(1,0,1),(0,1,1),(1,1,1))"


def _splitting(hot: str) -> str:
    """The levels of a tree whose leaves split where ``hot``, which may name the level."""
    parts = [f"s0 AS (SELECT *, {hot.format(0)} AS split FROM c0_ c)"]
    for level in (1, 2):
        parts.append(f"s{level} AS (SELECT *, {hot.format(level)} AS split FROM (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, f FROM s{level - 1}, kid WHERE split) c)")
    parts.append("s3 AS (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, f, false AS split FROM s2, kid WHERE split)")
    return f"{_PTS}, c0_ AS (SELECT {_cell(0)}, CAST(sum(f) AS BIGINT) AS f FROM pts GROUP BY 1, 2, 3), {_KID}, {_STATS}, " + ", ".join(parts)


_LEVELS = " UNION ALL ".join(f"SELECT CAST({l} AS INTEGER) AS level, x, y, z, f FROM s{l} WHERE NOT split" for l in range(4))
query("refine_variance", f"WITH {_splitting('coalesce((SELECT hot FROM v{0} v WHERE v.x = c.x AND v.y = c.y AND v.z = c.z), false)')} {_LEVELS}")(lambda s, d: octree.refine_by_variance(_level0(s, d), 5e11).df)
query("refine_if", f"WITH {_splitting('c.x % 3 = 0')} {_LEVELS}")(lambda s, d: octree.refine_if(_level0(s, d), lambda x: (F.col("x") % 3 == 0)).df)
query(
    "resample_uniform",
    f"WITH {_TREE}, two AS (SELECT x, y, z, CAST(f AS DOUBLE) AS f FROM leaf WHERE level = 2 UNION ALL SELECT x // 2, y // 2, z // 2, avg(f) FROM leaf WHERE level = 3 GROUP BY 1, 2, 3) SELECT CAST(1 AS INTEGER) AS level, x, y, z, CAST(f AS DOUBLE) AS f FROM leaf WHERE level = 1 UNION ALL SELECT 1, x * 2 + i, y * 2 + j, z * 2 + k, f FROM leaf, kid WHERE level = 0 UNION ALL SELECT 1, x // 2, y // 2, z // 2, avg(f) FROM two GROUP BY 2, 3, 4",
)(lambda s, d: octree.resample_uniform(_dense(s, d), 1).df)
query(
    "resample_to",
    f"WITH {_TREE}, ones AS (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z FROM c0, kid), lifted AS (SELECT x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, f FROM leaf, kid WHERE level = 0 UNION ALL SELECT x >> (level - 1), y >> (level - 1), z >> (level - 1), f FROM leaf WHERE level > 0) SELECT CAST(1 AS INTEGER) AS level, x, y, z, coalesce(avg(f), 0) AS f FROM ones LEFT JOIN lifted USING (x, y, z) GROUP BY x, y, z",
)(lambda s, d: octree.resample_to(_dense(s, d), octree.refine(_level0(s, d), 1)).df)
query("octree_geometry", f"WITH {_TREE} SELECT level, x, y, z, 8.0::DOUBLE / (1 << level) AS size, pow(8.0::DOUBLE / (1 << level), 3) AS volume, {', '.join(f'{a} * 8.0::DOUBLE / (1 << level) AS lo_{a}, ({a} + 1) * 8.0::DOUBLE / (1 << level) AS hi_{a}, ({a} + 0.5) * 8.0::DOUBLE / (1 << level) AS center_{a}' for a in XYZ)} FROM leaf")(lambda s, d: octree.geometry(_dense(s, d)))
query("octree_global_average", f"WITH {_TREE} SELECT CAST(sum(f * (512 // (1 << (3 * level)))) AS DOUBLE) / sum(512 // (1 << (3 * level))) AS f FROM leaf")(lambda s, d: octree.global_average(_dense(s, d)))
def _box(value: str) -> str:
    return "'[' || " + " || ',' || ".join(f"CAST({value.format(a)} AS VARCHAR)" for a in XYZ) + " || ']'"


_SIZE = "(8.0::DOUBLE / (1 << level))"
query(
    "octree_json",
    f"""WITH {_TREE} SELECT '{{"coordinates":' || {_box('{0}')} || ',"level":' || level || ',"min":' || {_box('{0} * ' + _SIZE)} || ',"max":' || {_box('({0} + 1) * ' + _SIZE)} || ',"center":' || {_box('({0} + 0.5) * ' + _SIZE)} || ',"size":' || {_SIZE} || ',"occupied":' || CASE WHEN f > 0 THEN 'true' ELSE 'false' END || '}}' AS value FROM leaf""",
)(lambda s, d: leaves_json(_dense(s, d)))
_MEETS = " AND ".join(f"{a}hi > l.{a} * ls AND {a}lo < (l.{a} + 1) * ls" for a in XYZ)
_SHARE = " * ".join(f"(least({a}hi, (l.{a} + 1) * ls) - greatest({a}lo, l.{a} * ls))" for a in XYZ)
query(
    "multilinear",
    f"""WITH {_TREE}, spots AS (SELECT DISTINCT x, y, z FROM pts), at_ AS (SELECT p.x, p.y, p.z, {_SIZE} AS size FROM spots p JOIN leaf l ON {' AND '.join(f'floor(p.{a} / {_SIZE}) = l.{a}' for a in XYZ)}),
    box AS (SELECT *, {', '.join(f'{a} - size / 2 AS {a}lo, {a} + size / 2 AS {a}hi' for a in XYZ)} FROM at_), l AS (SELECT *, {_SIZE} AS ls FROM leaf),
    got AS (SELECT box.x, box.y, box.z, round(sum(f * {_SHARE}) / sum({_SHARE}), 3) AS f FROM box JOIN l ON {_MEETS} GROUP BY 1, 2, 3)
    SELECT pid, coalesce(got.f, 0) AS f FROM pts LEFT JOIN got USING (x, y, z)""",
)(lambda s, d: octree_conv.interpolate(_dense(s, d), _points(s, d), "multilinear").select("pid", F.round("f", 3).alias("f")))
query(
    "interpolate_fallback",
    f"""WITH {_PTS}, c0 AS (SELECT {_cell(0)}, CAST(sum(f) AS BIGINT) AS f FROM pts GROUP BY 1, 2, 3), c2 AS (SELECT DISTINCT {_cell(2)} FROM pts),
    leaf AS (SELECT c2.x, c2.y, c2.z, c0.f FROM c2 JOIN c0 ON c0.x = c2.x // 4 AND c0.y = c2.y // 4 AND c0.z = c2.z // 4),
    one AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, avg(f) AS f FROM leaf GROUP BY 1, 2, 3), zero AS (SELECT x // 4 AS x, y // 4 AS y, z // 4 AS z, avg(f) AS f FROM leaf GROUP BY 1, 2, 3), q AS (SELECT pid, x + 1 AS x, y + 1 AS y, z + 1 AS z FROM pts)
    SELECT pid, round(coalesce(l.f, one.f, zero.f, 0), 3) AS f FROM q LEFT JOIN leaf l ON l.x = q.x // 2 AND l.y = q.y // 2 AND l.z = q.z // 2 LEFT JOIN one ON one.x = q.x // 4 AND one.y = q.y // 4 AND one.z = q.z // 4 LEFT JOIN zero ON zero.x = q.x // 8 AND zero.y = q.y // 8 AND zero.z = q.z // 8""",
)(lambda s, d: octree_conv.interpolate(octree.refine(_level0(s, d), 2, drop_empty=True), _shifted(s, d), coarser_ancestor=True).select("pid", F.round(F.col("f").cast("double"), 3).alias("f")))
query("octree_add", f"WITH {_TREE} SELECT level, x, y, z, f + f % 1000 AS f FROM leaf")(lambda s, d: (lambda x: octree.add(x, x.with_df(x.df.withColumn("f", F.col("f") % 1000))).df)(_dense(s, d)))
query("octree_concatenate", f"WITH {_TREE} SELECT level, x, y, z, f, f % 1000 AS f_1 FROM leaf")(lambda s, d: (lambda x: octree.concatenate(x, x.with_df(x.df.withColumn("f", F.col("f") % 1000))).df)(_dense(s, d)))


@query("octree_overlaps_nested", f"WITH {_PTS}, c0 AS (SELECT DISTINCT {_cell(0)} FROM pts), c2 AS (SELECT DISTINCT {_cell(2)} FROM pts WHERE z < 4) SELECT DISTINCT CAST(2 AS INTEGER) AS level, c2.x, c2.y, c2.z FROM c2 JOIN c0 ON c0.x = c2.x // 4 AND c0.y = c2.y // 4 AND c0.z = c2.z // 4")
def _(spark, d):
    """Level-0 leaves and, wrongly, some level-2 cells under them."""
    x = _level0(spark, d)
    p = x.points.df.filter("z < 4")
    under = p.select(F.lit(2).cast("int").alias("level"), *(octree.cell_at(CONFIG, i, F.col(a), 2).alias(a) for i, a in enumerate(XYZ)), F.col("f")).groupBy("level", *XYZ).agg(F.sum("f").alias("f"))
    return octree.overlaps(x.with_df(x.df.unionByName(under))).select("level", *XYZ).distinct()


def _shifted(spark, d) -> Points:
    p = _points(spark, d)
    return Points(p.df.select("pid", "b", *((F.col(a) + 1.0).alias(a) for a in XYZ)), XYZ, ())


# -- convolution over mixed levels; weights are integers, and all volumes powers of two

_TAPS = ", ".join(f"({k}, {o[0]}, {o[1]}, {o[2]}, {weight(k)})" for k, o in enumerate(cube_first_axis_slowest(3, 3)))
_W = np.array([[[weight(k)]] for k in range(27)])


def _hit_sql(condition: str, outs: str = "leaf") -> str:
    """A tap (cell of the output's level) against leaves of each level: those that cover it, and finer ones."""
    into = "ol, oox, ooy, ooz, k, w, i.f, i.level AS il, i.x AS ix, i.y AS iy, i.z AS iz, {0} AS finer FROM tap JOIN leaf i ON "
    return f"""WITH {_TREE}, up AS (SELECT DISTINCT CAST(greatest(level - 1, 0) AS INTEGER) AS level, x >> least(level, 1) AS x, y >> least(level, 1) AS y, z >> least(level, 1) AS z FROM leaf),
    lifted AS (SELECT * FROM up a WHERE NOT EXISTS (SELECT 1 FROM up b WHERE b.level < a.level AND b.x = a.x >> (a.level - b.level) AND b.y = a.y >> (a.level - b.level) AND b.z = a.z >> (a.level - b.level))),
    taps(k, ox, oy, oz, w) AS (VALUES {_TAPS}), tap AS (SELECT level AS ol, l.x AS oox, l.y AS ooy, l.z AS ooz, k, w, l.x + ox AS tx, l.y + oy AS ty, l.z + oz AS tz FROM {outs} l, taps),
    hit AS ({" UNION ALL ".join(f"SELECT {into.format('false')} i.level = {v} AND ol >= {v} AND i.x = tx >> (ol - {v}) AND i.y = ty >> (ol - {v}) AND i.z = tz >> (ol - {v})" for v in range(4))}
      {"".join(f" UNION ALL SELECT {into.format('true')} i.level = {v} AND ol = {o} AND {condition.format(g=v - o, h=1 << (v - o), m=1 << (v - o - 1))}" for v in (1, 2, 3) for o in range(v))})"""


def _tap_sql(condition: str, w: str, outs: str = "leaf") -> str:
    return f"""{_hit_sql(condition, outs)}, s AS (SELECT ol AS level, oox AS x, ooy AS y, ooz AS z, sum({w}) AS f0 FROM hit GROUP BY 1, 2, 3, 4)
    SELECT level, x, y, z, CAST(coalesce(f0, 0) AS DOUBLE) AS f0 FROM {outs} LEFT JOIN s USING (level, x, y, z)"""


_CENTER = "i.x = tx * {h} + {m} AND i.y = ty * {h} + {m} AND i.z = tz * {h} + {m}"
_UNDER = "i.x >> {g} = tx AND i.y >> {g} = ty AND i.z >> {g} = tz"
_RATIO = "power(8.0::DOUBLE, ol - il)"
query("adaptive_conv_center", _tap_sql(_CENTER, "w * f"))(lambda s, d: octree_conv.convolve(_dense(s, d), _W, 3).df)
query("adaptive_conv_volume", _tap_sql(_CENTER, f"w * f * {_RATIO}"))(lambda s, d: octree_conv.convolve(_dense(s, d), _W, 3, "volume").df)
query("adaptive_conv_overlap", _tap_sql(_UNDER, f"w * f * least(1, {_RATIO})"))(lambda s, d: octree_conv.convolve(_dense(s, d), _W, 3, "overlap").df)
query("adaptive_conv_strided", _tap_sql(_CENTER, "w * f", "lifted"))(lambda s, d: octree_conv.convolve(_dense(s, d), _W, 3, shift=1).df)
query(
    "adaptive_conv_transpose",
    f"{_hit_sql(_CENTER)}, s AS (SELECT il AS level, ix AS x, iy AS y, iz AS z, sum(w * o.f) AS f0 FROM hit JOIN leaf o ON o.level = ol AND o.x = oox AND o.y = ooy AND o.z = ooz GROUP BY 1, 2, 3, 4) SELECT level, x, y, z, CAST(coalesce(f0, 0) AS DOUBLE) AS f0 FROM leaf LEFT JOIN s USING (level, x, y, z)",
)(lambda s, d: (lambda x: octree_conv.convolve_transpose(x, _W, x, 3).df)(_dense(s, d)))
query(
    "adaptive_kernel_map",
    f"{_hit_sql(_UNDER)} SELECT CAST(k AS INTEGER) AS k, CAST(ol AS INTEGER) AS out_level, oox AS out_x, ooy AS out_y, ooz AS out_z, CAST(il AS INTEGER) AS in_level, ix AS in_x, iy AS in_y, iz AS in_z, CASE WHEN finer THEN {_RATIO} ELSE 1 END AS w FROM hit",
)(lambda s, d: octree_conv.kernel_map(_dense(s, d), 3, "overlap"))
query("sphere")(lambda s, d: sphere.voxelise_sphere(s, 100.0, 99.5)[0].df)
query("sphere_volume")(lambda s, d: sphere.volume_estimate(sphere.voxelise_sphere(s, 100.0, 99.0)[0]))


# -- clips of frames: hours in which a user did something

_HOURS = "hours AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"


def _hours(spark, d):
    h = F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("frame")
    return table(spark, d, "events").select("user_id", h).filter("user_id is not null and frame is not null").distinct()


_ISLANDS = "isl AS (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS island FROM hours)"
query("islands", f"WITH {_HOURS}, {_ISLANDS} SELECT * FROM isl")(lambda s, d: islands(_hours(s, d), key=["user_id"]))


@query("clip_segments", f"WITH {_HOURS}, {_ISLANDS} SELECT user_id, start FROM (SELECT user_id, frame AS start, count(*) OVER (PARTITION BY user_id, island ORDER BY frame ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM isl) WHERE n = 2")
def _(spark, d):
    return sliding(_hours(spark, d), 2, key=["user_id"]).select("user_id", "start")


query("clips", f"WITH {_HOURS} SELECT a.user_id, a.frame AS first, b.frame AS second FROM hours a JOIN hours b ON a.user_id = b.user_id AND b.frame - a.frame BETWEEN 1 AND 3")(
    lambda s, d: clips(_hours(s, d), 2, 2, key=["user_id"]).select("user_id", F.col("frames")[0].alias("first"), F.col("frames")[1].alias("second"))
)


@query("radius_label", f"WITH {CELLS}, t AS (SELECT DISTINCT b, x AS tx, y AS ty, z AS tz FROM cells WHERE f > 9000000), v AS (SELECT DISTINCT b, x, y, z FROM cells) SELECT b, x, y, z, CAST(EXISTS (SELECT 1 FROM t WHERE t.b = v.b AND (x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz) <= 4) AS INTEGER) AS label FROM v")
def _(spark, d):
    t = cells(spark, d).filter("f > 9000000").select("b", *(F.col(a).alias(f"t{a}") for a in XYZ)).distinct()
    v = cells(spark, d).select("b", *XYZ).distinct()
    return radius_labels(v, t, 2.0, key=["b"]).select("b", *XYZ, F.col("label").cast("int").alias("label"))


_LABELLED = "hit AS (SELECT CAST(f > 5000000 AS INTEGER) AS label, CAST(x > 20 AS INTEGER) AS predicted FROM cells)"


def _hits(spark, d):
    return cells(spark, d).select((F.col("f") > 5000000).cast("int").alias("label"), (F.col("x") > 20).cast("int").alias("predicted"))


query("class_balance", f"WITH {CELLS}, {_LABELLED} SELECT CAST(sum(label) AS BIGINT) AS positives, count(*) AS n, CAST(count(*) - sum(label) AS DOUBLE) / sum(label) AS pos_weight FROM hit")(lambda s, d: class_balance(_hits(s, d)))
query("recall", f"WITH {CELLS}, {_LABELLED} SELECT CAST(sum(label * predicted) AS DOUBLE) / sum(label) AS recall FROM hit")(lambda s, d: recall(_hits(s, d)))


@query(
    "clip_features",
    f"""WITH {CELLS}, pts AS (SELECT DISTINCT pid, b, x, y, f FROM cells) SELECT pid, round((f - avg(f) OVER (PARTITION BY b)) / stddev_pop(f) OVER (PARTITION BY b), 6) + 0.0::DOUBLE AS f0,
    CAST(least(x, 10) AS DOUBLE) / 10 AS f1, CAST(y AS DOUBLE) / 9 AS f2 FROM pts""",
)
def _(spark, d):
    rows = cells(spark, d).select("pid", "b", "x", "y", "f").distinct()
    return scaled(rows, "b", "f", "x", "y").select("pid", F.round("f0", 6).alias("f0"), "f1", "f2")
