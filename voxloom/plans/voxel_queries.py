"""Queries of the operators on voxels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxloom.functions import channels, losses
from voxloom.functions.offsets import Kernel
from voxloom.model import Points, Voxels
from voxloom.operators import conv, coords, norm, pool, setops

from . import blocks
from .registry import Registry
from .views import CELLS, POINTS, VOX, XYZ, cells, points, table, taps_sql, voxels, weight

REGISTRY = query = Registry()

CUBE3 = Kernel(3)
CUSTOM = Kernel(shape="custom", offsets=((0, 0, 0), (1, 0, 0), (0, -2, 0), (1, 1, 1)))


def _weights(kernel: Kernel) -> np.ndarray:
    return np.array([[[weight(k)]] for k in range(kernel.volume(3))])


def _snap(step: int, prefix: str = "") -> str:
    return ", ".join(f"CAST(floor({prefix}{a} / {step}.0) * {step} AS BIGINT) AS {a}" for a in XYZ)


def _grouped(aggregate: str) -> str:
    return f"WITH {CELLS} SELECT b, x, y, z, {aggregate} FROM cells GROUP BY b, x, y, z"


# -- coordinates


@query("quantize_sum", _grouped("CAST(sum(f) AS BIGINT) AS f"))
def _(spark, d):
    return voxels(spark, d).df


@query("quantize_max", _grouped("max(f) AS f"))
def _(spark, d):
    return pool.voxelise(cells(spark, d), XYZ, ["f"], "max").df


@query("quantize_avg_cents", _grouped("CAST(sum(f) AS DOUBLE) / count(*) AS f"))
def _(spark, d):
    df = pool.voxelise(cells(spark, d).withColumn("n", F.lit(1).cast("long")), XYZ, ["f", "n"], "sum").df
    return df.select("b", *XYZ, (F.col("f").cast("double") / F.col("n")).alias("f"))


@query("quantize_first", _grouped("arg_min(f, pid) AS f"))
def _(spark, d):
    return pool.voxelise(cells(spark, d), XYZ, ["f"], "first", "pid").df


@query("quantize_none", f"WITH {CELLS} SELECT b, x, y, z, f FROM cells")
def _(spark, d):
    return pool.voxelise(cells(spark, d), XYZ, ["f"], "none").df


@query("unique_map", _grouped("min(pid) AS unique_index"))
def _(spark, d):
    return coords.unique_map(cells(spark, d), ["b", *XYZ], "pid")


@query("inverse_map", f"WITH {CELLS} SELECT pid, min(pid) OVER (PARTITION BY b, x, y, z) AS unique_index FROM cells")
def _(spark, d):
    return coords.inverse_map(cells(spark, d), ["b", *XYZ], "pid")


@query("find", f"WITH {VOX}, q AS (SELECT DISTINCT b, x + 1 AS x, y, z FROM cells WHERE l_returnflag = 'A') SELECT q.b, q.x, q.y, q.z, f FROM q JOIN vox USING (b, x, y, z)")
def _(spark, d):
    q = cells(spark, d).filter("l_returnflag = 'A'").select("b", (F.col("x") + 1).alias("x"), "y", "z").distinct()
    return coords.find(voxels(spark, d), q).select("b", *XYZ, "f")


@query("stride2", f"WITH {VOX} SELECT DISTINCT b, {_snap(2)} FROM vox")
def _(spark, d):
    return coords.stride(voxels(spark, d), 2).df


@query("stride_map", f"WITH {VOX} SELECT b, x, y, z, {', '.join(f'CAST(floor({a} / 2.0) * 2 AS BIGINT) AS out_{a}' for a in XYZ)} FROM vox")
def _(spark, d):
    return coords.stride_map(voxels(spark, d), 2)


@query("stride_region", f"WITH {VOX}, {taps_sql(CUBE3.taps(3))} SELECT DISTINCT b, x + ox AS x, y + oy AS y, z + oz AS z FROM vox, taps WHERE (x + ox) % 2 = 0 AND (y + oy) % 2 = 0 AND (z + oz) % 2 = 0")
def _(spark, d):
    return coords.stride_region(voxels(spark, d), CUBE3, 2).df


@query("origin", f"WITH {CELLS} SELECT DISTINCT b, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS z FROM cells")
def _(spark, d):
    return coords.origin(voxels(spark, d))


@query("origin_map", f"WITH {VOX} SELECT b, x, y, z, b AS out_b FROM vox")
def _(spark, d):
    return coords.origin_map(voxels(spark, d))


@query("prune", f"WITH {VOX} SELECT * FROM vox WHERE f > 5000000")
def _(spark, d):
    return coords.prune(voxels(spark, d), F.col("f") > 5000000).df


@query("prune_backward", f"WITH {VOX} SELECT b, x, y, z, CASE WHEN f > 5000000 THEN f % 7 ELSE 0 END AS f FROM vox")
def _(spark, d):
    v = voxels(spark, d)
    return coords.prune_backward(v, coords.prune(v, F.col("f") > 5000000).map(lambda c: c % 7)).df


@query("prune_by_set", f"WITH {VOX} SELECT * FROM vox WHERE (b, x, y, z) IN (SELECT (b, x, y, z) FROM cells WHERE l_returnflag = 'R')")
def _(spark, d):
    return coords.prune(voxels(spark, d), cells(spark, d).filter("l_returnflag = 'R'")).df


@query("merge", f"WITH {CELLS} SELECT DISTINCT b, x, y, z FROM cells WHERE l_returnflag IN ('A', 'R')")
def _(spark, d):
    return coords.merge(*(voxels(spark, d, F.col("l_returnflag") == r, r) for r in "AR")).df


@query("union_map", f"WITH {CELLS} SELECT DISTINCT b, x, y, z, CAST(CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS INTEGER) AS part FROM cells WHERE l_returnflag IN ('A', 'R')")
def _(spark, d):
    return coords.union_map(*(voxels(spark, d, F.col("l_returnflag") == r, r) for r in "AR"))


@query("quantize_field", f"WITH {POINTS} SELECT pid, b, CAST(floor((x + 0.5) / 4) * 4 AS BIGINT) AS x, CAST(floor((y + 0.5) / 4) * 4 AS BIGINT) AS y, CAST(floor((z + 0.5) / 4) * 4 AS BIGINT) AS z, CAST(f AS DOUBLE) AS f FROM pts")
def _(spark, d):
    return coords.quantise(points(spark, d), 4)


@query("field_map", f"WITH {VOX}, pts AS (SELECT DISTINCT pid, b, x, y, z, f FROM cells), kept AS (SELECT * FROM vox WHERE f > 5000000) SELECT pid, b, x, y, z FROM pts JOIN (SELECT b, x, y, z FROM kept) USING (b, x, y, z)")
def _(spark, d):
    return coords.field_map(points(spark, d), coords.prune(voxels(spark, d), F.col("f") > 5000000))


@query("field_sum", f"WITH {POINTS} SELECT b, x, y, z, CAST(sum(f) AS BIGINT) AS f FROM pts GROUP BY b, x, y, z")
def _(spark, d):
    return pool.sparse(points(spark, d), 1, "sum").cast("long").df


@query("inverse_field", f"WITH {VOX}, pts AS (SELECT DISTINCT pid, b, x, y, z, f FROM cells) SELECT pid, vox.f AS f FROM pts JOIN vox USING (b, x, y, z)")
def _(spark, d):
    return pool.slice_back(points(spark, d), voxels(spark, d))


@query("sparse_quantize_label", f"WITH {CELLS} SELECT CAST(floor(x / 4.0) AS BIGINT) AS x, CAST(floor(y / 4.0) AS BIGINT) AS y, CAST(floor(z / 4.0) AS BIGINT) AS z, b, min(pid) AS unique_index, arg_min(f, pid) AS f, CAST(CASE WHEN min(ascii(l_linestatus)) = max(ascii(l_linestatus)) THEN min(ascii(l_linestatus)) ELSE -100 END AS INTEGER) AS label FROM cells GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return coords.sparse_quantise(cells(spark, d).withColumn("label", F.ascii("l_linestatus")), XYZ, 4, ["f"], "label", batch="b")


@query("kernel_map_count", f"WITH {VOX}, {taps_sql(CUBE3.taps(3))} SELECT CAST(k AS INTEGER) AS k, count(*) AS n FROM (SELECT b, x + ox AS x, y + oy AS y, z + oz AS z, k FROM vox, taps) JOIN vox USING (b, x, y, z) GROUP BY k")
def _(spark, d):
    return coords.kernel_map(voxels(spark, d), CUBE3).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_CROSS = Kernel(3, shape="cross")


@query("kernel_map", f"WITH {VOX}, {taps_sql(_CROSS.taps(3))}, coarse AS (SELECT DISTINCT b, {_snap(2)} FROM vox) SELECT CAST(k AS INTEGER) AS k, o.b, o.x, o.y, o.z, i.x AS in_x, i.y AS in_y, i.z AS in_z FROM (SELECT *, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM coarse, taps) o JOIN vox i ON i.b = o.b AND i.x = nx AND i.y = ny AND i.z = nz")
def _(spark, d):
    v = voxels(spark, d)
    return coords.kernel_map(v, _CROSS, coords.stride(v, 2))


@query("kernel_map_transposed", f"WITH {VOX}, {taps_sql(_CROSS.taps(3))}, coarse AS (SELECT DISTINCT b, {_snap(2)} FROM vox) SELECT CAST(k AS INTEGER) AS k, o.b, o.x, o.y, o.z, i.x AS in_x, i.y AS in_y, i.z AS in_z FROM (SELECT *, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM coarse, taps) i JOIN vox o ON i.b = o.b AND o.x = nx AND o.y = ny AND o.z = nz")
def _(spark, d):
    v = voxels(spark, d)
    return coords.kernel_map(coords.stride(v, 2), _CROSS, v, transposed=True)


@query("decomposed_sizes", f"WITH {VOX} SELECT b, count(*) AS n FROM vox GROUP BY b")
def _(spark, d):
    return coords.decomposed_sizes(voxels(spark, d))


@query("decomposed", f"WITH {VOX} SELECT * FROM vox WHERE b = 3")
def _(spark, d):
    return coords.decomposed(voxels(spark, d), 3).df


@query("batched", f"WITH {CELLS} SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS INTEGER) AS b, x, y, z, f FROM cells WHERE l_returnflag IN ('A', 'R')")
def _(spark, d):
    return coords.batched([cells(spark, d).filter(F.col("l_returnflag") == r).select(*((F.col(a) + 0.5).alias(a) for a in XYZ), "f") for r in "AR"])


@query("limit_points", f"WITH {CELLS}, n AS (SELECT x AS sample, count(*) AS n FROM cells GROUP BY x), s AS (SELECT sample, sum(n) OVER (ORDER BY sample) AS total, CAST(row_number() OVER (ORDER BY sample) - 1 AS INTEGER) AS b FROM n) SELECT s.sample, y, z, f, s.b FROM cells JOIN s ON x = s.sample WHERE total <= 3000")
def _(spark, d):
    return coords.limit_points(cells(spark, d).select(F.col("x").alias("sample"), "y", "z", "f"), "sample", 3000)


# -- convolution


def _conv_sql(kernel: Kernel, stride: int = 1, out: str | None = None, value: str = "w * i.f", bias: int = 0) -> str:
    coarse = out or ("SELECT b, x, y, z FROM vox" if stride == 1 else f"SELECT DISTINCT b, {_snap(stride)} FROM vox")
    return f"WITH {VOX}, {taps_sql(kernel.taps(3))}, outs AS ({coarse}) SELECT o.b, o.x, o.y, o.z, CAST(coalesce(sum({value}), 0) + {bias} AS BIGINT) AS f0 FROM (SELECT *, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM outs, taps) o LEFT JOIN vox i ON i.b = o.b AND i.x = nx AND i.y = ny AND i.z = nz GROUP BY o.b, o.x, o.y, o.z"


def _conv(kernel: Kernel, stride: int = 1, **more):
    return lambda spark, d: conv.convolve(voxels(spark, d), _weights(kernel), kernel, stride, **more).df


for _name, _kernel, _stride in (
    ("conv3", CUBE3, 1),
    ("conv_stride2", CUBE3, 2),
    ("conv_k2", Kernel(2), 2),
    ("conv_cross", _CROSS, 1),
    ("conv_dilated", Kernel(3, 2), 1),
    ("conv_custom", CUSTOM, 1),
    ("conv_wide", Kernel((5, 1, 3)), 1),
):
    query(_name, _conv_sql(_kernel, _stride))(_conv(_kernel, _stride))


#: Kernels without the centre, so some outputs are reached by nothing.
_OFF = Kernel(shape="custom", offsets=((1, 0, 0), (0, -2, 0), (1, 1, 1)))
query("conv_unreached", _conv_sql(_OFF))(_conv(_OFF))
query("conv_bias_unreached", _conv_sql(_OFF, 2, bias=7))(_conv(_OFF, 2, bias=[7]))
query("conv_expand", _conv_sql(_CROSS, 1, f"SELECT DISTINCT b, x + ox AS x, y + oy AS y, z + oz AS z FROM vox, taps"))(_conv(_CROSS, 1, expand=True))


@query("conv_pointwise", f"WITH {VOX} SELECT b, x, y, z, 3 * f + 1 AS f0, -2 * f + 5 AS f1 FROM vox")
def _(spark, d):
    return conv.convolve(voxels(spark, d), np.array([[[3, -2]]]), Kernel(1), bias=[1, 5]).df


@query("conv_channels", f"WITH {VOX}, {taps_sql(_CROSS.taps(3))}, two AS (SELECT *, f % 1000 AS g FROM vox) SELECT o.b, o.x, o.y, o.z, CAST(sum(w * i.f + (k + 1) * i.g) AS BIGINT) AS f0, CAST(sum((2 - k) * i.f - w * i.g) AS BIGINT) AS f1 FROM (SELECT b, x, y, z, k, w, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM two, taps) o JOIN two i ON i.b = o.b AND i.x = nx AND i.y = ny AND i.z = nz GROUP BY o.b, o.x, o.y, o.z")
def _(spark, d):
    v = voxels(spark, d)
    two = v.with_df(v.df.withColumn("g", F.col("f") % 1000), ["f", "g"])
    w = np.array([[[weight(k), 2 - k], [k + 1, -weight(k)]] for k in range(_CROSS.volume(3))])
    return conv.convolve(two, w, _CROSS).df


_COARSE = f"coarse AS (SELECT b, {_snap(2)}, CAST(sum(f) AS BIGINT) AS f FROM vox GROUP BY 1, 2, 3, 4)"


def _coarse(spark, d) -> Voxels:
    return pool.pool(voxels(spark, d), Kernel(2), 2, "sum")


@query("conv_transpose", f"WITH {VOX}, {_COARSE}, {taps_sql(CUBE3.taps(3))} SELECT o.b, o.x, o.y, o.z, CAST(coalesce(sum(w * i.f), 0) AS BIGINT) AS f0 FROM vox o LEFT JOIN (SELECT *, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM coarse, taps) i ON i.b = o.b AND o.x = nx AND o.y = ny AND o.z = nz GROUP BY o.b, o.x, o.y, o.z")
def _(spark, d):
    return conv.convolve_transpose(_coarse(spark, d), _weights(CUBE3), CUBE3, 2, out=voxels(spark, d)).df


@query("conv_transpose_unreached", f"WITH {VOX}, {_COARSE}, {taps_sql(_OFF.taps(3))} SELECT o.b, o.x, o.y, o.z, CAST(coalesce(sum(w * i.f), 0) + 7 AS BIGINT) AS f0 FROM vox o LEFT JOIN (SELECT *, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM coarse, taps) i ON i.b = o.b AND o.x = nx AND o.y = ny AND o.z = nz GROUP BY o.b, o.x, o.y, o.z")
def _(spark, d):
    return conv.convolve_transpose(_coarse(spark, d), _weights(_OFF), _OFF, 2, bias=[7], out=voxels(spark, d)).df


@query("conv_generative", f"WITH {VOX}, {_COARSE}, {taps_sql(Kernel(2).taps(3))} SELECT b, x + ox AS x, y + oy AS y, z + oz AS z, CAST(sum(w * f) AS BIGINT) AS f0 FROM coarse, taps GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return conv.convolve_transpose(_coarse(spark, d), _weights(Kernel(2)), Kernel(2), 2).df


@query("conv_backward_input", f"WITH {VOX}, {taps_sql(_CROSS.taps(3))} SELECT i.b, i.x, i.y, i.z, CAST(coalesce(sum(w * g), 0) AS BIGINT) AS f FROM vox i LEFT JOIN (SELECT b, x + ox AS x, y + oy AS y, z + oz AS z, w, f % 7 AS g FROM vox, taps) o USING (b, x, y, z) GROUP BY i.b, i.x, i.y, i.z")
def _(spark, d):
    v = voxels(spark, d)
    return conv.convolve_backward(v, v.map(lambda c: c % 7), _weights(_CROSS), _CROSS)[0].df


@query("conv_backward_weight", f"WITH {VOX}, {taps_sql(_CROSS.taps(3))} SELECT CAST(k AS INTEGER) AS k, CAST(0 AS INTEGER) AS ci, CAST(0 AS INTEGER) AS co, CAST(sum(i.f * g) AS BIGINT) AS value FROM (SELECT b, x + ox AS x, y + oy AS y, z + oz AS z, k, f % 7 AS g FROM vox, taps) o JOIN vox i USING (b, x, y, z) GROUP BY k")
def _(spark, d):
    v = voxels(spark, d)
    return conv.convolve_backward(v, v.map(lambda c: c % 7), _weights(_CROSS), _CROSS)[1]


_PART = "part_cents AS (SELECT p_partkey AS l_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)"


def _matrix(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("value"))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("col"), F.round(F.col("p_retailprice") * 100).cast("long").alias("c"))
    return m, x


@query("spmm", f"WITH {_PART} SELECT l_orderkey AS row, CAST(sum(CAST(l_quantity AS BIGINT) * c) AS BIGINT) AS c FROM lineitem JOIN part_cents USING (l_partkey) GROUP BY l_orderkey")
def _(spark, d):
    return conv.spmm(*_matrix(spark, d), ["c"])


@query("spmm_avg", f"WITH {_PART} SELECT l_orderkey AS row, CAST(sum(c) AS DOUBLE) / count(*) AS c FROM lineitem JOIN part_cents USING (l_partkey) GROUP BY l_orderkey")
def _(spark, d):
    return conv.spmm_average(*_matrix(spark, d), ["c"])


@query("spmm_backward", "SELECT l_partkey AS col, CAST(sum(CAST(l_quantity AS BIGINT) * (l_orderkey % 13)) AS BIGINT) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def _(spark, d):
    grad = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 13).alias("g"))
    return conv.spmm_backward(_matrix(spark, d)[0], grad, ["g"])


@query("spmm_avg_backward", "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_partkey AS col, round(sum(CAST(l_orderkey % 13 AS DOUBLE) / n), 6) AS g FROM lineitem JOIN n USING (l_orderkey) JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def _(spark, d):
    grad = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 13).cast("double").alias("g"))
    return conv.spmm_average_backward(_matrix(spark, d)[0].drop("value"), grad, ["g"]).select("col", F.round("g", 6).alias("g"))


# -- pooling


def _pool_sql(kernel: Kernel, stride: int, aggregate: str) -> str:
    return _conv_sql(kernel, stride).replace("CAST(coalesce(sum(w * i.f), 0) + 0 AS BIGINT) AS f0", f"coalesce({aggregate}, 0) AS f")


query("pool_sum", _pool_sql(CUBE3, 2, "CAST(sum(i.f) AS BIGINT)"))(lambda s, d: pool.pool(voxels(s, d), CUBE3, 2, "sum").df)
query("pool_max", _pool_sql(CUBE3, 2, "max(i.f)"))(lambda s, d: pool.pool(voxels(s, d), CUBE3, 2, "max").df)
query("pool_avg", _pool_sql(_CROSS, 1, "CAST(sum(i.f) AS DOUBLE) / nullif(count(i.f), 0)"))(lambda s, d: pool.pool(voxels(s, d), _CROSS, 1, "average").df)
for _mode, _aggregate in (("sum", "CAST(sum(i.f) AS BIGINT)"), ("max", "max(i.f)"), ("average", "CAST(sum(i.f) AS DOUBLE) / nullif(count(i.f), 0)")):
    query(f"pool_{_mode}_unreached", _pool_sql(_OFF, 1, _aggregate))(lambda s, d, m=_mode: pool.pool(voxels(s, d), _OFF, 1, m).df)
query("pool_tile", f"WITH {VOX}, {_COARSE} SELECT * FROM coarse")(lambda s, d: _coarse(s, d).df)


@query("max_pool_source", f"WITH {VOX}, hit AS (SELECT b, {_snap(2)}, f, x AS in_x, y AS in_y, z AS in_z FROM vox) SELECT b, x, y, z, f, in_x, in_y, in_z FROM hit QUALIFY row_number() OVER (PARTITION BY b, x, y, z ORDER BY f DESC, in_x, in_y, in_z) = 1")
def _(spark, d):
    return pool.max_pool_with_source(voxels(spark, d), Kernel(2), 2)


@query("pool_transpose", f"WITH {VOX}, {_COARSE} SELECT v.b, v.x, v.y, v.z, c.f FROM vox v JOIN coarse c ON c.b = v.b AND c.x = floor(v.x / 2.0) * 2 AND c.y = floor(v.y / 2.0) * 2 AND c.z = floor(v.z / 2.0) * 2")
def _(spark, d):
    return pool.pool_transpose(_coarse(spark, d), Kernel(2), voxels(spark, d)).df


@query("pool_backward_max", f"WITH {VOX}, {_COARSE}, hit AS (SELECT b, x, y, z, floor(x / 2.0) * 2 AS cx, floor(y / 2.0) * 2 AS cy, floor(z / 2.0) * 2 AS cz FROM vox QUALIFY row_number() OVER (PARTITION BY b, cx, cy, cz ORDER BY f DESC, x, y, z) = 1) SELECT v.b, v.x, v.y, v.z, coalesce(c.f, 0) AS f FROM vox v LEFT JOIN hit h USING (b, x, y, z) LEFT JOIN coarse c ON c.b = h.b AND c.x = cx AND c.y = cy AND c.z = cz")
def _(spark, d):
    v = voxels(spark, d)
    return pool.pool_backward(v, _coarse(spark, d), Kernel(2), "max").df


@query("pool_backward_avg", f"WITH {VOX}, c AS (SELECT b, {_snap(2)}, CAST(count(*) AS DOUBLE) AS n FROM vox GROUP BY 1, 2, 3, 4) SELECT v.b, v.x, v.y, v.z, 1024 / n AS f FROM vox v JOIN c ON c.b = v.b AND c.x = floor(v.x / 2.0) * 2 AND c.y = floor(v.y / 2.0) * 2 AND c.z = floor(v.z / 2.0) * 2")
def _(spark, d):
    v = voxels(spark, d)
    grad = _coarse(spark, d).map(lambda c: F.lit(1024.0))
    return pool.pool_backward(v, grad, Kernel(2), "average").df


for _mode, _aggregate in (("sum", "CAST(sum(f) AS BIGINT)"), ("max", "max(f)"), ("average", "CAST(sum(f) AS DOUBLE) / count(*)")):
    query(f"global_{_mode}", f"WITH {VOX} SELECT b, {_aggregate} AS f FROM vox GROUP BY b")(lambda s, d, m=_mode: pool.global_pool(voxels(s, d), m))


@query("direct_max_pool", "WITH x AS (SELECT p_partkey AS in_id, p_size - 25 AS f FROM part) SELECT l_orderkey AS out_id, CAST(greatest(max(f), 0) AS INTEGER) AS f FROM lineitem JOIN x ON in_id = l_partkey GROUP BY l_orderkey")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("in_id"), (F.col("p_size") - 25).cast("int").alias("f"))
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("in_id"), F.col("l_orderkey").alias("out_id"))
    return pool.direct_max_pool(x, pairs, ["f"])


# -- several sets


@query("union_sum", f"WITH {CELLS} SELECT b, x, y, z, CAST(sum(f) AS BIGINT) AS f FROM cells WHERE l_returnflag IN ('A', 'R') GROUP BY b, x, y, z")
def _(spark, d):
    return setops.union(*(voxels(spark, d, F.col("l_returnflag") == r, r) for r in "AR")).df


def _pair(spark, d) -> tuple[Voxels, Voxels]:
    v = voxels(spark, d)
    return v, v.map(lambda c: c % 1000)


query("add", f"WITH {VOX} SELECT b, x, y, z, f + f % 1000 AS f FROM vox")(lambda s, d: setops.add(*_pair(s, d)).df)
query("subtract", f"WITH {VOX} SELECT b, x, y, z, f - f % 1000 AS f FROM vox")(lambda s, d: setops.subtract(*_pair(s, d)).df)
query("multiply", f"WITH {VOX} SELECT b, x, y, z, f * (f % 1000) AS f FROM vox")(lambda s, d: setops.multiply(*_pair(s, d)).df)
query("divide", f"WITH {VOX} SELECT b, x, y, z, CAST(f AS DOUBLE) / nullif(f % 1000, 0) AS f FROM vox")(lambda s, d: setops.divide(*_pair(s, d)).df)
query("add_scalar", f"WITH {VOX} SELECT b, x, y, z, f + 7 AS f FROM vox")(lambda s, d: setops.add(voxels(s, d), 7).df)
query("cat", f"WITH {VOX} SELECT b, x, y, z, f, f % 1000 AS f_1 FROM vox")(lambda s, d: setops.cat(*_pair(s, d)).df)
query("total", f"WITH {VOX} SELECT b, x, y, z, f + f % 1000 AS f FROM vox")(lambda s, d: setops.total(*_pair(s, d)).df)
query("mean", f"WITH {VOX} SELECT b, x, y, z, (f + f % 1000) / CAST(2 AS DOUBLE) AS f FROM vox")(lambda s, d: setops.mean(*_pair(s, d)).df)
@query("select_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)")
def _(spark, d):
    ids = table(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return setops.select_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ids, "l_orderkey")


@query("remove_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)")
def _(spark, d):
    ids = table(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return setops.remove_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ids, "l_orderkey")


_PER_B = "per_b AS (SELECT b, CAST(sum(f) AS BIGINT) % 1000 AS g FROM vox GROUP BY b)"


def _per_b(spark, d):
    v = voxels(spark, d)
    return v, pool.global_pool(v, "sum").select("b", (F.col("f") % 1000).alias("g"))


query("broadcast_add", f"WITH {VOX}, {_PER_B} SELECT b, x, y, z, CAST(f + g AS BIGINT) AS f FROM vox JOIN per_b USING (b)")(lambda s, d: setops.broadcast_add(*_per_b(s, d)).df)
query("broadcast_multiply", f"WITH {VOX}, {_PER_B} SELECT b, x, y, z, CAST(f * g AS BIGINT) AS f FROM vox JOIN per_b USING (b)")(lambda s, d: setops.broadcast_multiply(*_per_b(s, d)).df)
query("broadcast_copy", f"WITH {VOX}, {_PER_B} SELECT b, x, y, z, CAST(g AS BIGINT) AS g0 FROM vox JOIN per_b USING (b)")(lambda s, d: setops.broadcast_copy(*_per_b(s, d)).df)
query("broadcast_cat", f"WITH {VOX}, {_PER_B} SELECT b, x, y, z, f, CAST(g AS BIGINT) AS g0 FROM vox JOIN per_b USING (b)")(lambda s, d: setops.broadcast_cat(*_per_b(s, d)).df)


@query("broadcast_backward", f"WITH {VOX} SELECT b, CAST(sum((f % 7) * (f % 1000)) AS BIGINT) AS f FROM vox GROUP BY b")
def _(spark, d):
    v = voxels(spark, d)
    return setops.broadcast_backward(v.map(lambda c: c % 1000), v.map(lambda c: c % 7), pool.global_pool(v, "sum"))


# -- functions of channels, on values that are halves of small integers

_HALVES = f"{VOX}, half AS (SELECT b, x, y, z, CAST(f % 33 - 16 AS DOUBLE) / 2 AS f FROM vox)"


def _halves(spark, d) -> Voxels:
    return voxels(spark, d).map(lambda c: (c % 33 - 16).cast("double") / 2)


for _name, _sql in {
    "relu": "greatest(f, 0)",
    "relu6": "least(greatest(f, 0), 6)",
    "hardtanh": "least(greatest(f, -1), 1)",
    "hardshrink": "CASE WHEN abs(f) > 0.5 THEN f ELSE 0 END",
    "softshrink": "CASE WHEN f > 0.5 THEN f - 0.5 WHEN f < -0.5 THEN f + 0.5 ELSE 0 END",
    "leaky_relu": "CASE WHEN f >= 0 THEN f ELSE f * CAST(0.01 AS DOUBLE) END",
    "softsign": "f / (1 + abs(f))",
    "hardsigmoid": "least(greatest(f + 3, 0), 6) / 6",
    "hardswish": "f * least(greatest(f + 3, 0), 6) / 6",
}.items():
    query(_name, f"WITH {_HALVES} SELECT b, x, y, z, CAST({_sql} AS DOUBLE) AS f FROM half")(lambda s, d, n=_name: channels.activate(_halves(s, d), n).cast("double").df)

query("threshold", f"WITH {_HALVES} SELECT b, x, y, z, CASE WHEN f > 2 THEN f ELSE CAST(-1 AS DOUBLE) END AS f FROM half")(lambda s, d: channels.activate(_halves(s, d), "threshold", bound=2.0, value=-1.0).df)
query("prelu", f"WITH {_HALVES} SELECT b, x, y, z, CASE WHEN f >= 0 THEN f ELSE f / 4 END AS f FROM half")(lambda s, d: channels.prelu(_halves(s, d), [0.25]).df)


def _rounded(v: Voxels):
    return v.map(lambda c: F.round(c, 9)).df


def _real(sql: str, name: str = "f") -> str:
    """Rounded, and never minus zero."""
    return f"round(CAST({sql} AS DOUBLE), 9) + 0.0::DOUBLE AS {name}"


_SIGMOID = "(1 / (1 + exp(-({0}))))"
_LOGSIGMOID = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"
_T = f"(1 / (1 + {channels._ERF_P} * abs(f / sqrt(2))))"
_ERF = "0"
for _a in reversed(channels._ERF_A):
    _ERF = f"({_ERF} + {_a}) * {_T}"
for _name, _sql in {
    "elu": "CASE WHEN f > 0 THEN f ELSE exp(f) - 1 END",
    "selu": f"{channels.SELU_SCALE} * CASE WHEN f > 0 THEN f ELSE {channels.SELU_ALPHA} * (exp(f) - 1) END",
    "celu": "greatest(f, 0) + least(0, exp(f) - 1)",
    "gelu": f"0.5 * f * (1 + sign(f) * (1 - {_ERF} * exp(-f * f / 2)))",
    "silu": f"f * {_SIGMOID.format('f')}",
    "sigmoid": _SIGMOID.format("f"),
    "tanh": "1 - 2 / (exp(2 * f) + 1)",
    "logsigmoid": _LOGSIGMOID.format("f"),
    "rrelu": "CASE WHEN f >= 0 THEN f ELSE f * 11.0::DOUBLE / 48 END",
    "softplus": "ln(1 + exp(f))",
    "tanhshrink": "f - (1 - 2 / (exp(2 * f) + 1))",
    "dropout": "f",
    "alpha_dropout": "f",
}.items():
    query(_name, f"WITH {_HALVES} SELECT b, x, y, z, {_real(_sql)} FROM half")(lambda s, d, n=_name: _rounded(channels.activate(_halves(s, d), n)))

# -- normalisation

_MOMENTS = "(f - avg(f) OVER ({0})) / sqrt(var_pop(f) OVER ({0}) + {1})"
query("variance", f"WITH {_HALVES} SELECT b, x, y, z, (f - f * f) * (f - f * f) / 4 AS f FROM half")(lambda s, d: (lambda v: setops.variance(v, v.map(lambda c: c * c)).df)(_halves(s, d)))
query("batch_norm", f"WITH {_HALVES} SELECT b, x, y, z, {_real('2 * ' + _MOMENTS.format('', '1e-5') + ' + 1')} FROM half")(lambda s, d: _rounded(norm.batch_norm(_halves(s, d), [2.0], [1.0])))
query("instance_norm", f"WITH {_HALVES} SELECT b, x, y, z, {_real(_MOMENTS.format('PARTITION BY b', '1e-8'))} FROM half")(lambda s, d: _rounded(norm.instance_norm(_halves(s, d))))
query("stable_instance_norm", f"WITH {_HALVES} SELECT b, x, y, z, {_real(_MOMENTS.format('PARTITION BY b', '1e-6'))} FROM half")(lambda s, d: _rounded(norm.stable_instance_norm(_halves(s, d))))
query(
    "instance_norm_backward",
    f"WITH {_HALVES}, y AS (SELECT *, f * f AS g, sqrt(var_pop(f) OVER (PARTITION BY b) + 1e-8) AS s, {_MOMENTS.format('PARTITION BY b', '1e-8')} AS y_ FROM half) SELECT b, x, y, z, {_real('(g - avg(g) OVER (PARTITION BY b) - y_ * avg(g * y_) OVER (PARTITION BY b)) / s')} FROM y",
)(lambda s, d: (lambda v: _rounded(norm.instance_norm_backward(v, v.map(lambda c: c * c))))(_halves(s, d)))


def _channels(spark, d) -> Voxels:
    v = _halves(spark, d)
    return v.with_df(v.df.select(*v.keys, "f", (F.col("f") * F.col("f") / 8).alias("g")), ["f", "g"])


_TWO = f"{_HALVES}, two AS (SELECT *, f * f / 8 AS g FROM half)"
for _name, _f, _g, _run in (
    ("normalise_rows", "f / greatest(sqrt(f * f + g * g), 1e-12)", "g / greatest(sqrt(f * f + g * g), 1e-12)", norm.normalise_rows),
    ("softmax", "1 / (1 + exp(g - f))", "1 / (1 + exp(f - g))", channels.softmax),
    ("softmax_rows", "exp(f - max(f) OVER ()) / sum(exp(f - 8)) OVER () * exp(max(f) OVER () - 8)", "exp(g - 8) / sum(exp(g - 8)) OVER ()", lambda v: channels.softmax(v, over_rows=True)),
    ("softmin", "1 / (1 + exp(f - g))", "1 / (1 + exp(g - f))", channels.softmin),
    ("log_softmax", "-ln(1 + exp(g - f))", "-ln(1 + exp(f - g))", channels.log_softmax),
):
    query(_name, f"WITH {_TWO} SELECT b, x, y, z, {_real(_f)}, {_real(_g, 'g')} FROM two")(lambda s, d, f=_run: _rounded(f(_channels(s, d))))
query("glu", f"WITH {_TWO} SELECT b, x, y, z, {_real('f * ' + _SIGMOID.format('g'))} FROM two")(lambda s, d: _rounded(channels.glu(_channels(s, d))))
query("sinusoidal", f"WITH {_TWO} SELECT b, x, y, z, {_real('sin(f + g / 4)', 'f0')}, {_real('3 * sin(f / 2 + 2 * g + 1)', 'f1')} FROM two")(lambda s, d: _rounded(channels.sinusoidal(_channels(s, d), np.array([[1.0, 0.5], [0.25, 2.0]]), [0.0, 1.0], [1.0, 3.0])))
query("linear", f"WITH {_HALVES} SELECT b, x, y, z, f * 2 + 1 AS f0, f * -4 + 0.5 AS f1 FROM half")(lambda s, d: conv.linear(_halves(s, d), np.array([[2.0, -4.0]]), [1.0, 0.5]).df)


# -- losses; of halves, so sums are exact

def _x():
    return F.col("f")


def _y():
    return F.floor(F.col("f") / 2)


for _name, _loss, _sql in (
    ("loss_mse", lambda: losses.mse(_x(), _y()), "(f - floor(f / 2)) * (f - floor(f / 2))"),
    ("loss_l1", lambda: losses.l1(_x(), _y()), "abs(f - floor(f / 2))"),
    ("loss_smooth_l1", lambda: losses.smooth_l1(_x(), _y()), "CASE WHEN abs(f - floor(f / 2)) < 1 THEN 0.5 * (f - floor(f / 2)) * (f - floor(f / 2)) ELSE abs(f - floor(f / 2)) - 0.5 END"),
    ("loss_hinge_embedding", lambda: losses.hinge_embedding(_x(), F.when(_x() > 1, 1).otherwise(-1)), "CASE WHEN f > 1 THEN f ELSE greatest(0, 1 - f) END"),
    ("loss_multi_margin", lambda: losses.multi_margin([_x(), _x() / 2, F.lit(1.0), -_x()], F.pmod(F.col("x"), F.lit(4))), "(CASE WHEN x % 4 = 0 THEN 0 ELSE greatest(0, 1 - own + f) END + CASE WHEN x % 4 = 1 THEN 0 ELSE greatest(0, 1 - own + f / 2) END + CASE WHEN x % 4 = 2 THEN 0 ELSE greatest(0, 1 - own + 1) END + CASE WHEN x % 4 = 3 THEN 0 ELSE greatest(0, 1 - own - f) END) / 4"),
):
    _full = f"WITH {_HALVES}, own AS (SELECT *, CASE x % 4 WHEN 0 THEN f WHEN 1 THEN f / 2 WHEN 2 THEN 1 ELSE -f END AS own FROM half) SELECT CAST(sum(CAST({_sql} AS DOUBLE)) AS DOUBLE) AS loss FROM own"
    query(_name, _full)(lambda s, d, f=_loss: losses.total_of(_halves(s, d).df, f().cast("double")))

_UP, _DOWN = (_LOGSIGMOID.format(x) for x in ("f", "-f"))
_POSITIVE = "CASE WHEN f > 0 THEN {0} ELSE {1} END"
for _name, (_loss, _sql) in {
    "loss_bce": (lambda: losses.binary_cross_entropy(channels.sigmoid(_x()), (_x() > 0).cast("double")), _POSITIVE.format(f"-{_UP}", f"-{_DOWN}")),
    "loss_bce_logits": (lambda: losses.binary_cross_entropy_with_logits(_x(), (_x() > 0).cast("double"), 2.0), _POSITIVE.format(f"-2 * {_UP}", f"-{_DOWN}")),
    "loss_cross_entropy": (lambda: losses.cross_entropy([_x(), _x() / 2, F.lit(1.0)], F.pmod(F.col("x"), F.lit(3))), "ln(exp(f) + exp(f / 2) + exp(1)) - CASE x % 3 WHEN 0 THEN f WHEN 1 THEN f / 2 ELSE 1 END"),
    "loss_nll": (lambda: losses.nll([-F.abs(_x()), F.lit(-1.0)], F.pmod(F.col("x"), F.lit(2))), "CASE x % 2 WHEN 0 THEN abs(f) ELSE 1 END"),
    "loss_kl_div": (lambda: losses.kl_div(-F.abs(_x()), channels.sigmoid(_x())), f"{_SIGMOID.format('f')} * ({_UP} + abs(f))"),
    "loss_poisson_nll": (lambda: losses.poisson_nll(_x(), F.abs(_x()), full=True), "exp(f) - abs(f) * f + CASE WHEN abs(f) > 1 THEN abs(f) * ln(abs(f)) - abs(f) + 0.5 * ln(2 * pi() * abs(f)) ELSE 0 END"),
    "loss_multilabel_margin": (lambda: losses.multilabel_margin([_x(), _x() / 2, F.lit(1.0)], F.array(F.pmod(F.col("x"), F.lit(3)).cast("int"), F.lit(-1), F.lit(0))), "(SELECT sum(greatest(0, 1 - CASE x % 3 WHEN 0 THEN f WHEN 1 THEN f / 2 ELSE 1 END + s)) FROM (VALUES (0, f), (1, f / 2), (2, 1)) v(i, s) WHERE i <> x % 3) / 3"),
    "loss_multilabel_soft_margin": (lambda: losses.multilabel_soft_margin([_x(), -_x()], [(_x() > 0).cast("double"), F.lit(1.0)]), f"({_POSITIVE.format(f'-{_UP}', f'-{_DOWN}')} - {_DOWN}) / 2"),
    "loss_soft_margin": (lambda: losses.soft_margin(_x(), F.when(_x() > 0, 1.0).otherwise(-1.0)), "ln(1 + exp(-abs(f)))"),
}.items():
    _mean = f"round(avg(CAST({_sql} AS DOUBLE)), 9) AS loss" if "SELECT" not in _sql else None
    _full = f"WITH {_HALVES} SELECT {_mean} FROM half" if _mean else f"WITH {_HALVES}, each AS (SELECT CAST({_sql} AS DOUBLE) AS v FROM half) SELECT round(avg(v), 9) AS loss FROM each"
    query(_name, _full)(lambda s, d, f=_loss: losses.mean_of(_halves(s, d).df, f()).select(F.round("loss", 9).alias("loss")))


@query("loss_weighted_cross_entropy", f"WITH {_HALVES} SELECT round(sum((1 + 2 * (x % 2)) * (ln(exp(f) + exp(1)) - CASE x % 2 WHEN 0 THEN f ELSE 1 END)) / sum(1 + 2 * (x % 2)), 9) AS loss FROM half")
def _(spark, d):
    label = F.pmod(F.col("x"), F.lit(2))
    return losses.mean_of(_halves(spark, d).df, losses.cross_entropy([_x(), F.lit(1.0)], label), losses.class_weight([1.0, 3.0], label)).select(F.round("loss", 9).alias("loss"))


# -- interpolation at half cells: the weights are powers of two


_EIGHT = taps_sql(Kernel(2).taps(3), name="corner")


@query("splat", f"WITH {POINTS}, {_EIGHT} SELECT b, x + ox AS x, y + oy AS y, z + oz AS z, CAST(sum(f) AS DOUBLE) / 8 AS f FROM pts, corner GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return pool.splat(points(spark, d)).df


@query("interp_mid", f"WITH {VOX}, pts AS (SELECT DISTINCT pid, b, x, y, z, f FROM cells), {_EIGHT} SELECT c.pid, CAST(sum(coalesce(v.f, 0)) AS DOUBLE) / 8 AS f FROM (SELECT pid, b, x + ox AS x, y + oy AS y, z + oz AS z FROM pts, corner) c LEFT JOIN vox v USING (b, x, y, z) GROUP BY c.pid")
def _(spark, d):
    return pool.interpolate(voxels(spark, d).cast("double"), points(spark, d))


@query("interp_backward", f"WITH {VOX}, pts AS (SELECT DISTINCT pid, b, x, y, z, f FROM cells), {_EIGHT}, sent AS (SELECT b, x + ox AS x, y + oy AS y, z + oz AS z, CAST(sum(f) AS DOUBLE) / 8 AS f FROM pts, corner GROUP BY 1, 2, 3, 4) SELECT v.b, v.x, v.y, v.z, coalesce(s.f, 0) AS f FROM vox v LEFT JOIN sent s USING (b, x, y, z)")
def _(spark, d):
    """Each point's price as the gradient of what was interpolated at it."""
    return pool.interpolate_backward(voxels(spark, d), points(spark, d)).df


@query("interp_map", f"WITH {VOX}, pts AS (SELECT DISTINCT pid, b, x, y, z, f FROM cells), {_EIGHT} SELECT c.pid, c.b, c.x, c.y, c.z, CAST(0.125 AS DOUBLE) AS w FROM (SELECT pid, b, x + ox AS x, y + oy AS y, z + oz AS z FROM pts, corner) c JOIN vox USING (b, x, y, z)")
def _(spark, d):
    p = points(spark, d)
    return pool.interpolation_map(voxels(spark, d), Points(p.df.drop("f"), p.axes, ()))


# -- blocks


def _two(spark, d) -> Voxels:
    """Two channels of small halves, so that products and sums stay exact."""
    v = voxels(spark, d)
    return v.with_df(v.df.select("b", *XYZ, ((F.col("f") % 7) / 2.0).alias("f0"), ((F.col("f") % 5 - 2) / 2.0).alias("f1")), ("f0", "f1"))


_TWO = f"{VOX}, two AS (SELECT b, x, y, z, CAST(f % 7 AS DOUBLE) / 2 AS f0, CAST(f % 5 - 2 AS DOUBLE) / 2 AS f1 FROM vox)"


@query(
    "squeeze_excite",
    f"""WITH {_TWO}, gate AS (SELECT b, greatest(avg(f0) - 0.5 * avg(f1), 0) AS h FROM two GROUP BY b)
    SELECT b, x, y, z, round(f0 / (1 + exp(-2 * h)), 6) AS f0, round(f1 / (1 + exp(h)), 6) AS f1 FROM two JOIN gate USING (b)""",
)
def _(spark, d):
    v = blocks.squeeze_excite(_two(spark, d), np.array([[1.0], [-0.5]]), np.array([[2.0, -1.0]]))
    return v.df.select("b", *XYZ, *(F.round(f, 6).alias(f) for f in v.feats))


_BLOCK = blocks.Conv(1, 1, seed=3)


def _block_sql() -> str:
    """A convolution with the block's weights, batch norm over all rows, relu."""
    taps = ", ".join(f"({k}, {', '.join(map(str, o))}, {float(_BLOCK.weight[k, 0, 0])!r}::DOUBLE)" for k, o in enumerate(CUBE3.taps(3)))
    return f"""WITH {_TWO}, taps(k, ox, oy, oz, w) AS (VALUES {taps}),
    y AS (SELECT o.b, o.x, o.y, o.z, sum(w * i.f0) AS f FROM (SELECT b, x, y, z, w, x + ox AS nx, y + oy AS ny, z + oz AS nz FROM two, taps) o JOIN two i ON i.b = o.b AND i.x = nx AND i.y = ny AND i.z = nz GROUP BY 1, 2, 3, 4),
    s AS (SELECT avg(f) AS m, var_pop(f) AS v FROM y) SELECT b, x, y, z, round(greatest((f - m) / sqrt(v + 1e-5), 0), 5) + 0.0::DOUBLE AS f FROM y, s"""


@query("conv_block", _block_sql())
def _(spark, d):
    v = _two(spark, d)
    return _BLOCK(v.with_df(v.df, ("f0",))).df.select("b", *XYZ, F.round("f0", 5).alias("f"))


@query("classify", f"WITH {_TWO} SELECT b, max(f0) * 2 - max(f1) + 1 AS score0, max(f0) * -0.5 + max(f1) * 4 - 2 AS score1 FROM two GROUP BY b")
def _(spark, d):
    return blocks.classify(_two(spark, d), [], np.array([[2.0, -0.5], [-1.0, 4.0]]), [1.0, -2.0])


query("residual")(lambda s, d: blocks.Residual(2, 2, excite=2)(_two(s, d)).df)
query("residual_bottleneck")(lambda s, d: blocks.Residual(2, 1, stride=2, bottleneck=True, expansion=2)(_two(s, d)).df)
query("unet")(lambda s, d: blocks.UNet(2, 2, (2, 2))(_two(s, d)).df)
