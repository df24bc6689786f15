"""Queries of the operators on Gaussians, which are made from the embeddings' first dimensions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.camera import Camera
from voxloom.operators import raster, splats

from .registry import Registry
from .views import table

REGISTRY = query = Registry()
CAMERA = Camera.look_at((0.0, 0.0, -3.0), (0.0, 0.0, 0.0), (0.0, -1.0, 0.0), 32, 32, 0.9)

#: Places and opacities are multiples of 1 / 64, so that filters agree to the last bit.
_GAUSS = """gauss AS (SELECT vec_id AS gid, floor(embedding[1]::DOUBLE * 64) / 64 AS px, floor(embedding[2]::DOUBLE * 64) / 64 AS py, floor(embedding[3]::DOUBLE * 64) / 64 AS pz,
  (vec_id % 65) / 64.0::DOUBLE AS opacity FROM embeddings)"""


def gaussians(spark, d):
    e = lambda i: F.floor(F.col("embedding")[i].cast("double") * 64) / 64
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("gid"),
        *(e(i).alias(p) for i, p in enumerate(splats.P)),
        F.lit(1.0).alias("qw"),
        *((e(i + 3) / 2).alias(q) for i, q in enumerate(splats.Q[1:])),
        *((0.02 + F.abs(e(i + 6)) / 8).alias(s) for i, s in enumerate(splats.S)),
        (F.pmod("vec_id", F.lit(65)) / 64).alias("opacity"),
        *(F.abs(e(i + 9)).alias(c) for i, c in enumerate(splats.RGB)),
        *(e(i + 12).alias(v) for i, v in enumerate(splats.V)),
    )


_KEEP = "gid, px, py, pz, opacity"


@query("gaussian_filter_opacity", f"WITH {_GAUSS} SELECT {_KEEP} FROM gauss WHERE opacity >= 0.5")
def _(spark, d):
    return splats.filter_opacity(gaussians(spark, d), 0.5).select(*_KEEP.split(", "))


@query("gaussian_filter_bounds", f"WITH {_GAUSS} SELECT {_KEEP} FROM gauss WHERE px >= -0.125 AND px < 0.125 AND py >= 0 AND py < 1 AND pz >= -1 AND pz < 0.25")
def _(spark, d):
    return splats.filter_bounds(gaussians(spark, d), (-0.125, 0, -1), (0.125, 1, 0.25)).select(*_KEEP.split(", "))


@query("gaussian_constraints", f"WITH {_GAUSS} SELECT gid, greatest(px, 0.000001::DOUBLE) AS sx, least(greatest(opacity + py, 0), 1) AS opacity FROM gauss")
def _(spark, d):
    df = gaussians(spark, d).withColumns({"sx": F.col("px"), "opacity": F.col("opacity") + F.col("py")})
    return splats.project_constraints(df).select("gid", "sx", "opacity")


@query("gaussian_translate", f"WITH {_GAUSS} SELECT gid, px + 1 AS px, py - 2 AS py, pz + 0.5 AS pz FROM gauss")
def _(spark, d):
    return splats.transform(gaussians(spark, d), (1, 0, 0, 0), (1, -2, 0.5)).select("gid", *splats.P)


@query("knn", f"WITH {_GAUSS} SELECT a.gid, b.gid AS other FROM gauss a JOIN gauss b ON a.gid <> b.gid QUALIFY row_number() OVER (PARTITION BY a.gid ORDER BY (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz), b.gid) <= 3")
def _(spark, d):
    return splats.knn(gaussians(spark, d), 3, 0.1).select("gid", "other")


#: The Gaussians in full, with the rotation matrix r00 to r22.
_E = lambda i: f"floor(embedding[{i}]::DOUBLE * 64) / 64"
_WHOLE = f"""raw AS (SELECT vec_id AS gid, {_E(1)} AS px, {_E(2)} AS py, {_E(3)} AS pz, 1.0::DOUBLE AS qw, {_E(4)} / 2 AS qx, {_E(5)} / 2 AS qy, {_E(6)} / 2 AS qz,
  0.02::DOUBLE + abs({_E(7)}) / 8 AS sx, 0.02::DOUBLE + abs({_E(8)}) / 8 AS sy, 0.02::DOUBLE + abs({_E(9)}) / 8 AS sz, (vec_id % 65) / 64.0::DOUBLE AS opacity,
  abs({_E(10)}) AS r, abs({_E(11)}) AS g, abs({_E(12)}) AS b, {_E(13)} AS vx, {_E(14)} AS vy, {_E(15)} AS vz FROM embeddings),
unit AS (SELECT *, qw / n AS w, qx / n AS x, qy / n AS y, qz / n AS z FROM (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM raw)),
turned AS (SELECT *, 1 - 2 * (y * y + z * z) AS r00, 2 * (x * y - w * z) AS r01, 2 * (x * z + w * y) AS r02, 2 * (x * y + w * z) AS r10, 1 - 2 * (x * x + z * z) AS r11, 2 * (y * z - w * x) AS r12,
  2 * (x * z - w * y) AS r20, 2 * (y * z + w * x) AS r21, 1 - 2 * (x * x + y * y) AS r22 FROM unit)"""


def _sum_sql(i: int, j: int, scale: str) -> str:
    return "(" + " + ".join(f"r{i}{k} * r{j}{k} * {scale.format('s' + a)}" for k, a in enumerate("xyz")) + ")"


def _entries(scale: str) -> dict[str, str]:
    return {f"{'xyz'[i]}{'xyz'[j]}": _sum_sql(i, j, scale) for i in range(3) for j in range(i, 3)}


def _real(sql: str, name: str, digits: int = 9) -> str:
    """Rounded, and never minus zero."""
    return f"round({sql}, {digits}) + 0.0::DOUBLE AS {name}"


def _rounded(df, keys=("gid",), digits: int = 9):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in df.columns if c not in keys))


_COV = ", ".join(f"{v} AS c{n}" for n, v in _entries("({0} * {0})").items())
_MAHALANOBIS = " + ".join(f"pow((r0{k} * (0.1 - px) + r1{k} * (0.2 - py) + r2{k} * (0.3 - pz)) / s{a}, 2)" for k, a in enumerate("xyz"))


def _next_pairs(df):
    """Each Gaussian with that of the next higher id, the last with the first."""
    ids = df.select("gid").distinct()
    lowest = ids.agg(F.min("gid").alias("lowest"))
    following = ids.select(F.col("gid").alias("gid_a"), F.lead("gid").over(Window.orderBy("gid")).alias("gid_b"))
    return following.crossJoin(F.broadcast(lowest)).select("gid_a", F.coalesce("gid_b", "lowest").alias("gid_b"))


query("covariances", f"WITH {_WHOLE} SELECT gid, {', '.join(_real(v, 'c' + n) for n, v in _entries('({0} * {0})').items())} FROM turned")(lambda s, d: _rounded(splats.covariances(gaussians(s, d))))
query("inverse_covariances", f"WITH {_WHOLE} SELECT gid, {', '.join(_real(v, 'i' + n, 6) for n, v in _entries('(1 / ({0} * {0}))').items())} FROM turned")(lambda s, d: _rounded(splats.inverse_covariances(gaussians(s, d)), digits=6))


def _moved_sql() -> str:
    """The motion of gaussian_transform on all columns that it changes."""
    q = [0.9, 0.1, 0.3, -0.2]
    n = sum(v * v for v in q) ** 0.5
    w, x, y, z = (v / n for v in q)
    m = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    place = [f"{a} * p0 + {b} * p1 + {c} * p2" for a, b, c in m]
    spots = [_real(row.replace("p0", "px").replace("p1", "py").replace("p2", "pz") + f" + {t}", p) for row, t, p in zip(place, (1, 2, 3), splats.P, strict=True)]
    speeds = [_real(row.replace("p0", "vx").replace("p1", "vy").replace("p2", "vz"), v) for row, v in zip(place, splats.V, strict=True)]
    turns = [f"{w} * qw - {x} * qx - {y} * qy - {z} * qz", f"{w} * qx + {x} * qw + {y} * qz - {z} * qy", f"{w} * qy - {x} * qz + {y} * qw + {z} * qx", f"{w} * qz + {x} * qy - {y} * qx + {z} * qw"]
    # a negative number after a minus sign needs its own brackets
    turns = [t.replace("- -", "+ ") for t in turns]
    return f"WITH {_WHOLE} SELECT gid, {', '.join(spots)}, {', '.join(_real(t, q) for t, q in zip(turns, splats.Q, strict=True))}, {', '.join(_real(c, c) for c in (*splats.S, 'opacity', *splats.RGB))}, {', '.join(speeds)} FROM turned"


query("gaussian_transform", _moved_sql())(lambda s, d: _rounded(splats.transform(gaussians(s, d), (0.9, 0.1, 0.3, -0.2), (1, 2, 3))))
query("mahalanobis", f"WITH {_WHOLE} SELECT gid, {_real(_MAHALANOBIS, 'mahalanobis2', 6)} FROM turned")(lambda s, d: _rounded(splats.with_mahalanobis(gaussians(s, d), (0.1, 0.2, 0.3)).select("gid", "mahalanobis2"), digits=6))
query("density", f"WITH {_WHOLE} SELECT gid, {_real(f'exp(-0.5 * ({_MAHALANOBIS})) / sqrt(pow(2 * pi(), 3) * pow(sx * sy * sz, 2))', 'density', 6)} FROM turned")(lambda s, d: _rounded(splats.with_density(gaussians(s, d), (0.1, 0.2, 0.3)).select("gid", "density"), digits=6))
query(
    "overlap_integrals",
    f"""WITH {_WHOLE}, cov AS (SELECT gid, px, py, pz, {_COV} FROM turned), pairs AS (SELECT gid AS gid_a, coalesce(lead(gid) OVER (ORDER BY gid), min(gid) OVER ()) AS gid_b FROM raw),
    j AS (SELECT gid_a, gid_b, a.px - b.px AS d0, a.py - b.py AS d1, a.pz - b.pz AS d2, {', '.join(f'a.c{n} + b.c{n} AS {n}' for n in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM pairs JOIN cov a ON a.gid = gid_a JOIN cov b ON b.gid = gid_b),
    k AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM j)
    SELECT gid_a, gid_b, {_real("exp(-0.5 * ((yy * zz - yz * yz) * d0 * d0 + (xx * zz - xz * xz) * d1 * d1 + (xx * yy - xy * xy) * d2 * d2 + 2 * ((xz * yz - xy * zz) * d0 * d1 + (xy * yz - xz * yy) * d0 * d2 + (xy * xz - xx * yz) * d1 * d2)) / det) / sqrt(pow(2 * pi(), 3) * det)", "overlap", 6)} FROM k""",
)(lambda s, d: _rounded(splats.overlap_integrals(gaussians(s, d), gaussians(s, d), _next_pairs(gaussians(s, d))), ("gid_a", "gid_b"), 6))
query("axis_bounds", f"WITH {_WHOLE}, cov AS (SELECT gid, px, py, pz, {_COV} FROM turned) SELECT gid, {', '.join(_real(f'p{a} - 3 * sqrt(c{a}{a})', 'lo_' + a) + ', ' + _real(f'p{a} + 3 * sqrt(c{a}{a})', 'hi_' + a) for a in 'xyz')} FROM cov")(lambda s, d: _rounded(splats.axis_bounds(gaussians(s, d))))
query("gaussian_sample")(lambda s, d: splats.sample(gaussians(s, d), 3))
query("deactivate_activate", f"WITH {_WHOLE} SELECT gid, {_real('greatest(least(opacity, 1 - 1e-6), 1e-6)', 'opacity', 12)}, {', '.join(_real(c, c, 12) for c in (*splats.S, *splats.RGB))} FROM raw")(lambda s, d: _rounded(splats.activate(splats.deactivate(gaussians(s, d))).select("gid", "opacity", *splats.S, *splats.RGB), digits=12))
query(
    "gaussians_from_points",
    f"WITH {_GAUSS}, near AS (SELECT a.gid, (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz) AS d2 FROM gauss a JOIN gauss b ON a.gid <> b.gid QUALIFY row_number() OVER (PARTITION BY a.gid ORDER BY (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz), b.gid) <= 3) SELECT gid, {_real('0.5 * ln(greatest(avg(d2), 1e-7))', 'sx')}, {_real('ln(0.1::DOUBLE / 0.9)', 'opacity_raw')} FROM near GROUP BY gid",
)(lambda s, d: _rounded(splats.from_points(gaussians(s, d).select("gid", *splats.P, *splats.RGB), 0.1).select("gid", "sx", "opacity_raw")))
query("view_colour", f"WITH {_WHOLE} SELECT gid, {', '.join(_real(c, c, 12) for c in splats.RGB)} FROM raw")(lambda s, d: _rounded(splats.view_colour(splats.deactivate(gaussians(s, d)), (0, 0, -3), 0).select("gid", *splats.RGB), digits=12))

# the camera looks along z from (0, 0, -3), so camera axes are (x, -y up to sign, z + 3) as its matrix says
WIDE = Camera.look_at((0.0, 0.0, -3.0), (0.0, 0.0, 0.0), (0.0, -1.0, 0.0), 128, 128, 0.9)


def _screen_sql(c: Camera, opacity: str = "opacity") -> str:
    """What project() leaves, as ``seen``."""
    m, lim = np.array(c.world_to_camera), 0.65 * c.width / c.fx
    cam = ", ".join(f"{m[i][0]} * px + {m[i][1]} * py + {m[i][2]} * pz + {m[i][3]} AS c{i}" for i in range(3))
    jac = ", ".join(f"({c.fx} / zz_) * {m[i][k]} - ({c.fx} * least(greatest({t}, {-lim}), {lim}) / zz_) * {m[2][k]} AS j{i}{k}" for i, t in ((0, "tx"), (1, "ty")) for k in range(3))
    bas = ", ".join(f"(j{i}0 * r0{k} + j{i}1 * r1{k} + j{i}2 * r2{k}) * s{'xyz'[k]} AS b{i}{k}" for i in range(2) for k in range(3))
    return f"""{_WHOLE}, cam AS (SELECT * REPLACE ({opacity} AS opacity), {cam} FROM turned), spot AS (SELECT *, greatest(c2, {c.near}) AS zz_, c0 / greatest(c2, {c.near}) AS tx, c1 / greatest(c2, {c.near}) AS ty FROM cam),
jac AS (SELECT *, {jac} FROM spot), bas AS (SELECT *, {bas} FROM jac),
form AS (SELECT *, b00 * b00 + b01 * b01 + b02 * b02 + {raster.LOW_PASS} AS fa, b00 * b10 + b01 * b11 + b02 * b12 AS fb, b10 * b10 + b11 * b11 + b12 * b12 + {raster.LOW_PASS} AS fd, {c.fx} * tx + {c.cx} AS u, {c.fy} * ty + {c.cy} AS v FROM bas),
screen AS (SELECT *, fa * fd - fb * fb AS det, ceil(3 * sqrt((fa + fd) / 2 + sqrt(greatest(pow((fa + fd) / 2, 2) - (fa * fd - fb * fb), 0.1)))) AS radius FROM form),
seen AS (SELECT *, fd / det AS ka, -fb / det AS kb, fa / det AS kc FROM screen WHERE c2 > {c.near} AND det > 1e-12 AND opacity >= {raster.LEAST_ALPHA} AND u + radius >= 0 AND u - radius < {c.width} AND v + radius >= 0 AND v - radius < {c.height})"""


def _tile_sql(x: str, tile: int, size: int) -> str:
    return f"least(greatest(CAST(floor(({x}) / {tile}) AS INTEGER), 0), {(size + tile - 1) // tile - 1})"


def _image_sql(c: Camera, opacity: str = "opacity", background=(0, 0, 0)) -> str:
    """Each pixel's Gaussians from front to back as ``frags``, and the image of them as ``image``."""
    near = " AND ".join(f"{a} // 16 BETWEEN {_tile_sql(f'{p} - radius', 16, c.width)} AND {_tile_sql(f'{p} + radius', 16, c.width)}" for a, p in (("pix", "u"), ("piy", "v")))
    shown = ", ".join(f"coalesce(sum({k} * alpha * t), 0) + coalesce(min(aft), 1) * {b} AS {k}" for k, b in zip(("r", "g", "b"), background, strict=True))
    return f"""{_screen_sql(c, opacity)}, pixel AS (SELECT CAST(i % {c.width} AS INTEGER) AS pix, CAST(i // {c.width} AS INTEGER) AS piy FROM range({c.width * c.height}) p(i)),
lit AS (SELECT pix, piy, gid, c2 AS depth, r, g, b, ka, kb, kc, opacity, u - (pix + 0.5) AS dx, v - (piy + 0.5) AS dy FROM seen JOIN pixel ON {near}),
pow_ AS (SELECT *, -0.5 * (ka * dx * dx + kc * dy * dy) - kb * dx * dy AS pw FROM lit), al AS (SELECT *, exp(pw) AS gauss, least({raster.MOST_ALPHA}, opacity * exp(pw)) AS alpha FROM pow_ WHERE pw <= 0),
aft AS (SELECT *, exp(sum(ln(1 - alpha)) OVER (PARTITION BY pix, piy ORDER BY depth, gid)) AS aft FROM al WHERE alpha >= {raster.LEAST_ALPHA}), frags AS (SELECT *, aft / (1 - alpha) AS t FROM aft WHERE aft >= {raster.STOP}),
image AS (SELECT pix AS x, piy AS y, {shown}, coalesce(sum(depth * alpha * t), 0) AS depth, 1 - coalesce(min(aft), 1) AS alpha FROM pixel LEFT JOIN frags USING (pix, piy) GROUP BY 1, 2)"""


_IMAGE = f"x, y, {', '.join(_real(k, k, 6) for k in ('r', 'g', 'b', 'depth', 'alpha'))} FROM image"
_SEEN = f"gid, {_real('u', 'u', 6)}, {_real('v', 'v', 6)}, {_real('ka', 'ka', 6)}, {_real('kb', 'kb', 6)}, {_real('kc', 'kc', 6)}, {_real('opacity', 'opacity', 6)}, {_real('c2', 'depth', 6)}, {_real('r', 'r', 6)}, {_real('g', 'g', 6)}, {_real('b', 'b', 6)}, {_real('radius', 'radius', 6)}"
query("project", f"WITH {_screen_sql(CAMERA)} SELECT {_SEEN} FROM seen")(lambda s, d: _rounded(raster.project(gaussians(s, d), CAMERA), digits=6))
query(
    "tiles",
    f"WITH {_screen_sql(CAMERA)} SELECT {_SEEN}, CAST(tx.i AS INTEGER) AS tx, CAST(ty.i AS INTEGER) AS ty FROM seen, range(4) tx(i), range(4) ty(i) WHERE tx.i BETWEEN {_tile_sql('u - radius', 8, 32)} AND {_tile_sql('u + radius', 8, 32)} AND ty.i BETWEEN {_tile_sql('v - radius', 8, 32)} AND {_tile_sql('v + radius', 8, 32)}",
)(lambda s, d: _rounded(raster.tiles(raster.project(gaussians(s, d), CAMERA), CAMERA, 8), ("gid", "tx", "ty"), 6))
query("render", f"WITH {_image_sql(WIDE, background=(0.1, 0.2, 0.3))} SELECT {_IMAGE}")(lambda s, d: _rounded(raster.render(gaussians(s, d), WIDE, (0.1, 0.2, 0.3)), ("x", "y"), 6))
query("render_raw", f"WITH {_image_sql(CAMERA, 'greatest(least(opacity, 1 - 1e-6), 1e-6)')} SELECT {_IMAGE}")(lambda s, d: _rounded(raster.render_raw(splats.deactivate(gaussians(s, d)), CAMERA), ("x", "y"), 6))


def _image(s, d):
    return raster.render(gaussians(s, d), CAMERA)


def _ssim_sql() -> str:
    """Of the image and itself with half the red: windows of 11 along x, then along y."""
    weights = [math.exp(-(k * k) / 4.5) for k in range(-5, 6)]
    taps = ", ".join(f"({k}, {w / sum(weights)})" for k, w in zip(range(-5, 6), weights, strict=True))
    names = ("p", "q", "pp", "qq", "pq")
    passes, last = [], "both_"
    for axis in "xy":
        moved = {"x": "x + d AS x, y", "y": "x, y + d AS y"}[axis]
        passes.append(f"{axis}_ AS (SELECT {moved}, ch, {', '.join(f'sum({n} * w) AS {n}' for n in names)} FROM {last}, win GROUP BY 1, 2, 3)")
        last = f"{axis}_"
    return f"""WITH {_image_sql(CAMERA)}, long_ AS (SELECT x, y, 0 AS ch, r AS p, r / 2 AS q FROM image UNION ALL SELECT x, y, 1, g, g FROM image UNION ALL SELECT x, y, 2, b, b FROM image),
    both_ AS (SELECT *, p * p AS pp, q * q AS qq, p * q AS pq FROM long_), win(d, w) AS (VALUES {taps}), {', '.join(passes)}
    SELECT {_real("avg((2 * p * q + 0.0001) * (2 * (pq - p * q) + 0.0009) / ((p * p + q * q + 0.0001) * (pp - p * p + qq - q * q + 0.0009)))", "ssim", 6)} FROM y_ WHERE x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31"""


query("image_l1", f"WITH {_image_sql(CAMERA)} SELECT {_real('avg(r / 2) / 3', 'l1', 6)} FROM image")(lambda s, d: _rounded(raster.l1(_image(s, d), _image(s, d).withColumn("r", F.col("r") / 2)), (), 6))
query("image_ssim", _ssim_sql())(lambda s, d: _rounded(raster.ssim(_image(s, d), _image(s, d).withColumn("r", F.col("r") / 2)), (), 6))

_GRADS = {
    "gu": "-dp * (ka * dx + kb * dy)",
    "gv": "-dp * (kc * dy + kb * dx)",
    "gka": "-0.5 * dx * dx * dp",
    "gkb": "-dx * dy * dp",
    "gkc": "-0.5 * dy * dy * dp",
    "gopacity": f"CASE WHEN opacity * gauss <= {raster.MOST_ALPHA} THEN gauss * da ELSE 0 END",
    "gdepth": "alpha * t",
    "gr": "alpha * t",
    "gg": "alpha * t",
    "gb": "alpha * t",
}


@query(
    "composite_backward",
    f"""WITH {_image_sql(CAMERA)}, own AS (SELECT *, r + g + b + depth AS own, (r + g + b + depth) * alpha * t AS part, min(aft) OVER (PARTITION BY pix, piy) AS end_ FROM frags),
    back AS (SELECT *, own * t - coalesce(sum(part) OVER (PARTITION BY pix, piy ORDER BY depth, gid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) / (1 - alpha) + end_ / (1 - alpha) AS da FROM own),
    each AS (SELECT *, CASE WHEN opacity * gauss <= {raster.MOST_ALPHA} THEN opacity * gauss * da ELSE 0 END AS dp FROM back)
    SELECT gid, {', '.join(_real(f'sum({v})', n, 5) for n, v in _GRADS.items())} FROM each GROUP BY gid""",
)
def _(spark, d):
    frags = raster.fragments(raster.project(gaussians(spark, d), CAMERA), CAMERA)
    grad = spark.range(32 * 32).select((F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") / 32).cast("int").alias("y"), *(F.lit(1.0).alias(c) for c in ("gr", "gg", "gb", "gdepth", "galpha")))
    return _rounded(raster.composite_backward(frags, grad), digits=5)
