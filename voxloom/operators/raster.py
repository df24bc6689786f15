"""Rendering of Gaussians: projection, tiles, compositing as an ordered window, and the gradient of compositing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxloom.camera import Camera

from .splats import P, RGB, S, _clean, _total, _with_rotation, settled, view_colour

#: Fixed values of the renderer.
LOW_PASS = 0.3
MOST_ALPHA, LEAST_ALPHA = 0.99, 1 / 255
STOP = 1e-4


def project(df: DataFrame, camera: Camera) -> DataFrame:
    """Visible Gaussians on the screen: gid, u, v, the conic ka kb kc, opacity, depth, r g b, radius.

    The covariance is projected by the local affine approximation (directions clamped to 1.3 times the field of view)
    and widened by a low-pass; what lies before the near plane, off the screen or is too faint goes.
    """
    w, t = camera.rotation, camera.translation
    df, r = _with_rotation(df)
    cam = {f"__c{i}": _total([F.lit(float(w[i][k])) * F.col(P[k]) for k in range(3)]) + F.lit(float(t[i])) for i in range(3)}
    df = df.withColumns(cam).withColumn("__z", F.greatest(F.col("__c2"), F.lit(camera.near)))
    df = df.withColumns({"__tx": F.col("__c0") / F.col("__z"), "__ty": F.col("__c1") / F.col("__z")})
    lim = lambda c, size, f: F.least(F.greatest(c, F.lit(-0.65 * size / f)), F.lit(0.65 * size / f))
    rows = [
        (camera.fx / F.col("__z"), -camera.fx * lim(F.col("__tx"), camera.width, camera.fx) / F.col("__z"), 0),
        (camera.fy / F.col("__z"), -camera.fy * lim(F.col("__ty"), camera.height, camera.fy) / F.col("__z"), 1),
    ]
    # each row of the projected basis J W R diag(s)
    df = df.withColumns({f"__j{i}{k}": a * F.lit(float(w[axis][k])) + b * F.lit(float(w[2][k])) for i, (a, b, axis) in enumerate(rows) for k in range(3)})
    df = df.withColumns({f"__b{i}{k}": _total([F.col(f"__j{i}{m}") * r[m][k] for m in range(3)]) * F.col(S[k]) for i in range(2) for k in range(3)})
    dot = lambda i, j: _total([F.col(f"__b{i}{k}") * F.col(f"__b{j}{k}") for k in range(3)])
    df = settled(df)
    df = df.withColumns({"__a": dot(0, 0) + LOW_PASS, "__b": dot(0, 1), "__d": dot(1, 1) + LOW_PASS})
    a, b, d = F.col("__a"), F.col("__b"), F.col("__d")
    df = settled(df.withColumns({"__u": camera.fx * F.col("__tx") + camera.cx, "__v": camera.fy * F.col("__ty") + camera.cy, "__det": a * d - b * b}))
    det, mid = F.col("__det"), 0.5 * (a + d)
    df = settled(df.withColumn("__radius", F.ceil(3 * F.sqrt(mid + F.sqrt(F.greatest(mid * mid - det, F.lit(0.1))))).cast("double")))
    inverse = 1 / F.greatest(det, F.lit(1e-12))
    seen = (F.col("__c2") > camera.near) & (det > 1e-12) & (F.col("opacity") >= LEAST_ALPHA)
    for c, size in (("__u", camera.width), ("__v", camera.height)):
        seen = seen & (F.col(c) + F.col("__radius") >= 0) & (F.col(c) - F.col("__radius") < size)
    return df.filter(seen).select("gid", F.col("__u").alias("u"), F.col("__v").alias("v"), (d * inverse).alias("ka"), (-b * inverse).alias("kb"), (a * inverse).alias("kc"), "opacity", F.col("__c2").alias("depth"), *RGB, F.col("__radius").alias("radius"))


def tiles(screen: DataFrame, camera: Camera, tile: int = 16) -> DataFrame:
    """``screen`` once for every tile (tx, ty) that a Gaussian's square may touch."""

    def reach(c: str, size: int) -> Column:
        most = F.lit((size + tile - 1) // tile - 1)
        edge = lambda x: F.least(F.greatest(F.floor(x / tile).cast("int"), F.lit(0)), most)
        return F.sequence(edge(F.col(c) - F.col("radius")), edge(F.col(c) + F.col("radius")))

    return screen.withColumn("tx", F.explode(reach("u", camera.width))).withColumn("ty", F.explode(reach("v", camera.height)))


def fragments(screen: DataFrame, camera: Camera, tile: int = 16) -> DataFrame:
    """What each Gaussian adds to each pixel (x, y): alpha, and the transmittance ``t`` before it.

    The transmittance is a running product over the pixel's Gaussians by depth (ties by gid), as a sum of logarithms
    in a window. It only falls, so keeping the rows where it is still STOP or more after the row ends each pixel
    where a loop over it would break off. Pixels are the window's keys: none gathers more than its own Gaussians.
    """
    pixels = F.array(*(F.struct(F.lit(i % tile).alias("i"), F.lit(i // tile).alias("j")) for i in range(tile * tile)))
    df = tiles(screen, camera, tile).withColumn("__p", F.explode(pixels))
    df = df.withColumns({"x": F.col("tx") * tile + F.col("__p.i"), "y": F.col("ty") * tile + F.col("__p.j")}).filter((F.col("x") < camera.width) & (F.col("y") < camera.height))
    df = df.withColumns({"dx": F.col("u") - (F.col("x") + 0.5), "dy": F.col("v") - (F.col("y") + 0.5)})
    power = -0.5 * (F.col("ka") * F.col("dx") * F.col("dx") + F.col("kc") * F.col("dy") * F.col("dy")) - F.col("kb") * F.col("dx") * F.col("dy")
    df = df.withColumn("__w", power).filter("__w <= 0").withColumn("gauss", F.exp("__w"))
    df = df.withColumn("alpha", F.least(F.lit(MOST_ALPHA), F.col("opacity") * F.col("gauss"))).filter(F.col("alpha") >= LEAST_ALPHA)
    order = Window.partitionBy("x", "y").orderBy("depth", "gid")
    df = df.withColumn("__after", F.sum(F.log1p(-F.col("alpha"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("after", F.exp("__after")).filter(F.col("after") >= STOP)
    return _clean(df.withColumn("t", F.col("after") / (1 - F.col("alpha"))).drop("tx", "ty", "radius"))


def composite(frags: DataFrame, camera: Camera, background: Sequence[float] = (0.0, 0.0, 0.0), spark: SparkSession | None = None) -> DataFrame:
    """One row for each pixel: x, y, r, g, b, depth, alpha."""
    weight = F.col("alpha") * F.col("t")
    sums = frags.groupBy("x", "y").agg(*(F.sum(F.col(c) * weight).alias(c) for c in (*RGB, "depth")), F.min("after").alias("after"))
    every = (spark or frags.sparkSession).range(camera.width * camera.height).select((F.col("id") % camera.width).cast("int").alias("x"), F.floor(F.col("id") / camera.width).cast("int").alias("y"))
    df = every.join(sums, ["x", "y"], "left").withColumn("after", F.coalesce("after", F.lit(1.0)))
    shown = [(F.coalesce(c, F.lit(0.0)) + F.col("after") * F.lit(float(b))).alias(c) for c, b in zip(RGB, background, strict=True)]
    return df.select("x", "y", *shown, F.coalesce("depth", F.lit(0.0)).alias("depth"), (1 - F.col("after")).alias("alpha"))


def render(df: DataFrame, camera: Camera, background: Sequence[float] = (0.0, 0.0, 0.0), tile: int = 16) -> DataFrame:
    """The image of an activated table, by its stored colours."""
    return composite(fragments(project(df, camera), camera, tile), camera, background)


def render_raw(raw: DataFrame, camera: Camera, degree: int = 0, background: Sequence[float] = (0.0, 0.0, 0.0), tile: int = 16) -> DataFrame:
    """The image of a raw table, coloured by its spherical harmonics."""
    return render(view_colour(raw, camera.position.tolist(), degree), camera, background, tile)


def composite_backward(frags: DataFrame, grad: DataFrame, background: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Gradients for the screen attributes of each Gaussian: gu gv gka gkb gkc gopacity gdepth gr gg gb.

    ``grad`` has for each pixel gr gg gb gdepth galpha. What lies behind a fragment is a running sum in reverse
    order: its weight falls with the fragment's own opacity.
    """
    j = frags.join(grad.select("x", "y", *(F.col(c).alias(f"__{c}") for c in ("gr", "gg", "gb", "gdepth", "galpha"))), ["x", "y"])
    shade = _total([F.col(c) * F.col(f"__g{c}") for c in (*RGB, "depth")])
    j = j.withColumn("__own", shade).withColumn("__part", F.col("__own") * F.col("alpha") * F.col("t"))
    behind = Window.partitionBy("x", "y").orderBy("depth", "gid").rowsBetween(1, Window.unboundedFollowing)
    j = j.withColumn("__behind", F.coalesce(F.sum("__part").over(behind), F.lit(0.0)))
    j = j.withColumn("__end", F.min("after").over(Window.partitionBy("x", "y")))
    back = _total([F.lit(float(b)) * F.col(f"__g{c}") for b, c in zip(background, RGB, strict=True)])
    j = j.withColumn("__da", F.col("__own") * F.col("t") - F.col("__behind") / (1 - F.col("alpha")) + (F.col("__galpha") - back) * F.col("__end") / (1 - F.col("alpha")))
    raw = F.col("opacity") * F.col("gauss")
    j = j.withColumn("__dp", F.when(raw <= MOST_ALPHA, raw * F.col("__da")).otherwise(F.lit(0.0)))
    dx, dy, dp, w = F.col("dx"), F.col("dy"), F.col("__dp"), F.col("alpha") * F.col("t")
    parts = {
        "gu": -dp * (F.col("ka") * dx + F.col("kb") * dy),
        "gv": -dp * (F.col("kc") * dy + F.col("kb") * dx),
        "gka": -0.5 * dx * dx * dp,
        "gkb": -dx * dy * dp,
        "gkc": -0.5 * dy * dy * dp,
        "gopacity": F.when(raw <= MOST_ALPHA, F.col("gauss") * F.col("__da")).otherwise(F.lit(0.0)),
        "gdepth": w * F.col("__gdepth"),
    } | {f"g{c}": w * F.col(f"__g{c}") for c in RGB}
    return j.groupBy("gid").agg(*(F.sum(c).alias(n) for n, c in parts.items()))


# -- image losses; images have x, y and r, g, b


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, channel, p, q) of two images."""
    long = lambda df, name: df.select("x", "y", F.explode(F.array(*(F.struct(F.lit(i).alias("channel"), F.col(c).alias(name)) for i, c in enumerate(RGB)))).alias("s")).select("x", "y", "s.*")
    return long(a, "p").join(long(b, "q"), ["x", "y", "channel"])


def l1(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b).agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias("l1"))


def _blurred(df: DataFrame, names: Sequence[str], window: int, sigma: float, keep: Sequence[str] = ()) -> DataFrame:
    """``names`` under a Gaussian window with zeros beyond the edges, and ``keep`` as they are, for each pixel and channel.

    The window is separable: two passes of ``window`` taps each send weighted sums along an axis. What a pixel sends to
    itself tells which pixels the image has, so that it isn't read again.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    weights = [w / sum(weights) for w in weights]
    taps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-half, half + 1), weights, strict=True)))
    own = ["__in", *keep]
    df = df.withColumn("__in", F.lit(1))
    for axis in ("x", "y"):
        moved = df.withColumn("__t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("__t.d"))
        df = moved.groupBy("x", "y", "channel").agg(*(F.sum(F.col(n) * F.col("__t.w")).alias(n) for n in names), *(F.max(F.when(F.col("__t.d") == 0, F.col(k))).alias(k) for k in own))
    return df.filter("__in = 1").drop("__in")


def _structure(a: DataFrame, b: DataFrame, window: int, sigma: float) -> DataFrame:
    """For each pixel and channel the four factors of the similarity, the blurred values m and n, and the own ones."""
    p, q, m, n = (F.col(c) for c in "pqmn")
    values = _both(a, b).select("x", "y", "channel", "p", "q", p.alias("m"), q.alias("n"), (p * p).alias("pp"), (q * q).alias("qq"), (p * q).alias("pq"))
    c1, c2 = 0.01**2, 0.03**2
    factors = {
        "f_mean": 2 * m * n + c1,
        "f_cov": 2 * (F.col("pq") - m * n) + c2,
        "f_square": m * m + n * n + c1,
        "f_var": (F.col("pp") - m * m) + (F.col("qq") - n * n) + c2,
    }
    return _blurred(values, ["m", "n", "pp", "qq", "pq"], window, sigma, ["p", "q"]).select("x", "y", "channel", "p", "q", "m", "n", *(c.alias(name) for name, c in factors.items()))


_SIMILARITY = "f_mean * f_cov / (f_square * f_var)"


def ssim(a: DataFrame, b: DataFrame, window: int = 11, sigma: float = 1.5) -> DataFrame:
    """One row: the structural similarity, Gaussian window, zeros beyond the edges."""
    return _structure(a, b, window, sigma).agg(F.avg(F.expr(_SIMILARITY)).alias("ssim"))


def ssim_backward(a: DataFrame, b: DataFrame, pixels: int, window: int = 11, sigma: float = 1.5) -> DataFrame:
    """(x, y, gr, gg, gb): the gradient of ssim() for the first image, which has ``pixels`` pixels.

    Slopes by the blurred value, its square and the product go back through the same window, which is symmetric.
    """
    s = _structure(a, b, window, sigma).withColumn("s", F.expr(_SIMILARITY))
    slopes = {
        "by_mean": "2 * n * (f_cov - f_mean) / (f_square * f_var) + 2 * m * s * (1 / f_var - 1 / f_square)",
        "by_square": "-s / f_var",
        "by_product": "2 * f_mean / (f_square * f_var)",
    }
    back = _blurred(s.select("x", "y", "channel", "p", "q", *(F.expr(e).alias(n) for n, e in slopes.items())), list(slopes), window, sigma, ["p", "q"])
    g = back.select("x", "y", "channel", ((F.col("by_mean") + 2 * F.col("p") * F.col("by_square") + F.col("q") * F.col("by_product")) / (3 * pixels)).alias("g"))
    return g.groupBy("x", "y").agg(*(F.max(F.when(F.col("channel") == i, F.col("g"))).alias(f"g{c}") for i, c in enumerate(RGB)))
