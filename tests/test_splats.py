"""Gaussians: values, files, and rendering against a small NumPy rasteriser."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.camera import Camera
from voxloom.operators import raster, splats
from voxloom.sources import ply

SCHEMA = "gid long, px double, py double, pz double, qw double, qx double, qy double, qz double, sx double, sy double, sz double, opacity double, r double, g double, b double, vx double, vy double, vz double"
CAMERA = Camera.look_at((0, 0, -3), (0, 0, 0), (0, -1, 0), 32, 32, 0.9)


def table(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], SCHEMA.replace("gid long", "gid double")).withColumn("gid", F.col("gid").cast("long"))


def one(gid=0, p=(0, 0, 0), q=(1, 0, 0, 0), s=(1, 1, 1), opacity=0.5, rgb=(0, 0, 0), v=(0, 0, 0)):
    return (gid, *p, *q, *s, opacity, *rgb, *v)


def crowd(n=40, seed=0):
    rng = np.random.default_rng(seed)
    return [one(i, rng.normal(0, 0.5, 3), rng.normal(size=4), rng.uniform(0.05, 0.3, 3), rng.uniform(0.2, 0.95), rng.uniform(size=3), rng.normal(size=3)) for i in range(n)]


def rotation(q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def covariance(row):
    r = rotation(row[4:8])
    return r @ np.diag(np.square(row[8:11])) @ r.T


def matrix(r, tag):
    return np.array([[r[f"{tag}{''.join(sorted(a + b))}"] for b in "xyz"] for a in "xyz"])


def test_covariances(spark):
    rows = crowd(10)
    df = table(spark, rows)
    for got, inv, row in zip(splats.covariances(df).orderBy("gid").collect(), splats.inverse_covariances(df).orderBy("gid").collect(), rows):
        np.testing.assert_allclose(matrix(got, "c"), covariance(row), atol=1e-12)
        np.testing.assert_allclose(matrix(inv, "i") @ covariance(row), np.eye(3), atol=1e-8)
    with pytest.raises(Exception, match="quaternion"):
        splats.covariances(table(spark, [one(q=(0, 0, 0, 0))])).collect()


def test_values(spark):
    df = table(spark, [one()])
    assert splats.with_mahalanobis(df, (1, 2, 2)).first().mahalanobis2 == pytest.approx(9)
    assert splats.with_density(df, (0, 0, 0)).first().density == pytest.approx((2 * math.pi) ** -1.5)
    pair = spark.createDataFrame([(0, 0)], "gid_a long, gid_b long")
    assert splats.overlap_integrals(df, df, pair).first().overlap == pytest.approx((4 * math.pi) ** -1.5)


def test_transform_moves_covariance(spark):
    rows, q, t = crowd(5), (0.9, 0.1, -0.3, 0.2), (1, 2, 3)
    moved = splats.transform(table(spark, rows), q, t)
    r = rotation(q)
    for got, c, row in zip(moved.orderBy("gid").collect(), splats.covariances(moved).orderBy("gid").collect(), rows):
        np.testing.assert_allclose([got.px, got.py, got.pz], r @ row[1:4] + t)
        np.testing.assert_allclose([got.vx, got.vy, got.vz], r @ row[15:18])
        np.testing.assert_allclose(matrix(c, "c"), r @ covariance(row) @ r.T, atol=1e-12)


def test_filters_and_validation(spark):
    df = table(spark, [one(0, (1, 0, 0), opacity=0.25), one(1, (0, 2, 0), opacity=0.75)])
    assert [r.gid for r in splats.filter_opacity(df, 0.5).collect()] == [1]
    assert [r.gid for r in splats.filter_bounds(df, (0, 0, 0), (1, 3, 1)).collect()] == [1]
    for f in (lambda: splats.filter_opacity(df, 2), lambda: splats.filter_bounds(df, (0, 0, 0), (0, 1, 1))):
        with pytest.raises(ValueError):
            f()
    assert splats.validated(df).count() == 2
    with pytest.raises(Exception, match="out of range"):
        splats.validated(table(spark, [one(opacity=1.5)])).collect()


def test_knn_is_exact_for_any_cell(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (40, 3)), rng.uniform(-5, 5, (20, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "gid long, px double, py double, pz double")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:3]}
    for cell in (0.05, 20.0):
        assert {(r.gid, r.other) for r in splats.knn(df, 3, cell).collect()} == want


def shuffled(df):
    """Rows of each exchange of what was run last on ``df``."""
    rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_knn_shuffles_no_pairs(spark):
    """Over many blocks, with repeated places, equal distances and far points; rows that any step reads stay near the number of points."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.floor(rng.normal(0, 0.12, (5000, 3)) * 64) / 64, np.zeros((50, 3)), rng.uniform(-9, 9, (50, 3))])
    gid = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(g), *map(float, p)) for g, p in zip(gid, x, strict=True)], "gid long, px double, py double, pz double")
    off = x[:, None] - x[None]
    d = off[..., 0] * off[..., 0] + off[..., 1] * off[..., 1] + off[..., 2] * off[..., 2]
    np.fill_diagonal(d, np.inf)
    order = np.argsort(gid)
    want = {(int(gid[i]), int(gid[order[j]])) for i in range(len(x)) for j in np.argsort(d[i, order], kind="stable")[:3]}
    near = splats.knn(df, 3, 0.1)
    assert {(r.gid, r.other) for r in near.collect()} == want
    rows = shuffled(near)
    assert rows and max(rows) < 5 * len(x)


def test_gaussians_from_points_shuffle_no_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 0.12, (3000, 3)) * 64) / 64
    df = spark.createDataFrame([(i, *map(float, p), 0.5, 0.5, 0.5) for i, p in enumerate(x)], "gid long, px double, py double, pz double, r double, g double, b double")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    made = splats.from_points(df, 0.1)
    got = {r.gid: r.sx for r in made.collect()}
    want = 0.5 * np.log(np.maximum(np.sort(d, 1)[:, :3].mean(1), 1e-7))
    np.testing.assert_allclose([got[i] for i in range(len(x))], want, rtol=1e-9)
    rows = shuffled(made)
    assert rows and max(rows) < 5 * len(x)


def reference_image(rows, camera, background):
    w, t = camera.rotation, camera.translation
    items = []
    for row in rows:
        c = w @ np.array(row[1:4]) + t
        z = max(c[2], camera.near)
        lim = 0.65 * camera.width / camera.fx
        tx, ty = np.clip(c[:2] / z, -lim, lim)
        j = np.array([[camera.fx / z, 0, -camera.fx * tx / z], [0, camera.fy / z, -camera.fy * ty / z]]) @ w
        cov = j @ covariance(row) @ j.T + 0.3 * np.eye(2)
        if c[2] > camera.near:
            items.append((c[2], row[0], np.array([camera.fx * c[0] / z + camera.cx, camera.fy * c[1] / z + camera.cy]), np.linalg.inv(cov), row, math.ceil(3 * math.sqrt(np.trace(cov) / 2 + math.sqrt(max((np.trace(cov) / 2) ** 2 - np.linalg.det(cov), 0.1))))))
    items.sort(key=lambda i: i[:2])
    out = np.zeros((camera.height, camera.width, 5))
    for y in range(camera.height):
        for x in range(camera.width):
            trans = 1.0
            for z, _, mean, conic, row, radius in items:
                tile = lambda v: int(np.clip(np.floor(v / 16), 0, 1))
                if not (tile(mean[0] - radius) <= x // 16 <= tile(mean[0] + radius) and tile(mean[1] - radius) <= y // 16 <= tile(mean[1] + radius)):
                    continue
                d = mean - (x + 0.5, y + 0.5)
                alpha = min(0.99, row[11] * math.exp(-0.5 * d @ conic @ d))
                if alpha < 1 / 255:
                    continue
                if trans * (1 - alpha) < 1e-4:
                    break
                out[y, x] += np.array([*row[12:15], z, 0]) * alpha * trans
                trans *= 1 - alpha
            out[y, x, :3] += trans * np.array(background)
            out[y, x, 4] = 1 - trans
    return out


def image(df):
    out = np.zeros((32, 32, 5))
    for r in df.collect():
        out[r.y, r.x] = [r.r, r.g, r.b, r.depth, r.alpha]
    return out


def test_render_equals_a_rasteriser(spark):
    rows = crowd(30)
    got = image(raster.render(table(spark, rows), CAMERA, (0.2, 0.4, 0.6)))
    np.testing.assert_allclose(got, reference_image(rows, CAMERA, (0.2, 0.4, 0.6)), atol=1e-9)


def test_render_scenes(spark):
    red = image(raster.render(table(spark, [one(s=(0.3,) * 3, opacity=0.9, rgb=(1, 0, 0))]), CAMERA))
    assert red[16, 16, 0] > 0.7 and red[16, 16, 4] > 0.8 and red[0, 0, 4] < 1e-3
    assert red[16, 16, 3] / red[16, 16, 4] == pytest.approx(3, abs=0.05)
    empty = image(raster.render(table(spark, [one()]).limit(0), CAMERA, (0.2, 0.4, 0.6)))
    assert (empty[..., :3] == [0.2, 0.4, 0.6]).all()
    two = image(raster.render(table(spark, [one(0, (0, 0, -1), s=(0.3,) * 3, opacity=0.99, rgb=(1, 0, 0)), one(1, (0, 0, 1), s=(0.3,) * 3, opacity=0.99, rgb=(0, 0, 1))]), CAMERA))
    assert two[16, 16, 0] > 0.8 and two[16, 16, 2] < 0.1


def test_backward_of_compositing(spark):
    rows = crowd(6, seed=3)
    screen = raster.project(table(spark, rows), CAMERA).cache()
    rng = np.random.default_rng(0)
    g = rng.normal(size=(32, 32, 5))
    grad = spark.createDataFrame([(x, y, *map(float, g[y, x])) for y in range(32) for x in range(32)], "x int, y int, gr double, gg double, gb double, gdepth double, galpha double")
    got = {r.gid: r for r in raster.composite_backward(raster.fragments(screen, CAMERA), grad, (0.1, 0.2, 0.3)).collect()}
    loss = lambda df: float((image(raster.composite(raster.fragments(df, CAMERA), CAMERA, (0.1, 0.2, 0.3))) * g).sum())
    gid = next(iter(got))
    for column, name in (("u", "gu"), ("kb", "gkb"), ("opacity", "gopacity"), ("r", "gr"), ("depth", "gdepth")):
        moved = lambda s: screen.withColumn(column, F.when(F.col("gid") == gid, F.col(column) + s * 1e-6).otherwise(F.col(column)))  # noqa: B023, E731
        assert got[gid][name] == pytest.approx((loss(moved(1)) - loss(moved(-1))) / 2e-6, rel=2e-3, abs=1e-4), name


def test_ssim(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(size=(2, 9, 8, 3))
    make = lambda i: spark.createDataFrame([(x, y, *map(float, i[y, x])) for y in range(9) for x in range(8)], "x int, y int, r double, g double, b double")
    w = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    w /= w.sum()

    def blur(i):
        p = np.pad(i, ((5, 5), (5, 5), (0, 0)))
        return sum(w[s] * w[t] * p[s : s + 9, t : t + 8] for s in range(11) for t in range(11))

    ma, mb = blur(a), blur(b)
    saa, sbb, sab = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    want = ((2 * ma * mb + 1e-4) * (2 * sab + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (saa + sbb + 9e-4))).mean()
    assert raster.ssim(make(a), make(b)).first()[0] == pytest.approx(want)
    assert raster.l1(make(a), make(b)).first()[0] == pytest.approx(abs(a - b).mean())
    assert raster.ssim(make(a), make(a)).first()[0] == pytest.approx(1)


def test_ply_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 6
    cols = {c: rng.normal(size=n) for c in ply._SCALARS}
    q = rng.normal(size=(4, n))
    cols |= dict(zip(("qw", "qx", "qy", "qz"), q / np.linalg.norm(q, axis=0)))
    rest = rng.normal(size=(n, 15, 3))
    (tmp_path / "a.ply").write_bytes(ply.encode(cols, rest))
    got = ply.read_raw(spark, str(tmp_path / "a.ply")).orderBy("gid").collect()
    for i, r in enumerate(got):
        np.testing.assert_allclose([r[c] for c in cols], [cols[c][i] for c in cols], atol=1e-6)
        np.testing.assert_allclose(r.rest, rest[i], atol=1e-6)
    ply.write(ply.read_raw(spark, str(tmp_path / "a.ply")), str(tmp_path / "b.ply"))
    assert (tmp_path / "b.ply").read_bytes() == (tmp_path / "a.ply").read_bytes()
    act = ply.read(spark, str(tmp_path / "a.ply")).orderBy("gid").first()
    assert act.opacity == pytest.approx(1 / (1 + math.exp(-cols["opacity_raw"][0])), abs=1e-6) and act.sx == pytest.approx(math.exp(cols["sx"][0]), rel=1e-5)


def test_compressed_ply(spark, tmp_path):
    n = 300
    names = [f"{s}_{w}" for w in ("x", "y", "z", "scale_x", "scale_y", "scale_z", "r", "g", "b") for s in ("min", "max")]
    chunk = np.zeros(2, [(c, "<f4") for c in names])
    for c in names:
        chunk[c] = -1 if c.startswith("min") else 1
    for c in "rgb":
        chunk[f"min_{c}"] = 0
    vertex = np.zeros(n, [(f"packed_{c}", "<u4") for c in ("position", "rotation", "scale", "color")])
    vertex["packed_position"] = (2047 << 21) | (0 << 11) | 1024
    vertex["packed_rotation"] = (1 << 30) | (512 << 20) | (512 << 10) | 512
    vertex["packed_scale"] = (0 << 21) | (1023 << 11) | 2047
    vertex["packed_color"] = (255 << 24) | (0 << 16) | (51 << 8) | 128
    head = ["ply", "format binary_little_endian 1.0", "element chunk 2", *(f"property float {c}" for c in names), f"element vertex {n}", *(f"property uint {c}" for c in vertex.dtype.names), "end_header", ""]
    (tmp_path / "c.ply").write_bytes("\n".join(head).encode() + chunk.tobytes() + vertex.tobytes())
    r = ply.read(spark, str(tmp_path / "c.ply")).filter("gid = 299").first()
    np.testing.assert_allclose([r.px, r.py, r.pz, r.sx, r.sy, r.sz], [1, -1, 2 * 1024 / 2047 - 1, math.exp(-1), math.e, math.e], rtol=1e-6)
    np.testing.assert_allclose([r.r, r.g, r.b, r.opacity], [1, 0, 0.2, 128 / 255], atol=1e-6)
    assert r.qx > 0.99 and abs(r.qw) < 0.01


@pytest.mark.parametrize("data", [b"nothing", b"ply\nformat ascii 1.0\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty list uchar int v\nend_header\n"])
def test_malformed_ply(data):
    with pytest.raises(ValueError):
        list(ply.decode(data))


def test_view_colour_by_harmonics(spark):
    raw = splats.deactivate(table(spark, [one(p=(0, 0, 1))]))
    raw = raw.withColumns({f"dc{i}": F.lit(0.25) for i in range(3)})
    assert splats.view_colour(raw, (0, 0, 0), 0).first().r == pytest.approx(0.5 + 0.28209479177387814 * 0.25)
    sh = F.array(*(F.array(*(F.lit(v),) * 3) for v in (0.0, 1.0, 0.0)))
    got = splats.view_colour(raw.withColumn("rest", sh), (0, 0, 0), 1).first().r
    assert got == pytest.approx(0.5 + 0.28209479177387814 * 0.25 + 0.4886025119029199)


def test_queries_take_all_gaussians(spark, tmp_path):
    from voxloom.plans import catalog
    from voxloom.plans.splat_queries import WIDE, gaussians

    rng = np.random.default_rng(9)
    rows = [(i * 7, [float(v) for v in rng.normal(0, 0.15, 64)]) for i in range(600)]  # ids with gaps, beyond 500
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = catalog.queries()
    df = gaussians(spark, str(tmp_path))
    pairs = {(r.gid_a, r.gid_b) for r in q["overlap_integrals"](spark, str(tmp_path)).select("gid_a", "gid_b").collect()}
    assert pairs == {(i * 7, (i + 1) % 600 * 7) for i in range(600)}
    got = q["knn"](spark, str(tmp_path)).collect()
    x = np.array([[r.px, r.py, r.pz] for r in df.orderBy("gid").select(*splats.P).collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert {(r.gid, r.other) for r in got} == {(i * 7, int(j) * 7) for i in range(600) for j in np.argsort(d[i], kind="stable")[:3]}
    # the image of all differs from that of a few, and is what render gives for all
    image = lambda f: {(r.x, r.y): (r.r, r.g, r.b) for r in f.collect()}
    whole, few = image(q["render"](spark, str(tmp_path))), image(raster.render(df.filter("gid < 64"), WIDE, (0.1, 0.2, 0.3)))
    want = image(raster.render(df, WIDE, (0.1, 0.2, 0.3)))
    assert whole.keys() == want.keys() and all(np.allclose(whole[k], want[k], atol=1e-6) for k in want)  # the query rounds
    assert not all(np.allclose(whole[k], few[k], atol=1e-3) for k in few)
