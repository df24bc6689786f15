import numpy as np
import pytest
from pyspark.sql import functions as F
from test_splats import CAMERA, crowd, image, table
from test_voxels import cloud

from voxloom import streaming
from voxloom.operators import pool, raster, splats
from voxloom.plans import blocks, training


@pytest.mark.parametrize("kind", ["sgd", "adam", "adamw"])
def test_optimisers_descend(kind):
    p = {"w": np.array([3.0, -2.0])}
    opt = training.Optimizer(p, kind, rate=0.1, momentum=0.5 if kind == "sgd" else 0.0, decay=0.01)
    acc = training.Accumulator(opt, 2)
    for _ in range(300):
        acc.add({"w": 2 * p["w"]})
    assert abs(p["w"]).max() < 0.05 and opt.steps == 150
    acc.add({"w": p["w"]})
    assert acc.flush() and not acc.flush()
    sched = training.StepDecay(opt, 2)
    assert [round(sched.step(), 6) for _ in range(3)] == [0.1, 0.01, 0.01]


def test_epoch_over_batches(spark):
    rows = [(i, float(x), 2.0 * x + 1) for i in range(6) for x in range(4)]
    df = spark.createDataFrame(rows, "sample int, x double, y double")
    p = {"w": np.zeros(2)}

    def step(batch):
        e = F.lit(float(p["w"][0])) * F.col("x") + float(p["w"][1]) - F.col("y")
        r = batch.agg(F.avg(e * e), F.avg(2 * e * F.col("x")), F.avg(2 * e)).first()
        return r[0], {"w": np.array([r[1], r[2]])}

    opt = training.Optimizer(p, "adam", rate=0.2)
    first = training.train_epoch(step, training.batches(df, 2, seed=1), opt)
    for k in range(6):
        last = training.train_epoch(step, training.batches(df, 3, seed=k), opt)
    assert last < first / 4 and training.evaluate(lambda b: step(b)[0], training.batches(df, 6)) < first


def test_blocks(spark):
    v, cells = cloud(spark, 40, 3, 4, span=2)
    y = blocks.Residual(4, 4, excite=2)(v)
    assert y.df.count() == len(cells) and y.df.agg(F.min("f0")).first()[0] >= 0
    y = blocks.Residual(4, 2, stride=2, bottleneck=True, expansion=2)(v)
    assert len(y.feats) == 4 and y.stride == (2, 2, 2)
    u = blocks.UNet(4, 3, (4, 4))(v)
    assert len(u.feats) == 3 and u.df.count() == len(cells)
    scores = blocks.classify(v, [blocks.Conv(4, 4, stride=2)], np.ones((4, 5)), [0.0] * 5)
    assert scores.count() == 2 and len(scores.columns) == 6


def test_squeeze_excite_gates_by_batch(spark):
    v, cells = cloud(spark, 30, 2, 2)
    w = np.zeros((2, 1)), np.zeros((1, 2))
    got = {(r.b, r.x, r.y): (r.f0, r.f1) for r in blocks.squeeze_excite(v, *w).df.collect()}
    assert all(got[k] == pytest.approx(tuple(f / 2)) for k, f in cells.items())


def test_splat_training(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = crowd(5, seed=7)
    target = raster.render(table(spark, rows), CAMERA).cache()
    start = splats.deactivate(table(spark, rows)).withColumns({"dc0": F.col("dc0") + 0.4, "px": F.col("px") + 0.03})
    t = training.SplatTrainer(start, rates={"p": 0.01, "d": 0.1, "o": 0.01, "s": 0.005, "q": 0.001})
    losses = [t.step(CAMERA, target) for _ in range(4)]
    assert losses[-1] < losses[0]
    assert t.raw.filter("seen > 0").count() == 5
    t.densify_from, t.most_scale = 0.0, 100.0
    added, removed = t.densify_and_prune()
    assert added >= 5 and t.raw.count() == 5 + added - removed and t.raw.select("gid").distinct().count() == t.raw.count()
    t.reset_opacity()
    assert t.raw.agg(F.max("opacity_raw")).first()[0] <= np.log(0.01 / 0.99) + 1e-9
    t.least_opacity, t.densify_from = 1.0, 1e9
    assert t.densify_and_prune() == (0, 0)
    assert image(t.render_image(CAMERA)).shape == (32, 32, 5)


def test_projection_backward(spark):
    rows = crowd(4, seed=2)
    raw = splats.deactivate(table(spark, rows))
    names = ("gu", "gv", "gka", "gkb", "gkc", "gdepth", "gopacity", "gr", "gg", "gb")
    grads = raw.select("gid", *(F.lit(1.0).alias(n) for n in names))
    got = training.project_backward(raw, grads, CAMERA).orderBy("gid").first()
    total = lambda df: raster.project(splats.activate(df), CAMERA).filter("gid = 0").select(F.col("u") + F.col("v") + F.col("ka") + F.col("kb") + F.col("kc") + F.col("depth")).first()[0]
    for c in ("px", "pz", "sy", "qx"):
        up, down = (total(raw.withColumn(c, F.col(c) + s * 1e-5)) for s in (1, -1))
        assert got[f"g_{c}"] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-4)


def test_objective(spark):
    df = table(spark, crowd(3))
    a = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.5)], "x int, y int, r double, g double, b double")
    assert training.objective(df, a, a) == 0 and training.objective(df, a, a, 1.0, 0.5) > 0
    with pytest.raises(ValueError):
        training.objective(df, a, a, -1.0)


def test_streaming(spark, tmp_path):
    rows = [(0, 1, 2.0), (0, 1, 3.0), (1, 4, 5.0)]
    spark.createDataFrame(rows, "b int, x long, f double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("b int, x long, f double").parquet(str(tmp_path / "in"))
    q = streaming.voxel_sums(stream, ["x"], ["f"]).writeStream.outputMode("complete").format("memory").queryName("voxels_now").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("voxels_now").collect()} == {(0, 1, 5.0, 2), (1, 4, 5.0, 1)}
    q = streaming.for_each_batch(stream, lambda df: pool.voxelise(df, ["x"], ["f"], "max").df, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert {(r.b, r.x, r.f) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 1, 3.0), (1, 4, 5.0)}


def test_ssim_backward(spark):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(size=(2, 6, 7, 3))
    make = lambda i: spark.createDataFrame([(x, y, *map(float, i[y, x])) for y in range(6) for x in range(7)], "x int, y int, r double, g double, b double")
    got = {(r.x, r.y): (r.gr, r.gg, r.gb) for r in raster.ssim_backward(make(a), make(b), 42).collect()}
    assert len(got) == 42
    for x, y, c in ((0, 0, 0), (3, 2, 1), (6, 5, 2)):
        up, down = a.copy(), a.copy()
        up[y, x, c] += 1e-5
        down[y, x, c] -= 1e-5
        want = (raster.ssim(make(up), make(b)).first()[0] - raster.ssim(make(down), make(b)).first()[0]) / 2e-5
        assert got[x, y][c] == pytest.approx(want, rel=1e-4, abs=1e-9)


def test_harmonics_backward(spark):
    rng = np.random.default_rng(8)
    rest = rng.normal(0, 0.2, size=(3, 15, 3))
    rows = splats.deactivate(table(spark, crowd(3, seed=8))).drop("rest").orderBy("gid").collect()
    schema = splats.deactivate(table(spark, crowd(3, seed=8))).schema
    make = lambda r, k=None, c=0, by=0.0: spark.createDataFrame([tuple(row[f] if f != "rest" else [[v + (by if (i, j, m) == (0, k, c) else 0) for m, v in enumerate(t)] for j, t in enumerate(r[i].tolist())] for f in schema.names) for i, row in enumerate(rows)], schema)
    raw = make(rest)
    grads = raw.select("gid", *(F.lit(1.0 if n in ("gr", "gg", "gb") else 0.0).alias(n) for n in ("gu", "gv", "gka", "gkb", "gkc", "gdepth", "gopacity", "gr", "gg", "gb")))
    got = training.project_backward(raw, grads, CAMERA, degree=2).filter("gid = 0").first()
    assert len(got.g_rest) == 15 and all(v == 0 for k in got.g_rest[8:] for v in k)
    shown = lambda df: splats.view_colour(df, CAMERA.position.tolist(), 2).filter("gid = 0").select(F.col("r") + F.col("g") + F.col("b")).first()[0]
    for k, c in ((0, 0), (4, 1), (7, 2)):
        assert got.g_rest[k][c] == pytest.approx((shown(make(rest, k, c, 1e-5)) - shown(make(rest, k, c, -1e-5))) / 2e-5, rel=1e-4, abs=1e-8)
    for c in ("px", "pz"):
        up, down = (shown(raw.withColumn(c, F.col(c) + s * 1e-5)) for s in (1, -1))
        assert got[f"g_{c}"] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_schedule_and_harmonics_in_training(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = crowd(4, seed=9)
    target = raster.render(table(spark, rows), CAMERA).cache()
    start = splats.deactivate(table(spark, rows)).withColumns({"dc0": F.col("dc0") + 0.5, "rest": F.array_repeat(F.array_repeat(F.lit(0.0), 3), 3)})
    t = training.SplatTrainer(start, extent=2.0, degree_every=0, most_degree=1, densify_after=1, densify_every=2, reset_every=3, densify_from=0.0, most_scale=100.0, most=8)
    assert t.rate("px") == pytest.approx(2 * 1.6e-4) and t.rate("rest") == 1.25e-4
    t.step(CAMERA, target)
    assert t.raw.count() == 4 and t.raw.select(F.explode("rest").alias("k")).filter("k[0] <> 0").count() > 0
    t.step(CAMERA, target)
    assert t.raw.count() >= 4
    t.step(CAMERA, target)
    assert t.raw.agg(F.max("opacity_raw")).first()[0] <= np.log(0.01 / 0.99) + 1e-9
    assert t.rate("px") < 2 * 1.6e-4


def test_optimiser_of_activated_tables(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    opt = training.SplatOptimizer(table(spark, crowd(3)), 0.5)
    grads = opt.gaussians.select("gid", F.lit(1.0).alias("g_sx"), F.lit(-1.0).alias("g_opacity"))
    before = opt.gaussians.agg(F.sum("px")).first()[0]
    for _ in range(2):
        opt.step(grads)
    r = opt.gaussians.agg(F.max("sx"), F.min("opacity"), F.sum("px"), F.count("*")).first()
    assert r[0] == pytest.approx(1e-6) and r[1] == 1 and r[2] == pytest.approx(before) and r[3] == 3
    with pytest.raises(ValueError):
        training.SplatOptimizer(opt.gaussians.limit(0))
