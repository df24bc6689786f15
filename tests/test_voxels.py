"""Voxel operators against brute force in NumPy, adjoint identities, and the shape of plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import channels, losses
from voxloom.functions.offsets import Kernel
from voxloom.model import Points, Voxels
from voxloom.operators import conv, coords, norm, pool, setops

AXES = ("x", "y", "z", "t")


def cloud(spark, n, dim, feats=1, seed=0, span=4):
    rng = np.random.default_rng(seed)
    keys = np.unique(np.concatenate([rng.integers(0, 2, (n, 1)), rng.integers(-span, span, (n, dim))], 1), axis=0)
    values = rng.integers(-9, 10, (len(keys), feats)).astype(float)
    cols = ["b", *AXES[:dim], *(f"f{i}" for i in range(feats))]
    rows = [tuple(map(int, k)) + tuple(map(float, v)) for k, v in zip(keys, values)]
    schema = ", ".join(f"{c} {'double' if c[0] == 'f' else 'long'}" for c in cols)
    df = spark.createDataFrame(rows, schema).repartition(3)
    return Voxels(df, AXES[:dim], tuple(cols[1 + dim :]), (1,) * dim, "in"), {tuple(k): v for k, v in zip(map(tuple, keys), values)}


def collected(v):
    return {tuple(r[k] for k in v.keys): np.array([r[f] for f in v.feats]) for r in v.df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-9)


def brute(cells, outs, taps, w, sign=1):
    out = {}
    for o in outs:
        hits = [(k, i) for k, off in enumerate(taps) if (i := (o[0], *(c + sign * d for c, d in zip(o[1:], off)))) in cells]
        out[o] = sum((cells[i] @ w[k] for k, i in hits), np.zeros(w.shape[2]))  # 0 where nothing reaches
    return out


@pytest.mark.parametrize("dim,size,shape,dilation", [(1, 5, "cube", 1), (2, 3, "cross", 1), (3, 3, "cube", 1), (3, 2, "cube", 1), (2, 3, "cube", 2), (4, 3, "cross", 1)])
def test_convolution(spark, dim, size, shape, dilation):
    v, cells = cloud(spark, 60, dim, 2, seed=dim)
    k = Kernel(size, dilation, shape)
    w = np.random.default_rng(1).normal(size=(k.volume(dim), 2, 3))
    same(collected(conv.convolve(v, w, k)), brute(cells, cells, k.taps(dim), w))


@pytest.mark.parametrize("stride", [2, 3])
def test_strided_convolution_with_negative_coordinates(spark, stride):
    v, cells = cloud(spark, 80, 3)
    k = Kernel(3)
    w = np.random.default_rng(2).normal(size=(27, 1, 1))
    outs = {(c[0], *(int(np.floor(x / stride)) * stride for x in c[1:])) for c in cells}
    got = collected(conv.convolve(v, w, k, stride))
    same(got, brute(cells, outs, k.taps(3), w))
    assert set(collected(coords.stride(v, stride))) == outs


def test_transposed_convolution_is_the_adjoint(spark):
    v, _ = cloud(spark, 60, 2, 2)
    k = Kernel(3)
    w = np.random.default_rng(3).normal(size=(9, 2, 3))
    y = conv.convolve(v, w, k, 2)
    g = y.map(lambda c: F.sin(c))
    gx = conv.convolve_transpose(g, np.ascontiguousarray(w.transpose(0, 2, 1)), k, 2, out=v)
    dot = lambda a, b: sum(float(a[i] @ b[i]) for i in a if i in b)
    assert dot(collected(y), collected(g)) == pytest.approx(dot(collected(v), collected(gx)))


def test_backward_of_convolution(spark):
    v, cells = cloud(spark, 40, 2, 2)
    k = Kernel(3)
    w = np.random.default_rng(4).normal(size=(9, 2, 2))
    g = conv.convolve(v, w, k).map(lambda c: F.cos(c))
    gx, gw = conv.convolve_backward(v, g, w, k)
    grads = collected(g)
    table = {(r.k, r.ci, r.co): r["value"] for r in gw.collect()}
    loss = lambda cells, w: sum(float(brute(cells, cells, k.taps(2), w)[o] @ grads[o]) for o in grads)
    eps, base = 1e-6, loss(cells, w)
    for at in [(0, 0, 1), (4, 1, 0), (8, 1, 1)]:
        moved = w.copy()
        moved[at] += eps
        assert table.get(at, 0.0) == pytest.approx((loss(cells, moved) - base) / eps, rel=1e-3, abs=1e-3)
    key = next(iter(cells))
    moved = {c: (f + np.array([eps, 0]) if c == key else f) for c, f in cells.items()}
    assert collected(gx)[key][0] == pytest.approx((loss(moved, w) - base) / eps, rel=1e-3, abs=1e-3)


def test_tiled_pooling_equals_pooling_over_taps(spark):
    v, _ = cloud(spark, 80, 3, 2)
    for mode in ("sum", "average", "max"):
        tiled = pool.pool(v, Kernel(2), 2, mode)
        same(collected(tiled), collected(pool.pool(v, Kernel(2), 2, mode, out=coords.stride(v, 2))))
        assert "Generate" not in tiled.df._jdf.queryExecution().toString()


def test_pool_backward(spark):
    v, cells = cloud(spark, 50, 2)
    coarse = pool.pool(v, Kernel(2), 2, "sum")
    ones = coarse.map(lambda c: F.lit(1.0))
    assert all(x[0] == 1 for x in collected(pool.pool_backward(v, ones, Kernel(2), "sum")).values())
    won = collected(pool.pool_backward(v, ones, Kernel(2), "max"))
    assert won.keys() == cells.keys() and sorted(x[0] for x in won.values()) == [0.0] * (len(cells) - coarse.df.count()) + [1.0] * coarse.df.count()
    assert sum(x[0] for x in collected(pool.pool_backward(v, ones, Kernel(2), "average")).values()) == pytest.approx(coarse.df.count())


def test_quantised_labels(spark):
    rows = [(0, 0.1, 1.0, 3), (1, 0.2, 2.0, 3), (2, 1.5, 3.0, 1), (3, 1.9, 4.0, 2), (4, -0.1, 5.0, 7)]
    df = spark.createDataFrame(rows, "pid long, x double, f double, label int")
    got = {r.x: (r.unique_index, r.f, r.label) for r in coords.sparse_quantise(df, ["x"], 1.0, ["f"], "label").collect()}
    assert got == {0: (0, 1.0, 3), 1: (2, 3.0, -100), -1: (4, 5.0, 7)}


def test_union_and_merge(spark):
    a, ca = cloud(spark, 30, 2, seed=1)
    b, cb = cloud(spark, 30, 2, seed=2)
    total = {k: ca.get(k, 0) + cb.get(k, 0) for k in ca.keys() | cb.keys()}
    same(collected(setops.union(a, b)), total)
    assert set(collected(coords.merge(a, b))) == set(total)
    with pytest.raises(ValueError):
        setops.add(a, Voxels(b.df, b.axes, b.feats, b.stride, "other"))


def test_interpolation_is_a_partition_of_unity_inside(spark):
    full = spark.range(64).select(F.lit(0).cast("int").alias("b"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.lit(1.0).alias("f"))
    v = Voxels(full, ("x", "y"), ("f",), (1, 1), "g")
    p = Points(spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 3.25, 6.5), (2, 0, 7.0, 7.0), (3, 0, 9.5, 1.0)], "pid long, b int, x double, y double"), ("x", "y"), ())
    got = {r.pid: r.f for r in pool.interpolate(v, p).collect()}
    assert got == {0: pytest.approx(1), 1: pytest.approx(1), 2: pytest.approx(1), 3: 0.0}


def test_splat_conserves_features(spark):
    p = Points(spark.createDataFrame([(0, 0, 0.3, -1.2, 2.0), (1, 1, 4.0, 5.5, 3.0)], "pid long, b int, x double, y double, f double"), ("x", "y"), ("f",))
    assert pool.splat(p).df.agg(F.sum("f")).first()[0] == pytest.approx(5.0)


def test_norms(spark):
    v, cells = cloud(spark, 60, 2, 2)
    x = np.array(list(cells.values()))
    want = dict(zip(cells, (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5)))
    same(collected(norm.batch_norm(v)), want)
    got = collected(norm.instance_norm(v, [2.0, 1.0], [0.0, 1.0]))
    for b in (0, 1):
        rows = np.array([f for k, f in cells.items() if k[0] == b])
        for k in (k for k in cells if k[0] == b):
            np.testing.assert_allclose(got[k], (cells[k] - rows.mean(0)) / np.sqrt(rows.var(0) + 1e-8) * [2, 1] + [0, 1])
    unit = collected(norm.normalise_rows(v))
    assert all(np.linalg.norm(f) == pytest.approx(1) or not f.any() for f in unit.values())


def test_instance_norm_backward(spark):
    v, cells = cloud(spark, 20, 1)
    g = v.map(lambda c: F.sin(c))
    got = collected(norm.instance_norm_backward(v, g))
    grads = collected(g)

    def loss(c):
        out = 0.0
        for b in {k[0] for k in c}:
            keys = [k for k in c if k[0] == b]
            x = np.array([c[k][0] for k in keys])
            out += float(((x - x.mean()) / np.sqrt(x.var() + 1e-8)) @ np.array([grads[k][0] for k in keys]))
        return out

    for key in list(cells)[:3]:
        up, down = ({k: f + (1e-5 * s if k == key else 0) for k, f in cells.items()} for s in (1, -1))
        assert got[key][0] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-4, abs=1e-6)


def test_activations(spark):
    from math import erf

    x = np.linspace(-4, 4, 33)
    df = spark.createDataFrame([(float(a),) for a in x], "f double")
    sig = 1 / (1 + np.exp(-x))
    wanted = {
        "relu": np.maximum(x, 0), "relu6": np.clip(x, 0, 6), "leaky_relu": np.where(x >= 0, x, 0.01 * x), "elu": np.where(x > 0, x, np.expm1(x)),
        "selu": 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(x)), "celu": np.maximum(x, 0) + np.minimum(0, np.expm1(x)),
        "gelu": np.array([0.5 * a * (1 + erf(a / 2**0.5)) for a in x]), "silu": x * sig, "sigmoid": sig, "tanh": np.tanh(x),
        "hardshrink": np.where(abs(x) > 0.5, x, 0), "hardtanh": np.clip(x, -1, 1), "logsigmoid": np.log(sig), "rrelu": np.where(x >= 0, x, x * (1 / 8 + 1 / 3) / 2),
        "softplus": np.log1p(np.exp(x)), "softshrink": np.sign(x) * np.maximum(abs(x) - 0.5, 0), "softsign": x / (1 + abs(x)), "tanhshrink": x - np.tanh(x),
        "hardsigmoid": np.clip(x + 3, 0, 6) / 6, "hardswish": x * np.clip(x + 3, 0, 6) / 6, "dropout": x, "alpha_dropout": x,
    }
    got = df.select("f", *(channels.ELEMENTWISE[n](F.col("f")).cast("double").alias(n) for n in wanted)).orderBy("f").toPandas()
    for n, w in wanted.items():
        np.testing.assert_allclose(got[n], w, atol=1e-6, err_msg=n)


def test_softmax_and_losses(spark):
    v, cells = cloud(spark, 30, 1, 3)
    x = np.array(list(cells.values()))
    e = np.exp(x - x.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    same(collected(channels.softmax(v)), dict(zip(cells, p)))
    same(collected(channels.log_softmax(v)), dict(zip(cells, np.log(p))))
    c = np.exp(x - x.max(0))
    same(collected(channels.softmax(v, over_rows=True)), dict(zip(cells, c / c.sum(0))))
    label = F.pmod(F.col("x"), F.lit(3))
    y = np.array([k[1] % 3 for k in cells])
    own = [F.col(f) for f in v.feats]
    at = np.arange(len(y))
    hinge = np.maximum(0, 1 - x[at, y][:, None] + x)
    hinge[at, y] = 0
    for loss, want in (
        (losses.cross_entropy(own, label), -np.log(p[at, y]).mean()),
        (losses.multi_margin(own, label), hinge.mean()),
        (losses.smooth_l1(own[0], own[1]), np.where(abs(x[:, 0] - x[:, 1]) < 1, 0.5 * (x[:, 0] - x[:, 1]) ** 2, abs(x[:, 0] - x[:, 1]) - 0.5).mean()),
        (losses.soft_margin(own[0], F.lit(1.0)), np.log1p(np.exp(-x[:, 0])).mean()),
        (losses.binary_cross_entropy_with_logits(own[0], F.lit(1.0), 2.0), (2 * np.log1p(np.exp(-x[:, 0]))).mean()),
    ):
        assert losses.mean_of(v.df, loss).first()[0] == pytest.approx(want)


def test_plans_have_no_nested_loops(spark):
    v, _ = cloud(spark, 40, 3)
    w = np.ones((27, 1, 1))
    plans = [coords.kernel_map(v, Kernel(3)), conv.convolve(v, w, Kernel(3), 2).df, pool.pool(v, Kernel(3)).df, pool.interpolate(v, Points(v.df.withColumn("pid", F.monotonically_increasing_id()), v.axes, ()))]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_input(spark):
    v, _ = cloud(spark, 10, 2)
    empty = v.with_df(v.df.limit(0))
    assert conv.convolve(empty, np.ones((9, 1, 1)), Kernel(3)).df.count() == 0
    assert pool.global_pool(empty).count() == 0
    assert norm.batch_norm(empty).df.count() == 0
