"""Octree operators: hand-computed values, brute force over boxes, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.offsets import cube_first_axis_slowest, kernel_index
from voxloom.model import OctreeConfig, Points
from voxloom.operators import octree, octree_conv, sphere

CONFIG = OctreeConfig(8.0, 1.0, 3)
XYZ = ("x", "y", "z")


def leaves(spark, rows, feats=("f",), **more):
    schema = "level int, x long, y long, z long, " + ", ".join(f"{f} double" for f in feats)
    rows = [(*r[:4], *map(float, r[4:])) for r in rows]
    return octree.from_voxels(spark.createDataFrame(rows, schema), CONFIG, XYZ, feats, **more)


def points(spark, places, feats=None):
    rows = [(i, 0, *map(float, p), *(() if feats is None else (float(feats[i]),))) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, "pid long, b int, x double, y double, z double" + ("" if feats is None else ", f double"))
    return Points(df, XYZ, () if feats is None else ("f",))


def mixed(spark, a=1.0, b=2.0):
    return leaves(spark, [(0, 0, 0, 0, a)] + [(1, x, y, z, b) for x in (2, 3) for y in (0, 1) for z in (0, 1)])


def table(x):
    return {(r[x.level], *(r[a] for a in x.axes)): [r[f] for f in x.feats] for r in x.df.collect()}


def test_convolution_across_a_refinement_boundary(spark):
    w = np.zeros((27, 1, 1))
    w[kernel_index((0, 0, 0), 3)], w[kernel_index((1, 0, 0), 3)], w[kernel_index((-1, 0, 0), 3)] = 10, 100, 1000
    got = table(octree_conv.convolve(mixed(spark), w, 3))
    assert got[0, 0, 0, 0] == [210] and got[1, 2, 0, 0] == [1220]


def test_means(spark):
    x = mixed(spark, 1, 3)
    assert octree.global_average(x).first()[0] == pytest.approx(2.0)
    assert octree.global_average(x, False).first()[0] == pytest.approx(25 / 9)


def test_nearest_and_uniform(spark):
    x = mixed(spark)
    got = octree_conv.interpolate(x, points(spark, [(4, 4, 4), (9, 1, 1), (15.9, 7.9, 7.9), (-1, 0, 0)])).orderBy("pid").collect()
    assert [r.f for r in got] == [1, 2, 2, 0]
    assert octree.resample_uniform(x, 1).df.count() == 16


def test_fallback_to_the_finest_cell_with_data(spark):
    x = leaves(spark, [(1, 0, 0, 0, 1.0, -1.0), (2, 2, 2, 2, 10.0, -10.0), (0, 1, 0, 0, 100.0, -100.0)], ("f", "g"))
    q = points(spark, [(1, 1, 1), (6.5, 1, 1), (4.5, 4.5, 4.5), (5, 4.5, 6.5), (12, 3, 3), (-3, 1, 1), (3, 20, 1)])
    got = octree_conv.interpolate(x, q, coarser_ancestor=True).orderBy("pid").collect()
    np.testing.assert_allclose([(r.f, r.g) for r in got], [(v, -v) for v in (1, 2, 10, 10, 100, 0, 0)])


@pytest.mark.parametrize("mode", ["nearest", "multilinear"])
def test_points_that_share_an_id_or_lack_one_keep_their_values(spark, mode):
    x = leaves(spark, [(0, 0, 0, 0, 1.0), (1, 4, 0, 0, 5.0)])
    rows = [(7, 0, 4.0, 4.0, 4.0), (7, 0, 17.0, 1.0, 1.0), (7, 0, 22.0, 6.0, 6.0), (None, 0, 4.0, 4.0, 4.0), (None, 0, 50.0, 1.0, 1.0)]
    q = Points(spark.createDataFrame(rows, "pid long, b int, x double, y double, z double"), XYZ, ())
    got = octree_conv.interpolate(x, q, mode, coarser_ancestor=True).collect()
    assert sorted((r.pid or 0, r.f) for r in got) == [(0, 0.0), (0, 1.0), (7, 1.0), (7, 5.0), (7, 5.0)]


@pytest.mark.parametrize("bad", [[(0, 0, 0, 0, 1.0), (1, 1, 1, 1, 1.0)], [(1, 0, 0, 0, 1.0), (1, 0, 0, 0, 2.0)], [(4, 0, 0, 0, 1.0)], [(-1, 0, 0, 0, 1.0)]])
def test_broken_sets_are_rejected(spark, bad):
    with pytest.raises(ValueError):
        leaves(spark, bad)


@pytest.mark.parametrize("bad", [(8, 2, 3, 3), (0, 1, 3, 3), (8, 1, 31, 3), (8, 1, 3, 5)])
def test_broken_configurations_are_rejected(bad):
    base, least, depth, dim = bad
    with pytest.raises(ValueError):
        OctreeConfig(base, least, depth, (0.0,) * dim)


def test_from_points_and_refine(spark):
    x = octree.from_points(points(spark, [(1, 1, 1), (7.9, 0.1, 0.1), (8, 0, 0)], [1, 3, 10]), CONFIG)
    assert table(x) == {(0, 0, 0, 0): [2.0], (0, 1, 0, 0): [10.0]}
    row = leaves(spark, [(0, i, 0, 0, i + 1.0) for i in range(2)])
    fine = octree.refine(row, 1, ((0, 0, 0), (8, 8, 8)))
    assert {k[0] for k in table(fine)} == {0, 1} and fine.df.count() == 9
    with pytest.raises(Exception, match="cell"):
        octree.from_points(points(spark, [(float("nan"), 0, 0)], [1]), CONFIG).df.collect()


def test_split_and_sum_conserve(spark):
    x = mixed(spark)
    fine = octree.refine(x, 3, policy="split")
    assert fine.df.agg(F.sum("f")).first()[0] == pytest.approx(17)
    back = octree.coarsen(fine, 0, reduction="sum")
    assert back.df.agg(F.sum("f")).first()[0] == pytest.approx(17) and not octree.has_overlapping_leaves(back)


def test_drop_empty_is_the_default_without_pointless_leaves(spark):
    rng = np.random.default_rng(5)
    p = points(spark, rng.uniform(0, 16, (40, 3)), rng.uniform(size=40))
    x = octree.from_points(p, CONFIG)
    whole, held = octree.refine(x, 2), octree.refine(x, 2, drop_empty=True)
    used = {tuple(r) for r in octree.locate(p.df, whole, XYZ).select(*(f"leaf_{k}" for k in whole.keys)).distinct().collect()}
    assert {k for k in table(whole) if k in used} == set(table(held))


def test_refine_by_density_stops_at_the_bound(spark):
    rng = np.random.default_rng(6)
    p = points(spark, rng.normal(4, 1, (200, 3)), rng.uniform(size=200))
    x = octree.refine_by_density(octree.from_points(p, CONFIG), 20)
    n = octree.locate(p.df, x, XYZ).groupBy(*(f"leaf_{k}" for k in x.keys)).count().collect()
    assert sum(r["count"] for r in n) == 200
    assert all(r["count"] <= 20 or r.leaf_level == 3 for r in n)


def test_refine_by_variance_of_large_whole_numbers(spark):
    """Sums of squares beyond the largest long."""
    big = 3_000_000_000
    rows = [(i, 0, 1.0 + 6 * (i % 2), 1.0, 1.0, big if i % 2 else 0) for i in range(4)] + [(i, 0, 9.0, 1.0, 1.0, big) for i in range(4, 8)]
    p = Points(spark.createDataFrame(rows, "pid long, b int, x double, y double, z double, f long"), XYZ, ("f",))
    x = octree.Leaves(spark.createDataFrame([(0, 0, 0, 0, 1), (0, 1, 0, 0, 2)], "level int, x long, y long, z long, f long"), CONFIG, XYZ, ("f",), p)
    got = table(octree.refine_by_variance(x, 1e18))
    assert {k[0] for k in got if got[k] == [1]} == {1} and {k for k in got if got[k] == [2]} == {(0, 1, 0, 0)}


def test_resample_to(spark):
    x = mixed(spark, 1, 3)
    fine, coarse = octree.refine(x, 2), leaves(spark, [(0, 0, 0, 0, 0.0), (0, 1, 0, 0, 0.0), (0, 5, 0, 0, 0.0)])
    assert set(map(tuple, table(octree.resample_to(x, fine)).values())) == {(1.0,), (3.0,)}
    assert table(octree.resample_to(fine, coarse)) == {(0, 0, 0, 0): [1.0], (0, 1, 0, 0): [3.0], (0, 5, 0, 0): [0.0]}


def boxes(x):
    return [(k, np.array(k[1:]) * (8 / 2 ** k[0]), 8 / 2 ** k[0], np.array(f)) for k, f in table(x).items()]


@pytest.mark.parametrize("mode", ["center", "volume", "overlap"])
def test_convolution_against_boxes(spark, mode):
    rng = np.random.default_rng(7)
    p = points(spark, rng.uniform(0, 16, (60, 3)), rng.uniform(size=60))
    x = octree.refine_by_density(octree.from_points(p, CONFIG), 4)
    w = rng.normal(size=(27, 1, 1))
    got = table(octree_conv.convolve(x, w, 3, mode))
    cells = boxes(x)
    for key, lo, s, _ in cells[:25]:
        want = 0.0
        for k, off in enumerate(cube_first_axis_slowest(3, 3)):
            a = lo + np.array(off) * s
            for _, b, t, f in cells:
                if mode == "overlap":
                    want += w[k, 0, 0] * f[0] * np.prod(np.clip(np.minimum(a + s, b + t) - np.maximum(a, b), 0, None)) / s**3
                elif ((a + s / 2 >= b) & (a + s / 2 < b + t)).all():
                    want += w[k, 0, 0] * f[0] * ((t / s) ** 3 if mode == "volume" else 1)
        assert got[key][0] == pytest.approx(want, abs=1e-9)


def test_multilinear_against_boxes(spark):
    rng = np.random.default_rng(8)
    p = points(spark, rng.uniform(0, 16, (60, 3)), rng.uniform(size=60))
    x = octree.refine_by_density(octree.from_points(p, CONFIG), 4)
    q = rng.uniform(-1, 17, (40, 3))
    got = [r.f for r in octree_conv.interpolate(x, points(spark, q), "multilinear").orderBy("pid").collect()]
    cells = boxes(x)
    for place, value in zip(q, got):
        home = [s for _, lo, s, _ in cells if ((place >= lo) & (place < lo + s)).all()]
        want = 0.0
        if home:
            lo, hi = place - home[0] / 2, place + home[0] / 2
            vol = [(np.prod(np.clip(np.minimum(hi, b + t) - np.maximum(lo, b), 0, None)), f[0]) for _, b, t, f in cells]
            want = sum(v * f for v, f in vol) / sum(v for v, _ in vol)
        assert value == pytest.approx(want, abs=1e-6)


def test_transpose_is_the_adjoint(spark):
    x = mixed(spark)
    w = np.random.default_rng(9).normal(size=(27, 1, 1))
    y = octree_conv.convolve(x, w, 3, "overlap")
    g = y.with_df(y.df.withColumn("f0", F.cos("f0")))
    back = octree_conv.convolve_transpose(g, w, x, 3, "overlap")
    a, b, c, d = (table(t) for t in (y, g, x, back))
    assert sum(a[k][0] * b[k][0] for k in a) == pytest.approx(sum(c[k][0] * d[k][0] for k in c))


@pytest.mark.parametrize("target,n", [(90, 57), (99, 204), (99.5, 232)])
def test_sphere(spark, target, n):
    x, reached = sphere.voxelise_sphere(spark, 100.0, target)
    assert x.df.count() == n and reached >= target and not octree.has_overlapping_leaves(x)


def test_sphere_out_of_reach(spark):
    with pytest.raises(RuntimeError):
        sphere.voxelise_sphere(spark, 1.0, 99.99, depth=1)
