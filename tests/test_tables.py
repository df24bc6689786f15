import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.model import Voxels
from voxloom.operators import clips
from voxloom.sources import frames, tables


def test_dense_and_sparse(spark):
    x = np.zeros((2, 2, 3, 4))
    x[0, :, 1, 2] = [5, 6]
    x[1, :, 0, 3] = [0, 7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "b int, v array<array<array<double>>>")
    v = tables.to_sparse(df, "v", 2, 2)
    assert {tuple(r) for r in v.df.collect()} == {(0, 1, 2, 5.0, 6.0), (1, 0, 3, 0.0, 7.0)}
    assert tables.to_sparse(df, "v", 2, 2, remove_zeros=False).df.count() == 24
    back = np.zeros_like(x)
    for r in tables.to_dense(v, (2, 3, 4)).collect():
        back[r.b, :, r.x, r.y] = [r.f0, r.f1]
    assert (back == x).all()
    assert tuple(tables.sparse_coo(v)[1].first()) == (2, 2, 4)
    assert [tuple(r)[1:] for r in tables.dense_coordinates(spark, (2, 1, 2)).orderBy("row").collect()] == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 1)]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2, 0.5), (1, -4, 3, 2.5)], "b int, x long, y long, f double")
    v = Voxels(df, ("x", "y"), ("f",), (2, 2), "o")
    tables.save_sparse(v, str(tmp_path / "one"))
    got = tables.load_sparse(spark, str(tmp_path / "one"))
    assert (got.stride, got.origin, got.axes) == (v.stride, "o", v.axes) and sorted(map(tuple, got.df.collect())) == sorted(map(tuple, df.collect()))
    tables.save_sparse_list([v, v.with_df(df.limit(0))], str(tmp_path / "two"))
    assert [t.df.count() for t in tables.load_sparse_list(spark, str(tmp_path / "two"))] == [2, 0]
    tables.save_tables({"a": df}, str(tmp_path / "three"))
    assert tables.load_tables(spark, str(tmp_path / "three"))["a"].count() == 2
    w = {"w": np.arange(6.0).reshape(2, 3)}
    tables.save_parameters(spark, w, str(tmp_path / "four"))
    np.testing.assert_array_equal(tables.load_parameters(spark, str(tmp_path / "four"))["w"], w["w"])


def test_frames(spark, tmp_path):
    for i in (7, 8):
        body = {"grid_info": {"origin_m": [1.0, 0.0, 0.0], "voxel_size_m": 0.5}, "voxels": [{"coordinates": [i, 0, 1], "intensity": 2.0, "num_cameras": 3}], "targets": [{"position_m": [2.0, 1.0, 0.0]}]}
        (tmp_path / f"frame_{i:04d}.json").write_text(json.dumps(body, indent=1))
    f = frames.read_frames(spark, str(tmp_path))
    assert sorted(tuple(r) for r in frames.voxels_of(f).collect()) == [(7, 7, 0, 1, 2.0, 3), (8, 8, 0, 1, 2.0, 3)]
    assert tuple(frames.targets_of(f).first())[1:] == (2.0, 2.0, 0.0)


def test_clips(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 7, 9)], "frame long")
    assert sorted(r.start for r in clips.sliding(df, 3).collect()) == [1, 5]
    got = {tuple(r.frames) for r in clips.clips(df, 3, 1).collect()}
    assert got == {(1, 2, 3), (5, 6, 7), (1, 3, 5), (3, 5, 7), (5, 7, 9)}


def test_radius_labels(spark):
    rng = np.random.default_rng(0)
    v, t = rng.integers(-6, 6, (80, 3)), rng.uniform(-6, 6, (5, 3))
    v = np.unique(v, axis=0)
    vox = spark.createDataFrame([(0, *map(int, p)) for p in v], "frame long, x long, y long, z long")
    tar = spark.createDataFrame([(0, *map(float, p)) for p in t], "frame long, tx double, ty double, tz double")
    got = {(r.x, r.y, r.z): r.label for r in clips.radius_labels(vox, tar, 2.5).collect()}
    assert got == {tuple(map(int, p)): int((((p - t) ** 2).sum(1) <= 6.25).any()) for p in v}
    assert clips.class_balance(clips.radius_labels(vox, tar, 2.5)).first().n == len(v)


def test_scaled_features(spark):
    df = spark.createDataFrame([(0, 1.0, 3, 0), (0, 3.0, 20, 9), (1, 5.0, 1, 4)], "clip int, intensity double, cameras int, t int")
    got = {r.intensity: (r.f0, r.f1, r.f2) for r in clips.scaled(df).collect()}
    assert got[1.0] == (pytest.approx(-1), 0.3, 0.0) and got[3.0] == (pytest.approx(1), 1.0, 1.0) and got[5.0][0] == 0
    assert clips.recall(df.select(F.lit(1).alias("predicted"), (F.col("t") > 0).cast("int").alias("label"))).first()[0] == 1
