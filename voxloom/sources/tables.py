"""Tensors as tables: dense and sparse forms, stores, and parameters of models."""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.model import AXES, Voxels
from voxloom.operators.pool import voxelise


def dense_coordinates(spark: SparkSession, shape: Sequence[int], batch: str = "b") -> DataFrame:
    """All cells (batch, axes) of a dense tensor of ``shape``, the last axis fastest; ``row`` numbers them."""
    names = [batch, *AXES[: len(shape) - 1]]
    df, left = spark.range(prod(shape)).withColumnRenamed("id", "row"), F.col("row")
    cols = []
    for name, size in reversed(list(zip(names, shape, strict=True))):
        cols.append((left % size).cast("int" if name == batch else "long").alias(name))
        left = F.floor(left / size)
    return df.select("row", *reversed(cols))


def exploded(df: DataFrame, value: str, dim: int, channels_first: bool = True, batch: str = "b", names: Sequence[str] | None = None) -> DataFrame:
    """Cells of nested arrays: ``value`` is [channels, ...] for each batch row. Returns batch, axes, f0, f1, ..."""
    axes = list(AXES[:dim]) if names is None else list(names)
    if channels_first:
        long = df.select(batch, F.posexplode(value).alias("__c", "__v"))
    else:
        raise ValueError("values are channels first")
    for a in axes:
        long = long.select(batch, *(c for c in long.columns if c not in (batch, "__v")), F.posexplode("__v").alias(a, "__v"))
    return long.select(batch, *(F.col(a).cast("long").alias(a) for a in axes), F.col("__c").alias("channel"), F.col("__v").alias("value"))


def to_sparse(df: DataFrame, value: str, dim: int, channels: int, remove_zeros: bool = True, batch: str = "b") -> Voxels:
    """Voxels of a dense tensor; with ``remove_zeros`` only cells in which some channel isn't 0."""
    axes, feats = AXES[:dim], [f"f{i}" for i in range(channels)]
    long = exploded(df, value, dim, batch=batch)
    wide = long.groupBy(batch, *axes).agg(*(F.max(F.when(F.col("channel") == i, F.col("value"))).alias(f) for i, f in enumerate(feats)))
    if remove_zeros:
        wide = wide.filter(sum((F.abs(F.col(f)) for f in feats), F.lit(0)) != 0)
    return Voxels(wide, tuple(axes), tuple(feats), (1,) * dim, "dense", batch)


def sparse_coo(v: Voxels) -> tuple[DataFrame, DataFrame]:
    """Coordinates with features, and one row with the size by axis (largest coordinate plus 1)."""
    return v.df.select(*v.keys, *v.feats), v.df.agg(*((F.max(k) + 1).cast("long").alias(k) for k in v.keys))


def to_dense(v: Voxels, shape: Sequence[int]) -> DataFrame:
    """Every cell of ``shape`` (batch, axes) with its features; 0 where ``v`` has none."""
    cells = dense_coordinates(v.df.sparkSession, shape, v.batch).toDF("row", *v.keys)
    joined = cells.join(v.df, v.keys, "left")
    return joined.select("row", *v.keys, *(F.coalesce(f, F.lit(0)).alias(f) for f in v.feats))


def from_table(spark: SparkSession, path: str, axes: Sequence[str], feats: Sequence[str], mode: str = "average", row_id: str | None = None, batch: str = "b") -> Voxels:
    """Voxels of a Parquet table with one column for each axis and channel."""
    return voxelise(spark.read.parquet(path), axes, feats, mode, row_id, batch, origin=path)


def with_features(v: Voxels, features: DataFrame, feats: Sequence[str]) -> Voxels:
    """Other features, by coordinate, on the same set."""
    return v.with_df(v.coords().join(features.select(*v.keys, *feats), v.keys), feats)


# -- stores: Parquet, with what a table can't say in a small JSON text file beside it


def _describe(v: Voxels) -> dict:
    return {"axes": v.axes, "feats": v.feats, "stride": v.stride, "origin": v.origin, "batch": v.batch}


def save_sparse(v: Voxels, path: str) -> None:
    v.df.select(*v.keys, *v.feats).write.mode("overwrite").parquet(f"{path}/rows")
    _save_text(v.df.sparkSession, json.dumps(_describe(v)), f"{path}/about")


def load_sparse(spark: SparkSession, path: str) -> Voxels:
    d = json.loads(_load_text(spark, f"{path}/about"))
    return Voxels(spark.read.parquet(f"{path}/rows"), tuple(d["axes"]), tuple(d["feats"]), tuple(d["stride"]), d["origin"], d["batch"])


def save_sparse_list(parts: Sequence[Voxels], path: str) -> None:
    """Several tensors of the same columns in one table, partitioned by their number."""
    first = parts[0]
    df = None
    for i, v in enumerate(parts):
        rows = v.df.select(F.lit(i).alias("tensor"), *v.keys, *(F.col(f).alias(n) for f, n in zip(v.feats, first.feats, strict=True)))
        df = rows if df is None else df.unionByName(rows)
    df.write.mode("overwrite").partitionBy("tensor").parquet(f"{path}/rows")
    _save_text(first.df.sparkSession, json.dumps([_describe(v) for v in parts]), f"{path}/about")


def load_sparse_list(spark: SparkSession, path: str) -> list[Voxels]:
    about = json.loads(_load_text(spark, f"{path}/about"))
    rows = spark.read.parquet(f"{path}/rows")
    return [Voxels(rows.filter(F.col("tensor") == i).drop("tensor"), tuple(d["axes"]), tuple(about[0]["feats"]), tuple(d["stride"]), d["origin"], d["batch"]) for i, d in enumerate(about)]


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    _save_text(spark, json.dumps(list(tables)), f"{path}/about")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(_load_text(spark, f"{path}/about"))}


def save_parameters(spark: SparkSession, parameters: dict, path: str) -> None:
    """Arrays of a model by name, as a table (name, shape, values)."""
    rows = [(n, list(map(int, p.shape)), p.astype(float).ravel().tolist()) for n, p in parameters.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict:
    import numpy as np

    return {r.name: np.array(r["values"], float).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def _save_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _load_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
