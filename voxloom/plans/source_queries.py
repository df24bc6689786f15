"""Queries of conversions between dense and sparse tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import setops
from voxloom.sources import tables

from .registry import Registry
from .views import VOX, XYZ, cells, table, voxels

REGISTRY = query = Registry()
_SHAPE = (7, 51, 11, 9)


@query("dense_coordinates", "SELECT i AS row, CAST(i // 20 AS INTEGER) AS b, i // 5 % 4 AS x, i % 5 AS y FROM range(60) r(i)")
def _(spark, d):
    return tables.dense_coordinates(spark, (3, 4, 5))


@query("to_dense", f"WITH {VOX} SELECT row, g.b, g.x, g.y, g.z, coalesce(f, 0) AS f FROM (SELECT i AS row, CAST(i // 5049 AS INTEGER) AS b, i // 99 % 51 AS x, i // 9 % 11 AS y, i % 9 AS z FROM range(35343) r(i)) g LEFT JOIN vox v ON v.b = g.b AND v.x = g.x AND v.y = g.y AND v.z = g.z")
def _(spark, d):
    return tables.to_dense(voxels(spark, d), _SHAPE)


def _dense(spark, d):
    """Embeddings as one-channel tensors along x; small values are 0."""
    v = F.transform("embedding", lambda e: F.when(F.abs(e) > 0.1, e.cast("double")).otherwise(F.lit(0.0)))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("b"), F.array(v).alias("v"))


_LONG = "long AS (SELECT vec_id AS b, CAST(i - 1 AS BIGINT) AS x, CAST(CASE WHEN abs(embedding[i]) > CAST(0.1 AS DOUBLE) THEN embedding[i] ELSE 0 END AS DOUBLE) AS f0 FROM embeddings, range(1, 65) r(i))"
query("to_sparse", f"WITH {_LONG} SELECT * FROM long WHERE f0 <> 0")(lambda s, d: tables.to_sparse(_dense(s, d), "v", 1, 1).df)
query("to_sparse_all", f"WITH {_LONG} SELECT * FROM long")(lambda s, d: tables.to_sparse(_dense(s, d), "v", 1, 1, remove_zeros=False).df)
query("sparse_size", f"WITH {VOX} SELECT CAST(max(b) + 1 AS BIGINT) AS b, max(x) + 1 AS x, max(y) + 1 AS y, max(z) + 1 AS z FROM vox")(lambda s, d: tables.sparse_coo(voxels(s, d))[1])
query("append", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")(lambda s, d: setops.append(*(table(s, d, "lineitem").filter(F.col("l_returnflag") == r).select("l_orderkey") for r in "AR")))


@query("replace_features", f"WITH {VOX} SELECT b, x, y, z, x + y AS g FROM vox")
def _(spark, d):
    v = voxels(spark, d)
    other = cells(spark, d).select("b", *XYZ, (F.col("x") + F.col("y")).alias("g")).distinct()
    return tables.with_features(v, other, ["g"]).df
