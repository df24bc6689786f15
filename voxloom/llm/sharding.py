"""Sharding by sampled splitters (DataFrame operations only)."""

from __future__ import annotations

from bisect import bisect_left
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

_UNIT = 1 << 32  # a row's own uniform number is a 32-bit hash


def _weighted_cuts(sample: list[tuple[float, float]], parts: float) -> list[float]:
    """Keys at which the cumulated weight passes each multiple of a ``parts``-th of the whole."""
    total, done, cuts, goal = sum(w for _, w in sample), 0.0, [], 1
    for key, w in sorted(sample):
        done += w
        if done >= goal * total / parts:
            cuts.append(key)
            goal = int(done * parts / total) + 1
    return sorted(set(cuts))


def _draw(rows: DataFrame, rate, seed: int) -> list[tuple[float, float]]:
    """Poisson sample of keys; a row's chance is its size times ``rate``, and its weight the size it stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * rate)
    own = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(_UNIT)) / F.lit(float(_UNIT))
    return [(r.key, r.w) for r in rows.filter(own < chance).select("key", (F.col("size") / chance).alias("w")).collect()]


def _ranged(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """``rows`` with ``bucket``, the number of cuts up to their key (keys are below 2 ** 52)."""
    inf = float("inf")
    return Bucketizer(splits=[-inf, *(cuts or [2.0**53]), inf], inputCol="key", outputCol="range").transform(rows).withColumn("bucket", F.col("range").cast("int")).drop("range")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64, samples: int = 16384, heavy: float = 0.01, rounds: int = 6) -> DataFrame:
    """All rows in ``shards`` shards whose sizes (UTF-8 bytes of the text plus 1) are near equal: law ``bytes``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null), bucket. Rows are ordered by a hash of
    their text, so equal texts (a group) are neighbours. About ``samples`` keys, drawn with a chance in
    proportion to size, give the splitters of ``shards * ranges_per_shard`` ranges. The exact bytes of each
    range are then counted; ranges of over twice the mean are drawn from again and subdivided, up to ``rounds``
    times. Groups of over ``heavy`` of a shard (``shards / heavy`` of them at most) are taken out first: each
    goes whole to a shard, but one that is larger than a shard is subdivided by a hash of its ids. Ranges then fill
    the shards in key order up to the same size. A slot is the row's rank in its range plus the number of rows in
    the ranges before it, so no task sorts a shard.

    A null text has size 1 and the checksum of an empty one. Repeated rows are rows. An empty table gives no rows.
    What the driver gathers is bounded by the parameters: samples, heavy groups and counts by range.
    """
    text = F.col(text_col).cast("string").cast("binary")
    body = F.coalesce(text, F.lit("").cast("binary"))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 12).cast("double").alias("key"),  # 52 bits: exact as a double
        )
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = max(total / shards, 1.0)
    unit = target / ranges_per_shard

    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > heavy * target).collect()
    spark = docs.sparkSession
    subs = {g.key: ceil(g.bytes / unit) for g in groups}
    known = spark.createDataFrame([(k, n) for k, n in subs.items()] or [(-1.0, 1)], "key double, parts int")
    marked = rows.join(F.broadcast(known), "key", "left")
    light = marked.filter("parts is null").drop("parts")

    light_bytes = total - sum(g.bytes for g in groups)
    cuts = _weighted_cuts(_draw(light, F.lit(samples / max(light_bytes, 1)), 0), max(light_bytes / unit, 1))
    for n in range(1, rounds + 1):
        over = [r for r in _ranged(light, cuts).groupBy("bucket").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * unit).collect()]
        if not over:
            break
        rates = spark.createDataFrame([(r.bucket, 64.0 / unit) for r in over], "bucket int, rate double")
        again = _ranged(light, cuts).join(F.broadcast(rates), "bucket")
        drawn, edges = _draw(again, F.col("rate"), n), [-1.0, *cuts, float("inf")]
        for r in over:
            own = [x for x in drawn if edges[r.bucket] <= x[0] < edges[r.bucket + 1]]
            cuts += _weighted_cuts(own, max(r.bytes / unit, 2)) if own else []
        cuts = sorted(set(cuts))

    base, first = {}, len(cuts) + 2
    for key, n in subs.items():
        base[key], first = first, first + n
    own = spark.createDataFrame([(k, float(b)) for k, b in base.items()] or [(-1.0, 0.0)], "key double, base double")
    placed = _ranged(marked, cuts).join(F.broadcast(own), "key", "left")
    part = F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    placed = placed.withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(part.cast("int")))

    held = {r.bucket: (r.bytes, r.n) for r in placed.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    goes, load = {}, [0] * shards
    units = []
    for key, n in subs.items():
        parts = [b for b in range(base[key], base[key] + n) if b in held]
        whole = sum(held[b][0] for b in parts) <= target
        units += [parts] if whole else [[b] for b in parts]
    for unit_parts in sorted(units, key=lambda u: (-sum(held[b][0] for b in u), u)):
        to = load.index(min(load))
        goes |= dict.fromkeys(unit_parts, to)
        load[to] += sum(held[b][0] for b in unit_parts)
    room, ends = 0.0, []
    for x in load:
        room += max(target - x, 0)
        ends.append(room)
    filled = 0.0
    for b in sorted(b for b in held if b <= len(cuts)):
        goes[b] = min(bisect_left(ends, (filled + held[b][0] / 2) * room / max(light_bytes, 1)), shards - 1)
        filled += held[b][0]
    before, starts = [0] * shards, []
    for b in sorted(goes):
        starts.append((b, goes[b], before[goes[b]]))
        before[goes[b]] += held[b][1]

    to = spark.createDataFrame(starts or [(-1, 0, 0)], "bucket int, shard int, start long")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "doc_id"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(to), "bucket")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "bucket")
    )
