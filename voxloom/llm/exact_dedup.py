"""Exact de-duplication by a tree merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _digest(text):
    """SHA-256 (32 bytes), then an unrelated 64-bit hash and the length, which every merge verifies too."""
    body = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.unhex(F.concat(F.sha2(body, 256), wide(F.xxhash64(body)), wide(F.octet_length(body).cast("long"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 7) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are dealt over ``2 ** rounds`` runs, each sorted by digest, whatever their text, so a group of copies is
    spread over all runs. The runs are a binomial tree: in round r those whose number has bit r set send their
    entries to the run without it, where the sorted entries are merged; equal digests (SHA-256, a second hash and
    the length must agree) leave one entry with the largest id and the count. Both runs lie in pieces by digest, so a merge is
    spread over tasks however long the runs have become. Going down, the root's entries return to the runs that hold
    the digest and meet the run's own rows there. No round moves a text, and no task gathers a group. The texts are read
    once, when the digests are written.

    Texts are equal when their bytes are; null counts as empty. The largest id of a group stays (a null id is
    smaller than any); of repeated rows with that id exactly one stays. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(1 << rounds)).cast("int")))
    sorted_runs = rows.repartition("run", "digest").sortWithinPartitions("run", "digest")

    leaf = sorted_runs.groupBy("run", "digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    level = leaf
    for r in range(rounds):
        to = F.col("run").bitwiseAND(F.lit(~(1 << r))).alias("run")
        level = level.groupBy(to, "digest").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    root = level.select("digest", "top", "n")

    down = leaf.select("run", "digest").join(root, "digest")
    return sorted_runs.join(down, ["run", "digest"]).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )
