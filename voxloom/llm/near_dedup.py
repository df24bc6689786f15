"""Near-duplicate join on word shingles with Bayesian candidate pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, groups, lookup, overlaps, release, released, row_key, slices
from .components import components
from .shingles import MinHash, band_keys, shingle_sets

_COMPARED = 1 << 17  # pairs that are compared at a time


def least_matches(values: int, step: int, threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared MinHash values, the fewest matches with which a pair stays.

    The similarity has a uniform prior, so after m matches of n it is Beta(m + 1, n - m + 1); a pair is dropped
    when the chance of reaching ``threshold`` is below ``tolerance``.
    """

    def chance(m: int, n: int) -> float:  # P(Beta(m + 1, n - m + 1) >= t), a binomial tail
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next((m for m in range(n + 1) if chance(m, n) >= tolerance), n) for n in range(step, values + 1, step)}


def _pairs(starts: np.ndarray, n: int, left: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within each group, in lots; of a crossed group only those of a left and another row."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0
    for s, e in zip(starts, [*starts[1:], n], strict=True):
        if crossed[s]:
            x, y = s + np.flatnonzero(left[s:e]), s + np.flatnonzero(~left[s:e])
            i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        elif e - s == 2:
            i, j = np.array([s]), np.array([s + 1])
        else:
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
        a.append(i)
        b.append(j)
        held += len(i)
        if held >= _COMPARED:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the edges (i, j) lead to."""
    root = np.arange(n)
    while len(i):
        old = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == old).all():
            break
    return root


def _prints(minhash: MinHash, bands: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, "text"):
                sigs, keys, n = [], [], []
                for s in shingle_sets(texts, width):
                    v = minhash(s)
                    n.append(len(s))
                    sigs.append((v >> np.uint32(16)).astype(np.uint16).tobytes())
                    keys.append(band_keys(v, bands).view(np.int64))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("key"), part.column("row_key"), pa.array(n, pa.int32()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "key", "row_key", "n", "sig", "bands"])

    return run


def _prune(least: dict[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, ["band", "lo", "hi"]):
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(t.num_rows, -1)
            node = t["node"].to_numpy()
            crossed = t["lo"].to_numpy() != t["hi"].to_numpy()
            kept_i, kept_j = [], []
            for i, j in _pairs(starts, t.num_rows, t["left"].to_numpy(), crossed):
                matches, done = np.zeros(len(i), np.int32), 0
                for n, m in least.items():
                    matches += (sig[i, done:n] == sig[j, done:n]).sum(1, dtype=np.int32)
                    stay = matches >= m
                    i, j, matches, done = i[stay], j[stay], matches[stay], n
                kept_i.append(i)
                kept_j.append(j)
            if kept_i:
                root = _roots(t.num_rows, np.concatenate(kept_i), np.concatenate(kept_j))
                own = np.flatnonzero(root != np.arange(len(root)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    if n == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]], np.int64)
    _, columns = np.unique(np.concatenate(sets), return_inverse=True)
    return overlaps(np.repeat(np.arange(n), [len(s) for s in sets]), columns, n)


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in groups(batches, ["cluster", "lo", "hi"]):
            n = t["node"].to_numpy()
            once = np.ones(len(n), bool)  # a row that its table holds twice has come twice
            once[1:] = n[1:] != n[:-1]
            once[starts] = True
            if not once.all():
                starts = np.searchsorted(np.flatnonzero(once), starts)
                t = t.filter(pa.array(once))
            node, copies, left = t["node"].to_numpy(), t["copies"].to_numpy(), t["left"].to_numpy()
            crossed = t["lo"].to_numpy() != t["hi"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
            links, texts, root = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                if e - s < 2:
                    continue
                both = _shared(sets[s:e])
                size = np.array([len(x) for x in sets[s:e]])
                near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                near &= node[s:e, None] != node[None, s:e]
                if crossed[s]:
                    near &= left[s:e, None] != left[None, s:e]
                links[s:e], texts[s:e] = near @ copies[s:e], near.sum(1)
                root[s:e] = s + _roots(e - s, *np.nonzero(near))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root]), pa.array(links), pa.array(texts)], ["node", "root", "links", "texts"])

    return run


def near_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8, width: int = 5, bands: int = 20, rows_per_band: int = 5, tolerance: float = 1e-5, block: int = 256) -> DataFrame:
    """One row per row of ``docs``: row_key, doc_id, class_id, class_size, links, linked_texts, kept.

    The steps:

    1. Rows of equal text become one node, by digest. A node has ``bands * rows_per_band`` MinHash values.
    2. Nodes that share a band are candidates. Within each band's groups their values are compared step by step; a
       pair is dropped as soon as its posterior chance of reaching ``threshold`` is below ``tolerance``.
       What stays is reduced to a spanning forest, so a group of n near copies gives n - 1 rows, not n * n / 2.
    3. The components of that forest are clusters. Within a cluster all pairs are verified exactly on their
       shingles, so links are counted in full. Groups and clusters of over ``block`` nodes are dealt over
       pairs of blocks.
    4. The components of verified links are the classes; class_id is the smallest doc_id.

    ``links`` is the number of other rows with a similarity of ``threshold`` or more, copies included, and
    ``linked_texts`` that of other texts. Of a class the row with the smallest id stays (of repeated rows one).
    Null, empty and blank texts have no shingle: each is a class of its own and stays.
    Two texts of a similarity of exactly 0.8 share no band with a chance of 0.0004 and are pruned with less than 0.0002; both
    fall fast above it.
    """
    minhash = MinHash(bands * rows_per_band)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), row_key(F.col(id_col), text).alias("row_key"))
    texts = texts.withColumns({"key": F.unhex(F.md5(F.col("text").cast("binary"))), "row": F.monotonically_increasing_id()})
    id_type = texts.schema["doc_id"].dataType.simpleString()
    prints = cut(texts.mapInArrow(released(_prints(minhash, bands, width)), f"row long, doc_id {id_type}, key binary, row_key binary, n int, sig binary, bands array<long>"))

    nodes = prints.filter("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "row_key", "row")).alias("top"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    banded = nodes.select("node", F.explode("bands").alias("band"))
    busy = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = banded.join(busy, "band").join(nodes.select("node", "sig"), "node")
    least = least_matches(bands * rows_per_band, 2 * rows_per_band, threshold, tolerance)
    candidates = blocks(members, "band", F.col("size"), block).select("band", "lo", "hi", "left", "node", "sig")
    clusters = components(candidates.mapInArrow(released(_prune(least)), "a long, b long"))
    clusters = cut(clusters.withColumnRenamed("root", "cluster"))

    # exact verification on the shingles of one row of each node
    wanted = clusters.join(nodes.select("node", "key", "copies", "top"), "node").select("node", "cluster", "copies", F.col("top.row_key").alias("row_key"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(batch, "text"):
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("cluster"), part.column("copies"), pa.array([s.tobytes() for s in shingle_sets(some, width)], pa.binary())], ["node", "cluster", "copies", "shingles"])

    found = lookup(texts.select("row_key", "text"), wanted, ["row_key"]).select("node", "cluster", "copies", "text").mapInArrow(released(shingles), "node long, cluster long, copies long, shingles binary")
    found = blocks(found.join(sizes, "cluster"), "cluster", F.col("size"), block).select("cluster", "lo", "hi", "left", "node", "copies", "shingles")
    checked = cut(found.mapInArrow(released(_verify(threshold)), "node long, root long, links long, texts long"))
    linked = checked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("linked_texts"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))

    placed = nodes.select("key", "node", "top", "copies").join(linked, "node", "left").join(classes, "node", "left")
    placed = placed.select("key", "top", "copies", F.coalesce("root", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"))
    placed = cut(placed)
    best = placed.groupBy("class").agg(F.min("top").alias("best"), F.sum("copies").alias("class_size"))
    placed = placed.join(best, "class").select("key", "best", "class_size", (F.col("links") + F.col("copies") - 1).alias("links"), "linked_texts")
    own = prints.select("row", "row_key", "doc_id", "key", "n")
    out = own.filter("n > 0").join(placed, "key").select("row_key", "doc_id", F.col("best.doc_id").alias("class_id"), "class_size", "links", "linked_texts", (F.col("row") == F.col("best.row")).alias("kept"))
    alone = own.filter("n = 0").select("row_key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(True))
    return out.union(alone)


def near_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters) -> DataFrame:
    """near_classes() without the row keys."""
    return near_classes(docs, text_col, id_col, **parameters).drop("row_key")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns.

    Null, empty and blank texts are in no class with another and all stay, repeated ones too. Of repeated rows that stay, as
    many are kept as near_classes() keeps.
    """
    key = "__row_key"
    base = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    classes = cut(near_classes(docs, text_col, id_col, **parameters).select(F.col("row_key").alias(key), "kept"))
    counts = classes.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.count_if("kept").alias("__kept")).filter("__kept > 0")
    out = base.join(counts.filter("__kept = __n").select(key), key, "left_semi")
    # rows of the same id and text, of which fewer stay: numbered where they lie, and written down so that the numbers hold
    part = base.join(counts.filter("__kept < __n"), key)
    if counts.filter("__kept < __n").limit(1).count():
        part = cut(part.withColumn("__number", F.monotonically_increasing_id()))
        first = part.groupBy(key).agg(F.min("__number").alias("__number"))  # a class keeps one row
        out = out.unionByName(part.join(first, [key, "__number"], "left_semi").drop("__n", "__kept", "__number"))
    return out.drop(key)
