"""What several operators of this subpackage share: reading, lineage cuts, word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that the vectorised helpers take in at a time; longer texts are cut between words.
CHUNK_BYTES = 1 << 17
#: Characters of texts that an operator takes from a batch at a time.
SLICE = 1 << 22

#: Rows in a batch that goes to Python: whole texts are long, and two of a task's batches are held at a time.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches for Python to BATCH_ROWS, unless they are smaller.

    Queries and pipeline stages call this; operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker gives freed memory back to the system.

    Workers are used again by later stages, and each would otherwise keep the most it ever held.
    """

    def wrapped(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only a session in local mode without one (a test) gets a folder of this machine; on a cluster that is an error.
    """
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[[^-]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="voxloom-"))
    return named or sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more.

    It does so after a garbage collection of the driver, which may be long in coming while the files pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes up to which lookup() broadcasts.
BROADCAST_BYTES = 24 << 20


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined to ``small`` (keys and other columns) on ``keys``, where nulls are equal.

    ``small`` is computed and its size taken; up to ``most`` bytes it is broadcast, so that the rows of ``big`` stay
    where they are. Beyond, both sides are shuffled.
    """
    small = cut(small.toDF(*(f"__small_{c}" if c in keys else c for c in small.columns)))
    listed = [f for f in small.schema if not f.name.startswith("__small_")]
    own = lambda f: F.size(f.name) * 8 if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() != "struct" else F.octet_length(F.to_json(f.name)) if f.dataType.typeName() in ("array", "struct", "map") else F.octet_length(F.col(f.name).cast("string")) + 8
    size = small.agg(F.coalesce(F.sum(F.lit(48) + sum((F.coalesce(own(f), F.lit(0)) for f in listed), F.lit(0))), F.lit(0))).first()[0]
    on = [F.col(k).eqNullSafe(F.col(f"__small_{k}")) for k in keys]
    return big.join(F.broadcast(small) if size <= most else small.hint("shuffle_merge"), on, how).drop(*(f"__small_{k}" for k in keys))


def row_key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text that names a row.

    Unlike a row number it is the same whenever the row is computed again, after whatever shuffle. Rows of the same id
    and text have the same key.
    """
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("\0")), F.lit("\1"), F.coalesce(text.cast("string"), F.lit("\0"))).cast("binary")))


def fold(id_col: str, folds: int):
    """The part of a row: crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method with halved steps; the last column is the constant.

    The other columns are scaled to unit variance first.
    """
    scale = np.maximum(x.std(0), 1e-9)
    scale[-1] = 1.0
    z, w = x / scale, np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).sum() + ridge / 2 * (w @ w)
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        part = 1.0
        while part > 1e-6 and (new := loss(w + part * step)) > now:
            part /= 2
        if part <= 1e-6 or now - new < 1e-9:
            break
        w, now = w + part * step, new
    return w / scale


# ---------------------------------------------------------------------------------------------------
# Hashes of words, for whole batches of texts at once.

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)

#: Separators are bytes that stand in no word: by ``LETTERS`` all ASCII but letters and digits, by ``SPACES`` blanks.
LETTERS = np.ones(256, dtype=bool)
LETTERS[:128] = [chr(c).isalnum() for c in range(128)]
SPACES = np.ones(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (_powers(b, 2 * CHUNK_BYTES) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))


def _hash_words(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in ``data``: a polynomial in the places of its bytes, taken from running sums."""
    b = np.frombuffer(data, np.uint8)
    word = np.zeros(len(b) + 2, bool)
    word[1:-1] = inside.take(b)
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = (_UP, _DOWN) if len(b) <= len(_UP) else (_powers(int(_BASE), len(b)), _powers(int(_DOWN[1]), len(b)))
    run = np.zeros(len(b) + 1, np.uint64)
    value = _BYTE.take(b)
    value *= up[: len(b)]
    np.cumsum(value, out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts]), starts


def _pieces(data: bytes, inside: np.ndarray) -> Iterator[bytes]:
    """``data`` in pieces of about CHUNK_BYTES that end between words."""
    at = 0
    while len(data) - at > CHUNK_BYTES:
        back = ~inside[np.frombuffer(data, np.uint8, CHUNK_BYTES, at)]
        ends = np.flatnonzero(back)
        if not len(ends):  # a single word longer than a piece
            rest = np.flatnonzero(~inside[np.frombuffer(data, np.uint8, -1, at)])
            end = at + int(rest[0]) if len(rest) else len(data)
        else:
            end = at + int(ends[-1])
        end = max(end, at + 1)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[bytes], inside: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and offsets: text i has words ``offsets[i]:offsets[i + 1]``."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            sizes = np.array([len(texts[i]) + 1 for i in group])
            h, starts = _hash_words(b"\n".join(texts[i] for i in group), inside)
            ends = np.searchsorted(starts, np.cumsum(sizes))
            counts[group] = np.diff(ends, prepend=0)
            hashes.append(h)
        group.clear()
        held = 0

    for i, t in enumerate(texts):
        if len(t) > CHUNK_BYTES:
            flush()
            parts = [_hash_words(p, inside)[0] for p in _pieces(t, inside)]
            counts[i] = sum(map(len, parts))
            hashes += parts
            continue
        if held + len(t) > CHUNK_BYTES:
            flush()
        group.append(i)
        held += len(t) + 1
    flush()
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(counts)])


def slices(batch, column: int | str, most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow batch as (first row, texts) of about ``most`` characters each; null counts as empty."""
    values = batch.column(column)
    at, rows, held = 0, [], 0
    for i in range(len(values)):
        text = values[i].as_py() or ""
        rows.append(text)
        held += len(text)
        if held >= most:
            yield at, rows
            at, rows, held = i + 1, [], 0
    if rows:
        yield at, rows


# ---------------------------------------------------------------------------------------------------
# Groups of rows whose pairs are looked at.

_CELLS = 1 << 22  # entries of a dense block of indicators


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by ``keys``: a table and where its groups start."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and v[0] != held[-1].column(k)[-1].as_py()
        starts = np.flatnonzero(new)
        if held and not len(starts):
            held.append(batch)
            continue
        if held and len(starts):
            t = pa.Table.from_batches([*held, batch.slice(0, starts[0])])
            yield t, _starts(t, keys)
            held = []
            last = starts[-1]
            if last > starts[0]:
                t = pa.Table.from_batches([batch.slice(starts[0], last - starts[0])])
                yield t, starts[:-1] - starts[0]
        else:
            last = starts[-1] if len(starts) else 0
            if last:
                t = pa.Table.from_batches([batch.slice(0, last)])
                yield t, np.concatenate([[0], starts[:-1]])
        held.append(batch.slice(last))
    if held:
        t = pa.Table.from_batches(held)
        yield t, _starts(t, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def blocks(rows: DataFrame, key: str, size: Column, block: int) -> DataFrame:
    """Deals each group of ``size`` rows over pairs of blocks: (key, lo, hi, left) for every pair a row is in.

    Up to ``block`` rows a group is one block. A larger one falls into ceil(size / block) blocks by a hash of its
    nodes, and each two blocks meet once, so no task holds more than two of them and all pairs are seen.
    """
    rows = rows.withColumn("n_blocks", F.ceil(size / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return rows.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("left")).drop("own", "other").repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "node")


def overlaps(rows: np.ndarray, columns: np.ndarray, n: int, first: int | None = None) -> np.ndarray:
    """How many columns each of the ``first`` rows (None: all) has in common with each of ``n``; (row, column) are given once each."""
    first = n if first is None else first
    out = np.zeros((first, n), np.int64)
    times = np.bincount(columns)
    np.fill_diagonal(out, np.bincount(rows[times[columns] == 1], minlength=n)[:first])
    common = times > 1  # a column of one row only is in no intersection
    place = np.cumsum(common) - 1
    use = common[columns]
    rows, columns = rows[use], place[columns[use]]
    step = max(_CELLS // n, 1)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for at in range(0, int(common.sum()), step):
        a, b = np.searchsorted(columns, [at, at + step])
        dense = np.zeros((n, step), np.float32)
        dense[rows[a:b], columns[a:b] - at] = 1
        out += np.rint(dense[:first] @ dense.T).astype(np.int64)
    return out
