"""Benchmark decontamination by q-gram lemma filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import cut, lookup, mix, released, slices

_Q = 12  # two overlapping words of 8 bytes
_FLAGS = 22  # bits of a q-gram's hash that index the first filter

#: Pairs of a place in a text and a place in an item that are looked at together.
HITS = 1 << 20


def normalise(text: str) -> bytes:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def qgrams(data: bytes) -> np.ndarray:
    """A 64-bit code of the q bytes from each place on."""
    n = len(data) - _Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.empty(len(data) - 7, np.uint64)
    for at in range(8):
        part = np.frombuffer(data, "<u8", (len(data) - at) // 8, at)
        eight[at::8] = part[: len(eight[at::8])]
    return (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ mix(eight[_Q - 8 : _Q - 8 + n])


def budget(length: int, rate: float) -> int:
    """Edits that a passage of ``length`` bytes may have: ``rate`` of it, but so few that q-grams must be shared."""
    return max(min(int(length * rate), (length - _Q) // _Q), 0)


def banded_distance(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int] | None:
    """The least edit distance of ``item`` to a substring of ``region``, and where that ends; None if over ``edits``.

    ``item`` may start at the region's first ``2 * edits + 1`` places, so a band of 4 * edits + 1 diagonals holds
    every alignment within the budget.
    """
    m, n, far = len(item), len(region), edits + 1
    width = 4 * edits + 1
    # cell k of row i stands for place i + k - edits of the region
    row = np.full(width, far)
    places = np.arange(width) - edits
    row[(places >= 0) & (places <= min(2 * edits, n))] = 0
    steps = np.arange(width)
    for i in range(1, m + 1):
        at = places + i
        valid = (at >= 1) & (at <= n)
        same = region[np.clip(at - 1, 0, max(n - 1, 0))] == item[i - 1] if n else np.zeros(width, bool)
        new = np.where(valid, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a byte of the item is missing
        new = np.where((at >= 0) & (at <= n), new, far)
        new = np.minimum.accumulate(new - steps) + steps  # bytes that the region has in addition
        row = np.minimum(new, far)
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(m + places[best])) if row[best] <= edits else None


@dataclass
class Index:
    """The q-grams of all items: sorted codes and the item of each; items that are too short by their first word."""

    items: list[bytes]
    ids: list
    edits: np.ndarray
    need: np.ndarray  # q-grams that an occurrence shares at least
    codes: np.ndarray
    item: np.ndarray
    flags: np.ndarray
    short: dict[bytes, list[tuple[int, list[bytes]]]]

    @classmethod
    def of(cls, rows: list[tuple], rate: float) -> Index:
        kept = [(i, t) for i, t in ((i, normalise(t or "")) for i, t in rows) if t]
        items = [t for _, t in kept]
        grams = [qgrams(t) for t in items]
        codes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        size = np.array([len(g) for g in grams], np.int64)
        order = np.argsort(codes, kind="stable")
        flags = np.zeros(1 << _FLAGS, bool)
        flags[codes >> np.uint64(64 - _FLAGS)] = True
        edits = np.array([budget(len(t), rate) for t in items], np.int64)
        short: dict[bytes, list[tuple[int, list[bytes]]]] = {}
        for i, t in enumerate(items):
            if len(t) < _Q:
                short.setdefault(t.split(b" ")[0], []).append((i, t.split(b" ")))
        return cls(items, [i for i, _ in kept], edits, size - _Q * edits, codes[order], np.repeat(np.arange(len(items)), size)[order], flags, short)

    def candidates(self, codes: np.ndarray) -> list[int]:
        """Items of which so many q-grams stand somewhere in the text that the lemma allows an occurrence."""
        held = np.unique(codes[self.flags[codes >> np.uint64(64 - _FLAGS)]])
        if not len(held) or not len(self.codes):
            return []
        at = np.minimum(np.searchsorted(held, self.codes), len(held) - 1)
        count = np.bincount(self.item[held[at] == self.codes], minlength=len(self.items))
        return np.flatnonzero((count >= self.need) & (count > 0)).tolist()

    def regions(self, codes: np.ndarray, item: int) -> Iterator[int]:
        """First places of regions of the text with these q-grams in which the lemma allows an occurrence of ``item``.

        An occurrence with e edits keeps at least length - q + 1 - q * e q-grams, all on diagonals that are at most
        e apart. Diagonals fall into bands of 2 * e + 1 that overlap by half or more, so one band has them all. The
        text is taken in slices of HITS hits; a band is counted once no later place can add to it, so what is held at a
        time is bounded by the item, however often the text repeats its q-grams.
        """
        e, own = int(self.edits[item]), qgrams(self.items[item])
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.searchsorted(own, codes)
        times = np.searchsorted(own, codes, "right") - first
        at = np.flatnonzero(times)
        first, times = first[at], times[at]
        done = np.cumsum(times)
        held = np.zeros((2, 0), np.int64)  # band and place of the item
        start = 0
        while start < len(at):
            end = max(int(np.searchsorted(done, (done[start - 1] if start else 0) + HITS, "right")), start + 1)
            n = times[start:end]
            where = np.repeat(at[start:end], n)
            entry = np.repeat(first[start:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = order[entry]
            diagonal = where - place
            # a band b holds the diagonals from b * (e + 1) on, 2 * e + 1 of them; a diagonal is in one or two bands
            upper = np.floor_divide(diagonal, e + 1)
            second = diagonal - (upper - 1) * (e + 1) <= 2 * e
            band = np.concatenate([held[0], upper, upper[second] - 1])
            place = np.concatenate([held[1], place, place[second]])
            # of an item's q-gram a band counts one occurrence
            key = np.unique((band - band.min()) * len(own) + place)
            band, place = key // len(own) + band.min(), key % len(own)
            after = at[end] if end < len(at) else np.iinfo(np.int64).max
            whole = band * (e + 1) + 2 * e + len(own) <= after
            counted, count = np.unique(band[whole], return_counts=True)
            yield from (counted[count >= max(self.need[item], 1)] * (e + 1)).tolist()
            held = np.stack([band[~whole], place[~whole]])
            start = end

    def find(self, text: str) -> list[tuple]:
        """(item_id, edit distance, place of the end) of the occurrences in ``text``, one for each item."""
        data = normalise(text)
        found: dict[int, tuple[int, int]] = {}
        if self.short:  # too short for a q-gram: exact, on word bounds
            words = data.split(b" ")
            if set(words) & self.short.keys():
                place = 0
                for k, w in enumerate(words):
                    for i, own in self.short.get(w, ()):
                        if i not in found and words[k : k + len(own)] == own:
                            found[i] = (0, place + len(self.items[i]))
                    place += len(w) + 1
        codes = qgrams(data)
        for i in self.candidates(codes):
            item, e = self.items[i], int(self.edits[i])
            at = data.find(item)
            if at >= 0:
                found[i] = (0, at + len(item))
                continue
            for first in self.regions(codes, i) if e else ():
                from_ = max(first, 0)
                region = data[from_ : max(first + 2 * e + len(item) + e, 0)]
                got = banded_distance(np.frombuffer(item, np.uint8), np.frombuffer(region, np.uint8), e)
                if got and (i not in found or got[0] < found[i][0]):
                    found[i] = (got[0], from_ + got[1])
                    if got[0] == 1:
                        break
        return [(self.ids[i], d, at) for i, (d, at) in sorted(found.items())]


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most_chars: int = 2 << 20) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most_chars`` characters, so that what is broadcast at a time has a bound (some 30
    bytes a character)."""
    items = benchmark.select(F.col(id_col), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    block: list[tuple] = []
    held = 0
    for i, t in items.orderBy(id_col, text_col).toLocalIterator():
        if block and held + len(t) > most_chars:
            yield block
            block, held = [], 0
        block.append((i, t))
        held += len(t)
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", matches_col: str = "matches", rate: float = 0.05, item_id: str = "item_id", item_text: str = "text", most_chars: int = 2 << 20) -> DataFrame:
    """``docs`` with, for each whole text, the benchmark items it holds: array of (item_id, distance, end).

    An item is held if all of it occurs within an edit distance of ``rate`` of its length (fewer where the lemma
    would let an occurrence share no q-gram; exact for items shorter than q). Case and white space don't count;
    lengths, distances and ends are in bytes of the normalised text. Of the occurrences of an item the nearest is
    given.

    The q-grams of the items (a stated query set) are broadcast in blocks of bounded size. One block is looked up where the
    texts lie, and no row moves. Of more blocks each takes a pass of its own, which writes down only texts that
    hold something; these findings are then joined to the texts by their digest. Null, empty and very short texts hold
    nothing; null or blank items are left out; items of the same text are found each. An empty benchmark gives
    empty arrays. Ids may be of any type.
    """
    kind = benchmark.schema[item_id].dataType
    docs = docs.drop(matches_col)
    blocks = load_items(benchmark, item_id, item_text, most_chars)
    index, more = Index.of(next(blocks), rate), next(blocks, None)
    if more is None:
        return _match_block(docs, index, text_col, matches_col, kind)
    key = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    texts = docs.select(key.alias("__key"), F.col(text_col))
    found = None
    while True:
        own = cut(_match_block(texts, index, text_col, "found", kind).filter(F.size("found") > 0).select("__key", "found").dropDuplicates(["__key"]))
        found = own if found is None else found.unionByName(own)
        if more is None:
            break
        index, more = Index.of(more, rate), next(blocks, None)
    found = found.groupBy("__key").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("__found"))
    joined = lookup(docs.withColumn("__key", key), found, ["__key"], "left")
    empty = F.array().cast(f"array<struct<item_id: {kind.simpleString()}, distance: int, end: bigint>>")
    return joined.withColumn(matches_col, F.coalesce("__found", empty)).drop("__key", "__found")


def _match_block(docs: DataFrame, index: Index, text_col: str, matches_col: str, id_type: DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("distance", pa.int32()), ("end", pa.int64())]))
    names = docs.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + f"`{matches_col}` array<struct<item_id: {id_type.simpleString()}, distance: int, end: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.find(t) for _, texts in slices(batch, text_col) for t in texts]
            rows = [[{"item_id": i, "distance": d, "end": e} for i, d, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, kind)], [*names, matches_col])

    return docs.mapInArrow(released(run), schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; see matches() for odd rows, which stay."""
    return matches(docs, benchmark, matches_col="__matches", **parameters).filter(F.size("__matches") == 0).drop("__matches")
