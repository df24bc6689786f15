"""Line de-duplication by a deletion-neighbourhood join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, groups, lookup, mix, overlaps, release, released, slices, word_hashes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: The bounds of the query and of the pipeline.
WORDS_PER_EDIT, CHARS_PER_EDIT = 15, 20
#: Lines of a key up to which all its pairs are made, and lines that are compared with others in one task.
FEW, BLOCK = 64, 512
#: A token is frequent if more than one in FREQUENT is it, so there are fewer than that.
FREQUENT = 1 << 16
#: Keys that a task holds before it deals them out or sifts them.
KEYS_HELD = 1 << 19
#: A line's place is the rank of its row, then so many bits for its number in the text.
LINE_BITS = 31


def line_names(lines: list[bytes]) -> np.ndarray:
    """128-bit digests as two 64-bit numbers by line; the first names the line where its keys are joined."""
    digests = b"".join(map(xxhash.xxh3_128_digest, lines))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def half_keys(codes: np.ndarray, offsets: np.ndarray, by_chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of four halves of each line, of which two lines within one edit share at least one.

    Lines are ``codes[offsets[i]:offsets[i + 1]]``. The edit lies in the first or in the second half of the shorter line,
    so the other half is the same in both. A line is halved as the shorter one (or one of equal length) and as the
    longer one, whose second half starts one token later. A half's key is a polynomial in the places from its start on.
    """
    n, at = np.diff(offsets), offsets[:-1]
    powers = np.full(max(n.max(initial=0), 1) + 1, _BASE, np.uint64)
    back = np.full(len(powers), pow(int(_BASE), -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes) * powers[np.arange(len(codes)) - np.repeat(at, n)], out=run[1:])
    keys = []
    for shorter, shift in ((n, 0), (n - 1, 1)):
        half = shorter // 2
        for second, start, end in ((0, np.zeros_like(n), half), (1, half + shift, n)):
            value = (run[at + end] - run[at + start]) * back[start]
            keys.append(mix(value + mix(shorter.astype(np.uint64) * np.uint64(4) + np.uint64(2 * second + by_chars))))
    return np.tile(np.arange(len(n)), 4), np.concatenate(keys).view(np.int64)


def neighbourhoods(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each line its key, then the key of each variant that lacks one token.

    Lines are ``codes[offsets[i]:offsets[i + 1]]``. A key is a polynomial in the places of the tokens, so running sums give
    all variants: tokens after the one that is lacking move forward by one place.
    """
    n, at = np.diff(offsets), offsets[:-1]
    powers = np.full(n.max(initial=0) + 2, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(codes)) - np.repeat(at, n)
    c = mix(codes)
    here, moved = np.zeros(len(codes) + 1, np.uint64), np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(c * powers[place + 1], out=here[1:])
    np.cumsum(c * powers[place], out=moved[1:])
    out = np.empty(len(codes) + len(n), np.uint64)
    whole = at + np.arange(len(n))
    out[whole] = here[offsets[1:]] - here[at] + n.astype(np.uint64)
    less = np.ones(len(out), bool)
    less[whole] = False
    sizes = np.repeat(n, n).astype(np.uint64)
    out[less] = here[:-1] - np.repeat(here[at], n) + np.repeat(moved[offsets[1:]], n) - moved[1:] + sizes - np.uint64(1)
    return mix(out).view(np.int64)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one inserted, deleted or replaced word at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    front = 0
    while front < least and a[front] == b[front]:
        front += 1
    back = 0
    while back < least - front and a[-1 - back] == b[-1 - back]:
        back += 1
    return max(len(a), len(b)) - front - back <= 1


def tokens(line: str, least_words: int, chars_per_edit: int | None) -> list:
    """What edits of a line are counted in: words from ``least_words`` on, else characters; none if only equality counts.

    Words are what ASCII white space separates, as bytes; characters are strings.
    """
    words = line.encode("utf-8", "replace").split()
    if len(words) >= least_words:
        return words
    return list(line) if chars_per_edit and len(line) >= chars_per_edit else []


def encoded(lines: list[str]) -> list[bytes]:
    return [line.encode("utf-8", "replace") for line in lines]


def coded(lines: list[str], data: list[bytes], least_words: int, chars_per_edit: int | None) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of ``lines`` (``data`` as bytes) as numbers: whether they are characters, which lines, their codes, and offsets by line."""
    codes, offsets = word_hashes(data, SPACES)
    n = np.diff(offsets)
    long = n >= least_words
    if long.any():
        yield False, np.flatnonzero(long), codes[np.repeat(long, n)], np.concatenate([[0], np.cumsum(n[long])])
    if chars_per_edit:
        own = np.array([i for i in np.flatnonzero(~long) if len(lines[i]) >= chars_per_edit], np.int64)
        if len(own):
            points = np.frombuffer("".join(lines[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield True, own, mix(points.astype(np.uint64) + np.uint64(1)), np.concatenate([[0], np.cumsum([len(lines[i]) for i in own])])


def most_edits(n: int, per_edit: int | None) -> int:
    """The bound of a pair whose shorter line has ``n`` tokens."""
    return max(1, n // per_edit) if per_edit else 1


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether ``most`` inserted, deleted or replaced tokens at most turn ``a`` into ``b``.

    Furthest places on each diagonal, edit by edit, so the cost grows with the edits and not with the length.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if most == 1:
        return within_one(a, b)
    if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > most:
        return False
    goal = len(b) - len(a)
    front: dict[int, int] = {}
    for edits in range(most + 1):
        new = {}
        for d in range(max(-edits, -len(a)), min(edits, len(b)) + 1):
            i = max(front.get(d, -2) + 1, front.get(d - 1, -1), front.get(d + 1, -2) + 1) if edits else 0
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            new[d] = i
        if new.get(goal, -1) >= len(a):
            return True
        front = new
    return False


def run_sizes(per_edit: int) -> tuple[int, int]:
    """Tokens of a gram, and grams of a window, of which lines within two or more edits share at least one.

    ``k`` edits leave one of the ``k + 1`` stretches between them with (n - k) / (k + 1) tokens or more, and n is at
    least ``k * per_edit``. That is least for two edits.
    """
    run = -(-(2 * per_edit - 2) // 3)
    gram = max(1, run * 7 // 10)
    return gram, run - gram + 1


def shared_keys(n: np.ndarray, edits: np.ndarray, per_edit: int) -> np.ndarray:
    """Places of keys that lines within ``edits`` share at least, if the shorter has ``n`` tokens.

    A stretch of r tokens holds r - gram - window + 2 whole windows, and one place is the least of ``window`` of them
    at most; the ``edits + 1`` stretches have n - edits tokens together.
    """
    gram, window = run_sizes(per_edit)
    return np.maximum(1, -((n - edits - (gram + window - 2) * (edits + 1)) // -window))


def run_keys(codes: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and key of the least gram of each window of ``window`` grams; lines are ``codes[offsets[i]:offsets[i + 1]]``.

    Two lines that share a stretch of ``gram + window - 1`` tokens, at whatever places, share the key of its window.
    """
    rows = len(codes) - gram - window + 2
    if rows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    powers = np.multiply.accumulate(np.full(gram, _BASE, np.uint64))
    whole = np.zeros(len(codes) - gram + 1, np.uint64)
    for k in range(gram):
        whole += codes[k : k + len(whole)] * powers[k]
    whole = mix(whole)
    line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = line[:rows] == line[gram + window - 2 :]
    least = whole[:rows].copy()
    for k in range(1, window):
        np.minimum(least, whole[k : k + rows], out=least)
    chosen = np.zeros(len(whole), bool)
    for k in range(window):
        chosen[k : k + rows] |= inside & (whole[k : k + rows] == least)
    at = np.flatnonzero(chosen)
    return line[at], whole[at].view(np.int64)


def dealt(keys: np.ndarray, others: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Entries by the bucket of their key: one row for each bucket, with the keys and other numbers as bytes."""
    bucket = (((keys >> np.int64(32)) + np.int64(1 << 31)) * buckets >> np.int64(32)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    body = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(v))[: len(first)], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), body(keys[order]), *(body(v[order]) for v in others.values())], ["bucket", "keys", *others])


def gathered(parts: Iterator[np.ndarray], others: list[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """dealt() of KEYS_HELD entries or more at a time; the rows of a part are keys and other numbers."""
    held: list[np.ndarray] = []
    for x in parts:
        held.append(x)
        if sum(x.shape[1] for x in held) >= KEYS_HELD:
            keys, *rest = np.concatenate(held, 1)
            held = []
            yield dealt(keys, dict(zip(others, rest, strict=True)), buckets)
    if held:
        keys, *rest = np.concatenate(held, 1)
        yield dealt(keys, dict(zip(others, rest, strict=True)), buckets)


def entries(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.int64)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By text: numbers and digests of its lines that aren't blank."""
    for batch in batches:
        for at, texts in slices(batch, "text"):
            number, lines, sizes = [], [], []
            for text in texts:
                own = [line.strip() for line in text.split("\n")]
                found = [i for i, line in enumerate(own) if line]
                number += found
                lines += filter(None, own)
                sizes.append(len(found))
            names, part = line_names(encoded(lines)), batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), _lists(np.array(number, np.int32), sizes), _lists(names[:, 0].copy(), sizes), _lists(names[:, 1].copy(), sizes)], ["row", "doc_id", "line", "name", "check"])


def _entries(buckets: int) -> Callable:
    """Lines (name, check, place), dealt over ``buckets`` by name; of lines that a batch holds twice the earliest.

    The others go, so only their places are given, in rows without names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            names, checks, number = (batch.column(c).flatten().to_numpy() for c in ("name", "check", "line"))
            if not len(names):
                continue
            sizes = np.diff(batch.column("line").offsets.to_numpy())
            places = np.repeat(batch.column("rank").to_numpy() << LINE_BITS, sizes) | number.astype(np.int64)
            first, again = _earliest(names, checks, places)
            yield dealt(names[first], {"checks": checks[first], "places": places[first]}, buckets)
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array([int(places[again[0]]) * 31 % buckets], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (none, none, places[again]))], ["bucket", "keys", "checks", "places"])

    return run


def _earliest(names: np.ndarray, checks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the earliest of their line, and which are later ones; an entry that is there twice counts once."""
    order = np.lexsort((places, checks, names))
    line = np.ones(len(order), bool)
    line[1:] = (np.diff(names[order]) != 0) | (np.diff(checks[order]) != 0)
    later = ~line
    later[1:] &= np.diff(places[order]) != 0
    return order[line], order[later]


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, half) by place: -1 for lines that have an earlier equal, else, for lines that share keys, whether a half is among them."""
    held: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
    for batch in batches:
        alone = np.array([not x for x in batch.column("keys").to_pylist()], bool)
        again = entries(batch.filter(pa.array(alone)), "places")
        if len(again):
            yield pa.RecordBatch.from_arrays([pa.array(again), pa.array(np.full(len(again), -1, np.int8))], ["id", "half"])
        batch = batch.filter(pa.array(~alone))
        held.append([entries(batch, c) for c in ("keys", "checks", "places")])
    names, checks, places = (np.concatenate(x) for x in zip(*held, strict=True))
    asked = places < 0
    busy, where = np.unique(names[asked], return_inverse=True)
    half = np.zeros(len(busy), np.int8)
    half[where[checks[asked] & 1 == 0]] = 1
    names, checks, places = names[~asked], checks[~asked], places[~asked]
    first, again = _earliest(names, checks, places)
    at = np.minimum(np.searchsorted(busy, names[first]), max(len(busy) - 1, 0))
    hit = busy[at] == names[first] if len(busy) else np.zeros(len(first), bool)
    ids = np.concatenate([places[again], places[first[hit]]])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.full(len(again), -1, np.int8), half[at[hit]]]))], ["id", "half"])


def _keys(least_words: int, words_per_edit: int | None, chars_per_edit: int | None, buckets: int) -> Callable:
    """Keys of the lines and names of the lines, dealt over ``buckets``.

    A half key is even, a run key odd; the latter come from lines that are long enough for two edits, once for each place.
    """

    def of(texts: list[str]) -> Iterator[np.ndarray]:
        lines = list({line.strip() for text in texts for line in text.split("\n")})
        data = encoded(lines)
        every = line_names(data)[:, 0]
        for by_chars, which, codes, offsets in coded(lines, data, least_words, chars_per_edit):
            per = chars_per_edit if by_chars else words_per_edit
            names = every[which]
            line, keys = half_keys(codes, offsets, by_chars)
            yield np.stack([keys & ~np.int64(1), names[line]])
            if per:
                n = np.diff(offsets)
                twice = n >= 2 * per
                line, keys = run_keys(codes[np.repeat(twice, n)], np.concatenate([[0], np.cumsum(n[twice])]), *run_sizes(per))
                yield np.stack([keys | np.int64(1), names[twice][line]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered((x for batch in batches for _, texts in slices(batch, "text") for x in of(texts)), ["names"], buckets)

    return run


def _busy(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(name, key, -times) of the keys that two lines or more have, dealt over ``buckets`` by name.

    Once KEYS_HELD entries are held, those of keys that are known to be shared go out, so that a key of many lines takes no
    memory. An entry may then come several times, and a line that its table holds twice counts its places twice.
    """
    keys = names = known = np.zeros(0, np.int64)

    def shared() -> np.ndarray:
        order = np.argsort(keys)
        k = keys[order]
        again = np.zeros(len(k) + 1, bool)
        again[1:-1] = k[1:] == k[:-1]
        use = again[1:] | again[:-1]  # most keys have one entry only
        if len(known):
            use |= known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
        order, k = order[use], k[use]
        n, first = names[order], np.flatnonzero(np.diff(k, prepend=k[:1] - 1))
        out = np.zeros(len(keys), bool)
        if len(first):
            differ = np.minimum.reduceat(n, first) != np.maximum.reduceat(n, first)
            if len(known):
                differ |= known[np.minimum(np.searchsorted(known, k[first]), len(known) - 1)] == k[first]
            out[order] = np.repeat(differ, np.diff(first, append=len(k)))
        return out

    def out(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((n, k))
        k, n = k[order], n[order]
        first = np.flatnonzero((np.diff(k, prepend=k[:1] - 1) != 0) | (np.diff(n, prepend=n[:1] - 1) != 0))
        return dealt(n[first], {"checks": k[first], "places": first - np.append(first[1:], len(k))}, buckets)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    room = KEYS_HELD
    for batch in batches:
        held.append((entries(batch, "keys"), entries(batch, "names")))
        if sum(len(k) for k, _ in held) >= room:
            keys, names = (np.concatenate([old, *new]) for old, new in zip((keys, names), zip(*held, strict=True), strict=True))
            gone, held = shared(), []
            known = np.union1d(known, keys[gone])
            yield out(keys[gone], names[gone])
            keys, names = keys[~gone], names[~gone]
    keys, names = (np.concatenate([old, *new]) for old, new in zip((keys, names), zip(*held, strict=True) if held else ((), ()), strict=True))
    gone = shared()
    yield out(keys[gone], names[gone])


def _variants(buckets: int) -> Callable:
    """The deletion neighbourhoods, dealt over ``buckets``; the place that a variant lacks is ``lacks``, 0 for the line itself."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("keys")
        keys, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        return np.stack([keys, np.repeat(batch.column("id").to_numpy(), n), np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)])

    return lambda batches: gathered(map(of, batches), ["ids", "lacks"], buckets)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (id, earlier) of lines whose neighbourhoods meet within one edit.

    Two lines are one replacement apart if variants that lack the same place are equal, and one insertion apart if one
    line equals a variant of the other. Of a key the earliest line and, by place, the earliest variant are held, so
    each line gets one candidate of a key, whatever the number of its lines.
    """
    least = np.zeros((3, 0), np.int64)  # key, lacks, id

    def pairs(all_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of entries sorted by key, lacks and id."""
        key, lacks, ids = all_
        for own in ((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(lacks, prepend=lacks[:1] - 1) != 0),):  # the same place
            first = np.flatnonzero(own)
            yield ids, np.repeat(ids[first], np.diff(first, append=len(ids)))
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        size = np.diff(first, append=len(ids))
        far = np.iinfo(np.int64).max
        line = np.minimum.reduceat(np.where(lacks == 0, ids, far), first)
        variant = np.minimum.reduceat(np.where(lacks > 0, ids, far), first)
        yield ids, np.where(lacks == 0, np.repeat(variant, size), np.repeat(line, size))

    def out(all_: np.ndarray) -> pa.RecordBatch:
        later, earlier = (np.concatenate(x) for x in zip(*pairs(all_), strict=True))
        both = np.unique(np.stack([later, earlier])[:, earlier < later], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["id", "earlier"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([entries(batch, c) for c in ("keys", "lacks", "ids")]))
        n += held[-1].shape[1]
        if n >= KEYS_HELD:
            all_ = np.concatenate([least, *held], 1)
            all_ = all_[:, np.lexsort(all_[::-1])]
            yield out(all_)
            least, held, n = all_[:, (np.diff(all_[:2], prepend=all_[:2, :1] - 1) != 0).any(0)], [], 0
    all_ = np.concatenate([least, *held], 1)
    if all_.shape[1]:
        yield out(all_[:, np.lexsort(all_[::-1])])


#: What _stars() gives.
STAR, PAIR, HOT = 0, 1, 2


def _named(buckets: int) -> Callable:
    """Lines (name, id, size and kind of token), dealt over ``buckets`` by name."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        names, ids, size, chars = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("name", "id", "size", "chars"))
        return np.stack([names, ids, size << 32 | chars << 62])

    return lambda batches: gathered(map(of, batches), ["checks", "places"], buckets)


def _placed(buckets: int) -> Callable:
    """Run keys with the ids of their lines, dealt over ``buckets`` by key; ``about`` holds times, size and kind of token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, 0), np.int64), *(np.stack([entries(b, c) for c in ("keys", "checks", "places")]) for b in batches)]
        names, checks, places = np.concatenate(held, 1)
        line, key = np.flatnonzero(places >= 0), np.flatnonzero((places < 0) & (checks & 1 == 1))
        line = line[np.argsort(names[line], kind="stable")]
        low, high = (np.searchsorted(names[line], names[key], side) for side in ("left", "right"))
        n = high - low  # names of 64 bits may stand for two lines
        of = line[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        key = np.repeat(key, n)
        if len(key):
            yield dealt(checks[key], {"ids": checks[of], "about": places[of] - places[key]}, buckets)

    return run


def _stars(words_per_edit: int | None, chars_per_edit: int | None) -> Callable:
    """Rows (kind, id, earlier, times, need) from the keys that lines share.

    STAR: a line, the earliest line of a key, the places of the key that they share and how many places of all their keys
    their bound calls for. PAIR: likewise, a line and each other earlier line of a key of up to FEW lines. HOT: a line's
    places of a key of more lines, and how many the line shares with any that is near it. Pairs whose sizes are too far apart are left out. Of a key of many lines only the
    earliest one is held.
    """

    def split(about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return about & 0x7FFFFFFF, about >> 32 & 0x3FFFFFFF, about >> 62

    def rows(kind: int, ids: np.ndarray, earlier: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        (t1, n1, chars), (t2, n2, _) = split(a), split(b)
        m, need, edits = np.minimum(n1, n2), np.ones(len(ids), np.int64), np.ones(len(ids), np.int64)
        for by_chars, per in ((0, words_per_edit), (1, chars_per_edit)):
            if per:
                own = np.maximum(1, m // per)
                edits = np.where(chars == by_chars, own, edits)
                need = np.where(chars == by_chars, shared_keys(m, own, per), need)
        fit = (earlier < ids) & (np.abs(n1 - n2) <= edits)
        return batch(kind, ids[fit], earlier[fit], np.minimum(t1, t2)[fit], need[fit])

    def least(about: np.ndarray) -> np.ndarray:
        """The fewest places that a line shares with any other within their bound, which may be the shorter."""
        _, n, chars = split(about)
        out = np.ones(len(n), np.int64)
        for by_chars, per in ((0, words_per_edit), (1, chars_per_edit)):
            if per:
                e = np.maximum(1, n // per)
                short = np.maximum(n - e, 1)
                own = np.minimum(shared_keys(np.maximum(short, per * e), e, per), np.where(short < per * e, shared_keys(short, np.maximum(e - 1, 1), per), np.iinfo(np.int64).max))
                out = np.where(chars == by_chars, own, out)
        return out

    def batch(kind: int, ids, earlier, times, need) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int8)), pa.array(ids), pa.array(earlier), pa.array(times.astype(np.int32)), pa.array(need.astype(np.int32))], ["kind", "id", "earlier", "times", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros((3, 0), np.int64)  # key, earliest id and what is known about it
        held, n, room = [np.zeros((3, 0), np.int64)], 0, KEYS_HELD

        def sifted(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal hot, held, n, room
            every = np.concatenate([hot, *held], 1)
            old = np.zeros(every.shape[1], bool)
            old[: hot.shape[1]] = True
            order = np.lexsort((every[1], every[0]))
            (key, ids, about), old = every[:, order], old[order]
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            size = np.diff(first, append=len(key))
            many = np.repeat((size > FEW) | (np.logical_or.reduceat(old, first) if len(first) else first > 0), size)
            start = np.repeat(first, size)
            use = many | last
            yield rows(STAR, ids[use], ids[start[use]], about[use], about[start[use]])
            new = many & ~old
            yield batch(HOT, ids[new], ids[new], split(about[new])[0], least(about[new]))
            if last:
                i = np.flatnonzero(~many)
                for d in range(1, FEW):
                    i = i[i - d > start[i]]
                    if not len(i):
                        break
                    yield rows(PAIR, ids[i], ids[i - d], about[i], about[i - d])
            top = first[many[first]] if len(first) else first
            hot = np.stack([key[top], ids[top], about[top]])
            held = [np.stack([key, ids, about])[:, ~many]]
            n = 0

        for b in batches:
            held.append(np.stack([entries(b, c) for c in ("keys", "ids", "about")]))
            n += held[-1].shape[1]
            if n >= room:
                yield from sifted(False)
        yield from sifted(True)

    return run


def _texts_of_lines(least_words: int, chars_per_edit: int | None) -> Callable:
    """The wanted lines of each text, their numbers of tokens and their neighbourhoods.

    A wanted line is twice its number, and one more if its neighbourhood is wanted too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, ids = batch.column("wanted").to_pylist(), batch.column("ids").to_pylist()
            for at, texts in slices(batch, "text"):
                own: list[int] = []
                line, half = [], []
                for k, text in enumerate(texts):
                    lines = text.split("\n")
                    own += ids[at + k]
                    line += [lines[i >> 1].strip() for i in wanted[at + k]]
                    half += [i & 1 for i in wanted[at + k]]
                size, chars, data = np.zeros(len(line), np.int32), np.zeros(len(line), bool), encoded(line)
                half, keys, of = np.array(half, bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for by_chars, which, codes, offsets in coded(line, data, least_words, chars_per_edit):
                    size[which], chars[which] = np.diff(offsets), by_chars
                    n, use = np.diff(offsets), half[which]
                    keys.append(neighbourhoods(codes[np.repeat(use, n)], np.concatenate([[0], np.cumsum(n[use])])))
                    of.append(np.repeat(which[use], n[use] + 1))
                of = np.concatenate(of)
                held = np.bincount(of, minlength=len(line))
                keys = _lists(np.concatenate(keys)[np.argsort(of, kind="stable")], held)
                columns = ((own, pa.int64()), (line_names(data)[:, 0].copy(), pa.int64()), (line, pa.string()), (size, pa.int32()), (chars, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, kind) for v, kind in columns), keys], ["id", "name", "text", "size", "chars", "keys"])

    return run


class Bound:
    """How many edits two lines may be apart."""

    def __init__(self, least_words: int, words_per_edit: int | None, chars_per_edit: int | None):
        self.least_words, self.words_per_edit, self.chars_per_edit = least_words, words_per_edit, chars_per_edit

    def tokens(self, line: str) -> list:
        return tokens(line, self.least_words, self.chars_per_edit)

    def edits(self, shorter: list) -> int:
        return most_edits(len(shorter), self.words_per_edit if isinstance(shorter[0], bytes) else self.chars_per_edit)

    def near(self, a: list, b: list) -> bool:
        return type(a[0]) is type(b[0]) and within(a, b, self.edits(min(a, b, key=len)))

    def checked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the lines that are within the bound of the other line of their pair."""
        for batch in batches:
            a, b = batch.column("text").to_pylist(), batch.column("other").to_pylist()
            keep = [self.near(self.tokens(x), self.tokens(y)) for x, y in zip(a, b, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["id"])

    def numbered(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Line, hash and place of each token, numbered where it repeats in its line; and the kind of tokens by line."""
        rows, hashes, places, kinds = [], [], [], np.zeros(len(lines), np.int64)
        for by_chars, which, codes, offsets in coded(lines, encoded(lines), self.least_words, self.chars_per_edit):
            n = np.diff(offsets)
            row = np.repeat(which, n)
            kinds[which] = by_chars
            order = np.lexsort((codes, row))
            first = (np.diff(row[order], prepend=-1) != 0) | (np.diff(codes[order], prepend=~codes[order[:1]]) != 0)
            start = np.flatnonzero(first)
            times = np.empty(len(order), np.int64)
            times[order] = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
            rows.append(row)
            hashes.append(mix(codes + mix(times.astype(np.uint64) * np.uint64(2) + np.uint64(by_chars))).view(np.int64))
            places.append(np.arange(len(codes)) - np.repeat(offsets[:-1], n))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(rows or empty), np.concatenate(hashes or empty), np.concatenate(places or empty), kinds

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, n) of the lines."""
        for batch in batches:
            token, n = np.unique(self.numbered(batch.column("text").to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])

    def rarest(self, frequent: pa.Table) -> Callable:
        """(token, id, n, chars) of as many of each line's rarest tokens as its bound and one more.

        ``frequent`` has the counts of tokens that are not rare.
        """
        token, n = (frequent[c].to_numpy() for c in ("token", "n"))
        order = np.argsort(token)
        token, n = token[order], n[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, own, _, kinds = self.numbered(batch.column("text").to_pylist())
                if not len(row):
                    continue
                at = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
                count = np.where(token[at] == own, n[at], 0) if len(token) else np.zeros(len(own), np.int64)
                order = np.lexsort((own, count, row))
                row, own = row[order], own[order]
                size = np.bincount(row, minlength=batch.num_rows)
                rank = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                use = rank <= self.bounds(size, kinds)[row]
                row = row[use]
                yield pa.RecordBatch.from_arrays([pa.array(own[use]), batch.column("id").take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(kinds[row].astype(bool))], ["token", "id", "n", "chars"])

        return run

    def bounds(self, size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = np.ones(np.broadcast_shapes(size.shape, kinds.shape), np.int64)
        for by_chars, per in ((0, self.words_per_edit), (1, self.chars_per_edit)):
            if per:
                out = np.where(kinds == by_chars, np.maximum(1, size // per), out)
        return out

    def paired(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (id, earlier) of open lines and others that share a token and whose sizes fit."""
        for t, starts in groups(batches, ["token"]):
            ids, n, chars, open_ = (t[c].to_numpy() for c in ("id", "n", "chars", "open"))
            start = np.repeat(starts, np.diff(starts, append=len(ids)))
            i = np.flatnonzero(open_)
            for d in range(1, FEW):
                i = i[i - d >= start[i]]
                if not len(i):
                    break
                j = i - d
                fit = (ids[j] < ids[i]) & (chars[i] == chars[j]) & (np.abs(n[i] - n[j]) <= self.bounds(np.minimum(n[i], n[j]), chars[i].astype(int)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[fit]]), pa.array(ids[j[fit]])], ["id", "earlier"])

    def compared(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of open lines (``left``) that are near an earlier one of the others in their pair of blocks."""
        for t, starts in groups(batches, ["token", "lo", "hi"]):
            node, left = t["node"].to_numpy(), t["left"].to_numpy()
            out = []
            for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
                mine, others = (i[np.unique(node[i], return_index=True)[1]] for i in (s + np.flatnonzero(left[s:e]), s + np.flatnonzero(~left[s:e])))
                if not len(mine) or not len(others) or node[others[0]] >= node[mine[-1]]:
                    continue
                m = len(mine)
                text = t["text"].take(pa.array(np.concatenate([mine, others]))).to_pylist()
                row, token, place, kinds = self.numbered(text)
                _, columns = np.unique(token, return_inverse=True)
                size = np.bincount(row, minlength=len(text))
                common = overlaps(row, columns, len(text), m)[:, m:]
                most = self.bounds(np.minimum(size[:m, None], size[None, m:]), kinds[:m, None])
                maybe = (np.maximum(size[:m, None], size[None, m:]) - common <= most) & (node[others][None, :] < node[mine][:, None])
                whole = np.full((len(text), size.max()), -1, np.int64)
                whole[row, place] = columns
                for i in np.flatnonzero(maybe.any(1)):
                    near = np.flatnonzero(maybe[i])
                    # first as they stand side by side, then with tokens moved
                    straight = (whole[m + near] != whole[i]).sum(1) <= most[i, near]
                    if straight.any() or any(self.near(self.tokens(text[i]), self.tokens(text[m + j])) for j in near):
                        out.append(node[mine[i]])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])


def against(rows: DataFrame, block: int) -> DataFrame:
    """Deals each token's lines (token, node, open) over pairs of blocks: (token, lo, hi, left) for every pair a row is in.

    Open lines are dealt over blocks ``lo`` and all lines over blocks ``hi``, of about ``block`` each; a pair has the open ones
    (``left``) of the one and the lines of the other. So each open line meets each line once, and lines that are settled don't meet.
    """
    sizes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_hi"), F.ceil(F.count_if("open") / block).cast("int").alias("n_lo")).filter("n_lo > 0")
    rows = rows.join(sizes, "token")
    lo, hi = F.pmod(F.xxhash64("node", F.lit(1)), "n_lo").cast("int"), F.pmod(F.xxhash64("node"), "n_hi").cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("n_lo") - 1), lambda i: F.struct(i.alias("lo"), hi.alias("hi"), F.lit(False).alias("left")))
    mine = F.transform(F.sequence(F.lit(0), F.col("n_hi") - 1), lambda i: F.struct(lo.alias("lo"), i.alias("hi"), F.lit(True).alias("left")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("open"), F.concat(every, mine)).otherwise(every))).select("*", "at.*").drop("at", "n_lo", "n_hi")
    return rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "node")


def ranked(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n, rank): the different rows of ``rows``, how often each is there, and its number in the order of (doc_id, row)."""
    order = cut(rows.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy("doc_id", "row").withColumn("at", F.monotonically_increasing_id()))
    part, at = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(order.groupBy(part.alias("part")).agg(F.max(at) + 1).collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = order.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part long, start long")
    return order.join(F.broadcast(starts), part == F.col("part")).select("row", "doc_id", "n", (F.col("start") + at).alias("rank"))


def repeated_lines(docs: DataFrame, least_words: int = 10, words_per_edit: int | None = None, chars_per_edit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, lines): which lines of each row of ``docs`` (row, doc_id, text) have an earlier equal; and (row, doc_id) of
    rows with lines that ``docs`` holds more than once.

    ``row`` is a hash of the text, so with the id it names a row however often that is computed. Rows of the same id and
    text are one here; dedup_lines() tells them apart.
    Lines are what newlines separate, compared without the white space around them; blank lines have no equal.
    Earlier is by (doc_id, row, number of the line). A line goes if an earlier line is the same or, where both have
    ``least_words`` words or more, within an edit distance of one word for each ``words_per_edit`` words of the shorter
    line, one at least (one for all if None). Where both have fewer words, and ``chars_per_edit`` characters or more,
    it is one character for each ``chars_per_edit`` (None: such lines need to be equal). The distance is not
    carried on: what counts is the earlier line itself, whether or not that one stays.

    1. Equal lines become one by a 128-bit digest, with the earliest place.
    2. Distinct lines give hashed keys of halves (see half_keys) and, if they are long enough for two edits, of the least
       gram of each window (see run_keys). Lines that share none with another are within their bound of none.
    3. Lines that share a half emit their deletion neighbourhood as hashed keys: the line itself and each variant without
       one token. Equal variants are joined (see _met).
    4. Lines of two edits or more that are within their bound share a stretch without an edit (see run_sizes), so they share
       the least gram of a window in it. Pairs that share fewer keys than their bound calls for (see
       shared_keys) are dropped. First each line meets the earliest line of each of its keys; lines that this doesn't
       settle meet all earlier lines of their keys of up to FEW lines.
    5. Pairs that share only keys of more lines have all but ``k`` tokens in common, where ``k`` is their bound, so they share one
       of the ``k + 1`` first in any order; rare tokens come first. Lines of a token of up to FEW lines make pairs. Of others, lines that
       are not settled yet are compared with all in blocks of BLOCK lines: no pair is written down, yet a group of n lines that are nearly as far apart as the bound takes time in the square of n.
    6. The edit distance of every candidate pair is verified on the words or characters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    bound = Bound(least_words, words_per_edit, chars_per_edit)
    prints = cut(docs.select("row", "doc_id", "text").mapInArrow(released(_lines), f"row long, doc_id {kind}, line array<int>, name array<long>, check array<long>").filter(F.size("line") > 0))
    order = ranked(prints)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select("text").mapInArrow(released(_keys(least_words, words_per_edit, chars_per_edit, 4 * parts)), "bucket int, keys binary, names binary")
    dealt_out = "bucket int, keys binary, checks binary, places binary"
    busy = cut(keys.repartition(parts, "bucket").mapInArrow(released(partial(_busy, buckets=4 * parts)), dealt_out))
    release(spark)

    lines = lookup(prints, order.select("row", "doc_id", "rank"), ["row", "doc_id"]).select("rank", "line", "name", "check").mapInArrow(released(_entries(4 * parts)), dealt_out)
    same = cut(lines.union(busy).repartition(parts, "bucket").mapInArrow(released(_same), "id long, half tinyint"))
    equal = same.filter("half < 0").select("id")
    rank, number = F.shiftright("id", LINE_BITS).alias("rank"), F.col("id").bitwiseAND((1 << LINE_BITS) - 1).cast("int").alias("line")

    own = F.sort_array(F.collect_list(F.struct((F.col("line") * 2 + F.col("half")).cast("int").alias("wanted"), F.col("id").alias("ids"))))
    wanted = same.filter("half >= 0").select("id", "half", rank, number).groupBy("rank").agg(own.alias("own"))
    wanted = wanted.join(order, "rank").select("row", "doc_id", "own.wanted", "own.ids")
    words = lookup(docs.select("row", "doc_id", "text"), wanted, ["row", "doc_id"]).mapInArrow(released(_texts_of_lines(least_words, chars_per_edit)), "id long, name long, text string, size int, chars boolean, keys array<long>")
    words = cut(words)
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        own = cut(lookup(words.select("id", "text"), pairs.select("id").union(pairs.select("earlier")).distinct(), ["id"]))
        both = pairs.join(own, "id").join(own.select(F.col("id").alias("earlier"), F.col("text").alias("other")), "earlier")
        return both.select("id", "text", "other").mapInArrow(released(bound.checked), "id long")

    near_keys = words.filter(F.size("keys") > 0).select("id", "keys").mapInArrow(released(_variants(4 * parts)), "bucket int, keys binary, ids binary, lacks binary")
    pairs = near_keys.repartition(parts, "bucket").mapInArrow(released(_met), "id long, earlier long")
    if not words_per_edit and not chars_per_edit:
        near = verified(pairs.distinct())
    else:
        placed = busy.union(words.select("name", "id", "size", "chars").mapInArrow(released(_named(4 * parts)), dealt_out))
        placed = placed.repartition(parts, "bucket").mapInArrow(released(_placed(4 * parts)), "bucket int, keys binary, ids binary, about binary")
        met = cut(placed.repartition(parts, "bucket").mapInArrow(released(_stars(words_per_edit, chars_per_edit)), "kind tinyint, id long, earlier long, times int, need int"))

        def enough(pairs: DataFrame, less: Column) -> DataFrame:
            """Pairs (id, earlier) that have as many keys in common as their bound calls for, but for ``less`` of them."""
            pairs = pairs.groupBy("id", "earlier").agg(F.sum("times").alias("times"), F.min(F.col("need") - less).alias("need"))
            return pairs.filter("times >= need").select("id", "earlier")

        pairs = pairs.union(enough(met.filter(F.col("kind") == STAR), F.lit(0)))
        near = cut(verified(pairs.distinct()).distinct())
        release(spark)

        # lines that the earliest ones don't settle: all earlier lines of keys with few lines
        hot = met.filter(F.col("kind") == HOT).groupBy("id").agg(F.sum("times").alias("less"), F.min("need").alias("least"))
        undone = met.filter(F.col("kind") == PAIR).join(near, "id", "left_anti").join(hot.select("id", "less"), "id", "left").fillna(0, ["less"])

        # pairs that share only keys of many lines: by the rarest tokens of those lines
        hot = words.select("id", "text").join(hot.filter("less >= least").select("id"), "id").join(near.withColumn("done", F.lit(True)), "id", "left").select("id", "text", F.col("done").isNull().alias("open"))
        hot = cut(hot.dropDuplicates(["id"]))
        counts = hot.select("text").mapInArrow(released(bound.counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        counts = cut(counts)
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        frequent = counts.filter(F.col("n") > total / FREQUENT).toArrow()
        few_tokens = hot.select("id", "text").mapInArrow(released(bound.rarest(frequent)), "token long, id long, n int, chars boolean")
        few_tokens = cut(few_tokens)
        few_tokens = cut(few_tokens.join(few_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "token"))
        small = few_tokens.filter(F.col("size") <= FEW).join(hot.select("id", "open"), "id").select("token", "id", "n", "chars", "open")
        small = small.repartition("token").sortWithinPartitions("token", "id").mapInArrow(released(bound.paired), "id long, earlier long")
        rows = few_tokens.filter(F.col("size") > FEW).join(hot, "id").select("token", F.col("id").alias("node"), "text", "open")
        compared = against(rows, BLOCK).select("token", "lo", "hi", "left", "node", "text").mapInArrow(released(bound.compared), "id long")
        near = near.union(verified(enough(undone, F.col("less")).union(small).distinct())).union(compared)
    gone = equal.union(near).select(rank, number).groupBy("rank").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return gone.join(order, "rank").select("row", "doc_id", "lines"), order.filter("n > 1").select("row", "doc_id", "n")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", dropped_col: str = "dropped_lines", least_words: int = 10, words_per_edit: int | None = None, chars_per_edit: int | None = None) -> DataFrame:
    """``docs`` without the lines that repeated_lines() finds, and how many each row lost (0 or more).

    Rows stay, also those that lose all their lines; their text is then what blank lines leave. A null text stays
    null and a text without repeated lines is not touched. Of rows of the same id and text one is the first; the others lose
    all their lines. A column named ``dropped_col`` is replaced.
    """
    number, lost = "__row", "__lost"
    base = docs.drop(dropped_col).withColumn(number, F.xxhash64(F.col(text_col).cast("string")))
    found, again = repeated_lines(base.select(F.col(number).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), least_words, words_per_edit, chars_per_edit)
    found = found.select(F.col("row").alias(number), F.col("doc_id").alias(id_col), F.col("lines").alias(lost))
    again = cut(again.select(F.col("row").alias(number), F.col("doc_id").alias(id_col), F.col("n").alias("__n")))
    joined = lookup(base, found, [number, id_col], "left")
    if again.limit(1).count():  # rows of the same id and text: written down with a number, all but the first lose every line
        marked = lookup(joined, again, [number, id_col], "left")
        same = cut(marked.filter("__n is not null").withColumn("__number", F.monotonically_increasing_id()))
        first = same.groupBy(number, id_col).agg(F.min("__number").alias("__first"))
        same = lookup(same, first, [number, id_col], "left")
        every = F.sequence(F.lit(0), F.size(F.split(F.col(text_col).cast("string"), "\n")) - 1)
        filled = F.filter(every, lambda i: ~F.split(F.col(text_col).cast("string"), "\n")[i].rlike(r"(?U)^[\s\x1c-\x1f]*$"))
        same = same.withColumn(lost, F.when(F.col("__number") > F.col("__first"), filled).otherwise(F.col(lost)))
        joined = marked.filter("__n is null").drop("__n").unionByName(same.drop("__n", "__number", "__first"))
    joined = joined.drop(number)
    names = [c for c in joined.columns if c != lost]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema if f.name != lost) + f"`{dropped_col}` int"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(text_col), batch.column(lost)
            counts = np.zeros(batch.num_rows, np.int32)
            new = texts.to_pylist() if gone.null_count < len(gone) else None
            for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)) if new else ():
                drop = set(gone[i].as_py())
                counts[i] = len(drop)
                new[i] = "\n".join(x for k, x in enumerate(new[i].split("\n")) if k not in drop)
            columns = [pa.array(new, pa.string()) if new and c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], [*names, dropped_col])

    return joined.mapInArrow(released(rebuild), schema)
