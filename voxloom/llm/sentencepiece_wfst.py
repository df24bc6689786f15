"""SentencePiece encoding and decoding as a shortest path through a weighted transducer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import released, slices

#: Fixed values of the format: the sign for a blank, model types and piece types.
BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_INF = float("inf")
_SLICE = 1 << 19  # characters whose stretches are composed together
#: The pair transducer remembers up to 2 ** PAIR_BITS pairs.
PAIR_BITS = 20


class Normaliser:
    """The normaliser's transducer: replacements of the longest source that fits, and what becomes of white space.

    A compiled character map holds a double-array trie of sources (UTF-8) and the texts that they become. Its arcs are read out once;
    sources of one character are a table, longer ones are tried from the characters that begin one.
    """

    def __init__(self, spec):
        if spec.precompiled_charsmap and not spec.escape_whitespaces:
            raise ValueError("blanks must be escaped")
        if not spec.escape_whitespaces:
            raise ValueError("only models that write blanks as pieces are supported")
        self.prefix = BLANK if spec.add_dummy_prefix else ""
        self.trims = spec.remove_extra_whitespaces
        arcs = dict(self._arcs(spec.precompiled_charsmap)) if spec.precompiled_charsmap else {}
        self.single = {ord(k): v for k, v in arcs.items() if len(k) == 1}
        self.longer = {k: v for k, v in arcs.items() if len(k) > 1}
        self.longest = max(map(len, self.longer), default=0)
        self.begins = {k[0] for k in self.longer}

    @staticmethod
    def _arcs(blob: bytes) -> Iterator[tuple[str, str]]:
        size = int.from_bytes(blob[:4], "little")
        units, texts = np.frombuffer(blob, np.uint32, size // 4, 4).astype(np.int64), blob[4 + size :]
        labels, every = units & 0x800000FF, np.arange(1, 256)
        below = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
        open_ = [(0, b"")]
        while open_:
            at, source = open_.pop()
            base = below(at)
            next_ = base ^ every
            fit = next_ < len(units)
            fit[fit] = labels[next_[fit]] == every[fit]
            for c in every[fit].tolist():
                to = base ^ c
                if units[to] >> 8 & 1:
                    value = int(units[below(to)] & 0x7FFFFFFF)
                    yield (source + bytes([c])).decode("utf-8", "ignore"), texts[value : texts.index(b"\0", value)].decode("utf-8", "replace")
                open_.append((to, source + bytes([c])))

    def __call__(self, text: str) -> str:
        if self.longer and not self.begins.isdisjoint(text):
            out, i = [], 0
            while i < len(text):
                n = next((n for n in range(min(self.longest, len(text) - i), 1, -1) if text[i : i + n] in self.longer), 1) if text[i] in self.begins else 1
                out.append(self.longer[text[i : i + n]] if n > 1 else self.single.get(ord(text[i]), text[i]))
                i += n
            text = "".join(out)
        elif self.single:
            text = text.translate(self.single)
        if self.trims:
            text = re.sub(" +", " ", text).strip(" ")
        return self.prefix + text.replace(" ", BLANK) if text else ""


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


class Table:
    """Numbers by key, in open addressing, so that many keys are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(int(4 * len(keys)).bit_length(), 4)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        place = _place(keys, self.bits)
        while len(keys):
            free = self.keys[place] < 0
            _, first = np.unique(np.where(free, place, -1 - np.arange(len(place))), return_index=True)
            put = first[free[first]]
            self.keys[place[put]], self.values[place[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, place = keys[left], values[left], (place[left] + 1) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for unknown keys."""
        place = _place(keys, self.bits)
        here = self.keys[place]
        out = np.where(here == keys, self.values[place], -1)
        open_ = np.flatnonzero((here != keys) & (here >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[place[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return out


class Pieces:
    """The pieces' transducer: states of a trie, arcs from state to state by character, and the piece that a state ends.

    Arcs are in a table by state and character, so that many places of an input take their arcs in one look-up.
    """

    def __init__(self, ids: dict[str, int]):
        self.symbol = {c: k for k, c in enumerate(sorted(set("".join(ids))))}
        points = np.array([ord(c) for c in self.symbol], np.int64)
        self.number = np.full(0x110000, -1, np.int32)
        self.number[points] = np.arange(len(points))
        states: dict[str, int] = {"": 0}
        arcs, final = [], {}
        for piece, i in ids.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    arcs.append((states[piece[: k - 1]] * len(points) + self.symbol[piece[k - 1]], states[piece[:k]]))
            final[states[piece]] = i
        self.arcs = Table(*np.array(arcs, np.int64).reshape(-1, 2).T.copy())
        self.piece = np.full(len(states), -1, np.int32)
        self.piece[list(final)] = list(final.values())

    def compose(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all arcs that the pieces give over ``text`` (code points), none beyond ``ends`` of its place."""
        symbols = self.number[text].astype(np.int64)
        start = np.flatnonzero(symbols >= 0)
        state, at = np.zeros(len(start), np.int64), start
        found = []
        while len(start):
            state = self.arcs(state * len(self.symbol) + symbols[at])
            on = state >= 0
            start, at, state = start[on], at[on] + 1, state[on]
            piece = self.piece[state]
            use = piece >= 0
            found.append((start[use], at[use], piece[use]))
            on = at < ends[start]
            on[on] = symbols[at[on]] >= 0
            start, at, state = start[on], at[on], state[on]
        # the longest first
        return tuple(np.concatenate(x) for x in zip(*reversed(found), strict=True)) if found else (np.zeros(0, np.int64),) * 3


class Transducer:
    """The composition of normaliser, pieces and byte fallback with a text, and its shortest path.

    The normaliser maps blanks to BLANK and puts one in front. The piece transducer maps a character sequence to
    a piece's id; a character that is no piece leads through its bytes. Arcs weigh minus the piece's score in the
    tropical semiring. For a BPE model the pieces are composed with a pair transducer, whose states are pieces: it
    gives a pair of neighbours that merging would not have left side by side the weight infinity. A sequence without
    such a pair is what merging gives, so its path is the only one of finite weight.

    Shortest paths are taken by stretch: no piece crosses the bounds between a blank and what stands before it, and
    none holds a character that is only bytes. All new stretches of a slice are composed at once and relaxed place by place.
    Frequent stretches are remembered until there are ``remembered`` of them.
    """

    def __init__(self, model: bytes, remembered: int = 60_000):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normaliser, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are transducers of pieces")
        if trainer.treat_whitespace_as_suffix:
            raise ValueError("only models that put blanks before words are supported")
        self.normalise = Normaliser(normaliser)
        self.prefix = self.normalise.prefix
        self.bpe = trainer.model_type == BPE
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        self.out: list[bytes] = []
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            kind = p.type
            self.out.append(p.piece.replace(BLANK, " ").encode())
            if kind in (NORMAL, USER):
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif kind == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
                self.out[i] = (trainer.unk_surface or " ⁇ ").encode()
            else:
                self.out[i] = b""
        self.fallback = min(self.score.values(), default=0.0) - 10.0  # the library's penalty of an unknown character
        letters = set("".join(self.ids))
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        alone = "" if "\n" in letters else "\n"
        self.stretches = re.compile(f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+|{alone or '(?!)'}" if not inner else r"(?s).+").findall
        self.remembered, self.memo = remembered, {}
        self.pieces = [p.piece for p in proto.pieces]
        self.raw = [np.int32(i).tobytes() for i in range(len(self.pieces))]
        self.arcs = Pieces(self.ids)
        self.weight = np.zeros(len(self.pieces) + 1, np.float32)  # as the library adds them; the last is a character without a piece
        for piece, i in self.ids.items():
            self.weight[i] = -self.score[piece]
        self.weight[-1] = -self.fallback
        self.known, self.fit = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)  # pairs by their place
        self._spines = lru_cache(maxsize=8_000)(self._derive)

    # -- the pair transducer of a BPE model

    def _derive(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
        """How merging builds ``piece``: its first and its last symbol over time, and when each came to be.

        Time runs from high to low scores; a symbol comes at its own score, but not before its parts.
        """
        symbols = [(c, _INF) for c in piece]
        first, last = [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            best, at = max(((self.score.get(symbols[k][0] + symbols[k + 1][0], -_INF), -k) for k in range(len(symbols) - 1)))
            if best == -_INF:
                break
            k = -at
            new = (symbols[k][0] + symbols[k + 1][0], min(best, symbols[k][1], symbols[k + 1][1]))
            if k == 0:
                first.append(new)
            if k == len(symbols) - 2:
                last.append(new)
            symbols[k : k + 2] = [new]
        return first, last

    def _pair(self, a: str, b: str) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: no symbol of the two merges across their bound."""
        left, right = self._spines(a)[1], self._spines(b)[0]
        i = j = 0
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else -_INF
            next_right = right[j + 1][1] if j + 1 < len(right) else -_INF
            across = self.score.get(left[i][0] + right[j][0], -_INF)
            # of equal scores the leftmost merges first: within a, then across, then within b
            if across > next_left and across >= next_right and across > -_INF:
                return False
            if next_left == next_right == -_INF:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """Which pairs (left id * number of pieces + right id) the pair transducer lets through."""
        place = _place(keys, PAIR_BITS)
        fit = self.fit[place]
        missed = np.flatnonzero(self.known[place] != keys)
        if len(missed):
            new, where = np.unique(keys[missed], return_inverse=True)
            n = len(self.pieces)
            own = np.array([self._pair(self.pieces[k // n], self.pieces[k % n]) for k in new.tolist()], bool)
            fit[missed] = own[where]
            at = _place(new, PAIR_BITS)
            self.known[at], self.fit[at] = -1, False  # of pairs with the same place the last stays
            self.known[at] = new
            self.fit[at[self.known[at] == new]] = own[self.known[at] == new]
        return fit

    # -- the shortest path

    def _bytes(self, char: str) -> bytes:
        ids = [self.byte_ids[b] for b in char.encode("utf-8", "replace")]
        return b"".join([self.raw[i] for i in ids]) if min(ids) >= 0 else self.raw[self.unknown]

    def _paths(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of the least-weight paths through stretches.

        Arcs are relaxed by the place of their end within their stretch. ``state`` has the pair transducer's state after the
        best path to each place: a piece, or -1 after bytes and at the start, where anything may follow.
        """
        if not stretches:
            return {}
        text = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(s) for s in stretches])
        ends = np.cumsum(sizes)
        first = ends - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        start, end, piece = self.arcs.compose(text, np.repeat(ends, sizes))
        # a character that is no piece leads through its bytes
        single = np.zeros(len(text), bool)
        single[start[end - start == 1]] = True
        bare, n = np.flatnonzero(~single), len(self.pieces)
        start, end = np.concatenate([start, bare]), np.concatenate([end, bare + 1])
        piece = np.concatenate([piece.astype(np.int64), np.full(len(bare), n)])
        order = np.argsort(end, kind="stable")  # few runs, each in order
        place = (end - first[of[start]])[order]
        order = order[np.argsort(place.astype(np.uint16) if sizes.max() < 1 << 16 else place, kind="stable")]
        start, end, piece = start[order], end[order], piece[order]
        place = end - first[of[start]]
        # places of a stretch and the one after its last have slots of their own
        slot = lambda at, owner: at + owner
        owner = of[start]
        from_, to = slot(start, owner), slot(end, owner)
        weight = np.full(len(text) + len(sizes), _INF, np.float32)
        weight[slot(first, np.arange(len(sizes)))] = 0.0
        state, back = np.full(len(weight), -1, np.int64), np.full(len(weight), -1, np.int64)
        bounds = np.flatnonzero(np.diff(place, prepend=0, append=place[-1] + 1))
        for a, b in zip(bounds, bounds[1:]):  # noqa: B905
            f, t, p = from_[a:b], to[a:b], piece[a:b]
            own = weight[f] + self.weight[p]
            if self.bpe:
                left = state[f]
                both = np.flatnonzero((left >= 0) & (p < n) & (own < _INF))
                own[both[~self._fits(left[both] * n + p[both])]] = _INF
            new = np.flatnonzero(np.diff(t, prepend=-1))
            least = np.repeat(np.minimum.reduceat(own, new), np.diff(new, append=len(t)))
            best = np.flatnonzero((own == least) & (own < _INF))
            best = best[np.flatnonzero(np.diff(t[best], prepend=-1))]  # of equal weights the first, which is the longest piece
            weight[t[best]], back[t[best]] = own[best], f[best]
            state[t[best]] = np.where(p[best] < n, p[best], -1)
        last = slot(ends, np.arange(len(sizes)))
        if (weight[last] == _INF).any():
            raise AssertionError("a stretch has no path")
        # back from the ends, all stretches at a time
        at, parts = last, []
        live = np.arange(len(sizes))
        while len(live):
            parts.append((live, at))
            at = back[at]
            on = back[at] >= 0
            live, at = live[on], at[on]
        owner, at = (np.concatenate(x) for x in zip(*reversed(parts), strict=True))
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], at[order]
        raw, chars = self.raw, "".join(stretches)
        ids = [raw[i] if i >= 0 else self._bytes(chars[k]) for i, k in zip(state[at].tolist(), (at - owner - 1).tolist(), strict=True)]
        cuts = np.searchsorted(owner, np.arange(len(sizes) + 1)).tolist()
        return {s: b"".join(ids[cuts[k] : cuts[k + 1]]) for k, s in enumerate(stretches)}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [self.stretches(self.normalise(t)) if t else [] for t in texts]
        memo, new = self.memo, set()
        for c in cut:
            new.update(c)
        new.difference_update(memo)
        fresh = self._paths(list(new))
        found = memo | fresh
        if len(memo) < self.remembered:  # those that occur again in these texts
            seen: set[str] = set()
            again = seen.add
            for c in cut:
                for s in c:
                    if s in fresh:
                        if s in seen:
                            memo[s] = fresh[s]
                        else:
                            again(s)
        rows = [b"".join([found[s] for s in c]) for c in cut]
        return rows if min(self.byte_ids) >= 0 else [self._merged(r) for r in rows]

    def _merged(self, row: bytes) -> bytes:
        """Neighbouring unknown characters are one."""
        ids = np.frombuffer(row, np.int32)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Frees the remembered stretches."""
        self.memo.clear()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary the unknown sign."""
        out, n = self.out, len(self.out)
        data = b"".join([out[i] if 0 <= i < n else out[self.unknown] for i in ids])
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_compiled: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer for each model and process."""
    if model not in _compiled:
        _compiled.clear()
        _compiled[model] = Transducer(model)
    return _compiled[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, model: bytes, added: str, kind: str, values: Callable[[Transducer, pa.RecordBatch], Iterator[tuple[int, int, pa.Array]]]) -> DataFrame:
    docs = docs.drop(added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + f"`{added}` {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compiled(shared.value)
        for batch in batches:
            for at, n, column in values(own, batch):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, column], [*batch.schema.names, added])
        own.forget()  # the worker may go on to other work

    return docs.mapInArrow(released(run), schema)


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (array of int), as the SentencePiece library gives them.

    Of paths of exactly equal weight (which only unigram models have) the one with the longest last piece is taken.
    Null counts as empty and has no ids. No piece stands for a control sign, whatever a text says. A column named
    ``ids_col`` is replaced.
    """

    def values(own: Transducer, batch: pa.RecordBatch):
        for at, texts in slices(batch, text_col, _SLICE):
            rows = own.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            yield at, len(texts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return _mapped(docs, model, ids_col, "array<int>", values)


def encode_and_decode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """encode(), and whether decoding gives the text again (null counts as empty), in one pass."""

    def values(own: Transducer, batch: pa.RecordBatch):
        for at, texts in slices(batch, text_col, _SLICE):
            rows = [np.frombuffer(r, np.int32) for r in own.encode_all(texts)]
            same = [own.decode(r.tolist()) == t for r, t in zip(rows, texts, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
            yield at, len(texts), pa.StructArray.from_arrays([ids, pa.array(same)], ["ids", "same"])

    both = "__both"
    out = _mapped(docs.drop(ids_col, same_col), model, both, "struct<ids: array<int>, same: boolean>", values)
    return out.withColumns({ids_col: F.col(f"{both}.ids"), same_col: F.col(f"{both}.same")}).drop(both)


def decode(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for; null ids give an empty text.

    What encode() gave returns as it was, but for BLANK itself, which comes back as a blank. A column named
    ``text_col`` is replaced.
    """

    def values(own: Transducer, batch: pa.RecordBatch):
        column, step = batch.column(ids_col), 1000
        for at in range(0, batch.num_rows, step):
            part = column.slice(at, step)
            yield at, len(part), pa.array([own.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in part], pa.string())

    return _mapped(docs, model, text_col, "string", values)
