"""Language identification by rank-order profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, released, slices

_GAP = 0x20
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """By code point, made once in each process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 to 3 letters of the lower-cased text, words bounded by gaps) and their counts.

    A code holds up to three code points of 21 bits, so it stands for one n-gram only. Long texts are counted in
    pieces that overlap by two letters.
    """
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    low = text.lower()
    for at in range(0, len(low), CHUNK_BYTES):
        from_ = max(at - 2, 0)
        c = np.frombuffer(low[from_ : at + CHUNK_BYTES].encode("utf-32-le", "replace"), np.uint32)
        c = np.where(_is_letter()[c], c, _GAP).astype(np.int64)
        new = at - from_  # what is left of this index has been counted
        if at == 0:
            c = np.concatenate([[_GAP], c])
            new = 1
        if at + CHUNK_BYTES >= len(low):
            c = np.concatenate([c, [_GAP]])
        two, three = (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        one = c[new:]
        two, three = two[max(new - 1, 0) :], three[max(new - 2, 0) :]
        gap = lambda x: x == _GAP
        one = one[~gap(one)]
        two = two[~(gap(two >> 21) & gap(two & 0x1FFFFF))]
        three = three[~gap((three >> 21) & 0x1FFFFF)]
        u, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        codes.append(u)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, i = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(i, np.concatenate(counts), len(u)).astype(np.int64)


@dataclass
class Profiles:
    langs: list[str]
    codes: np.ndarray  # sorted; all n-grams of any profile
    ranks: np.ndarray  # [langs, codes + 1]; ``size`` where a profile lacks the n-gram
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        langs = sorted({r[0] for r in rows})
        codes = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(langs), len(codes) + 1), size)
        for lang, code, rank in rows:
            ranks[langs.index(lang), np.searchsorted(codes, code)] = rank
        return cls(langs, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest profile (of equally near ones the first by name) and its margin.

        The distance is the sum of the differences in rank of the text's most frequent n-grams; an n-gram that a
        profile lacks counts ``size``. The score is how much nearer the profile is than the next: 1 - d1 / d2,
        raised by the share of the largest distance that it stays below.
        """
        codes, counts = grams(text or "")
        if not len(codes) or not self.langs:
            return "und", 0.0
        if len(codes) > self.size:
            least = np.partition(counts, -self.size)[-self.size]
            top = counts >= least
            codes, counts = codes[top], counts[top]
        top = np.lexsort((codes, -counts))[: self.size]
        codes = codes[top]
        i = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        i[self.codes[i] != codes] = len(self.codes)
        ranks = self.ranks[:, i]
        out = np.where(ranks < self.size, np.abs(ranks - np.arange(len(codes))), self.size).sum(1)
        best = int(out.argmin())
        near = 1 - out[best] / (self.size * len(codes))
        margin = 1 - out[best] / max(np.delete(out, best).min(), 1) if len(out) > 1 else 1.0
        return self.langs[best], float(min(max(near + (1 - near) * margin, 0.0), 1.0))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_lang: int = 1500, profile: int = 300) -> Profiles:
    """Profiles of the ``profile`` most frequent n-grams of each language.

    N-grams are counted over a bounded sample of labelled rows: of each language those whose ids hash below
    ``docs_per_lang`` over the language's number of rows.
    """
    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id")).filter("text is not null and lang is not null")
    rate = known.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count(F.lit(1))).alias("rate"))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = known.join(F.broadcast(rate), "lang").filter(own < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in slices(batch, "text"):
                for lang in sorted(set(langs[at : at + len(texts)])):
                    got = [grams(t) for t, x in zip(texts, langs[at : at + len(texts)], strict=True) if x == lang]
                    u, i = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                    n = np.bincount(i, np.concatenate([n for _, n in got]), len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u), pa.array(n)], ["lang", "code", "n"])

    sums = sample.mapInArrow(released(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    rows = sums.withColumn("rank", rank).filter(F.col("rank") < profile).select("lang", "code", "rank").collect()
    return Profiles.of([tuple(r) for r in rows], profile)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` and for each whole text the predicted language and a score from 0 to 1.

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned. Columns of the
    same names as the two new ones are replaced.
    """
    docs = docs.drop(pred_col, score_col)
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + f"`{pred_col}` string, `{score_col}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(t) for _, texts in slices(batch, text_col) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(released(run), out)
