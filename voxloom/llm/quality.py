"""Quality by naive Bayes support vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, logistic, mix, released, slices, word_hashes

_PIECE = 1 << 18

#: Kinds of bytes, for n-grams of shapes.
_KIND = np.full(256, 3, np.uint32)  # other signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[i for i in range(128) if chr(i).islower()]] = 1
_KIND[128:] = 1
_KIND[[i for i in range(128) if chr(i).isupper()]] = 2
_KIND[[i for i in range(128) if chr(i).isdigit()]] = 4


def indicators(text: str, buckets: int) -> np.ndarray:
    """The features of a text, sorted: hashed byte trigrams, 5-grams of shapes, and words that follow themselves.

    Long texts are read in pieces that overlap, so all of a text counts.
    """
    data = text.encode("utf-8", "replace")
    seen = np.zeros(buckets, bool)
    for at in range(0, max(len(data) - 2, 1), _PIECE):
        b = np.frombuffer(data, np.uint8, min(_PIECE + 4, len(data) - at), at).astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            seen[((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(buckets)] = True
        if len(b) >= 5:
            k = _KIND[b]
            code = (((k[:-4] * 5 + k[1:-3]) * 5 + k[2:-2]) * 5 + k[3:-1]) * 5 + k[4:]
            seen[(code * np.uint32(2246822519) >> np.uint32(7)) % np.uint32(buckets)] = True
    return np.flatnonzero(seen).astype(np.int32)


def repeats(texts: list[str], buckets: int) -> list[np.ndarray]:
    """For each text, the feature of the share of words that equal one of the two words before, in steps of a fifth."""
    words, offsets = word_hashes([t.lower().encode("utf-8", "replace") for t in texts], SPACES)
    n = np.diff(offsets)
    place = np.arange(len(words)) - np.repeat(offsets[:-1], n)
    again = np.zeros(len(words), bool)
    again[1:] |= (words[1:] == words[:-1]) & (place[1:] >= 1)
    again[2:] |= (words[2:] == words[:-2]) & (place[2:] >= 2)
    run = np.concatenate([[0], np.cumsum(again)])
    share = (run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(n - 1, 1)
    step = np.ceil(np.clip(share, 0, 1) * 5).astype(np.uint64)
    return [np.array([int(s)], np.int32) for s in mix(step + np.uint64(77)) % np.uint64(buckets)]


def features(texts: list[str], buckets: int) -> list[np.ndarray]:
    return [np.unique(np.concatenate([indicators(t, buckets), r])) for t, r in zip(texts, repeats(texts, buckets), strict=True)]


@dataclass
class NaiveBayesSvm:
    weights: np.ndarray  # by bucket, log-count ratios times the hinge-loss model
    squares: np.ndarray  # by bucket, squared log-count ratios
    bias: float
    slope: float = 1.0  # of the logistic that turns margins into probabilities
    shift: float = 0.0

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, buckets: int, cost: float = 1.0, passes: int = 12, seed: int = 7) -> NaiveBayesSvm:
        """Log-count ratios of the indicators, then dual coordinate descent on the scaled rows.

        A fifth of the rows is kept back to turn margins into probabilities.
        """
        y = np.where(labels == 1, 1.0, -1.0)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        back, own = (order[: len(rows) // 5], order[len(rows) // 5 :]) if len(rows) >= 50 else (order, order)
        counts = np.ones((2, buckets))
        for i in own:
            counts[int(y[i] > 0), rows[i]] += 1
        ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float64)

        # a text's row is its ratios, scaled to length 1, and a constant
        norm = np.array([max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows])
        w, bias, alpha = np.zeros(buckets), 0.0, np.zeros(len(rows))
        positives = max((y[own] > 0).mean(), 1e-6)
        bound = np.where(y > 0, cost * 0.5 / positives, cost * 0.5 / max(1 - positives, 1e-6))
        for _ in range(passes):
            for i in rng.permutation(own):
                x, r = ratio[rows[i]] / norm[i], rows[i]
                gradient = y[i] * (w[r] @ x + bias) - 1
                new = min(max(alpha[i] - gradient / 2.0, 0.0), bound[i])  # the row's square length is 2
                if step := (new - alpha[i]) * y[i]:
                    w[r] += step * x
                    bias += step
                    alpha[i] = new
        model = cls(w * ratio, ratio**2, bias)
        margins = np.array([model.margin(rows[i]) for i in back])
        if 0 < (labels[back] == 1).mean() < 1:
            model.slope, model.shift = logistic(np.stack([margins, np.ones(len(margins))], 1), (labels[back] == 1).astype(float))
        return model

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum() / max(np.sqrt(self.squares[row].sum()), 1e-9) + self.bias) if len(row) else self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        m = np.array([self.margin(r) for r in features(texts, len(self.weights))])
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, buckets: int = 1 << 17) -> NaiveBayesSvm | None:
    """The model, from at most ``max_docs`` labelled rows (those whose ids hash lowest, half of each class where
    there are as many); None if a class has no row."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = [known.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for c in ("y = 1", "y <> 1")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for at, rows in slices(batch, "text"):
                found = features(rows, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array((y[at : at + len(rows)] == 1).astype(np.int32))], ["x", "y"])

    got = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("text", "y").mapInArrow(released(extract), "x binary, y int").toArrow()
    y = got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    rows = [np.frombuffer(x.as_py(), np.int32) for x in got["x"]]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].tobytes(), y[i]))  # whatever order the rows came in
    return NaiveBayesSvm.fit([rows[i] for i in order], y[order], buckets)


def score(docs: DataFrame, model: NaiveBayesSvm | None, text_col: str = "text", threshold: float = 0.5, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` and for each whole text a score from 0 to 1 and whether it reaches ``threshold`` (0 or 1).

    Null counts as empty; an empty text has no n-gram and gets the score of the model's constant. Without a model
    all scores are 0. Columns of the same names as the two new ones are replaced.
    """
    docs = docs.drop(score_col, predicted_col)
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + f"`{score_col}` double, `{predicted_col}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows)
            if model is not None:
                for at, texts in slices(batch, text_col):
                    s[at : at + len(texts)] = model.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, score_col, predicted_col])

    return docs.mapInArrow(released(run), out)
