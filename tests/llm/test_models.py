"""Toxicity, quality and language: held-out accuracy on planted data, and what odd rows give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import language_id, quality, toxicity
from voxloom.llm.common import LETTERS, SPACES, logistic, word_hashes

ODD = [(1, None), (2, ""), (3, "\n\t "), (4, "ab " * 300000), (5, "ab"), (5, "ab"), (None, "¡¿ 12 ?")]


def planted(spark, n=500, seed=0):
    """Ordinary words, with a rude one in toxic texts and signs or shouting in bad ones."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"{'kalemo'[rng.integers(6)]}{'nitusa'[rng.integers(6)]}{rng.integers(60)}x" for _ in range(rng.integers(30, 200))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        for _ in range(toxic * rng.integers(2, 6)):
            w.insert(rng.integers(len(w)), ("vile", "rotten", "filthy")[rng.integers(3)])
        text = " ".join(w)
        if not good:
            text = text.upper() if rng.random() < 0.5 else text.replace(" ", "### ")
        rows.append((i, text))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(rows, label):
    pos, neg = ([r.score for r in rows if r[label] == v] for v in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize("module,label,threshold", [(toxicity, "toxic", 0.3), (quality, "quality", 0.5)])
def test_held_out(spark, module, label, threshold):
    docs, labels = planted(spark)
    test = F.col("doc_id") % 4 == 0
    model = module.fit(docs, labels.filter(~test))
    rows = module.score(docs.filter(test), model).join(labels, "doc_id").collect()
    assert auc(rows, label) > 0.95
    assert all(r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    again = module.score(docs.filter(test).repartition(5), module.fit(docs.repartition(7), labels.filter(~test))).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in rows}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    docs, labels = planted(spark, 120)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("mine"), "y": F.lit(0)})
    got = module.score(odd, module.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (0, None, None)], labels.schema)))).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    assert module.fit(docs, labels.limit(0)) is None and module.fit(docs.limit(0), labels) is None
    assert module.fit(docs, labels.withColumns({"toxic": F.lit(1), "quality": F.lit(1)})) is None
    assert {r.score for r in module.score(odd, None).collect()} == {0.0} and module.score(odd.limit(0), None).count() == 0


def test_kneser_ney_is_a_distribution():
    import pyarrow as pa

    texts = ["a b a c", "a b b a", "c a b a"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array([1, 0, 1], pa.int32())})
    counts = pa.Table.from_batches(list(toxicity._count(iter([batch]))))
    words = counts.filter(pa.compute.equal(counts["kind"], 1))
    after = {w: sum(1 for k, b in zip(counts["kind"].to_pylist(), counts["b"].to_pylist()) if k == 2 and b == w) for w in words["a"].to_pylist()}
    shared = pa.table({"kind": pa.array([3] * len(after), pa.int8()), "a": list(after), "b": [0] * len(after), "toxic": list(after.values()), "plain": [0] * len(after), "texts": [0] * len(after)}, schema=counts.schema)
    model = toxicity.KneserNey.fit(pa.concat_tables([counts, shared]), 0.75)
    np.testing.assert_allclose(model.unigram.sum(1), 1)
    v = len(model.words)
    for c in (0, 1):  # after a known word: the bonus of its bigrams plus the backoff make 1
        for i, w in enumerate(model.words):
            bonus = sum(model.bonus[c, j] for j, k in enumerate(model.bigrams) if any(toxicity._bigram(np.array([w]), np.array([x]))[0] == k for x in model.words))
            assert bonus + model.backoff[c, i] == pytest.approx(1)
    assert v == 3


def test_toxicity_counts_all_labelled_texts(spark):
    """3,000 toxic and 4,500 plain texts, one word in 600 of the toxic ones; copies count once."""
    rows = [(i, "common " + "vile " * (i % 5 == 0) + f"x{i}", 1) for i in range(3000)] + [(i, f"common y{i}", 0) for i in range(3000, 7500)]
    rows += [(i + 10000, *r) for i, (_, *r) in enumerate(rows[:40])] + [rows[0]]
    every = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(every.select("doc_id", "text"), every.select("doc_id", "toxic"))
    assert model.share == 3000 / 7500
    own = np.array([600 - 0.75, 3000 - 0.75]) / 3600
    np.testing.assert_allclose(sorted(model.unigram[0, :2]), own + (1 - own.sum()) * 1.5 / 3.5, rtol=1e-12)


def test_toxicity_calibration_is_a_logistic_over_all_rows(spark):
    rng = np.random.default_rng(1)
    zones = len(toxicity._ZONES)
    y = (rng.random(400) < 0.3).astype(float)
    x = rng.normal(size=(400, zones, 2)) * [3, 0.2] + y[:, None, None] * np.linspace(0, 1, zones)[None, :, None]
    packed = [(bytearray(np.concatenate([y[at : at + 90, None], x[at : at + 90].reshape(len(y[at : at + 90]), -1)], 1).tobytes()),) for at in range(0, 400, 90)]
    model = toxicity.KneserNey(*[np.zeros(0)] * 6)
    toxicity._calibrate(model, spark.createDataFrame(packed, "rows binary"))
    losses = []
    for k in range(zones):
        z = np.concatenate([x[:, k], np.ones((400, 1))], 1)
        w = logistic(z, y)
        losses.append((np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).mean(), k, w))
    _, best, w = min(losses, key=lambda v: v[:2])
    assert model.zone == toxicity._ZONES[best] and model.share == y.mean()
    np.testing.assert_allclose(model.weights, w, rtol=1e-6)


def test_languages(spark):
    rng = np.random.default_rng(0)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["eau", "oi", "é"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(rng.integers(5, 60))), lang) for i in range(300) for lang in [list(syllables)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.fit(docs.filter("doc_id % 5 <> 0"))
    got = language_id.identify(docs.filter("doc_id % 5 = 0"), profiles).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    odd = language_id.identify(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang_pred", F.lit(1)), profiles).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, None)} == {"und"} and all(r.lang_pred != "und" for r in odd if r.doc_id in (4, 5))
    nothing = language_id.fit(docs.limit(0))
    assert language_id.identify(docs.limit(2), nothing).first().lang_pred == "und"


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = "Das Haus, 12 ÄÖ! " * 40
    whole = language_id.grams(text)
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 7)
    for a, b in zip(whole, language_id.grams(text)):
        np.testing.assert_array_equal(a, b)


@pytest.mark.parametrize("inside", [LETTERS, SPACES])
def test_word_hashes_do_not_depend_on_batches_or_pieces(monkeypatch, inside):
    from voxloom.llm import common

    texts = [b"", b"one two  three", b"two", "größe x,y".encode(), b"a" * 50 + b" b", b" "]
    h, o = word_hashes(texts, inside)
    alone = [word_hashes([t], inside)[0] for t in texts]
    assert (np.diff(o) == [len(a) for a in alone]).all()
    np.testing.assert_array_equal(h, np.concatenate(alone))
    assert h[o[2]] == h[o[1] + 1]
    monkeypatch.setattr(common, "CHUNK_BYTES", 8)
    np.testing.assert_array_equal(word_hashes(texts, inside)[0], h)
