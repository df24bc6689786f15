"""Sharding, URL verdicts, decontamination, SentencePiece and the pipeline."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, sharding, url_filter
from voxloom.llm.queries import PIECE_MODEL, URL_RULES

ODD = [(1, None), (2, ""), (3, "x" * 300000), (None, "a"), (4, "same"), (4, "same")]


# -- sharding


def check_shards(rows, texts, shards):
    assert len(rows) == len(texts)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)


def test_shards_are_near_equal_and_groups_whole(spark):
    rng = np.random.default_rng(0)
    texts = [(i, "t" * int(rng.pareto(1.5) * 200 + 5) + str(i)) for i in range(3000)] + [(10000 + i, "copied text " * 20) for i in range(300)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 8).collect()
    check_shards(rows, texts, 8)
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(load) < 1.1 * np.mean(load) or max(len(t) for _, t in texts) > 0.1 * np.mean(load)
    assert len({r.shard for r in rows if r.doc_id >= 10000}) == 1  # smaller than a shard


def test_a_group_larger_than_a_shard_is_divided(spark):
    texts = [(i, "hot text " * 30) for i in range(900)] + [(1000 + i, f"other {i} " * 30) for i in range(600)]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()
    check_shards(rows, texts, 4)
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    assert max(load) < 1.1 * np.mean(load)


def test_shards_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("key", "bucket", "size", "parts")})
    rows = sharding.shard(df).collect()
    check_shards(rows, ODD, 16)
    assert sharding.shard(df.limit(0)).count() == 0 and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


# -- URLs


def test_host_path_and_rules(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.COM/en/8?q", "https://example.com/en/77", "http://x.net/de/1", "http://a.example.net/de/8#f", "http://x.org", "http://exämple.org/ES/", "http://notexample.com/en/7", "ftp://u:p@h.COM:80/en/x://y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.judge(pages, labels, URL_RULES).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("www.example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[4][2:] == ("net/de/", "allow") and got[5] == ("a.example.net", "/de/8", "example.net/de/8", "block")
    assert got[6] == ("x.org", "", None, "allow") and got[7] == ("exämple.org", "/ES/", None, "allow")
    assert got[8] == ("notexample.com", "/en/7", "com/en/", "block") and got[9][:2] == ("u:p@h.com:80", "/en/x://y")


def test_mined_rules_find_a_planted_condition(spark):
    rng = np.random.default_rng(0)
    urls = [f"http://{rng.choice(['pills', 'shop', 'blog'])}.site.info/{rng.choice(['buy', 'read'])}/{rng.integers(5)}" for _ in range(400)]
    bad = ["pills" in u and "/buy/" in u for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i % 2] + [(None, 0, 0), (1, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels, [], min_confidence=0.9)
    assert [r.verdict == "block" for r in got.orderBy("page_id").collect()] == bad
    assert url_filter.judge(pages.limit(0), labels, []).count() == 0
    twice = url_filter.judge(pages.union(pages), labels, [], min_confidence=0.9)
    assert twice.count() == 800


def apriori(baskets, bad, least, min_confidence, min_lift):
    """Antecedents with their confidence, by hand: size by size from those that are frequent in bad baskets."""
    worst = [b for b, x in zip(baskets, bad, strict=True) if x]
    count = lambda a, rows: sum(a <= r for r in rows)
    level = {frozenset([i]) for b in worst for i in b}
    kept, found = [], {}
    while level:
        level = {a for a in level if count(a, worst) >= least}
        found |= {a: count(a, worst) / count(a, baskets) for a in level}
        level = {a | b for a in level for b in level if len(a | b) == len(a) + 1}
    for a, c in found.items():
        general = [v for g, v in found.items() if g < a]
        if c >= min_confidence and c / (len(worst) / len(baskets)) >= min_lift and all(v < c for v in general):
            kept.append((a, c))
    return kept


@pytest.mark.parametrize("seed", [0, 1])
def test_mined_rules_against_apriori(spark, seed):
    rng = np.random.default_rng(seed)
    urls = []
    for _ in range(300):
        words = [w for w in "abcdef" if rng.random() < 0.4]
        urls.append(f"http://h{rng.integers(3)}.info/{'/'.join(words)}{'/x/y' if 'a' in words else ''}")
    bad = [(("a" in u.split("/")) + ("c" in u.split("/")) + ("h1" in u) + rng.random() * 2) > 2.2 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i % 3], "doc_id long, quality int, toxic int")
    items = [frozenset(r.items_) for r in pages.orderBy("page_id").select(url_filter.tokens(pages.url).alias("items_")).collect()]
    of = [i for i in range(300) if i % 3]
    rules = apriori([items[i] for i in of], [bad[i] for i in of], 10, 0.6, 1.2)
    assert len(rules) > 5 and max(len(a) for a, _ in rules) > 1
    want = [max((c for a, c in rules if a <= b), default=None) for b in items]
    got = url_filter.judge(pages, labels, [], min_lift=1.2).orderBy("page_id").collect()
    assert [r.confidence for r in got] == pytest.approx(want) and [r.verdict == "block" for r in got] == [w is not None for w in want]


def test_rules_of_many_words_that_come_together(spark):
    import time

    path = "/".join(f"word{i}" for i in range(30))
    urls = [f"http://site.org/{path}" for _ in range(60)] + [f"http://other{i % 7}.org/page" for i in range(140)]
    bad = [i % 10 > 0 if i < 60 else i % 20 == 0 for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = url_filter.judge(pages, labels, []).orderBy("page_id").collect()
    assert [r.verdict == "block" for r in got] == [i < 60 for i in range(200)] and time.time() - began < 30


@pytest.mark.parametrize("most", [4096, 0])
def test_rules_of_one_host_leave_those_of_others(spark, most):
    path = "/".join("abcdefghij")  # 13 tokens that stand together: 8,191 rules of confidence 1
    urls = [f"http://evil.bad/{path}" for _ in range(20)] + [f"http://mixed.org/x{i % 2}" for i in range(20)] + [f"http://fine{i % 5}.com/y" for i in range(100)]
    bad = [i < 20 or (i < 40 and i % 5 > 0) for i in range(140)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels, [], max_rules=most).orderBy("page_id").collect()
    assert [r.verdict == "block" for r in got] == [i < 40 for i in range(140)]
    assert all(r.confidence == (1.0 if r.page_id < 20 else 0.8) for r in got[:40])


# -- decontamination


def edit_distance_to_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_against_brute_force(spark):
    rng = np.random.default_rng(2)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(n))
    items = [(i, say(20)) for i in range(6)] + [(6, "tiny one"), (7, None), (8, " ")]
    docs, truth = [], {}
    for i in range(60):
        text, held = say(60), rng.integers(0, 9)
        if held < 6:
            item = list(items[held][1])
            for _ in range(rng.integers(0, 9)):
                at = rng.integers(len(item))
                item[at : at + rng.integers(0, 2)] = rng.choice(list("xyz"), rng.integers(0, 2)).tolist()
            text = text[:40] + " " + "".join(item).upper() + "\n " + text[40:]
        docs.append((i, text))
        norm = decontaminate.normalise(text).decode()
        for j, t in items[:6]:
            d = edit_distance_to_substring(t, norm)
            if d <= decontaminate.budget(len(t), 0.05):
                truth[i, j] = d
    docs.append((60, "this is a TINY  one indeed"))
    docs.append((61, "a tiny onely word"))
    truth[60, 6] = 0
    df = spark.createDataFrame([*docs, (62, None), (63, "")], "doc_id long, text string").withColumn("item_id", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    assert {(r.doc_id, m.item_id): m.distance for r in got for m in r.matches} == truth and len(got) == 64
    assert decontaminate.keep_clean(df, bench).count() == 64 - len({i for i, _ in truth})
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == 64 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_contamination_of_repetitive_texts_in_bounded_memory():
    import resource

    items = [(f"i{k}", "a " * (200 + k)) for k in range(10)] + [("near", "a " * 100 + "b " + "a " * 100), ("short", "tiny one")]
    index = decontaminate.Index.of(items, 0.05)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = index.find("a " * 20000)
    assert [i for i, d, _ in got] == [*(f"i{k}" for k in range(10)), "near"] and got[-1][1] == 1
    assert {i for i, *_ in index.find("a " * 500000 + "tiny one")} == {*(f"i{k}" for k in range(10)), "near", "short"}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kilobytes


def test_contamination_in_many_blocks_and_with_ids_of_any_type(spark):
    rng = np.random.default_rng(8)
    items = [(f"item{i}", " ".join(f"word{rng.integers(500)}" for _ in range(12))) for i in range(9)]
    docs = [(i, f"before {items[i % 9][1]} after {items[(i * 2) % 9][1]}", "kept") for i in range(12)] + [(20, None, None), (20, None, None), (21, "clean", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = {r.doc_id: r.matches for r in decontaminate.matches(df, bench).collect()}
    rows = decontaminate.matches(df, bench, most_chars=100).collect()
    assert len(rows) == len(docs) and {r.doc_id: r.matches for r in rows} == one
    assert {m.item_id for m in one[3]} == {"item3", "item6"} and one[20] == [] and rows[0].asDict().keys() == {"doc_id", "text", "found", "matches"}


# -- SentencePiece

needs_model = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="the vocabulary file isn't here")


@needs_model
def test_encoding_equals_the_library(spark):
    import sentencepiece

    from voxloom.llm.sentencepiece_wfst import decode, encode, encode_and_decode, read_model

    model = read_model(PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = np.random.default_rng(0)
    texts = [None, "", " ", "   a  b ", "\n\n x\t\ty", "<s></s><unk> <0x41>", "日本語テスト😀 hello", "é ﬁ\u00a0", "a" * 3000, " " * 300, "x\x00y", "def f(x):\n    return x**2"]
    texts += ["".join(rng.choice(list("abcdefghijklmnopqrst  .,XYZé1"), 80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("mine"))
    got = decode(encode(df, model), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert r.ids == library.encode(t or "") and r.decoded == (t or "")
    assert encode(df.limit(0), model).count() == 0
    both = encode_and_decode(df, model).orderBy("doc_id").collect()
    assert [r.ids for r in both] == [r.ids for r in got] and all(r.round_trip for r in both)
    assert decode(spark.createDataFrame([(None,), ([5, 99999, -1],)], "ids array<int>"), model).count() == 2


@needs_model
def test_unigram_models_take_the_shortest_path():
    from sentencepiece import sentencepiece_model_pb2 as pb

    from voxloom.llm.sentencepiece_wfst import Transducer

    m = pb.ModelProto()
    for p, s, t in [("<unk>", 0, 2), ("▁", -2, 1), ("▁a", -3, 1), ("ab", -3.5, 1), ("b", -4, 1), ("a", -4, 1), ("▁ab", -9, 1)]:
        m.pieces.add(piece=p, score=s, type=t)
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    m.trainer_spec.model_type = 1
    got = np.frombuffer(Transducer(m.SerializeToString()).encode("ab"), np.int32).tolist()
    assert got == [1, 3]  # "▁" + "ab" costs 5.5, "▁a" + "b" 7, "▁ab" 9


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_unigram_models_with_a_character_map_equal_the_library(seed):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from voxloom.llm.sentencepiece_wfst import Transducer

    rng = np.random.default_rng(seed)
    mapped = pb.ModelProto()
    mapped.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=bool(seed % 2)).serialized_model_proto())
    m = pb.ModelProto()
    m.normalizer_spec.CopyFrom(mapped.normalizer_spec)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, seed < 2
    m.pieces.add(piece="<unk>", score=0, type=2)
    for i in range(256 if seed < 2 else 0):
        m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    for p in {"▁", "a", "f", "é", *("".join(rng.choice(list("▁abcfié"), rng.integers(1, 5))) for _ in range(80))}:
        if "▁" not in p[1:]:
            m.pieces.add(piece=p, score=-float(rng.integers(1000)) / 128 - len(p) / 1000, type=1)
    own, library = Transducer(m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["".join(rng.choice(list("abcfié ﬁ①Ⅳ\u3000e\u0301日😀\t"), rng.integers(0, 40))) for _ in range(400)]
    for t, ids in zip(texts, own.encode_all(texts), strict=True):
        got, want = np.frombuffer(ids, np.int32).tolist(), library.encode(t)
        # of paths of equal weight the library takes one by rounding over the whole text
        weigh = lambda x: sum(-own.fallback if i < 257 else own.weight[i] for i in x)
        assert got == want or (own.decode(got) == own.decode(want) and abs(weigh(got) - weigh(want)) < 1e-3), t


# -- the pipeline


@needs_model
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"{'kalemo'[rng.integers(6)]}{rng.integers(300)}x" for _ in range(n))
    item = say(30)
    texts = [say(80) for _ in range(120)]
    texts += [texts[0], texts[1].replace(" ", "\n", 1), say(20) + "\n" + item + "\n" + say(20)]
    toxic = {i for i in range(0, 120, 5)}
    texts = [" ".join(w for x in t.split(" ") for w in ([x, "vile"] if i in toxic and rng.random() < 0.1 else [x])) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept
    assert 122 not in kept and {500, 501} <= kept and len(kept & toxic) <= 2 and len(kept) >= 90
