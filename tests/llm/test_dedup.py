"""Exact, line and near de-duplication against brute force, and what odd rows give."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import near_dedup
from voxloom.llm.exact_dedup import exact_dedup
from voxloom.llm import line_dedup
from voxloom.llm.common import SPACES, word_hashes
from voxloom.llm.line_dedup import dedup_lines, half_keys, neighbourhoods, within, within_one
from voxloom.llm.near_dedup import keep_one, least_matches, near_join

SCHEMA = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", None), (3, "   \n ", "en"), (None, "a b c d e f g", "en"), (4, "a b c d e f g", "en"), (4, "a b c d e f g", "en"), (5, "word " * 40000, "en"), (6, "x", "de")]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n):
    return [f"w{rng.integers(400)}" for _ in range(n)]


def corpus(seed=0, n=60):
    """Texts with copies, near copies and shared lines."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        kind = rng.integers(4)
        if out and kind == 0:
            out.append(out[rng.integers(len(out))])
        elif out and kind == 1:
            w = out[rng.integers(len(out))].split(" ")
            for _ in range(rng.integers(1, 4)):
                w[rng.integers(len(w))] = "changed"
            out.append(" ".join(w))
        else:
            out.append("\n".join(" ".join(words(rng, rng.integers(3, 40))) for _ in range(rng.integers(1, 5))))
    return [(i, t, "en") for i, t in enumerate(out)]


# -- exact


def test_exact_groups(spark):
    rows = corpus()
    got = exact_dedup(docs(spark, rows), rounds=3).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[rows[r.doc_id][1]]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
        assert r.text_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()


def test_exact_odd_rows(spark):
    got = exact_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = lambda i: [r for r in got if r.doc_id == i]
    assert by(1)[0].keep_id == 2 and not by(1)[0].kept and by(2)[0].kept  # null counts as empty
    assert sum(r.kept for r in by(4)) == 1 and by(4)[0].group_size == 3 and not by(None)[0].kept
    assert exact_dedup(docs(spark, []).limit(0)).count() == 0
    clash = docs(spark, ODD).withColumns({c: F.lit(1) for c in ("digest", "run", "row", "top", "kept")})
    assert exact_dedup(clash).filter("kept").count() == 5


def test_exact_has_no_python(spark):
    plan = exact_dedup(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- lines


def brute_lines(rows, least=10):
    drop, seen, long = Counter(), set(), []
    for i, text, _ in sorted(rows):
        for line in (text or "").split("\n"):
            line = line.strip()
            if not line:
                continue
            w = line.split()
            if line in seen:
                drop[i] += 1
                continue
            seen.add(line)
            if len(w) >= least:
                drop[i] += any(within_one(w, o) for o in long)
                long.append(w)
    return drop


@pytest.mark.parametrize("seed", [0, 1])
def test_lines(spark, seed):
    rows = corpus(seed)
    want = brute_lines(rows)
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    assert {i: r.dropped_lines for i, r in got.items()} == {i: want[i] for i, *_ in rows}
    for i, text, _ in rows:
        assert len(got[i].text.split("\n")) == max(len(text.split("\n")) - want[i], 1)


@pytest.mark.parametrize("few", [64, 1])
def test_line_bound_grows_with_the_line(spark, monkeypatch, few):
    """With keys of one line at most, all pairs come from the rarest tokens."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", 512 if few > 1 else 4)
    monkeypatch.setattr(line_dedup, "KEYS_HELD", 1 << 19 if few > 1 else 200)
    rng = np.random.default_rng(5)
    rows, drop, earlier = [], [], []
    for n in (12, 29, 30, 44, 46, 75, 200, 4, 6, 8):
        for edits in (0, 1, 2, 3, 5, 13, 14):
            if edits == 0:
                base = words(rng, n) if n >= 10 else list("".join(f"{rng.integers(10**9)}" for _ in range(n)))
            own = list(base)
            for at in sorted(rng.permutation(len(own))[:edits], reverse=True):
                own[at : at + 1] = [["new"], [], [own[at], "more"]][rng.integers(3)] if n >= 10 else ["x"]
            line = (" " if n >= 10 else "").join(own)
            own = own if n >= 10 else list(line)
            per = 15 if n >= 10 else 20

            def distance(a, b):
                last = list(range(len(b) + 1))
                for i, x in enumerate(a, 1):
                    now = [i]
                    for j, y in enumerate(b, 1):
                        now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
                    last = now
                return last[-1]

            near = [w for p, w in earlier if p == per and abs(len(w) - len(own)) <= 14]
            bounds = [(max(1, min(len(w), len(own)) // per), w) for w in near if min(len(w), len(own)) >= (10 if per == 15 else 20)]
            hit = False
            for most, w in bounds:
                close = distance(w, own) <= most
                assert within(w, own, most) == close
                hit |= close
            rows.append((len(rows), line, "en"))
            drop.append(int(hit or any(w == own for _, w in earlier)))
            earlier.append((per, own))
    got = {r.doc_id: r.dropped_lines for r in dedup_lines(docs(spark, rows), words_per_edit=15, chars_per_edit=20).collect()}
    assert [got[i] for i in range(len(rows))] == drop
    old = {r.doc_id: r.dropped_lines for r in dedup_lines(docs(spark, rows)).collect()}
    assert sum(drop) > sum(old.values()) + 10


def test_settled_lines_of_a_token_do_not_meet(spark):
    """Each open line meets each line of its token in one pair of blocks; lines are not copied for lines that are settled."""
    rows = [(t, i, i % 50 == t) for t in (1, 2) for i in range(300)] + [(3, i, False) for i in range(300)]
    dealt = line_dedup.against(spark.createDataFrame(rows, "token long, node long, open boolean"), 10).collect()
    met = Counter()
    for t, lo, hi in {(r.token, r.lo, r.hi) for r in dealt}:
        own = [r for r in dealt if (r.token, r.lo, r.hi) == (t, lo, hi)]
        met.update((t, a.node, b.node) for a in own if a.left for b in own if not b.left)
    assert met == Counter((t, i, j) for t, i, open_ in rows if open_ for j in range(300))
    assert len(dealt) == 2 * (300 + 6 * 30)  # with all pairs of blocks it would be 30 times 900


def test_places_of_equal_lines(spark):
    """Rows are numbered in the order of their ids whatever the type, and of equal lines the earliest place stays."""
    rows = [("b", "x y\nz"), ("a", "z\nx y\nz"), (None, "z"), ("c", "q\nx y\n\nq"), ("a", "z\nx y\nz")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()
    want = [(None, "z", 0), ("a", "", 3), ("a", "x y", 2), ("b", "", 2), ("c", "q\n", 2)]
    assert sorted((r.doc_id or "", r.text, r.dropped_lines) for r in got) == sorted((i or "", t, n) for i, t, n in want)


def test_line_odd_rows(spark):
    rows = [r for r in ODD if r[0] is not None] + [(7, "a\n\nx\n", "en"), (8, "one two three four five six seven eight nine ten", "en"), (9, "one two three four FIVE six seven eight nine ten", "en"), (10, "one two three four six seven eight nine ten eleven twelve", "en")]
    got = dedup_lines(docs(spark, rows).withColumns({c: F.lit(0) for c in ("row", "line", "lines", "wanted")})).collect()
    text = {r.doc_id: r.text for r in got}
    assert text[1] is None and text[2] == "" and text[3] == "   \n "
    assert text[7] == "a\n\n" and text[9] == "" and text[10] != "" and "wanted" in got[0].asDict()
    assert sorted((r.text, r.dropped_lines) for r in got if r.doc_id == 4) == [("", 1), ("a b c d e f g", 0)]  # of repeated rows one is the first
    assert dedup_lines(docs(spark, rows).limit(0)).count() == 0


def word_codes(w):
    return word_hashes([" ".join(w).encode()], SPACES)[0]


def test_neighbourhoods_meet_within_one_edit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = words(rng, 12)
        b, at = list(a), rng.integers(12)
        kind = rng.integers(3)
        if kind == 0:
            b[at] = "new"
        elif kind == 1:
            del b[at]
        else:
            b.insert(at, "new")
        keys = [set(half_keys(word_codes(w), np.array([0, len(w)]), False)[1].tolist()) for w in (a, b)]
        assert within_one(a, b) and keys[0] & keys[1]
        both = neighbourhoods(word_codes(a + b), np.array([0, len(a), len(a) + len(b)]))
        (x, *xs), (y, *ys) = both[: len(a) + 1], both[len(a) + 1 :]
        assert (kind == 0 and xs[at] == ys[at]) or (kind == 1 and y == xs[at]) or (kind == 2 and x == ys[at])
    assert not within_one(["a", "b"], ["b", "a"])


# -- near copies


def brute_classes(rows, threshold=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, _ in rows]
    parent, links = list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (least[root(i)], links[i]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [256, 4])
def test_near_classes(spark, block):
    """With blocks of 4 nodes, groups and clusters are dealt over many pairs of blocks."""
    rng = np.random.default_rng(9)
    base = words(rng, 120)
    rows = corpus(5)
    for k in range(25):  # a large group of near copies
        w = list(base)
        w[rng.integers(len(w))] = f"new{k}"
        rows.append((100 + k, " ".join(w), "en"))
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.links) for r in near_join(docs(spark, rows), block=block).collect()}
    assert got == want
    assert keep_one(docs(spark, rows)).count() == len({c for c, _ in want.values()})


def test_near_odd_rows(spark):
    got = near_join(docs(spark, ODD).withColumns({c: F.lit(0) for c in ("row", "key", "node", "band", "sig", "kept", "links")})).collect()
    assert len(got) == len(ODD)
    by = lambda i: [r for r in got if r.doc_id == i]
    assert all(by(i)[0].class_id == i and by(i)[0].kept for i in (1, 2, 3, 5, 6))
    assert by(4)[0].links == 2 and by(4)[0].class_size == 3 and sum(r.kept for r in [*by(4), *by(None)]) == 1
    assert near_join(docs(spark, []).limit(0)).count() == 0


def test_blank_repeated_rows_stay(spark):
    blank = [(2, "", "en"), (2, "", "en")]
    assert keep_one(docs(spark, blank)).count() == 2
    both = keep_one(docs(spark, [*blank, (3, "a b c d e f", "en"), (3, "a b c d e f", "en"), (3, "a b c d e f", "de")])).collect()
    assert sorted(r.doc_id for r in both) == [2, 2, 3]


def test_pruning_bounds():
    least = least_matches(100, 10, 0.8, 1e-3)
    assert list(least) == list(range(10, 101, 10)) and sorted(least.values()) == list(least.values())
    assert 55 < least[100] < 75  # 80 matches are expected at the threshold


def test_shared_sizes():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(7)]
    got = near_dedup._shared(sets)
    assert (got == [[len(np.intersect1d(a, b)) if a is not b else got[i, i] for b in sets] for i, a in enumerate(sets)]).all()


def test_run_keys_are_made_of_long_lines_alone(monkeypatch):
    asked, real = [], line_dedup.run_keys
    monkeypatch.setattr(line_dedup, "run_keys", lambda codes, offsets, *a: asked.extend(np.diff(offsets).tolist()) or real(codes, offsets, *a))
    text = "\n".join(" ".join(f"w{i}" for i in range(n)) for n in (12, 29, 30, 45))
    made = list(line_dedup._keys(10, 15, None, 4)(iter([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])))
    keys = np.concatenate([line_dedup.entries(b, "keys") for b in made])
    assert sorted(asked) == [30, 45] and (keys & 1 == 0).sum() == 16 and (keys & 1 == 1).any()
