"""Vector search, ranking and spelling variants against brute force, with awkward rows."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import nearest, ranking, spelling

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, every=20, k=20):
    whole = [(i, key, [math.floor(64 * np.float32(x).item()) for x in v]) for i, (key, v) in enumerate(rows)
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, q in whole:
        if key is None or key % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c)), other is None, other or 0, other) for j, other, c in whole if j != i)
        out += [(key, rank + 1, f[3], -f[0]) for rank, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def run_top(spark, rows, **options):
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], VECTORS)
    for name in ("key", "vector", "no", "rank", "score", "query"):
        df = df.withColumn(name, F.lit(1))
    return sorted(map(tuple, nearest.top_k(df, **options).collect()), key=repr)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, .2) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, centres[0]) for i in range(60)]  # one vector many times, queries among them
    rows += [(i, centres[1]) for i in range(200, 211)]  # keys that repeat
    assert run_top(spark, rows, block=64, queries=8) == brute_top(rows)


def test_top_k_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]),
            (80, [float("inf"), 1.0]), (100, []), (120, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (-20, [-1.0, .5]), (3, [0.0, 0.0])]
    assert run_top(spark, rows, k=4) == brute_top(rows, k=4)
    assert run_top(spark, []) == []
    assert run_top(spark, [(20, [1.0])]) == []


def test_top_k_past_exact_doubles(spark):
    big = [(i, [float(2 ** (20 + i % 5)), float(i), -float(2 ** 21)]) for i in range(40)]
    assert run_top(spark, big, k=5) == brute_top(big, k=5)
    # Sums past a long take its end and tie there.
    huge = [(i, [1e12 * (1 + i % 3), 1.0]) for i in range(30)]
    got = run_top(spark, huge, k=3)
    assert [r[2] for r in sorted(got)] == [1, 2, 3, 0, 1, 2] and {r[3] for r in got} == {2 ** 63 - 1}


def test_bounds_leave_nothing_out():
    rng = np.random.default_rng(1)
    c, q = rng.integers(-50, 50, (300, 8)), rng.integers(-50, 50, (20, 8))
    pivots = nearest.choose_pivots(c, 6)
    far = lambda x: nearest.distances(x, pivots)
    ones = np.ones(len(c), int)
    at, to, score = nearest.search(q, far(q), far(q)[:, 0] ** 2, np.full(20, -10 ** 9), c, far(c), far(c)[:, 0] ** 2, ones, 5)
    for i in range(20):
        assert sorted(score[at == i])[-5:] == sorted((c @ q[i]).tolist())[-5:]


def test_queries_meet_candidates_together(monkeypatch):
    calls, plain = [], nearest.scores
    monkeypatch.setattr(nearest, "scores", lambda q, c: calls.append(len(q)) or plain(q, c))
    rng = np.random.default_rng(5)
    c = rng.integers(-2 ** 30, 2 ** 30, (300, 8))  # products past exact doubles, so all go through scores
    q, copies = c[:50], rng.integers(1, 4, 300)
    pivots = nearest.choose_pivots(c, 6)
    far = lambda x: nearest.distances(x, pivots)
    lowest = np.full(50, -2 ** 63)
    at, to, score = nearest.search(q, far(q), far(q)[:, 0] ** 2, lowest, c, far(c), far(c)[:, 0] ** 2, copies, 5)
    worst = nearest.kth_scores(plain(q, c), copies, 5)
    want = {(i, j) for i, j in zip(*np.nonzero(plain(q, c) >= worst[:, None]))}
    assert set(zip(at.tolist(), to.tolist())) == want
    assert (score == plain(q, c)[at, to]).all()
    assert len(calls) < 10 and (lowest == -2 ** 63).all()


def words_of(text):
    return [w.decode() for w in ranking.text_terms(text)]


def brute_ranked(docs, items, k=10):
    docs = [(key, words_of(t)) for key, t in docs]
    docs = [(key, w) for key, w in docs if w]
    total, length = len(docs), sum(len(w) for _, w in docs)
    bags = [(key, len(w), Counter(w)) for key, w in docs]
    out = []
    for name, text in items:
        found = []
        for key, n, bag in bags:
            score = 0
            for t in set(words_of(text)):
                df = sum(t in other for _, _, other in bags)
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
                    score += w * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * (10 + 90 * n * total // length)))
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(name, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run_ranked(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n", F.lit(2))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("x"))
    return sorted(map(tuple, ranking.ranked(d, i, **options).collect()), key=repr)


def texts(rng, n):
    vocabulary = ["und", "the", "Rare", "naïve", "x1", "42", "ÉTÉ", "foo", "bar", "baz"] + [f"w{i}" for i in range(40)]
    return [rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("shard, block, lookup", [(8192, 1024, 100_000), (16, 3, 100_000), (50, 1024, 0)])
def test_ranked_equals_brute_force(spark, monkeypatch, shard, block, lookup):
    monkeypatch.setattr(ranking, "LOOKUP_TERMS", lookup)
    rng = random.Random(2)
    docs = list(enumerate(texts(rng, 150))) + [(1000 + i, "foo bar foo") for i in range(30)]
    docs += [(None, "foo rare"), (7, "the the the"), (7, "the the the"), (5000, None), (5001, "  "), (5002, "foo " * 50_000)]
    items = list(enumerate(texts(rng, 12))) + [(50, None), (51, "nothing here matches"), (None, "foo"), (0, "foo rare")]
    assert run_ranked(spark, docs, items, shard=shard, block=block) == brute_ranked(docs, items)


def test_ranked_empty_tables(spark):
    assert run_ranked(spark, [], [(1, "a")]) == [] == run_ranked(spark, [(1, "a")], []) == run_ranked(spark, [(1, None)], [(1, "a")])


def test_treap_equals_sums():
    rng = np.random.default_rng(3)
    for _ in range(20):
        grid = rng.integers(0, 4, (rng.integers(1, 9), rng.integers(1, 40)))
        rows, columns = np.nonzero(grid)
        if not len(rows):
            continue
        treap = ranking.Treap(rows, columns, grid[rows, columns].astype(np.int64))
        asked = np.unique(rng.integers(0, grid.shape[0], 4))
        at, found = treap.top(asked, 5, at_once=3)
        sums = grid[asked].sum(axis=0)
        want = sorted((-s, c) for c, s in enumerate(sums.tolist()) if s)[:5]
        assert [(-s, c) for c, s in zip(at.tolist(), found.tolist())] == want


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    out = {}
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(close, default=None)
        out[w] = [best[1] if best and -best[0] >= ratio * n else None, n, len(close)]
    rows = []
    for w, (form, n, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, count, words.get(form)))
    return sorted(rows)


def test_variants_equal_brute_force(spark):
    rng = random.Random(9)
    words = {}
    for _ in range(250):
        words["".join(rng.choices("abé", k=rng.randint(3, 6)))] = rng.choice([1, 2, 5, 6, 25, 30, 150, 800])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).collect())) == brute_variants(words)
    pairs = sorted((r.word, r.near) for r in spelling.neighbours(df).collect())
    assert pairs == sorted((a, b) for a in words for b in words if near(a, b))


def test_vocabulary_equals_restatement(spark):
    import re
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["Älteren", "garçons", "abcdefg", "running", "ABCDEFG", "x" * 3, "été÷été"], k=40))) for i in range(60)]
    docs += [(3, None), (4, ""), (None, "running " * 300), (5, "running"), (5, "running"), (6, "longest" * 20_000)]
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(1))
    assert {r.word: r.n for r in spelling.vocabulary(df, damage=7).collect()} == want


def test_damaged_runs_that_become_other_runs():
    # Under key 34406 both runs are damaged, and the longer becomes the shorter.
    got = spelling.text_words(34406, "aaaaaaaa " * 5 + "aaaaaaa " * 6, spelling.DAMAGE)
    assert got == {b"a" * 7: 5, b"a" * 6: 6}


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
