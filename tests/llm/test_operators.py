"""Each training-data operator beside a brute-force version on small inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import (bpe, chats, lines, mixing, pages, passages, quality, simhash,
                          sketches, urls)
from postsift.llm.common import components, run_hashes, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [
        (300 + i, 301 + i) for i in range(40)] + [(500, 500)]
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got}
    assert set(root) - set(got) <= {500, *(a for a, b in edges if a == b)}


@pytest.mark.parametrize("length", [1, 2, 5, 7, 8])
def test_run_hashes_tell_runs_apart(spark, length):
    random.seed(length)
    rows = [([random.randrange(3) for _ in range(n)],) for n in range(12)]
    df = run_hashes(spark.createDataFrame(rows, "h array<long>"), "h", length, "r")
    seen = {}
    for r in df.collect():
        runs = [tuple(r.h[i:i + length]) for i in range(len(r.h) - length + 1)]
        assert len(r.r) == len(runs)
        for run, value in zip(runs, r.r):
            assert seen.setdefault(run, value) == value
    assert len(set(seen.values())) == len(seen)


# Mixing

def water_level(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > cap * sizes[s]}
        if not full:
            return goal | {s: unit * weight[s] for s in free}
        goal |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return goal


def test_mixing_meets_targets_exactly(docs):
    rows = mixing.report(docs.withColumn("source", F.nullif("source", F.lit("src3")))).collect()
    sources = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = None if sources[r.doc_id] == "src3" else sources[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = water_level(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= .5


def test_mixing_does_not_depend_on_partitions(docs):
    def got(df):
        return sorted((r.doc_id, r.taken) for r in mixing.report(df).collect())
    assert got(docs.repartition(1)) == got(docs.repartition(7, "lang"))


def test_mixed_documents_hold_the_words_taken(docs, texts):
    options = {"block_words": 64, "shard_slots": 16}
    taken = {r.doc_id: r.taken for r in mixing.report(docs, **options).collect()}
    mixed = Counter()
    for r in mixing.mix_documents(docs, order=("doc_id",), **options).collect():
        words = WORDS.findall(r.text)
        mixed[r.doc_id] += len(words)
        assert r.text in texts[r.doc_id]
    assert sum(mixed.values()) == sum(taken.values())


# Sketches

def test_sketches_against_python(docs, texts):
    rows = {r.doc_id: r for r in sketches.compare_with_edits(docs).collect()}
    order = sorted(texts)
    misses = []

    def shingles(t):
        w = WORDS.findall(t)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        if min(len(a), len(b)) > 200:
            misses.append(abs(rows[i].near_edited - len(a & b) / min(len(a), len(b))))
    assert np.mean(misses) < .08
    same = defaultdict(set)
    for i in order:
        same[texts[i]].add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in same.values())


# Tokens

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library(vocabulary):
    from tokenizers import Tokenizer
    library, own = Tokenizer.from_file(vocabulary), bpe.Encoder(bpe.read_vocabulary(vocabulary))
    random.seed(8)
    tokens = [b.decode("utf-8", "ignore") for b in own.bytes.values()]
    cases = ["", " ", "  a", "a  ", "aaaa" * 40, "x <|endoftext|>y", "don't I'LL 'sll", "\n\n x\t  y",
             "日本語 😀😀", "a\x1cb \x85 c", "x" * 3000]
    cases += ["".join(random.choice("abent \n't1.é!") for _ in range(30)) for _ in range(1500)]
    cases += ["".join(random.choice(tokens) for _ in range(6)) for _ in range(1500)]
    cases += ["".join(chr(random.randint(1, 0xD7FF)) for _ in range(12)) for _ in range(500)]
    for case in cases:
        want = library.encode(case, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(case), "<i4")
        assert got.tolist() == want, case
        assert own.decode(got, np.array([0, len(got)])) == [library.decode(want, skip_special_tokens=False)]


def test_invalid_ids_decode_as_the_library(spark, vocabulary):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary)
    random.seed(2)
    rows = [([random.randrange(50257) for _ in range(9)],) for _ in range(300)]
    tokenizer = bpe.Tokenizer(spark, vocabulary)
    df = spark.createDataFrame(rows, "ids array<int>").select("ids", tokenizer.decode("ids").alias("t"))
    for r in df.collect():
        assert r.t == library.decode(r.ids, skip_special_tokens=False)


# SimHash

def slow_print(text):
    from xxhash import xxh64_intdigest
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values):
    f = np.array(values, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    label = np.arange(len(f))
    while True:
        new = np.array([label[row].min() for row in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def test_near_duplicates_against_all_pairs(docs, texts):
    ids = sorted(texts)
    prints = [slow_print(texts[i]) for i in ids]
    root = linked(prints)
    for r in simhash.near_duplicates(docs).collect():
        k = ids.index(r.doc_id)
        assert r.fp & (1 << 64) - 1 == prints[k]
        assert r.component == ids[root[k]]
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {ids[k] for k in set(root)}


@pytest.mark.parametrize("limit", [20_000, 6])
def test_trie_walk_with_a_dense_cluster(spark, limit):
    random.seed(3)
    values = {random.getrandbits(64) for _ in range(100)} | {0, 1, 3, 7, 15, 2 ** 64 - 1}
    for base in list(values)[:2]:
        for _ in range(150):
            x = base
            for _ in range(random.randint(0, 3)):
                x ^= 1 << random.randrange(64)
            values.add(x)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    root = linked(sorted(values))
    low = {}
    for r, v in zip(root, signed):
        low[r] = min(low.get(r, v), v)
    df = spark.createDataFrame([(v, v) for v in signed], "key long, fp long")
    got = {r.fp: r.component for r in simhash.classes(df, limit=limit).collect()}
    assert got == {v: low[r] for r, v in zip(root, signed)}


# Quality

def test_measures_against_python(docs, texts):
    for r in quality.measure(docs).select("row.doc_id", *quality.MEASURES).collect():
        text = texts[r.doc_id]
        words, rows = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
        runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        held = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(rows) - len(set(rows))
        assert r.n_repeat_words == len(held)


def test_kept_documents_agree_with_labels(spark, sf_dir, docs):
    kept = quality.keep_good(docs).select("doc_id").withColumn("kept", F.lit(1))
    labels = table(spark, sf_dir, "labels").join(kept, "doc_id", "left").fillna(0, ["kept"]).collect()
    measured = {r.doc_id: r.n_words for r in quality.measure(docs).select("row.doc_id", "n_words").collect()}
    judged = [r for r in labels if measured[r.doc_id] >= 20]
    right = sum(r.kept == r.quality for r in judged)
    assert right / len(judged) > .95
    assert sum(r.quality and not r.kept for r in judged) / len(judged) < .02


# URLs

@pytest.mark.parametrize("url, want", [
    ("https://A.Example.ORG/es/1?x=/en", ("a.example.org", "/es/1", "example.org/es/", "block")),
    ("http://example.org/en/12#top", ("example.org", "/en/12", "example.org/en/1", "block")),
    ("http://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
    ("http://badexample.org/es/1", ("badexample.org", "/es/1", "org/", "allow")),
    ("http://x.com/de/", ("x.com", "/de/", "com/de/", "block")),
    ("http://x.com/fr/a//b", ("x.com", "/fr/a//b", "com/fr/", "allow")),
    ("http://x.org?a=://y.com/de/", ("x.org", "", None, "allow")),
    ("http://telecom/de/", ("telecom", "/de/", None, "allow")),
    ("no scheme", ("", "", None, "allow")), ("", ("", "", None, "allow")), (None, ("", "", None, "allow"))])
def test_url_rules(spark, url, want):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    r = urls.judge(df, urls.labelled_urls(df, labels)).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_url_trees_learn_what_the_text_shows(spark):
    rows = [(i, f"http://host{i % 7}.net/{'a' * 40 if i % 3 == 0 else 'b'}/{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id long, quality int")
    judged = urls.judge(df, urls.labelled_urls(df, labels)).select("row.page_id", "verdict").collect()
    held_out = [r for r in judged if r.page_id >= 400]
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in held_out) / len(held_out) > .95


# Lines

def test_near_pairs_against_all_pairs(spark):
    random.seed(4)
    values = {random.getrandbits(64) for _ in range(60)}
    for base in list(values)[:2]:
        for _ in range(80):
            x = base
            for _ in range(random.randint(0, 3)):
                x ^= 1 << random.randrange(64)
            values.add(x)
    v = np.array(sorted(values), np.uint64)
    signed = v.view(np.int64).tolist()
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = {tuple(sorted((signed[i], signed[j]))) for i, j in zip(*np.nonzero(near)) if i != j}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for group in (32, 4):
        assert {(r.a, r.b) for r in lines.near(df, group=group).collect()} == want


def test_line_prints_against_python(spark, docs):
    from xxhash import xxh64_intdigest
    some = docs.where("doc_id < 12")
    rows = {(r.doc_id, i): x for r in some.collect() for i, x in enumerate(r.text.split("\n"))}
    for r in lines.prints(some, "doc_id", "text").collect():
        import regex
        norm = regex.sub(r"[^\p{L}\p{N}]+", " ", rows[r.key, r.line].lower()).strip()
        h = [xxh64_intdigest(w.encode(), 42) for w in norm.split(" ")]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r.fp & (1 << 64) - 1 == want


def test_repeated_lines_go(spark):
    long = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([
        (2, f"Shared line here\nown two\n{long} END"), (1, f"own one\nSHARED  line, here!\n--\n{long} end"),
        (3, f"shared line here\nshared line here\n--\n{long} end of")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_repeats(df).collect()}
    assert got[1] == f"own one\nSHARED  line, here!\n--\n{long} end"
    assert got[2] == "own two"
    assert got[3] in ("--", f"--\n{long} end of")


def test_lines_of_one_fingerprint_meet_in_rounds(spark):
    random.seed(21)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(16)]
    kinds = []
    for _ in range(7):
        random.shuffle(words)
        kinds.append(list(words))
    # Two lines of each order: the second swaps two neighbours, so all fingerprints are equal.
    rows = []
    for k, order in enumerate(kinds):
        other = [order[1], order[0], *order[2:]]
        rows += [(2 * k, " ".join(order)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lines.prints(df, "doc_id", "text").select("fp").distinct().count() == 1
    got = {r.doc_id: r.dropped for r in lines.report(df).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(14)}


# Chats

def test_snapshots_collapse(spark):
    said = [("u", "a"), ("s", "b"), ("u", "c")]
    rows = [(c, t, r, x) for c, n in ((5, 1), (6, 2), (7, 3), (8, 3)) for t, (r, x) in enumerate(said[:n])]
    rows += [(9, 10, "u", "a"), (9, 20, "s", "other"), (10, 0, None, "b"), (11, 0, "", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.chat for r in chats.format_chats(df).collect()}
    assert set(got) == {7, 9, 10, 11}
    assert got[9] == "<|im_start|>u\na<|im_end|>\n<|im_start|>s\nother<|im_end|>\n"


def test_long_conversations_are_numbered_over_blocks(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    start = df.where("turn < 3000").withColumn("conv_id", F.lit(0).cast("long"))
    rows = chats.format_chats(df.unionByName(start)).orderBy("part").collect()
    assert {r.conv_id for r in rows} == {1} and [r.n_turns for r in rows] == [1024] * 4 + [904]
    assert "".join(r.chat for r in rows).count("<|im_start|>") == 5000


# Pages

PAGE = """<html><head><title>t</title></head><body><div id="cookie-notice">We use cookies</div>
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article class="post"><header><h1>Big &amp;
 more</h1><p>By me</p></header><p>One&nbsp;two <b>bold</b>.<p>Next <a href="x">link</a>.</p><ul><li>a<li>b</ul>
<form><input><button>Go</button></form><div class="ad">Buy</div><aside>rel</aside><script>if (a<b) "</p>"</script>
<pre>x
 y</pre>tail</article><section id="comments"><p>nice</p></section></main><footer>f</footer></body></html>"""


def test_main_text_of_a_page(spark):
    df = spark.createDataFrame([(1, "http://h/1", PAGE)], "page_id long, url string, html string")
    assert pages.main_text(df).first().text == "Big & more\nOne two bold.\nNext link.\na\nb\nx y\ntail"


def test_template_texts_without_an_article(spark):
    rows = [(i, f"http://h/{i}", f"<body><div>Welcome to us</div><div><p>story {i}</p></div></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in pages.main_text(df).collect()} == {f"story {i}" for i in range(12)}


@pytest.mark.parametrize("html, want", [
    ('<article class="has-comments"><h2 id="related-work">Work</h2><p>a</p><h2 id="search">Search</h2></article>', "Work\na\nSearch"),
    ('<article><section id="social-history"><p>a</p></section><div class="form-of-address">b</div></article>', "a\nb"),
    ('<body class="no-sidebar"><p>a</p><div class="sidebar">s</div></body>', "a"),
    ('<body class="sidebar"><div class="content with-sidebar"><p>a</p></div></body>', "a"),
    ('<body><div class="sidebar"><p>a</p></div></body>', "a"),
    ('<body><p>a</p><div id="cookie_notice">c</div><div class="ad-3">b</div><div id="comments-area">d</div></body>', "a")])
def test_names_skip_as_a_whole(spark, html, want):
    df = spark.createDataFrame([(1, "http://h/1", html)], "page_id long, url string, html string")
    assert pages.main_text(df).first().text == want


def test_wrapper_alignment():
    a = pages.shape(pages.read("<h1>x</h1><p>a</p><p>b</p>"))
    b = pages.shape(pages.read("<h1>x</h1><table></table><p>a</p>"))
    assert [(x[0], x[1], x[2]) for x in pages.merge(a, b)] == [
        ("h1", False, False), ("table", True, False), ("p", False, True)]
    c = pages.shape(pages.read("<h2>x</h2><p>a</p><h2>x</h2><p>a</p>"))
    assert [(x[0], x[2]) for x in c] == [("(h2 p)", True)]


# Passages

def test_compact_windows_hold_every_minimum():
    random.seed(6)
    for n in (3, 10, 200):
        v = np.array([random.randrange(1, 60) << 40 for _ in range(n)], np.uint64)
        v[[k for k in range(n) if k % 37 == 30]] = 0
        low, at, high = passages.compact_windows(v, 8)
        found = dict(zip(at.tolist(), zip(low.tolist(), high.tolist())))
        for i in range(n):
            for j in range(i + 7, n):
                if v[i:j + 1].all():
                    c = i + int(np.argmin(v[i:j + 1]))
                    assert found[c][0] <= i and found[c][1] >= j
        assert all(b - a >= 7 and v[a:b + 1].all() for a, b in found.values())


def test_planted_passages(spark):
    random.seed(7)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    exact, near, short = some(52), some(90), some(40)
    changed = list(near)
    changed[45] = "other"
    rows = [(1, some(60) + exact + some(80)), (2, exact + some(70)), (3, some(90) + near), (4, changed + some(30)),
            (5, some(80) + short), (6, short + some(90)), (7, some(200)), (8, some(300))]
    copy = some(70)
    rows += [(9, copy), (10, copy)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end): r.first for r in passages.repeated_passages(df).collect()}
    assert got == {(1, 60, 112): True, (2, 0, 52): False, (3, 90, 180): True, (4, 0, 90): False,
                   (9, 0, 70): True, (10, 0, 70): False}


def test_many_short_texts_have_no_passages(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 27))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert passages.repeated_passages(df).count() == 0


def test_passages_with_several_edits(spark):
    random.seed(11)
    some = lambda n: ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    edits = [(80, [40, 41]), (80, [38, 41]), (90, [30, 33, 34]), (160, [20, 21, 22, 23, 24, 25, 80, 84]), (75, [37])]
    edits += [(50, [25]), (52, [10])] * 10
    rows, want = [], set()
    for k, (size, places) in enumerate(edits):
        text = some(size)
        changed = [f"new{k}x{i}" if i in places else w for i, w in enumerate(text)]
        rows += [(2 * k, some(70) + text + some(60)), (2 * k + 1, some(30) + changed)]
        want |= {(2 * k, 70, 70 + size), (2 * k + 1, 30, 30 + size)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end) for r in passages.repeated_passages(df).collect()}
    assert got == want


def test_covered_runs_against_all_windows():
    random.seed(12)
    for _ in range(300):
        shared = [random.random() < random.choice((.6, .8, .9)) for _ in range(120)]
        edge = np.diff(np.array([0, *shared, 0]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        held = set()
        for i in low:
            for j in high:
                if j - i + 1 >= 20 and 10 * sum(shared[i:j + 1]) >= 8 * (j - i + 1):
                    held |= set(range(i, j + 1))
        first, last = passages.covered(low, high, 20, .8)
        got = [x for a, b in zip(first, last) for x in range(low[a], high[b] + 1)]
        assert len(got) == len(set(got)) and set(got) == held
