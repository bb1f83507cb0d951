"""Suffix tree, near-duplicates, M-tree, BPE, WARC, mixing and the pipeline against brute force and round trips."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import bpe, linededup, mixing, mtree, spelling, suffixtree, warc
from concord.llm import probminhash as pm
from concord.llm.queries import QUERIES, vocabulary

TEXT = "doc_id long, text string"


# suffix trees


def small_tree(words):
    keys, n = np.unique(spelling.sequences(words), return_counts=True)
    parts = []
    for d in range(spelling.DEPTH + 1):
        packed, at = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        parts.append((np.full(len(packed), d), packed >> np.uint64(8), (packed & np.uint64(255)).astype(int), np.bincount(at, n)))
    return spelling.SuffixTree.build(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def follow_slowly(tree, word):
    """The spelling one symbol at a time."""
    state, now = 0, 0.0
    for b in bytes([spelling.END]) * spelling.DEPTH:
        state = tree.follow[state, tree.symbol[b]]
    for b in word + bytes([spelling.END]):
        now += tree.log10[state, tree.symbol[b]]
        state = tree.follow[state, tree.symbol[b]]
    return now


def test_lockstep_equals_one_symbol_at_a_time(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices(["the", "xab1", "yab2", "bee", "been", "ö"], k=rng.randint(0, 9))).encode() for _ in range(900)]
    tree = small_tree(words)
    assert tree.depths.max() >= 3
    want = [follow_slowly(tree, w) for w in words]
    assert np.allclose(tree.spell(words), want, atol=1e-4)
    monkeypatch.setattr(spelling, "LONG", 7)
    assert np.allclose(tree.spell(words), want, atol=1e-4)
    assert np.allclose((10.0 ** tree.log10[:, :-1].astype(float)).sum(axis=1) + (256 - tree.symbol.max()) * 10.0 ** tree.log10[:, -1], 1, atol=1e-4)


def test_states_are_longest_suffixes():
    words = [b"abracadabra", b"abra", b"abrabra"] * 30 + [b"brabra", b"cadbracad"] * 40
    tree = small_tree(words)
    lookup = {}  # context bytes of a state, found by walking
    todo = [(0, b"")]
    while todo:
        state, seen = todo.pop()
        if state in lookup and len(lookup[state]) <= len(seen):
            continue
        lookup[state] = seen
        if len(seen) < spelling.DEPTH:
            todo += [(int(tree.follow[state, tree.symbol[b]]), (seen + bytes([b]))) for b in b"abrcd\n" if tree.depths[tree.follow[state, tree.symbol[b]]] == len(seen) + 1]
    contexts = {v: k for k, v in lookup.items() if len(v) == tree.depths[k]}
    rng = random.Random(6)
    state, history = 0, b""
    for _ in range(400):
        b = rng.choice(b"abrcd\n")
        history += bytes([b])
        state = int(tree.follow[state, tree.symbol[b]])
        best = next(history[len(history) - n :] for n in range(min(spelling.DEPTH, len(history)), -1, -1) if history[len(history) - n :] in contexts)
        assert state == contexts[best]


def tokens_of(text):
    return [w.translate(suffixtree.LOWER) for w in (text or "").encode().split()] + [suffixtree.END]


def is_held_out(id):
    return zlib.crc32(("" if id is None else str(id)).encode()) % 7 == 2


def brute_scores(docs, penalty=0.5):
    """Scores of (id, text), by dictionaries."""
    train = [tokens_of(t) for i, t in docs if not is_held_out(i)]
    tree = small_tree(sorted({w for t in train for w in t[:-1]}))
    follow = [defaultdict(Counter) for _ in range(suffixtree.DEPTH + 1)]
    for t in train:
        t = [suffixtree.BEGIN, *t]
        for i in range(1, len(t)):
            for d in range(min(i, suffixtree.DEPTH) + 1):
                follow[d][tuple(t[i - d : i])][t[i]] += 1
    root = follow[0][()]
    n, kinds = sum(root.values()), len(root)
    share = lambda c, s: follow[len(c)][c][s] / sum(follow[len(c)][c].values())
    kept = set()
    for d in range(1, suffixtree.DEPTH + 1):
        for c, after in follow[d].items():
            total = sum(after.values())
            gain = sum(k * math.log(share(c, s) / share(c[1:], s)) for s, k in after.items())
            if gain > 1e-9 and gain > (penalty * len(after) * math.log(total) if total > 1 else 0 if penalty < math.inf else penalty):
                kept.add(c)

    def p(c, s):
        if not c:
            return (root[s] if s in root else max(kinds, 1)) / (n + max(kinds, 1))
        if c not in kept:
            return p(c[1:], s)
        after = follow[len(c)][c]
        more = suffixtree.SMOOTH * len(after)
        return (after[s] + more * p(c[1:], s)) / (sum(after.values()) + more)

    for c in [(), *sorted(kept)[:50]]:  # all known tokens, and the unknown ones' spellings together
        assert math.fsum(p(c, s) for s in root) + p(c, None) == pytest.approx(1)
    out = []
    for i, text in docs:
        t = [suffixtree.BEGIN, *tokens_of(text)]
        logs = [math.log10(p(tuple(t[max(0, k - suffixtree.DEPTH) : k]), t[k])) + (0 if t[k] in root else follow_slowly(tree, t[k])) for k in range(1, len(t))]
        out.append((i, sum(logs)))
    return out, len(kept)


def invented(rng, n):
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(0, 80))) + (" Zz" + str(i) if i % 3 else "")) for i in range(n)]


@pytest.mark.parametrize("chunk", [1 << 22, 90])
def test_scores_against_brute_force(spark, monkeypatch, chunk):
    """In batches of a few texts, too, with texts in several pieces."""
    docs = invented(random.Random(3), 60)
    docs += [(100, None), (101, ""), (102, docs[5][1]), (None, docs[7][1]), (103, "q\0r \x1c é"), (104, "ab " * 400)]
    for i in (3, 17):  # a held-out copy of a text
        docs.append((next(k for k in range(1000, 2000) if is_held_out(k) and k not in dict(docs)), docs[i][1]))
    batches = spark.createDataFrame(docs, TEXT)
    if chunk < 1000:
        monkeypatch.setattr(suffixtree, "CHUNK", chunk)
        assert sum(1 for _ in suffixtree._slices("ab " * 400)) > 8
        pieces = suffixtree.pack_texts  # workers import the module anew, so batches are made here
        monkeypatch.setattr(suffixtree, "pack_texts", lambda d: spark.createDataFrame(pa.Table.from_batches(_here(pieces, d, docs))))
    got = sorted(((r.doc_id, r.score) for r in suffixtree.score(batches).collect()), key=str)
    want, kept = brute_scores(docs)
    assert kept > 50
    for (i, x), (j, y) in zip(got, sorted(want, key=str), strict=True):
        assert i == j and x == pytest.approx(y, rel=1e-4, abs=1e-3)


def _here(pieces, frame, docs):
    """Batches of ``docs`` made in this process."""
    number, held = 0, suffixtree._Batch()
    for row, (i, text) in enumerate(docs):
        lead, flags = [suffixtree.BEGIN], (0 if is_held_out(i) else suffixtree.TRAIN) | suffixtree.FIRST
        for words, last in suffixtree._slices(text):
            held.add(row, i, flags, lead, [*words, suffixtree.END] if last else words)
            lead, flags = (lead + words)[-suffixtree.DEPTH :], flags & ~suffixtree.FIRST
            if held.held >= suffixtree.CHUNK:
                yield held.done(number, pa.int64())
                number, held = number + 1, suffixtree._Batch()
    if held.rows:
        yield held.done(number, pa.int64())


def test_each_step_lets_go_of_its_shuffle_files(spark, monkeypatch):
    """Even while the tables that they were made for are still referred to."""
    blocks = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    cut, tables, left = suffixtree.cut_dealt, [], []

    def watched(df):
        tables.append(df)
        before, out = blocks(), cut(df)
        for _ in range(50):  # files are deleted in the background
            if not blocks() - before:
                break
            time.sleep(0.1)
        left.append(len(blocks() - before))
        return out

    monkeypatch.setattr(suffixtree, "cut_dealt", watched)
    docs = invented(random.Random(6), 60)
    assert len(suffixtree.score(spark.createDataFrame(docs, TEXT)).collect()) == len(docs)
    assert len(left) >= suffixtree.DEPTH + 2 and not any(left)


def test_an_empty_tree_scores_otherwise(spark):
    docs = invented(random.Random(4), 80)
    frame = spark.createDataFrame(docs, TEXT)
    full, empty = ({r.doc_id: r for r in suffixtree.score(frame, p).collect()} for p in (0.5, math.inf))
    assert all(r.mean_depth == 0 for r in empty.values()) and any(r.mean_depth > 1 for r in full.values())
    for i, want in brute_scores(docs, math.inf)[0]:
        assert empty[i].score == pytest.approx(want, rel=1e-4)
    assert all(abs(full[i].score - empty[i].score) > 1e-3 for i, t in docs if t)


def test_scores(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    words = {i: tokens_of(t)[:-1] for i, t in docs.items()}
    train = [i for i in docs if not is_held_out(i)]
    counts = Counter(w for i in train for w in words[i])
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    rows = QUERIES["op2_score"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in set(train), len(w) + 1, 1 + sum(x in counts for x in w), n)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_edge_cases(spark):
    rows = [(0, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "A b " * 30_000, "x"), (2, "A b " * 30_000, "x"), (5, "new\x1cwords é", "x"), (3, "z" * 5000, "x")]
    frame = spark.createDataFrame(rows, TEXT + ", score string")
    got = suffixtree.score(frame).collect()
    assert len(got) == 7 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 2} == {60_001}
    assert suffixtree.score(frame.limit(0)).count() == 0
    held = next(k for k in range(100) if is_held_out(k))
    (alone,) = suffixtree.score(spark.createDataFrame([(held, "never trained")], TEXT)).collect()
    assert (alone.n_known, alone.train_tokens) == (0, 0) and math.isfinite(alone.score)
    (named,) = suffixtree.score(spark.createDataFrame([("a", "x y")], "doc_id string, text string")).collect()
    assert named.doc_id == "a" and named.n_tokens == 3


def test_order_and_spelling_count(spark, sf_dir):
    docs = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    free = iter(i for i in range(10**6) if is_held_out(i))
    train = iter(i for i in range(10**6) if not is_held_out(i))
    rng = random.Random(7)
    whole, mixed, rows = set(), set(), []
    for k, text in enumerate(docs):
        if k % 7:
            rows.append((next(train), text))
            continue
        words = text.split()
        shuffled = rng.sample(words, len(words))
        for ids, t in ((whole, " ".join(words)), (mixed, " ".join(shuffled))):
            i = next(free)
            ids.add(i)
            rows.append((i, t))
    plausible, noise = next(free), next(free)
    rows += [(plausible, "thereander"), (noise, "xqzvkwjxqz")]
    got = {r.doc_id: r for r in suffixtree.score(spark.createDataFrame(rows, TEXT)).collect()}
    tokens = sum(got[i].n_tokens for i in whole)
    assert sum(got[i].score for i in whole) - sum(got[i].score for i in mixed) > 0.08 * tokens
    assert sum(got[i].score for i in whole) > sum(got[i].base_score for i in whole)
    assert got[plausible].n_known == got[noise].n_known == 1 and got[plausible].score > got[noise].score + 0.2


def test_spellings_are_whole_at_any_size(spark, monkeypatch):
    for limit in ("TABLE_ROWS", "CELLS"):  # what the tree was cut at
        monkeypatch.setattr(spelling, limit, 50, raising=False)
    rng = random.Random(8)
    words = ["".join(rng.choices(["the", "xab1", "yab2", "bee", "been", "ö"], k=rng.randint(0, 9))).encode() for _ in range(900)]
    keys, n = np.unique(spelling.sequences(words), return_counts=True)
    tree = spelling.grow(spark.createDataFrame(list(zip(keys.tolist(), n.tolist(), strict=True)), "key long, n long"))
    odd = [*words, b"", b"zzz", b"thz\xff", b"xab1yab2" * 40]
    want = small_tree(words).spell(odd)
    assert np.allclose(tree.spell(odd), want, atol=1e-3)
    monkeypatch.setattr(spelling, "LONG", 7)
    assert np.allclose(tree.spell(odd), want, atol=1e-3)
    none = spelling.Spelling.build(np.zeros(0, np.uint64), np.zeros(0))
    assert np.allclose(none.spell([b"ab", b""]), [-3 * np.log10(256), -np.log10(256)])


# near duplicates


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def family(rng, n, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        copy = list(base)
        for i in rng.sample(range(len(copy)), rng.randint(*edits)):
            copy[i] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(7)
    e = np.unique(rng.integers(0, 2**60, 1000).astype(np.uint64))
    x, y = np.ones(len(e)), rng.integers(1, 4, len(e)).astype(float)
    a, b = pm.signatures([(e, x), (e, y)], 8000)
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(len(e)))
    assert abs((a == b).mean() - want) < 0.03


@pytest.mark.parametrize("weights", ["log", "one"])
def test_recall_of_pairs_near_the_threshold(spark, weights):
    """Pairs just above it, whose texts repeat different passages different numbers of times."""
    rng, docs = random.Random(21), []
    while len(docs) < 240:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
        copy = list(base)
        for i in rng.sample(range(100), 2):
            copy[i] = f"x{rng.randint(0, 10**6)}"
        a, b = list(base), list(copy)
        for x, other in ((a, copy), (b, base)):
            at = rng.randint(0, 60)
            x += x[at : at + 30] * rng.randint(0, 12)
        one, two = shingles(" ".join(a)), shingles(" ".join(b))
        if 0.8 <= len(one & two) / len(one | two) < 0.86:
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in pm.near_duplicates(spark.createDataFrame(docs, TEXT), weights=weights).collect()}
    assert sum(got[i + 1] == i for i in range(0, 240, 2)) >= 0.99 * 120
    assert all(got[i] == i for i in range(0, 240, 2))


def test_weights_are_bounded_and_count():
    counts = np.array([1, 2, 5, 10**6])
    w = pm.WEIGHTS["log"](counts)
    assert w[0] == 1 and (np.diff(w) > 0).all() and w[-1] == pm.HEAVIEST
    rng = np.random.default_rng(3)
    e = np.unique(rng.integers(0, 2**60, 400).astype(np.uint64))
    x, y = rng.choice([1, pm.HEAVIEST], len(e)), rng.choice([1, pm.HEAVIEST], len(e))
    a, b = pm.signatures([(e[:360], x[:360]), (e[40:], y[40:])], 6000)
    assert (a == b).mean() > 320 / 400 / pm.HEAVIEST - 0.02
    assert (a != pm.signatures([(e[:360], np.ones(360))], 6000)[0]).mean() > 0.02


def test_hashes_of_long_texts(monkeypatch):
    texts = [b"ab cd " * 50, b"", b"x" * 300 + b" y " + b"z" * 40, b" \n"]
    want = pm._word_hashes(texts)
    monkeypatch.setattr(pm, "SEGMENT", 37)
    got = pm._word_hashes(texts)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and len(set(want[0].tolist())) == 5


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    texts = [t for k in range(8) for t in family(rng, 12, [(0, 1), (1, 3), (3, 5), (4, 8)][k % 4])]
    texts += ["one two three", "one two three", "one two  three", "one two", None, "", " ", "a b c d e f g"] + ["solo " + " ".join(family(rng, 1, (0, 0))) for _ in range(5)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], TEXT + ", node string, class_id int")
    got = pm.near_duplicates(frame.select("doc_id", "text"))
    want = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in got.collect()} == want
    kept = pm.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_lines_hide_no_link(spark):
    """Copies of texts that repeat a line many times, with edits in all its repetitions."""
    rng = random.Random(12)
    docs = []
    for i in range(30):
        line, rest = family(rng, 1, (0, 0))[0][:200], family(rng, 1, (0, 0))[0]
        docs += [(2 * i, (line + "\n") * 40 + rest), (2 * i + 1, (line[:190] + "x\n") * 40 + rest)]
    got = pm.near_duplicates(spark.createDataFrame(docs, TEXT)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs) and len({r.class_id for r in got}) < 60
    logs = pm.near_duplicates(spark.createDataFrame(docs, TEXT), weights="log").collect()
    assert len(logs) == 60


def test_a_large_group_without_a_center(spark):
    """A chain: each text is near the next ones, the ends have nothing in common."""
    words = [f"w{i}" for i in range(600)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 200])) for i in range(60)]
    got = {r.doc_id: r.class_id for r in pm.near_duplicates(spark.createDataFrame(docs, TEXT)).collect()}
    assert got == brute_classes(docs) and set(got.values()) == {0}


def test_near_duplicate_edge_cases(spark):
    same = "one two three four five six"
    frame = spark.createDataFrame([(None, same), (None, same), (4, same), (4, same), (5, "x " * 100_000), (6, None), (6, None)], TEXT)
    rows = sorted(((r.doc_id, r.class_id, r.n_rows) for r in pm.near_duplicates(frame).collect()), key=str)
    assert rows == sorted([(None, 4, 4), (None, 4, 4), (4, 4, 4), (4, 4, 4), (5, 5, 1), (6, 6, 1), (6, 6, 1)], key=str)
    assert sorted(str(r.doc_id) for r in pm.keep_one(frame).collect()) == ["4", "5", "6", "6"]
    assert pm.near_duplicates(frame.limit(0)).count() == 0


# M-tree


@pytest.mark.parametrize("kind", ["random", "ties", "huge", "clusters"])
def test_search_is_exact(kind):
    rng = np.random.default_rng(9)
    v = {"random": rng.integers(-40, 40, (1500, 12)), "ties": rng.integers(0, 2, (1500, 3)), "huge": rng.integers(-(2**28), 2**28, (300, 4)), "clusters": rng.integers(-3, 3, (1500, 6)) + rng.integers(0, 30, (15, 6)).repeat(100, 0) * 20}[kind].astype(np.int64)
    ids = rng.permutation(len(v))
    tree = mtree.MTree(ids, v)
    for i in range(0, len(v), 40):
        want = sorted(((int(v[j] @ v[i]), int(ids[j])) for j in range(len(v)) if j != i), key=lambda x: (-x[0], x[1]))[:20]
        assert tree.search(v[i], int(ids[i]), 20) == want
    assert (kind == "huge") != tree.exact and (len(v) < 2 * mtree.LEAF or tree.pages[-1].radii is not None)
    if kind == "clusters":
        assert tree.computed < 0.7 * len(v) * len(range(0, len(v), 40))


def test_clusters_are_ruled_out_by_bounds():
    """Of well-separated clusters most vectors are never computed; a bound from elsewhere saves more."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(64, 16))
    centers *= 900 / np.linalg.norm(centers, axis=1, keepdims=True)
    v = np.rint(centers.repeat(128, 0) + rng.normal(size=(64 * 128, 16)) * 12).astype(np.int64)
    ids = rng.permutation(len(v))
    trees = [mtree.MTree(ids, v), mtree.MTree(ids, v)]
    asked = range(0, len(v), 173)
    floors = mtree._floors(ids[::173], v[::173], ids[::2], v[::2], 20)
    for i, low in zip(asked, floors, strict=True):
        want = sorted(((int(x), int(y)) for x, y in zip(v @ v[i], ids) if y != ids[i]), key=lambda x: (-x[0], x[1]))[:20]
        assert trees[0].search(v[i], int(ids[i]), 20) == trees[1].search(v[i], int(ids[i]), 20, low) == want
    assert trees[0].computed < 0.25 * len(v) * len(asked) and trees[1].computed <= trees[0].computed


@pytest.mark.parametrize("kind", ["random", "ties", "huge", "repeated"])
def test_blocks_of_queries_share_products(kind):
    """Queries of a block meet a page in one product a round at most, not in one each; with and without bounds from elsewhere."""
    rng = np.random.default_rng(13)
    v = {"random": rng.integers(-40, 40, (4000, 32)), "ties": rng.integers(0, 2, (3000, 3)), "huge": rng.integers(-(2**28), 2**28, (600, 4)), "repeated": rng.integers(-9, 9, (40, 8)).repeat(50, 0)}[kind].astype(np.int64)
    ids = rng.permutation(len(v))
    asked = np.arange(0, len(v), len(v) // 200)
    want = []
    for row, i in enumerate(asked.tolist()):
        scores = v @ v[i]
        order = np.lexsort((ids, -scores))
        want += [(row, int(ids[j]), int(scores[j])) for j in order[ids[order] != ids[i]][:20]]
    tree = mtree.MTree(ids, v)
    leaves = sum(p.radii is None for p in tree.pages)
    for floors in (np.full(len(asked), -np.inf), mtree._floors(ids[asked], v[asked], ids[::3], v[::3], 20)):
        tree.products = 0
        rows, found, scores = tree.search_block(v[asked], ids[asked], 20, floors)
        assert list(zip(rows.tolist(), found.tolist(), scores.tolist(), strict=True)) == want
        assert tree.products <= leaves * (1 + math.ceil(math.log(leaves, 4))) < len(asked) * leaves
    assert [len(x) for x in tree.search_block(v[:0], ids[:0], 20, np.zeros(0))] == [0, 0, 0]
    assert [len(x) for x in mtree.MTree(ids[:5], v[:5, :0]).search_block(v[:1], ids[:1], 20, np.full(1, -np.inf))] == [4, 4, 4]


def test_top_k_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [0.5, 0.25]), (5, []), (None, [1.0, 1.0]), (6, [float("inf"), 0.0]), (7, [3.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(frame, frame.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 64 * 192), (0, 2, 4, 64 * 32 + 128 * 16), (0, 3, 5, 0)]
    assert mtree.top_k(frame.limit(0), frame, 5).count() == 0 == mtree.top_k(frame, frame.limit(0), 5).count()


# BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


@given(st.text(max_size=80) | st.text("ab etsh'\n\t19", max_size=80))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(codec, library, text):
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text) and codec.decode(packed) == text.encode()


def test_bpe_of_long_pieces(codec, library):
    rng = random.Random(10)
    for text in ("a" * 50_000, " " * 20_000, "".join(rng.choices("etaoinshr", k=20_000))):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def merged(parts, ranks):
    """Tokens after merging the pair of least rank, the first of equal ones, until none is left."""
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=14), st.lists(st.sampled_from(b"abc"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_bpe_with_other_merges(merges, data):
    tokens = [bytes([i]) for i in range(256)]
    ranks = {t: i for i, t in enumerate(tokens)}
    few = [b"a", b"b", b"c"]
    for a, b in merges:
        new = few[a % len(few)] + few[b % len(few)]
        if new not in ranks and merged([bytes([x]) for x in new], ranks) == [ranks[few[a % len(few)]], ranks[few[b % len(few)]]]:
            ranks[new] = len(ranks)
            few.append(new)
    piece = bytes(data)
    assert bpe.ByteBpe(ranks, r"(?s).+").encode_piece(piece) == merged([bytes([x]) for x in piece], ranks) if piece else True


def test_bpe_refuses_ranks_without_merges():
    with pytest.raises(ValueError):
        bpe.ByteBpe({**{bytes([i]): i for i in range(256)}, b"abc": 256}, ".")


@pytest.mark.parametrize("kind, id", [("int", 3), ("string", "three"), ("long", None)])
def test_bpe_digests_of_any_id(spark, kind, id):
    frame = spark.createDataFrame([(id, "a b", 1), (id, None, 2)], f"doc_id {kind}, text string, n_tokens int")
    rows = bpe.bpe_digests(frame, *vocabulary()).collect()
    assert [r.doc_id for r in rows] == [id, id] and sorted(r.n_tokens for r in rows) == [0, 2]
    assert bpe.bpe_digests(frame.limit(0), *vocabulary()).count() == 0


def test_bpe_frames(spark):
    frame = spark.createDataFrame([(1, "hello world", "q"), (2, None, "q"), (3, "", "q"), (1, "hello world", "q")], TEXT + ", ids string")
    encoded = bpe.bpe_encode(frame, *vocabulary())
    rows = bpe.bpe_decode(encoded, *vocabulary()).collect()
    assert [bytes(r.decoded).decode() for r in rows] == ["hello world", "", "", "hello world"] and rows[1].ids == []
    digests = {r.doc_id: r for r in bpe.bpe_digests(frame, *vocabulary()).collect()}
    assert digests[1].ids_sha256 == hashlib.sha256(np.array(rows[0].ids, "<u4").tobytes()).hexdigest() and digests[1].n_tokens == 2
    assert digests[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_encode(frame.limit(0), *vocabulary()).count() == 0
    both = bpe.bpe_encode(frame, *vocabulary(), digest="text_sha256")
    assert both.columns == ["doc_id", "text", "ids", "text_sha256"] and {r.text_sha256 for r in both.collect()} == {r.decoded_sha256 for r in digests.values()}


# WARC


def archive(n=6, zipped=True):
    records = [warc.record_bytes(i, f"http://x/{i}", f"payload {i} ".encode() * 40) for i in range(n)]
    return [warc.gzip_member(r) if zipped else r for r in records]


def ids(found):
    return [x[3]["warc-record-id"] for x in found if x[0] == "record"]


def urns(*which):
    return [f"<urn:page:{i}>" for i in which]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(zipped=zipped)
    whole = b"".join(parts)
    assert ids(warc.salvage(whole)) == urns(*range(6)) and not [x for x in warc.salvage(whole) if x[0] == "gap"]
    at = len(parts[0]) + len(parts[1])
    broken = bytearray(whole)
    broken[at + len(parts[2]) // 2] ^= 0xFF
    found = list(warc.salvage(bytes(broken)))
    assert ids(found) == urns(0, 1, 3, 4, 5)
    assert [x[1:3] for x in found if x[0] == "gap"] == [(at, len(parts[2]))]
    cut = whole[: -len(parts[5]) // 2]
    assert ids(warc.salvage(cut)) == urns(*range(5)) and list(warc.salvage(cut))[-1][0] == "gap"
    junk = b"junk\x1f\x8b\x08WARC/1.1\r\nno" + parts[0] + b"WARC/1.0\r\n\r\n" + parts[1]
    assert ids(warc.salvage(junk)) == urns(0, 1)
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"nothing")] == ["gap"]


def inner_gaps(found):
    return [x[4:] for x in found if x[0] == "gap" and x[4] is not None]


def test_salvage_inside_a_member():
    """Archives that are compressed as a whole."""
    parts = archive(zipped=False)
    plain = b"".join(parts)
    data = warc.gzip_member(plain)
    found = list(warc.salvage(data))
    assert ids(found) == urns(*range(6)) and [x[2] for x in found] == [0] * 5 + [len(data)]
    assert [x[5:] for x in found] == [(sum(map(len, parts[:i])), len(p)) for i, p in enumerate(parts)]
    last = data[:-12] + bytes(b ^ 0xFF for b in data[-12:])  # the checksum and the end of the last record
    assert ids(warc.salvage(last)) == urns(*range(5))
    trailer = data[:-8] + bytes(8)
    assert ids(warc.salvage(trailer)) == urns(*range(5)) and list(warc.salvage(trailer))[-1][:4] == ("gap", 0, len(data), "member")
    assert len(ids(warc.salvage(data[: len(data) * 9 // 10]))) >= 4
    at = len(parts[0]) + len(parts[1])
    for change in (at + 3, at + len(parts[2]) // 2, at + len(parts[2]) - 2):
        broken = bytearray(plain)
        broken[change] ^= 0xFF
        found = list(warc.salvage(warc.gzip_member(bytes(broken))))
        assert ids(found) == urns(0, 1, 3, 4, 5)
        assert inner_gaps(found) == [(at, len(parts[2]))]
    size = plain.replace(b"Content-Length: ", b"Content-Length: 9999", 1)  # a record that claims what others have
    assert ids(warc.salvage(warc.gzip_member(size))) == urns(*range(1, 6))
    both = warc.gzip_member(b"".join(parts[:3])) + b"junk" + warc.gzip_member(b"".join(parts[3:]))
    found = list(warc.salvage(both))
    assert ids(found) == urns(*range(6)) and sum(x[2] for x in found) == len(both)


def test_salvage_of_a_large_member_in_small_memory(monkeypatch):
    parts = archive(zipped=False)
    plain = b"".join(parts * 400)
    data = warc.gzip_member(plain)
    largest, real = [0], warc.parse_record

    def watch(data, at=0):
        largest[0] = max(largest[0], len(data))
        return real(data, at)

    monkeypatch.setattr(warc, "parse_record", watch)
    assert len(ids(warc.salvage(data))) == 2400
    assert largest[0] < 4 * warc.STEP + max(map(len, parts)) < len(plain)


@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=4), st.booleans())
@settings(max_examples=100, deadline=None)
def test_salvage_of_whole_members_covers_every_byte(changes, twice):
    whole = warc.gzip_member(b"".join(archive(zipped=False)))
    data = bytearray(whole * (1 + twice))
    for at, value in changes:
        data[at % len(data)] = value
    found = list(warc.salvage(bytes(data)))
    assert sum(x[2] for x in found) == len(data) and [x[1] for x in found] == sorted(x[1] for x in found)


@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=4))
@settings(max_examples=100, deadline=None)
def test_salvage_covers_every_byte(changes):
    data = bytearray(b"".join(archive()))
    for at, value in changes:
        data[at % len(data)] = value
    found = list(warc.salvage(bytes(data)))
    assert sum(x[2] for x in found) == len(data) and [x[1] for x in found] == sorted(x[1] for x in found)
    assert len(ids(found)) >= 6 - len(changes)


def test_payload_that_looks_like_a_record():
    inner = warc.record_bytes(9, None, b"x" * 50)
    outer = warc.record_bytes(1, "http://ä/\r\nWARC-Type: evil", inner)
    found = list(warc.salvage(outer))
    assert ids(found) == urns(1) and found[0][3]["warc-type"] == "response"


def test_revisits_and_files(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (5, None, big), (3, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (5, None, big), (None, "u", big)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.page_records(frame).collect()), key=str)
    digest = hashlib.sha1(big.encode()).hexdigest()
    small, none = hashlib.sha1(b"small").hexdigest(), hashlib.sha1(b"").hexdigest()
    want = [(1, "revisit", 5, 1200, digest), (3, "revisit", 5, 1200, digest), (None, "revisit", 5, 1200, digest)] + [(5, "response", None, 1200, digest)] * 2
    want += [(7, "response", None, 5, small), (8, "response", None, 5, small), (9, "response", None, 0, none), (10, "response", None, 0, none)]
    assert got == sorted(want, key=str)
    folder = str(tmp_path / "warc")
    warc.export_archives(warc.write_archives(warc.revisits(frame), size=500), folder)
    back = warc.read_archives(warc.load_archives(spark, folder))
    assert back.where("kind = 'record'").count() == 9 and back.where("kind = 'gap'").count() == 0
    assert warc.page_records(frame.limit(0)).count() == 0


def test_digests_in_headers():
    text = warc.record_bytes(1, "http://x", b"abc").decode()
    assert "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode() in text


# mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in names:
            if s in open_:
                target[s] += left * w[s] / total
        left = 0.0
        for s in sorted(open_, key=str):
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_ = open_ - {s}
    return target


def mixed_docs(spark, seed=11):
    rng = random.Random(seed)
    rows = [(i, " w" * rng.choice([0, 1, 5, 30, 200, 900]), rng.choice(["a", "b", "c", "d", None, "é"]), "x") for i in range(3000)]
    rows += [(9000 + i, "w " * 10, "tiny", "x") for i in range(3)] + [(1, "same text here", "a", str(i)) for i in range(40)] + [(None, None, "b", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_and_words_taken(spark):
    rows, frame = mixed_docs(spark)
    got = mixing.mix_rows(mixing.mix_plan(frame)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    target = fill(sizes)
    taken, seen = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        seen[r.source] = (r.source_size, r.target)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    mean = sum(sizes.values()) / len(rows)
    for s in sizes:
        assert seen[s] == (sizes[s], pytest.approx(target[s], rel=1e-9)) and abs(taken[s] - target[s]) <= max(2 * mean, 0.02 * target[s]) + 1
    again = mixing.mix_rows(mixing.mix_plan(frame.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_copies_are_drawn_without_bias(spark):
    """Over many documents of one size each is due the same number of copies on average."""
    frame = spark.createDataFrame([(i, "w " * (10 + 40 * (i % 2)), "ab"[i % 4 // 2]) for i in range(8000)], TEXT + ", source string")
    rows = mixing.mix_rows(mixing.mix_plan(frame)).collect()
    for s in "ab":
        due = next(r.target / r.source_size for r in rows if r.source == s)
        for n in (10, 50):
            copies = [r.copies for r in rows if r.source == s and r.size == n]
            assert abs(sum(copies) / len(copies) - due) < 0.05 and max(copies) - min(copies) <= 1


def test_mixed_documents(spark):
    rows, frame = mixed_docs(spark)
    want = Counter()
    for r in mixing.mix_plan(frame).collect():
        want[r.doc_id, r.source] += r.copies
    got = mixing.mix_documents(frame)
    assert got.columns == frame.columns
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +want
    assert mixing.mix_rows(mixing.mix_plan(frame.limit(0))).count() == 0 and mixing.mix_documents(frame.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], TEXT + ", source string")
    assert [r.taken for r in mixing.mix_rows(mixing.mix_plan(none)).collect()] == [0, 0]


# the pipeline


def test_stages_keep_the_columns_and_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir).cache()
        if name != "encode":
            assert after.columns == columns
        if name == "quality_rules":
            judged = spark.read.parquet(f"{sf_dir}/labels.parquet").join(after.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
            assert judged.where("quality = 0 and kept = 1").count() == 0
        if name == "line_dedup":
            lines = [x for r in after.collect() for x in r.text.split("\n") if len(x.split()) >= 5]
            assert len(lines) == len(set(lines)) and after.count() == before.count()
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in after.collect()) == sorted(set(brute_classes(rows).values()))
        if name == "mix":
            n = lambda f: f.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
            assert abs(n(after) - n(before)) < 0.1 * n(before)
        if name == "encode":
            texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
            assert after.count() == before.count() and all(r.decoded_sha256 == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in after.collect())
        before = after


def test_pipeline_query(spark, sf_dir):
    import __spark_entry__ as e

    frame = e.queries()["pipeline"](spark, sf_dir)
    assert frame.count() > 50 and {"doc_id", "n_tokens", "ids"} <= set(frame.columns)
    assert len([n for n in e.queries() if n.startswith("op")]) == 10


def test_stages_with_odd_rows(spark):
    """Nulls, empty texts, repeated rows, columns with names that operators use, an empty table."""
    rng = random.Random(40)
    text = lambda: "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(12)) for _ in range(8))
    some = text()
    rows = [(i, text(), "en", None if i % 5 == 0 else f"s{i % 3}", 1, i, "x") for i in range(60)]
    rows += [(100, None, "en", "s0", None, 1, "x"), (101, "", None, None, 0, 2, "x"), (None, text(), "en", "s1", 5, 3, None)]
    rows += [(200, some, "en", "s2", 7, 4, "x")] * 2 + [(201, some, "en", "s2", 7, 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, node string")
    for table in (docs, docs.limit(0)):
        names = table.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table, "").persist()
            assert kept.columns == names, name
            kept.count()
            table = kept
        last = corpus_pipeline.STAGES[-1][1](spark, table, "").collect()
        assert len(last) == table.count()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, "")
    assert {100, 101}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == 64
    single = stages["near_dedup"](spark, docs, "").where("doc_id IN (200, 201)").collect()
    assert [r.doc_id for r in single] == [200]


def test_plans_of_dedup_hold_no_plans_of_plans(spark, sf_dir, monkeypatch):
    """A plan that reads persisted tables holds theirs, which the driver spells out after each stage: they mustn't nest."""
    docs, nested = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for module in (linededup, pm):

        def counted(df, cut=module.cut):
            nested.append(df._jdf.queryExecution().toString().count("InMemoryRelation"))
            return cut(df)

        monkeypatch.setattr(module, "cut", counted)
    assert linededup.drop_repeated_lines(docs).count() == docs.count()
    lines, nested = max(nested), []
    assert 0 < pm.keep_one(docs).count() < docs.count()
    assert lines <= 10 and max(nested) <= 30


def test_near_dedup_lets_go_of_its_shuffle_files(spark, sf_dir, monkeypatch):
    """Before links are joined those of all earlier steps have gone, and the bands were dealt once."""
    blocks = lambda: {b for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    components, stars, left, again = pm.components, pm._stars, [], []

    def watched(links):
        for _ in range(50):  # files are deleted in the background
            if not blocks() - before:
                break
            time.sleep(0.1)
        left.append(len(blocks() - before))
        return components(links)

    def planned(buckets):
        pairs = stars(buckets)
        again.append(pairs._jdf.queryExecution().executedPlan().toString().count("Generate"))
        return pairs

    monkeypatch.setattr(pm, "components", watched)
    monkeypatch.setattr(pm, "_stars", planned)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = blocks()
    tables = pm.classes(docs)
    assert tables[0].count() == docs.count() and left and again == [0]
    assert max(left) <= 2  # of the one number that counting rows for a broadcast leaves


def test_near_dedup_stage_persists_nothing(spark, sf_dir, monkeypatch):
    """A persisted table keeps the shuffle files that it was made from, which are disk for as long as the stage runs."""
    kept, components = [], pm.components
    persistent = lambda: {*spark.sparkContext._jsc.getPersistentRDDs()}
    before = persistent()
    monkeypatch.setattr(pm, "components", lambda links: kept.append(persistent() - before) or components(links))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir).count() < docs.count()
    assert kept and not any(kept)
