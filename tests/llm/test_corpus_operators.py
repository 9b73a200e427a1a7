"""Operators over whole collections, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import packing
from lectern.llm.components import connected_components
from lectern.llm.multi_index import nearest
from lectern.llm.packing import best_fit, lower_bound, pack_documents
from lectern.llm.recompression import anchors, word_dedup_digests
from lectern.llm.shingle_join import Bands, linked, set_keys, shingle_components
from lectern.llm.suffix_dedup import Scratch, range_min, repeated_columns, sliding_min, substring_digests, without_repeats

DOCS = "doc_id long, text string, again string, key long, place int"
TOKENIZER = P.path("byte_bpe_50k.json")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


def corpus(seed=0, docs=120):
    """Texts with copies, near copies, shared passages, repetitions, and empty, null and long ones."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(words, 60))
    texts = []
    for i in range(docs):
        w = rng.choice(words, rng.integers(1, 200)).tolist()
        kind = i % 8
        if kind == 1 and texts:
            w = texts[rng.integers(len(texts))].split()
        elif kind == 2 and texts:
            w = texts[rng.integers(len(texts))].split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.integers(len(w))] = "edited"
        elif kind == 3:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        elif kind == 4:
            w = (w[:7] * 30)[:150]
        texts.append(" ".join(w))
    texts += ["", " \n ", "a" * 500, "ab" * 400, passage * 40]
    return [*enumerate(texts), (5000, None)]


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 9, 10, 10**6), (5, 4, 5, 10**6), (2, 1, 2, 10**6), (3, 4, 5, 400)])
def test_shingle_components(spark, n, num, den, block):
    rows = corpus()
    got = shingle_components(documents(spark, rows), n, num, den, block_tokens=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, n, num, den)


def test_shingle_components_odd_rows(spark):
    df = documents(spark, [(None, "one two three four"), (4, "one two three four"), (4, "one two three four"), (9, "A b"), (8, "a B"), (7, None)])
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in shingle_components(df, 3, 9, 10).collect())
    assert got == [((False, 0), 2, None), ((True, 4), 2, None), ((True, 4), 2, None), ((True, 7), 0, 7), ((True, 8), 1, 8), ((True, 9), 1, 8)]
    assert shingle_components(df.limit(0), 3, 9, 10).count() == 0


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([(9, 10), (4, 5), (1, 2)]), st.booleans())
def test_similar_sets_share_a_key(n, seed, t, common):
    num, den = t
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    differ = 2 * len(a) * (den - num) // (den + num)
    drop = rng.integers(0, differ + 1)
    b = np.unique(np.concatenate((rng.choice(a, len(a) - min(drop, len(a) - 1), replace=False), rng.integers(0, 2**63, max(0, differ - drop)).astype(np.uint64))))
    x = len(np.intersect1d(a, b))
    if x * (num + den) < num * (len(a) + len(b)):
        return
    left_out = np.sort(rng.choice(a, len(a) // 2, replace=False)) if common else None
    bands = Bands(num, den)
    ka, kb = ({int(k) for part in set_keys(s, bands, left_out) for k in part} for s in (a, b))
    assert ka & kb or np.array_equal(a, b)
    assert linked([a, b], num, den, bands, left_out).tolist() == [0, 0]


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, int(x)) for x in rng.integers(201, 240, 80)] + [(-5, 90), (90, 90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(c == 200 for i, c in got.items() if i >= 200) and got[90] == got[-5] == -5
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def cut_bytes(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - size + 1):
            s = x[k : k + size]
            if s in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(s)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size", [100, 20, 300, 400])
def test_substring_digests(spark, size):
    rows = corpus(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_digests(documents(spark, rows).repartition(5), size).collect()}
    assert got == cut_bytes(rows, size)


def test_hot_anchors_are_not_ordered(spark):
    """A passage with another context in each document: the same result, and no string of its anchors is gathered."""
    rng = np.random.default_rng(5)
    near = ["".join(rng.choice(list("abcd"), 30)) for _ in range(4)]
    texts = ["".join(rng.choice(list("abcdefgh"), 80)) + near[i % 4] + " All rights reserved by the makers of it. " + near[i % 3] + "".join(rng.choice(list("abcdefgh"), 80)) for i in range(90)]
    rows = list(enumerate([*texts, *texts[:3]]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_digests(documents(spark, rows).repartition(5), 60, hot=20).collect()}
    assert got == cut_bytes(rows, 60)

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in word_dedup_digests(documents(spark, rows).repartition(5), 3, hot=5).collect()}
    assert got == cut_words(rows, 3)


def cut_words(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            if s in seen:
                gone[k : k + size] = [True] * size
            seen.add(s)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("size", "rounds"), [(20, None), (5, None), (20, 0), (300, None)])
def test_word_dedup(spark, size, rounds):
    rows = corpus(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in word_dedup_digests(documents(spark, rows).repartition(5), size, rounds).collect()}
    assert got == cut_words(rows, size)


def test_dedup_of_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = documents(spark, [(None, text), (3, text), (3, text), (2, text + " tail"), (1, None)])
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed) for r in word_dedup_digests(df).collect())
    assert got == [((False, 0), 60, 0), ((True, 1), 0, 0), ((True, 2), 61, 60), ((True, 3), 60, 60), ((True, 3), 60, 60)]
    twice = documents(spark, [(3, text), (3, text)])
    assert {r.n_removed for r in substring_digests(twice).collect()} == {0}
    assert substring_digests(df.limit(0)).count() == 0 and word_dedup_digests(df.limit(0)).count() == 0


def test_dedup_of_different_texts_under_one_id(spark):
    """Rows of one id, or of null, lose their own repeats only; rows of one id and text are one document."""
    texts = [t for _, t in corpus(7, 40) if t]
    table = documents(spark, [*((None if i % 3 else 4 + i % 2, t) for i, t in enumerate(texts)), *((50 + i, t) for i, t in enumerate(texts[::5])), (4, texts[1])])
    rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.twin, r.text) for r in table.select("doc_id", F.xxhash64("text").alias("twin"), "text").collect()})
    want = cut_bytes([(i, r[3]) for i, r in enumerate(rows)], 20)
    named = {(r[1] if r[0] else None, *want[i]) for i, r in enumerate(rows)}
    got = substring_digests(table.repartition(5), 20).collect()
    assert len(got) == table.count() and {tuple(r) for r in got} == named
    assert {tuple(r) for r in substring_digests(table.repartition(5), 20, hot=5).collect()} == named
    want = cut_words([(i, r[3]) for i, r in enumerate(rows)], 5)
    assert {tuple(r) for r in word_dedup_digests(table.repartition(5), 5).collect()} == {(r[1] if r[0] else None, *want[i]) for i, r in enumerate(rows)}
    a, b = "the first text under null " * 3, "another text without a repeat in it, but quite as long as that"
    kept = without_repeats(documents(spark, [(None, a), (None, b)]), 20).collect()
    assert b in {r.text for r in kept}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_equal_windows_have_equal_anchors(letters, size):
    names = np.array([7919 * (x + 1) for x in letters], dtype=np.uint64)
    keys, word = anchors(names, np.array([0, len(names)]), size)
    seen = {}
    for k in range(len(letters) - size + 1):
        got = seen.setdefault(tuple(letters[k : k + size]), (keys[k], word[k] - k))
        assert got == (keys[k], word[k] - k)


def test_column_construction_parts(tmp_path):
    x = np.random.default_rng(0).integers(0, 9, 200)
    assert sliding_min(x.astype(np.uint64), 7).tolist() == [min(x[i : i + 7]) for i in range(194)]
    a = np.arange(0, 150)
    b = a + np.random.default_rng(1).integers(1, 50, 150)
    assert range_min(x, a, b).tolist() == [x[i:j].min() for i, j in zip(a, b, strict=True)]
    raw = [b"xabcdefy", b"abcdefz", b"qabcdeq"]
    for folder in (None, str(tmp_path)):
        with Scratch(folder) as files:
            string, column = repeated_columns(np.zeros(3, np.int64), np.array([1, 0, 1]), raw, 5, files)
        assert sorted(zip(string.tolist(), column.tolist())) == [(1, 1), (1, 2), (2, 1)]
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("rows", [packing.ROWS, 20])
def test_packing(spark, rows):
    texts = [*corpus(4), (7, "repeated id"), (None, "null id")]
    got = pack_documents(documents(spark, texts), TOKENIZER, capacity=256, rows=rows).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            to = at + ((len(ids) - at) % 256 or 256)
            want.append((str(i), at, to - at, zlib.crc32(np.array(ids[at:to], dtype="<u4").tobytes())))
            at = to
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.03 * lower_bound(np.array([r.length for r in got]), 256) + 1
    assert pack_documents(documents(spark, []), TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_bound_is_below_best_fit(lengths):
    x = np.sort(np.array(lengths))[::-1]
    bins, offsets, room = best_fit(x, 64)
    assert lower_bound(x, 64) <= len(room) and (room >= 0).all() and (np.bincount(bins, x) + room == 64).all()


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[700]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [1.0, None] + [0.0] * 14, 0), (2400, [1.0], 0), (None, [1.0] * 16, 0)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), block=128).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 1500, 100))
    recall = []
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(1500), d))[:10]
        recall.append(len(set(true) & set(g.vec_id)) / 10)
        g = g.sort_values("rank")
        assert np.allclose(d[g.vec_id], g.score, rtol=1e-12) and list(g["rank"]) == list(range(1, 11)) and (np.diff(g.score) >= 0).all()
    assert np.mean(recall) >= 0.9
    assert list(got[got.query_id == 700].sort_values("rank").vec_id) == list(range(701, 711))
    few = nearest(spark.createDataFrame([(100, [1.0, 2.0]), (101, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in few] == [(100, 101, 1.0)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

