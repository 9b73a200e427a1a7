"""Inputs that try hashes, sizes and ids: words of one polynomial hash, special strings, texts of megabytes, repeated and null ids."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lectern.llm import stages
from lectern.llm.arrays import same_bytes, split_words, word_hashes, word_names
from lectern.llm.byte_bpe import bpe_digests, codec
from lectern.llm.packing import pack_documents, tokenizer_ids
from lectern.llm.recompression import word_dedup_digests
from lectern.llm.repeats import MOST
from lectern.llm.shingle_join import Sets, shingle_components
from lectern.llm.suffix_dedup import substring_digests
from tests.llm.test_corpus_operators import components, cut_bytes, cut_words

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def thue_morse(n):
    """Two words of n letters that have one hash under any polynomial modulo 2**64."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")


def test_word_hashes_and_bytes():
    words = [*thue_morse(1024), *thue_morse(2048), "a", "ab", "abcdefgh", "abcdefghi", "é" * 40, "x" * 64, "x" * 65]
    raw = [w.encode() for w in words * 2]
    ends = np.cumsum([len(w) for w in raw])
    data, starts = np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(w) for w in raw]
    hashes = word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words) and (hashes[: len(words)] == hashes[len(words) :]).all()
    # hashes that all meet: the bytes still tell the words apart
    names, many = word_names(data, starts, ends, np.zeros(len(raw), np.uint64))
    assert many == len(words) and (names[: len(words)] == names[len(words) :]).all() and len(set(names.tolist())) == len(words)
    assert same_bytes(data, starts[:2], starts[[len(words), 1 + len(words)]], (ends - starts)[:2], step=7).all()


def test_vocabulary_survives_equal_hashes(monkeypatch):
    bpe, vocabulary = codec(RANKS)
    monkeypatch.setattr("lectern.llm.pretokens.word_hashes", lambda data, starts, ends: np.full(len(starts), 5, dtype=np.uint64))
    vocabulary.clear()
    texts = ["one two one three", "two  four'll one"]
    raw = [t.encode() for t in texts]
    ids, bounds = vocabulary.ids(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]
    vocabulary.clear()


@pytest.mark.parametrize("parts", [1, 2])
def test_words_of_one_polynomial_hash(spark, parts):
    rows = [(1, thue_morse(1024)[0]), (2, thue_morse(1024)[1]), (3, " ".join([*["w"] * 3, thue_morse(2048)[0], *map(str, range(19))])), (4, " ".join([*["w"] * 3, thue_morse(2048)[1], *map(str, range(19))]))]
    df = table(spark, rows, parts)
    bpe, _ = codec(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    want = {i: (hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df, RANKS).collect()} == want
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in word_dedup_digests(df).collect()} == cut_words(rows, 20)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(df, 3, 9, 10).collect()} == components(rows, 3, 9, 10)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_digests(df).collect()} == cut_bytes(rows, 100)


def test_special_strings_are_encoded_as_the_tokenizer_does():
    t = Tokenizer.from_file(TOKENIZER)
    texts = ["plain", "<|endoftext|> a", "x<|endoftext|><|endoftext|>y", "<|endof", "text|>", ""]
    raw = [x.encode() for x in texts]
    ids, bounds = tokenizer_ids(TOKENIZER).ids(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_shingle_names_are_exact():
    texts = ["A b c a b c", "a B", "a b", "c", "", "a b c"]
    raw = [t.encode() for t in texts]
    sets = Sets(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8), 3)
    own = [set(sets.names[a:b].tolist()) for a, b in zip(sets.cuts[:-1], sets.cuts[1:], strict=True)]
    assert list(map(len, own)) == [3, 1, 1, 1, 0, 1] and own[1] == own[2] != own[3] and own[5] < own[0] and sets.digests()[1] == sets.digests()[2]


def test_texts_of_megabytes(spark):
    """One word of a megabyte, and many words; no operator on whole texts may fail or change them."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefg"), 6)) for _ in range(3000)]
    rows = [(1, "ab" * 500_000), (2, " ".join(rng.choice(words, 200_000))), (3, "short"), (4, None)]
    df = table(spark, rows, 2)
    got = {r.doc_id: r for r in bpe_digests(df, RANKS).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in word_dedup_digests(df).collect()} == cut_words(rows, 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_digests(df).collect()} == cut_bytes(rows, 100)
    packed = pack_documents(df, TOKENIZER).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4} and all(r.length <= 1024 and r.partition_bound <= r.partition_bins for r in packed)
    t = Tokenizer.from_file(TOKENIZER)
    ids = np.array([*t.encode(rows[1][1], add_special_tokens=False).ids, 2], dtype="<u4")
    assert {(r.start, r.ids_crc32) for r in packed if r.doc_id == 2} == {(r.start, zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in packed if r.doc_id == 2}


def test_sizes_out_of_range(spark):
    df = table(spark, [(1, "a")], 1)
    for f in (substring_digests, word_dedup_digests):
        with pytest.raises(ValueError):
            f(df, MOST + 1)
        with pytest.raises(ValueError):
            f(df, 0)


def test_one_row_of_each_near_duplicate(spark):
    """Repeated rows, rows of one id with different texts, null ids, and columns of any name."""
    text = " ".join(f"word{i}" for i in range(60))
    near, other = text + " tail", " ".join(f"else{i}" for i in range(60))
    rows = [(1, text, 5), (1, text, 5), (1, other, 6), (2, near, 7), (3, other, 8), (None, "a lone text of some words here", 9), (None, None, 1), (None, None, 1), (4, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _head int").selectExpr("*", "_head AS k", "_head AS `row`", "'x' AS id", "0 AS component")
    kept = stages.keep_one_of_near(df, 5, 4, 5)
    assert kept.columns == df.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(True, 1, text), (True, 1, other), (False, 0, "a lone text of some words here"), (False, 0, ""), (False, 0, ""), (True, 4, "")])
    plain = spark.createDataFrame([(i, t) for i, t, _ in rows[:2] + rows[3:4]], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in stages.keep_one_of_near(plain, 5, 4, 5).collect()] == [(1, text)]


def test_equal_sets_of_different_words_are_linked(spark):
    """Small sets allow no difference, but texts that repeat their words have equal sets."""
    texts = ["a b c a b c", "a b c a b c a", "x y z", "x y z x y z x y z x", "b c a b c a b c", "p q", "p q p q", "q p q p q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_components(docs, words=3, num=9, den=10).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (1, 2), 3: (3, 3), 4: (3, 0), 5: (1, 5), 6: (2, 6), 7: (2, 6)}
