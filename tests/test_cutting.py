"""Cutting joined words by a trie, against the plain recurrence."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.cutting import Trie, cut_tokens
from lectern.operators import blocks as B
from lectern.operators import terms as T
from lectern.plans import queries as Q
from lectern.plans import theses

SF = "/root/testdata/sf0.001"
LEXICON = st.dictionaries(st.text("абвё", min_size=1, max_size=6), st.integers(0, 40), max_size=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(LEXICON, min_size=1, max_size=3), st.lists(st.text("абвёгАБ", max_size=24), max_size=12), st.randoms())
def test_equals_the_plain_cut(lexicons, tokens, rng):
    common = frozenset({"а", "бв"})
    words = [(g, w, n, w in common) for g, own in enumerate(lexicons) for w, n in own.items()]
    groups = [rng.randrange(len(lexicons)) for _ in tokens]
    want = [T.segment(t, lexicons[g], common) if t else None for t, g in zip(tokens, groups, strict=True)]
    assert cut_tokens(Trie(words, len(lexicons)), tokens, groups) == want


def test_long_tokens_and_words_beyond_the_longest():
    counts = {"данных" * 5: 3, "данных" * 6: 9, "данных": 2, "анализ": 5}
    tokens = ["анализ" + "данных" * 40, "данных" * 6, "данных" * 5 + "анализ", "Анализданных"]
    trie = Trie([(0, w, n, False) for w, n in counts.items()], 1)
    assert cut_tokens(trie, tokens, [0] * 4) == [T.segment(t, counts) for t in tokens]
    assert cut_tokens(Trie([], 1), ["абв", ""], [0, 0]) == [None, None]


def test_texts_are_cut_by_their_own_documents_words(spark):
    docs = [(1, "метод анализа данных и метод анализа данных"), (2, "методика изданий"), (3, None), (None, "метод")]
    lexicons = T.document_lexicons(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = [(1, "Методанализаданных и методанализаданных.", "x"), (2, "Методанализаданных", "x"), (1, None, "x"), (3, "Методанализаданных короткое", "x"), (None, "методметодметод", "x"), (1, "Методанализаданных\nнеизвестноеслово", "x")]
    got = sorted(map(tuple, T.restored(spark.createDataFrame(rows, "doc_id long, text string, words string"), lexicons).collect()), key=repr)
    want = [(1, "Метод анализа данных и методанализаданных.", "x"), (2, "Методанализаданных", "x"), (1, None, "x"), (3, "Методанализаданных короткое", "x"), (None, "методметодметод", "x"), (1, "Метод анализа данных\nнеизвестноеслово", "x")]
    assert got == sorted(want, key=repr)


def test_the_query_equals_the_plain_cut(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    import re

    def plain(text):
        words = re.findall("(?<![a-zà-ÿ])[a-zà-ÿ]{4,30}(?![a-zà-ÿ])", text.lower())
        counts = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        pairs = [(a, b) for a, b in zip(words[::2], words[1::2]) if len(a + b) >= 12]
        cuts = [T.segment(a + b, counts) for a, b in pairs]
        return len(pairs), sum(c is not None for c in cuts), sum(c == f"{a} {b}" for c, (a, b) in zip(cuts, pairs))

    some = random.Random(1).sample(sorted(docs), 60)
    got = {r.doc_id: (r.n_joined, r.n_cut, r.n_restored) for r in Q.joined_words(spark, SF).collect()}
    assert len(got) == len(docs) and {k: got[k] for k in some} == {k: plain(docs[k]) for k in some}
    assert sum(v[2] for v in got.values()) > 0.9 * sum(v[0] for v in got.values())


def test_titles_of_joined_words(spark):
    docs = theses.theses(spark, SF).filter("doc_id <= 6")
    b = B.blocks(docs.withColumn("text", F.regexp_replace("text", "анализа данных в системах", "анализаданныхвсистемах")))
    lexicons = T.document_lexicons(B.blocks(docs))
    titles = {r.doc_id: r.text for r in T.best_titles(b, lexicons).collect()}
    assert titles[1] == "Метод анализа данных в системах управления"
