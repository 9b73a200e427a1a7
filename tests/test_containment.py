"""Quotes in texts by winnowed fingerprints, against plain containment."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import winnow
from lectern.operators import containment
from lectern.operators.containment import texts_with_quotes
from lectern.plans import checking as C
from lectern.plans import routing as P


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé文🤦") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 250))) for _ in range(n)]


def cases():
    rng = random.Random(4)
    bodies = texts() + ["", None, "ab" * 3000, "x", "long " * 200_000 + "tail", "same", "same"]
    quotes = [None, "", "a", "é", "zz", "same", "ab" * 50, "long tail", "no such quote at all in any of these texts", " "]
    for b in bodies[:60]:
        for size in (1, 3, 4, 7, 8, 15, 40, 63, 64, 130, 600):
            if len(b) >= size:
                at = rng.randint(0, len(b) - size)
                quotes.append(b[at : at + size])
                quotes.append(b[at : at + size - 1] + "#")
    return quotes, bodies


def frames(spark, quotes, bodies):
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string").withColumn("body", F.lit("clash"))
    return q, spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("band", F.lit("x"))


def test_equals_plain_containment(spark):
    quotes, bodies = cases()
    got = sorted((r.item_id, r.doc_id) for r in texts_with_quotes(*frames(spark, quotes, bodies), "item_id", "doc_id").collect())
    assert got == sorted((i, d) for i, q in enumerate(quotes) for d, b in enumerate(bodies) if q and b and q in b)


def test_no_nested_loop_and_empty_sides(spark):
    q, t = frames(spark, ["abcd", "é", "x" * 300], ["abcd é", "x" * 400])
    found = texts_with_quotes(q, t, "item_id", "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 3
    assert texts_with_quotes(q.limit(0), t, "item_id", "doc_id").collect() == []
    assert texts_with_quotes(q, t.limit(0), "item_id", "doc_id").collect() == []


def test_a_small_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(containment, "MOST_BITS", 1 << 10)
    quotes, bodies = cases()
    got = texts_with_quotes(*frames(spark, quotes, bodies[:40]), "item_id", "doc_id").count()
    assert got == sum(q in b for q in quotes if q for b in bodies[:40] if b)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=40), st.integers(1, 200), st.data())
def test_windows_of_a_quote_are_windows_of_the_text(text, more, size, data):
    size = min(size, len(text))
    if not size:
        return
    at = data.draw(st.integers(0, len(text) - size))
    band = winnow.band_of(size)
    raw, quote = np.frombuffer(more + text, np.uint8), np.frombuffer(text[at : at + size], np.uint8)
    own, found = winnow.fingerprints(raw, np.array([0, len(more), len(raw)]), band)
    mine = winnow.fingerprints(quote, np.array([0, size]), band)[1]
    assert len(mine) and set(mine.tolist()) <= set(found[own == 1].tolist())


def test_bands_fit_their_quotes():
    assert all(size + width - 1 <= least for least, size, width in winnow.BANDS)
    assert [winnow.band_of(n) for n in (1, 4, 7, 8, 127, 128, 5000)] == [0, 3, 3, 4, 7, 8, 8]


def test_severity_follows_the_inferred_scope(spark):
    rows = spark.createDataFrame([("core:16", "Прочее", "Итерации с руководителем"), ("core:5.1", "Прочее", "Слайды"), ("core:1.6", "Прочее", "Прочее"), ("x:1", "Прочее", "Доклад")], "key string, category string, requirement string")
    got = {r.key: (r.scope, r.severity, r.weight) for r in P.with_meta(rows).collect()}
    assert got == {"core:16": ("document", "info", 0.25), "core:5.1": ("document", "info", 0.25), "core:1.6": ("defense_statements", "major", 3.0), "x:1": ("defense", "info", 0.25)}


EVIDENCE = "check_id string, doc_id long, spec_idx int, block_pos int, block_id string, match_idx int, quote string"


def test_evidence_by_block_counts_each_quote_once(spark):
    rows = [("personal-pronouns", 1, 0, 0, "b1", k, "Мы  тут") for k in range(14)] + [("personal-pronouns", 1, 0, k, f"b{k + 1}", 0, "мы") for k in (1, 2)]
    rows += [("yo-letter", 1, s, p, f"b{p + 1}", 0, f"q{s}") for p in range(10) for s in (1, 0)]
    out = {r.check_id: r for r in C.gathered_by_block(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert [e.block_pos for e in out["personal-pronouns"].evidence] == [0, 1, 2] and out["personal-pronouns"].n_found == 16
    assert [(e.block_pos, e.quote) for e in out["yo-letter"].evidence] == [(p, f"q{s}") for p in range(6) for s in (0, 1)] and out["yo-letter"].n_found == 20


@pytest.mark.parametrize(("sizes", "kept"), [([5, 5, 5, 5], 15), ([12, 3], 12), ([11, 4, 2], 15)])
def test_small_numerals_stop_behind_the_block_that_is_enough(spark, sizes, kept):
    rows = [("small-numerals", 1, 0, p, f"b{p}", k, f"q{k}") for p, n in enumerate(sizes) for k in range(n)]
    out = C.gathered_by_block(spark.createDataFrame(rows, EVIDENCE)).first()
    assert len(out.evidence) == kept and out.n_found == kept


def test_texts_with_many_fingerprints_go_out_in_bounded_batches():
    """Short quotes are in every text; a batch that repeats the texts for all of them at once grows with their number."""
    import numpy as np
    import pyarrow as pa

    from lectern.operators import containment as K

    texts = ["".join(chr(97 + (k * i + i // 7) % 26) for i in range(2_000)) for k in range(1, 101)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["id", "body"])
    full = np.full(1 << 4, np.uint64(2**64 - 1))  # a filter that lets everything through
    out = list(K._met({3: (1 << 10, full.tobytes())})(iter([batch])))
    sizes = [sum(len(t) for t in b.column(1).to_pylist()) for b in out]
    assert sum(sizes) > 3 * K.OUT_BYTES and max(sizes) <= K.OUT_BYTES + 2_000
    want = {(k, t[i : i + 4]) for k, t in enumerate(texts) for i in range(len(t) - 3)}
    assert sum(b.num_rows for b in out) == len(want)


@pytest.mark.parametrize("room", [0, 3_000, 10**9])
def test_quotes_that_are_sent_and_quotes_that_are_joined(spark, monkeypatch, room):
    monkeypatch.setattr(containment, "SENT_BYTES", room)
    quotes, bodies = cases()
    quotes += ["ab" * 90, "x" * 64 + "y" * 70, "same"]
    bodies += ["x" * 64 + "y" * 70 + "ab" * 500 + "x" * 64 + "y" * 69, "y" * 70 + "x" * 64]
    got = sorted((r.item_id, r.doc_id) for r in texts_with_quotes(*frames(spark, quotes, bodies), "item_id", "doc_id").collect())
    assert got == sorted((i, d) for i, q in enumerate(quotes) for d, b in enumerate(bodies) if q and b and q in b)


def test_a_long_text_sends_what_is_around_a_fingerprint():
    """Whole texts were sent, once for each of their fingerprints, so what was exchanged grew with the square of a text's length."""
    import pyarrow as pa

    rng = random.Random(6)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(200_000))
    quotes = [text[at : at + 200] for at in range(1_000, 199_000, 20_000)]
    bands, keys = winnow.quote_keys(pa.array(quotes))
    assert set(bands) == {8}
    bits = 1 << 16
    table = np.zeros(bits >> 6, np.uint64)
    for place in winnow.probes(np.array(keys, np.int64).view(np.uint64), bits):
        np.bitwise_or.at(table, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["id", "body"])
    out = [r for b in containment._met({8: (bits, table.tobytes())}, {8: 200})(iter([batch])) for r in b.to_pylist()]
    held = {r["key"]: r["body"] for r in out}
    assert all(q.encode() in held[k] for q, k in zip(quotes, keys, strict=True))
    assert sum(len(r["body"]) for r in out) < 20_000
