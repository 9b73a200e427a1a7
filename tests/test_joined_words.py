"""The registered query over joined words."""

import time

from lectern.plans import queries as Q


def test_the_work_is_linear_in_a_document(spark, tmp_path):
    """Words were searched anew for each pair of them, which took minutes here."""
    letters = "abcdefghijklmnop"
    text = " ".join("".join(letters[(n >> s) & 15] for s in (12, 8, 4, 0)) + "qrs" for n in range(20_000))
    spark.createDataFrame([(1, text), (2, "some words"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {r.doc_id: r.n_joined for r in Q.joined_words(spark, str(tmp_path)).collect()}
    assert got[1] == 10_000 and got[2] == 0 and time.time() - began < 60


def test_a_batch_is_cut_in_slices_of_bounded_size():
    """All words of a batch were Python values at once, a gigabyte in each worker of a table of 0.1 GB."""
    import tracemalloc

    import pyarrow as pa

    from lectern.operators import terms as T

    n = 400
    own = [[{"word": f"w{k}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) + "word", "n": 2} for j in range(300)] for k in range(n)]
    texts = [" ".join(a["word"] + b["word"] for a, b in zip(ws[::2], ws[1::2], strict=True)) for ws in own]
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    names = ["text", "_doc", "_lexicon"]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, "", "x"]), pa.array([*range(n), n, n + 1, n + 2]), pa.array([*own, None, [], None], kind)], names)
    del own
    tracemalloc.start()
    out = list(T._cut_texts(("text",), r"(?<!\S)[a-z]{8,}(?!\S)", ())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [t for b in out for t in b.column(0).to_pylist()]
    assert got[n:] == [None, "", "x"] and [t.replace(" ", "") for t in got[:n]] == [t.replace(" ", "") for t in texts]
    assert all(t.count(" ") == 299 for t in got[:n]) and len(out) > 1 and peak < 60 << 20
