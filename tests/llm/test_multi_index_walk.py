"""The multi-index traversal by runs of cells, against a heap of single pairs; and its memory at a large index."""

import heapq
import tracemalloc

import numpy as np
import pytest

from lectern.llm import multi_index as M


def one_by_one(counts, a, b, least):
    """The cells in order of the sum of distances, by a heap over pairs of places."""
    left, right = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out, held = [(a[left[0]] + b[right[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        cell = int(left[i]) * len(b) + int(right[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (a[left[p[0]]] + b[right[p[1]]], *p))
    return out


def index(counts, na, nb):
    return M.Index(np.zeros((na, 1)), np.zeros((nb, 1)), 1.0, counts)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_single_pairs(seed):
    rng = np.random.default_rng(seed)
    na, nb = rng.integers(1, 14, 2)
    counts = rng.integers(0, 4, na * nb)
    a, b = rng.random(na), rng.random(nb)
    for least in (0, 1, 2, 7, int(counts.sum()), 10**6):
        assert index(counts, na, nb).visited(a, b, least).tolist() == one_by_one(counts, a, b, least)


def test_ties_give_as_many_as_asked():
    rng = np.random.default_rng(1)
    for _ in range(60):
        na, nb = rng.integers(1, 9, 2)
        counts = rng.integers(0, 3, na * nb)
        a, b = np.round(rng.random(na), 1), np.round(rng.random(nb), 1)
        for least in (1, 4, 30):
            cells = index(counts, na, nb).visited(a, b, least)
            held = np.cumsum(counts[cells])
            assert len(set(cells.tolist())) == len(cells) and (counts[cells] > 0).all()
            assert (held[-1] if len(held) else 0) >= min(least, counts.sum()) and (held[:-1] < least).all()


def test_memory_at_a_large_index():
    rng = np.random.default_rng(2)
    big = index(rng.poisson(50, 447 * 447), 447, 447)
    big.bucket, big.salts = np.arange(447 * 447) // 80, np.ones(447 * 447, np.int64)
    a, b = rng.random((12, 447)), rng.random((12, 447))
    tracemalloc.start()
    pairs = sum(len(own) for own, cells in M.bounded(big, a, b, int(big.counts.sum() * 0.69)) for _ in [M.packed(big, np.arange(12), a, own, cells)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs > 12 * 100_000 and peak < 300 << 20


def test_entries_and_queries_meet_without_a_join(spark):
    """A join repeated a block of entries for each block of queries that met it, all of them in an executor's heap at once."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(1, 6)), 60, axis=0)))
    ids = np.arange(len(x))
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = M.nearest(vectors, k=3, every=7, target=1.0, block=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = []
    for q in ids[ids % 7 == 0]:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if i != q][:3]
        want += [(int(q), r + 1, int(i)) for r, i in enumerate(best)]
    rows = [(r.query_id, r["rank"], r.vec_id) for r in got.collect()]
    hits = len(set(rows) & set(want)) / len(want)
    assert len(rows) == len(want) and hits > 0.9


def test_a_bucket_is_ranked_as_a_whole():
    """The stream of entries and queries against all distances, with cells that a query doesn't visit and more entries than are held at once."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x, cells, ids = rng.normal(size=(90, 4)), rng.integers(0, 6, 90), np.arange(90) + 1000
    q, qids = x[:5], ids[:5]
    pairs = np.array([(i, c) for i in range(5) for c in ((0, 1, 2, 3) if i % 2 else (2, 5, 9))], dtype=np.int32)
    rows = [(7, 0, int(i), int(c), v.tobytes(), None, None) for i, c, v in zip(ids, cells, x, strict=True)] + [(7, 1, None, None, q.tobytes(), qids.astype(np.int64).tobytes(), pairs.tobytes())]
    names = ["bucket", "kind", "id", "cell", "xs", "qids", "qcells"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for block in (16, 4096):
        out = [r for b in M._rerank(4, 3, block)(iter([batch.slice(0, 40), batch.slice(40)])) for r in b.to_pylist()]
        for i in range(5):
            seen = [j for j in range(90) if j != i and cells[j] in {c for a, c in pairs.tolist() if a == i}]
            best = sorted((float(np.sqrt(((x[j] - q[i]) ** 2).sum())), int(ids[j])) for j in seen)[:3]
            got = sorted((r["score"], r["vec_id"]) for r in out if r["query_id"] == qids[i])[:3]
            assert [j for _, j in got] == [j for _, j in best] and [s for s, _ in got] == pytest.approx([s for s, _ in best])


def test_the_fit_holds_few_distances_at_once():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(8192, 8))
    tracemalloc.start()
    M.codebook(sample[:, :4], 512, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
