"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, and each half is quantised by a codebook of its
own (Babenko and Lempitsky, "The Inverted Multi-Index", 2012). A cell is a pair
of centroids. A query walks the cells in order of the sum of its two squared
distances, with a heap over the two sorted lists, until the cells seen hold the
share of all entries that the fit asks for; what they hold is reranked by the
exact distance.

The codebooks and the share are fitted on a bounded sample: the share is what
the sample's own queries need to see ``TARGET`` of their true neighbours. It is
small where data cluster and large where they don't.

Cells are laid into buckets of at most about ``BLOCK`` entries from their counts
(of which there are as many as cells); a larger cell, such as one that holds
many equal vectors, is dealt over several buckets by a hash of the id. Entries
and queries meet in the order of their buckets, entries first: a task keeps the
entries of one bucket, queries stream by in blocks of at most ``QUERIES`` with
the cells that each of them visits, and the best of each query go on. Nothing is
repeated for what it meets, so neither a task nor the driver holds a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ragged
from .session import ready, width

SAMPLE = 8192
PROBES = 256
TARGET = 0.95
#: Entries of a cell, on average, as long as a codebook has no more than a sixteenth of the sample.
IN_CELL = 50
BLOCK = 4096
QUERIES = 256
#: Rows of the sample whose distances to a codebook are held at once.
ROWS = 1024
#: Pairs of a query and a cell that a task holds at once, and how far beyond the nearest pair a run of cells is taken, as a share of all distances.
PAIRS, STEP = 1 << 20, 1 / 128


@dataclass
class Index:
    first: np.ndarray  # centroids of the first halves
    second: np.ndarray
    share: float
    counts: np.ndarray | None = None  # entries of each cell
    bucket: np.ndarray | None = None  # first bucket of each cell
    salts: np.ndarray | None = None  # and how many it is dealt over

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest_of(x[:, : self.half], self.first) * len(self.second) + nearest_of(x[:, self.half :], self.second)

    def visited(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """The cells of one query, nearest first, until they hold ``least`` entries; empty cells are left out.

        The heap holds one entry for each centroid of the first half: the sum of its
        next pair. A pop takes the whole run of pairs of that centroid up to ``STEP``
        beyond the sum, so cells come as arrays; in the end they are put in order, as
        a heap of single pairs would give them.
        """
        left, right = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        low, high = a[left], b[right]
        held_by = np.cumsum(self.counts.reshape(len(a), len(b))[np.ix_(left, right)], axis=1)
        step = max(float(low[-1] + high[-1] - low[0] - high[0]) * STEP, 1e-300)
        heap = [(low[0] + high[0], 0, 0)]  # (sum of the next pair, centroid, its place in the other half)
        runs, held, opened = [], 0, 1
        while heap and held < least:
            total, i, j = heapq.heappop(heap)
            if j == 0 and opened < len(a):  # the next centroid can't be nearer than this one was
                heapq.heappush(heap, (low[opened] + high[0], opened, 0))
                opened += 1
            to = max(j + 1, int(np.searchsorted(high, total + step - low[i], "right")))
            runs.append((i, j, to))
            held += int(held_by[i, to - 1] - (held_by[i, j - 1] if j else 0))
            if to < len(b):
                heapq.heappush(heap, (low[i] + high[to], i, to))
        if not runs:
            return np.zeros(0, np.int64)
        bound = heap[0][0] if heap else np.inf
        # what is taken may lie behind pairs that still wait: these come in too, up to the last that is needed
        rows, firsts, ends = (np.array(r, dtype=np.int64) for r in zip(*runs, strict=True))
        last = float((low[rows] + high[ends - 1]).max())
        if last > bound:
            more = [(i, j, int(np.searchsorted(high, last - low[i], "right"))) for _, i, j in heap] + [(i, 0, int(np.searchsorted(high, last - low[i], "right"))) for i in range(opened, len(a))]
            more = [r for r in more if r[2] > r[1]]
            if more:
                rows, firsts, ends = (np.concatenate((x, np.array(y, dtype=np.int64))) for x, y in zip((rows, firsts, ends), zip(*more, strict=True), strict=True))
        i, j = np.repeat(rows, ends - firsts), ragged(firsts, ends - firsts)
        cells, sums = left[i] * len(b) + right[j], low[i] + high[j]
        some = self.counts[cells] > 0
        i, j, cells, sums = i[some], j[some], cells[some], sums[some]
        order = np.lexsort((j, i, sums))
        cells = cells[order]
        return cells[: int(np.searchsorted(np.cumsum(self.counts[cells]), least)) + 1]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, ROWS of them at a time."""
    return np.concatenate([squared(x[k : k + ROWS], centres).argmin(axis=1) for k in range(0, len(x), ROWS)]) if len(x) else np.zeros(0, np.int64)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from seeds spread over the sorted sample; an empty cluster keeps its centroid."""
    if not x.shape[1]:  # vectors of one component have an empty half
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_of(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, k: int, neighbours: int, target: float = TARGET) -> Index:
    half = max(1, sample.shape[1] // 2)
    index = Index(codebook(sample[:, :half], k), codebook(sample[:, half:], k), 1.0)
    n = len(sample)
    if n <= 4 * neighbours:
        return index
    cell = index.cells(sample)
    index.counts = np.bincount(cell, minlength=len(index.first) * len(index.second))
    probes = np.linspace(0, n - 1, min(PROBES, n)).astype(int)
    a, b = index.distances(sample[probes])
    needed = []
    for row, i in enumerate(probes.tolist()):
        d = squared(sample[i : i + 1], sample)[0]
        d[i] = np.inf
        true = np.argpartition(d, neighbours)[:neighbours]
        order = index.visited(a[row], b[row], n)
        place = np.empty(len(index.counts), dtype=np.int64)
        place[order] = np.cumsum(index.counts[order])
        needed.append(place[cell[true]] / n)
    index.share = float(min(1.0, np.quantile(np.concatenate(needed), target)))
    return index


def codewords(n: int, sample: int) -> int:
    """Centroids of a codebook: they grow with the square root of the table, up to what the sample can tell apart."""
    return int(np.clip(np.sqrt(n / IN_CELL), 4, max(4, sample // 16)))


def lay_out(index: Index, block: int) -> int:
    """Assign cells to buckets of about ``block`` entries; the number of buckets."""
    index.bucket, index.salts = np.zeros(len(index.counts), np.int64), np.ones(len(index.counts), np.int64)
    at, held = 0, 0
    for cell, n in enumerate(index.counts.tolist()):
        if n > block:
            at += 1 if held else 0
            index.bucket[cell], index.salts[cell] = at, -(-n // block)
            at, held = at + int(index.salts[cell]), 0
            continue
        if held + n > block:
            at, held = at + 1, 0
        index.bucket[cell] = at
        held += n
    return at + 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[len(column)].as_py()].astype(np.float64).reshape(len(column), dim)


def _assign(index: Index, dim: int):
    """(id, cell, x) of each row; once cells are laid out, also the first bucket of its cell and how many it is dealt over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), dim)
                cells = index.cells(x)
                cols = [b.column(0), pa.array(cells.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())]
                if index.bucket is not None:
                    cols += [pa.array(index.bucket[cells].astype(np.int32)), pa.array(index.salts[cells].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "cell", "x", "first", "salts"][: len(cols)])

    return run


def bounded(index: Index, a: np.ndarray, c: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, cell) pairs of queries, in runs of at most PAIRS pairs or of one query."""
    own, cells, held = [], [], 0
    for q in range(len(a)):
        found = index.visited(a[q], c[q], least)
        if own and held + len(found) > PAIRS:
            yield np.concatenate(own), np.concatenate(cells)
            own, cells, held = [], [], 0
        own.append(np.full(len(found), q, dtype=np.int32))
        cells.append(found.astype(np.int32))
        held += len(found)
    if own:
        yield np.concatenate(own), np.concatenate(cells)


def packed(index: Index, ids: np.ndarray, x: np.ndarray, own: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that one of the queries visits: the queries, and their cells in it."""
    salts = index.salts[cells]
    bucket = np.repeat(index.bucket[cells], salts) + ragged(np.zeros(len(cells), np.int64), salts)
    own, cells = np.repeat(own, salts), np.repeat(cells, salts)
    order = np.argsort(bucket, kind="stable")
    bucket, own, cells = bucket[order], own[order], cells[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    qids, pairs, xs = [], [], []
    for k in range(len(cuts) - 1):
        used, place = np.unique(own[cuts[k] : cuts[k + 1]], return_inverse=True)
        qids.append(ids[used].astype(np.int64).tobytes())
        pairs.append(np.stack([place.astype(np.int32), cells[cuts[k] : cuts[k + 1]]], axis=1).tobytes())
        xs.append(x[used].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(qids, pa.binary()), pa.array(pairs, pa.binary()), pa.array(xs, pa.binary())], ["bucket", "qids", "qcells", "qxs"])


def _walk(index: Index, dim: int, least: int):
    """Blocks of queries for every bucket that one of them visits. ``cells`` holds (query, cell) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                some = b.slice(at, QUERIES)
                x = matrix(some.column(1), dim)
                ids = some.column(0).to_numpy(zero_copy_only=False)
                a, c = index.distances(x)
                for own, cells in bounded(index, a, c, least):
                    yield packed(index, ids, x, own, cells)

    return run


def best_of(ids: np.ndarray, local: np.ndarray, x: np.ndarray, have: np.ndarray, qids: np.ndarray, pairs: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query among the entries of a bucket, by the exact distance. ``have`` are the bucket's cells in order, ``local`` each entry's place among them."""
    near = squared(q, x)
    at = np.minimum(np.searchsorted(have, pairs[:, 1]), len(have) - 1)
    there = have[at] == pairs[:, 1]
    visits = np.zeros((len(q), len(have)), dtype=bool)
    visits[pairs[there, 0], at[there]] = True
    near[~visits[:, local] | (qids[:, None] == ids[None])] = np.inf
    slack = 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max())
    out = []
    for i in range(len(q)):
        d = near[i]
        limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        some = np.flatnonzero((d <= limit + slack[i]) & np.isfinite(d))
        exact = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[some], exact))[:k]
        out.append((np.full(len(best), qids[i]), ids[some][best], exact[best]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def _rerank(dim: int, k: int, block: int):
    """Rows in order of bucket, and in it entries (id, cell, xs) before blocks of queries (qids, qcells, xs): the k best of each query among at most ``2 * block`` entries of a bucket; a bucket of more, by a rare hash, gives its best in parts."""

    def parts(ids: list, cells: list, xs: list):
        for at in range(0, len(ids), 2 * block):
            have, local = np.unique(np.array(cells[at : at + 2 * block], np.int64), return_inverse=True)
            yield np.array(ids[at : at + 2 * block], np.int64), local, np.frombuffer(b"".join(xs[at : at + 2 * block])).reshape(-1, dim), have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, cells, xs, held = None, [], [], [], None
        for b in batches:
            for bucket, kind, i, c, x, qids, qcells in zip(*(b.column(k) for k in range(7)), strict=True):
                if bucket.as_py() != at:
                    at, ids, cells, xs, held = bucket.as_py(), [], [], [], None
                if kind.as_py() == 0:
                    ids.append(i.as_py())
                    cells.append(c.as_py())
                    xs.append(x.as_py())
                    continue
                if held is None:
                    held, ids, cells, xs = list(parts(ids, cells, xs)), [], [], []
                for part in held:
                    yield best_of(*part, np.frombuffer(qids.as_py(), np.int64), np.frombuffer(qcells.as_py(), np.int32).reshape(-1, 2), np.frombuffer(x.as_py()).reshape(-1, dim), k)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``, among all rows but its own.

    score is the Euclidean distance in double precision; ties go to the smaller
    id. Fewer than k candidates are all returned. Rows without an id, and null,
    zero or non-finite vectors take no part, nor do vectors of another dimension
    than the most frequent one (of equals the smallest). Rows of one id are
    candidates each. An empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]
    rows = rows.filter(F.size("x") == dim)
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("index")), F.lit(2**53)) < F.lit(int(min(1.0, sample / n) * 2**53))).limit(2 * sample).select("id", "x").toArrow().sort_by("id")
    if not drawn.num_rows:
        drawn = rows.limit(1).select("id", "x").toArrow()
    index = fit(matrix(drawn["x"].combine_chunks(), dim), codewords(n, sample), k, target)
    index.counts = np.zeros(len(index.first) * len(index.second), dtype=np.int64)
    seen = rows.mapInArrow(_assign(index, dim), "id long, cell int, x binary").groupBy("cell").count().toArrow()  # as many rows as cells
    index.counts[seen["cell"].to_numpy()] = seen["count"].to_numpy()
    lay_out(index, block)
    entries = rows.mapInArrow(_assign(index, dim), "id long, cell int, x binary, first int, salts int")
    none = lambda kind: F.lit(None).cast(kind)
    dealt = entries.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int").alias("bucket"), F.lit(0).alias("kind"), "id", "cell", F.col("x").alias("xs"), none("binary").alias("qids"), none("binary").alias("qcells"))
    asked = rows.filter(F.col("id") % every == 0).repartition(width(rows), "id").mapInArrow(_walk(index, dim, min(n, max(int(np.ceil(index.share * n)), k + 1))), "bucket int, qids binary, qcells binary, qxs binary")
    asked = asked.select("bucket", F.lit(1).alias("kind"), none("long").alias("id"), none("int").alias("cell"), F.col("qxs").alias("xs"), "qids", "qcells")
    met = dealt.union(asked).repartition(width(rows), "bucket").sortWithinPartitions("bucket", "kind", "id")
    best = met.mapInArrow(_rerank(dim, k, block), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


__all__ = ["Index", "fit", "nearest"]
