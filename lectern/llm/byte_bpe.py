"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Distinct pre-tokens of a chunk become rows of int32 matrices, bucketed by
length and padded with -1. A parallel matrix holds the rank of every adjacent
pair. Each round takes every row's leftmost minimum, merges that pair, closes
the gap (compaction) and looks up the two pairs that are new, in an
open-addressing table of pairs; rows without a pair left leave the matrix. A
pre-token above ``WIDEST`` bytes is a row of its own, in which a round takes the
minimum pair at all its places from the left, up to the first one whose merge
makes a pair of a lower rank, and closes the gaps when half of the row is gone;
the merges and their order are the same.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import CHUNK, U64, id_array, ragged, text_chunks
from .pretokens import Vocabulary
from .session import ready

NONE = np.int32(2**31 - 1)
WIDEST = 512
_BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, WIDEST)


class PairTable:
    """(a, b) -> rank of the merged token, by open addressing with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=U64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        ab = np.array(list(pairs), dtype=np.int64).reshape(-1, 2)
        key = (ab[:, 0].astype(U64) << U64(32)) | ab[:, 1].astype(U64)
        rank = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at, rest, self.probes = self._home(key), np.arange(len(key)), 0
        while len(rest):
            self.probes += 1
            free = rest[self.ranks[at[rest]] == NONE]
            slots, winners = np.unique(at[free], return_index=True)
            self.keys[slots], self.ranks[slots] = key[free[winners]], rank[free[winners]]
            placed = np.zeros(len(key), dtype=bool)
            placed[free[winners]] = True
            rest = rest[~placed[rest]]
            at[rest] = (at[rest] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the pair does not merge or one side is padding."""
        key = (a.astype(np.int64).astype(U64) << U64(32)) | b.astype(np.int64).astype(U64) & U64(0xFFFFFFFF)
        at = self._home(key)
        out = np.where(self.keys[at] == key, self.ranks[at], NONE)
        rest = np.flatnonzero((out == NONE) & (self.ranks[at] != NONE))
        for _ in range(self.probes):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & self.mask
            here = at[rest]
            hit = self.keys[here] == key[rest]
            out[rest[hit]] = self.ranks[here[hit]]
            rest = rest[~hit & (self.ranks[here] != NONE)]
        out[(a < 0) | (b < 0)] = NONE
        return out


class ByteBPE:
    """Encoder and decoder for one ranks file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        ranks = self.ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        order = sorted(ranks, key=ranks.get)
        top = max(ranks.values()) + 1
        self.sizes = np.zeros(top, dtype=np.int64)
        self.sizes[[ranks[t] for t in order]] = [len(t) for t in order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(order), dtype=np.uint8)
        digits = [b"%d " % i for i in range(top)]
        self.digit_sizes = np.array([len(d) for d in digits], dtype=np.int64)
        self.digit_starts = np.cumsum(self.digit_sizes) - self.digit_sizes
        self.digits = np.frombuffer(b"".join(digits), dtype=np.uint8)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        sizes = np.ones(n, dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (word, position, id)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=n)
        known = np.flatnonzero(whole >= 0)
        parts.append((known, np.zeros(len(known), np.int64), whole[known]))
        flat = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        begins = np.cumsum(lengths) - lengths
        low = 0
        for high in _BUCKETS:
            rows = np.flatnonzero((whole < 0) & (lengths > low) & (lengths <= high))
            for i in range(0, len(rows), step := max(1, 400_000 // high)):
                some = rows[i : i + step]
                parts += self._merge(some, flat, begins[some], lengths[some], sizes)
            low = high
        for i in np.flatnonzero((whole < 0) & (lengths > WIDEST)).tolist():
            ids = self._merge_row(flat[begins[i] : begins[i] + lengths[i]])
            sizes[i] = len(ids)
            parts.append((np.full(len(ids), i), np.arange(len(ids)), ids))
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        starts = np.cumsum(sizes) - sizes
        for word, place, ids in parts:
            out[starts[word] + place] = ids
        return out, sizes

    def _merge(self, words: np.ndarray, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        wide = int(lengths.max())
        cols = np.arange(wide)
        valid = cols[None] < lengths[:, None]
        ids = np.where(valid, flat[np.minimum(begins[:, None] + cols[None], len(flat) - 1)], -1)
        ranks = np.full((len(words), wide), NONE, dtype=np.int32)
        if wide > 1:
            ranks[:, :-1] = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        while True:
            best = ranks.argmin(axis=1)
            row = np.arange(len(words))
            rank = ranks[row, best]
            over = np.flatnonzero(rank == NONE)
            if len(over):
                done = ids[over]
                real = done >= 0
                sizes[words[over]] = real.sum(axis=1)
                r, c = np.nonzero(real)
                yield words[over[r]], c, done[r, c]
                live = np.flatnonzero(rank != NONE)
                if not len(live):
                    return
                words, ids, ranks, best, rank = words[live], ids[live], ranks[live], best[live], rank[live]
                row = np.arange(len(words))
            width = ids.shape[1] - 1
            ids[row, best] = rank
            shift = np.arange(width)[None] > best[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            ranks = np.where(np.arange(width)[None] >= best[:, None], ranks[:, 1:], ranks[:, :-1])
            right = np.minimum(best + 1, width - 1)
            ranks[row, best] = np.where(best + 1 < width, self.table(ids[row, best], ids[row, right]), NONE)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.table(ids[left, best[left] - 1], ids[left, best[left]])

    def _merge_row(self, ids: np.ndarray) -> np.ndarray:
        """One long row. Places that are merged away stay as holes (rank NONE) between links until half of the row is holes."""
        while True:
            n = len(ids)
            if n < 2:
                return ids
            ids = np.append(ids, -1)  # the end, where links stop
            after, before = np.arange(1, n + 2), np.arange(-1, n)
            ranks = np.append(self.table(ids[:-1], ids[1:]), NONE)
            alive, live = np.ones(n + 1, dtype=bool), n
            while 2 * live > n:
                rank = ranks.min()
                if rank == NONE:
                    return ids[:n][alive[:n]]
                at = np.flatnonzero(ranks == rank)
                fresh = np.ones(len(at), dtype=bool)  # places that share a symbol, as in a run of one letter, are taken in turn
                fresh[1:] = after[at[:-1]] != at[1:]
                head = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - head[np.cumsum(fresh) - 1]) % 2 == 0]
                gone = after[at]
                right, left = after[gone], before[at]
                joined = np.zeros(len(at), dtype=bool)  # the left neighbour is merged just before
                joined[1:] = left[1:] == gone[:-1]
                new = np.full(len(at), rank, dtype=ids.dtype)
                first = np.where(left < 0, -1, np.where(joined, rank, ids[np.maximum(left, 0)])).astype(ids.dtype)
                lower = np.flatnonzero((self.table(first, new) < rank) | (self.table(new, ids[right]) < rank))
                if len(lower):
                    at, gone, right, left = (x[: lower[0] + 1] for x in (at, gone, right, left))
                ids[at], ranks[gone], alive[gone] = rank, NONE, False
                after[at] = right
                before[right] = at
                ranks[at] = self.table(ids[at], ids[right])
                left = before[at]
                at, left = at[left >= 0], left[left >= 0]
                ranks[left] = self.table(ids[left], ids[at])
                live -= len(gone)
            ids = ids[:n][alive[:n]]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, end to end."""
        return self.bytes[ragged(self.starts[ids], self.sizes[ids])]

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, cuts): each id in decimal digits and a space behind it, and where each one starts."""
        sizes = self.digit_sizes[ids]
        return self.digits[ragged(self.digit_starts[ids], sizes)], np.concatenate(([0], np.cumsum(sizes)))


_made: dict[str, tuple[ByteBPE, Vocabulary]] = {}


def codec(path: str) -> tuple[ByteBPE, Vocabulary]:
    """Made once in each process."""
    if path not in _made:
        bpe = ByteBPE(path)
        _made[path] = bpe, Vocabulary(bpe.encode)
    return _made[path]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, vocabulary = codec(path)
        for batch in batches:
            for _, _, ids, offs, data in text_chunks(batch, limit=2 * CHUNK):
                tokens, cuts = vocabulary.ids(data, offs)
                text, at = bpe.decimals(tokens)
                raw = bpe.decode(tokens)
                raw_at = np.concatenate(([0], np.cumsum(bpe.sizes[tokens])))
                text, raw = text.tobytes(), raw.tobytes()
                shas, back = [], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    shas.append(hashlib.sha256(text[at[a] : max(at[a], at[b] - 1)]).hexdigest())
                    back.append(hashlib.sha256(raw[raw_at[a] : raw_at[b]]).hexdigest())
                yield pa.RecordBatch.from_arrays([id_array(ids), pa.array(np.diff(cuts)), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        vocabulary.clear()  # the process lives on for other tasks

    return run


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: the text is encoded, and the ids are decoded again.

    A null text is an empty one: no tokens, and digests of nothing. Null and
    repeated ids stay as they are, one row for each row; other columns are not
    read; an empty table gives no rows. No shuffle.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary = codec(path)
        for batch in batches:
            for _, _, ids, offs, data in text_chunks(batch, limit=2 * CHUNK):
                tokens, cuts = vocabulary.ids(data, offs)
                yield pa.RecordBatch.from_arrays([id_array(ids), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tokens))], ["doc_id", "ids"])

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row's text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_tokens(path), "doc_id long, ids array<int>")


def _bytes_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = codec(path)
        for batch in batches:
            ids = [bpe.decode(np.array(x or [], dtype=np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "bytes"])

    return run


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the bytes that the ids stand for; null ids are none."""
    ready(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_bytes_of(path), "doc_id long, bytes binary")
