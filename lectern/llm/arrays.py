"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on one bounded chunk of documents at a time: the UTF-8
bytes of some documents laid end to end (``data``) and their boundaries
(``offs``). A chunk holds about ``CHUNK`` bytes, so that the 64-bit arrays made
of it take a few dozen megabytes; a longer document is a chunk of its own, so
memory follows the longest document, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
NULL_ID = -(2**63)  # stands for a null id inside the operators

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_STEP = 0xC2B2AE3D27D4EB4F
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_WORD_INV = pow(_WORD_BASE, -1, 2**64)

#: White space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept between calls."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, CHUNK + 4096 if n > 4096 else 4096), base, dtype=U64)
        steps[0] = 1
        got = np.cumprod(steps, dtype=U64)
        if len(got) <= 4 * CHUNK:
            _POWERS[base] = got
    return got[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values, out=out[1:])
    return out


def text_arrays(batch: pa.RecordBatch, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offs, data) of a batch: row k's text is data[offs[k]:offs[k+1]]. Null ids become NULL_ID, null texts are empty."""
    ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    text = batch.column(batch.schema.get_field_index(text_col))
    n = len(text)
    if not n:
        return ids, np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    _, off_buf, data_buf = text.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    return ids, offs, data


def runs(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j
        i = j


def text_chunks(batch: pa.RecordBatch, id_col: str = "doc_id", text_col: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, ids, offs, data) for runs of rows of at most ``limit`` bytes."""
    ids, offs, data = text_arrays(batch, id_col, text_col)
    for i, j in runs(offs, limit):
        yield i, j, ids[i:j], offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): the words of the chunk; document k has words bounds[k]:bounds[k+1]. No word crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[(offs > 0) & (offs < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands. Eight bytes at a time go through a bijection of their own, so no algebra of the places makes long words meet; still, whoever needs equality compares the bytes (``same_bytes``)."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=U64)
    some, turn = np.arange(len(starts)), 0
    if int(sizes.max()) > 64:  # long words: all their blocks at once
        long = np.flatnonzero(sizes > 64)
        blocks = (sizes[long] + 7) >> 3
        own = np.repeat(np.arange(len(long)), blocks)
        k = ragged(np.zeros(len(long), np.int64), blocks)
        values = _block(eight, starts[long][own] + 8 * k, sizes[long][own] - 8 * k) + (k + 1).astype(U64) * U64(_STEP)
        out[long] = np.add.reduceat(mix(values), np.cumsum(blocks) - blocks)
        some = np.flatnonzero(sizes <= 64)
    while len(some):
        values = _block(eight, starts[some] + 8 * turn, sizes[some] - 8 * turn) + U64((turn + 1) * _STEP & (2**64 - 1))
        out[some] += mix(values)
        turn += 1
        some = some[sizes[some] > 8 * turn]
    return mix(out + sizes.astype(U64) * U64(_BASE))


def _block(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes at each place, as many as are left."""
    shift = (8 * np.maximum(0, 8 - left)).astype(U64)
    return (eight[at] << shift) >> shift


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, other: np.ndarray | None = None, step: int = CHUNK) -> np.ndarray:
    """Whether data[a:a+size] equals other[b:b+size] (``data`` itself by default) for each triple."""
    other = data if other is None else other
    out = np.ones(len(a), dtype=bool)
    todo = np.flatnonzero(sizes > 0)
    total = np.cumsum(sizes[todo])
    at = 0
    while at < len(todo):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + step, "right")))
        some = todo[at:to]
        equal = data[ragged(a[some], sizes[some])] == other[ragged(b[some], sizes[some])]
        out[some] = np.logical_and.reduceat(equal, total[at:to] - sizes[some] - done)
        at = to
    return out


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values (over the whole array; the caller drops windows that cross documents)."""
    n = len(values)
    if n < k:
        return np.zeros(0, U64)
    sums = prefix_sums(values * powers(_WORD_BASE, n))
    return mix((sums[k:] - sums[: n - k + 1]) * powers(_WORD_INV, n + 1)[: n - k + 1])


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[starts:ends] for each pair."""
    sums = prefix_sums(values * powers(_WORD_BASE, len(values)))
    return mix((sums[ends] - sums[starts]) * powers(_WORD_INV, len(values) + 1)[starts] + (ends - starts).astype(U64) * U64(0x632BE59BD9B4E019))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .., as one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64, copy=False))


def id_array(ids: np.ndarray) -> pa.Array:
    """Ids as a column; NULL_ID is null again."""
    return pa.array(ids, mask=ids == NULL_ID) if len(ids) else pa.array([], pa.int64())


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words with one space behind each, where each starts and the last one ends)"""
    sizes = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.append(data, np.uint8(32))[ragged(starts, sizes)]
    flat[at[1:] - 1] = 32
    return flat, at


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of each word, number of names): from 1 on, equal for words of equal bytes only. Hashes find equal words, and their bytes are compared."""
    unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    rep = where[back]
    sizes = ends - starts
    same = sizes == sizes[rep]
    at = np.flatnonzero(same & (rep != np.arange(len(rep))))
    same[at] = same_bytes(data, starts[at], starts[rep[at]], sizes[at])
    names = back.astype(np.int64) + 1
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        names[i] = others.setdefault(data[starts[i] : ends[i]].tobytes(), len(unique) + len(others) + 1)
    return names, len(unique) + len(others)
