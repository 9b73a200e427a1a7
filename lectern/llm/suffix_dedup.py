"""Exact substring deduplication on bytes by column-wise suffix construction.

A byte goes if a ``size``-byte string that covers it also starts earlier in the
collection (a smaller document id, or the same document further left).

Anchors: of the ``GRAM``-byte strings inside a window, the one with the least
hash, leftmost of equals. Segments are thus a few dozen windows long, and every
window of the corpus lies in exactly one. The distinct strings of the segments
whose anchor occurs again are the collection whose suffixes are ordered.

Construction, after Bauer, Cox and Rosone ("Lightweight algorithms for
constructing and inverting the BWT of string collections", 2013; common prefixes
after Cox, Garofalo, Rosone and Sciortino): the strings are read from their last
column to their first, and each round inserts one symbol of every string. The
transform holds, in the order of the suffixes, the symbol before each of them; so
the next order is the stable sort of the present one by the transform, and its
common prefixes are one more than the least common prefix between neighbours
with one symbol. Strings of one anchor are aligned at it, and equal windows stand
at equal columns, so a suffix is ordered among those of its own column (the
positional transform of Durbin, 2014). Order, transform and common prefixes live
in files of the shared folder that are read and written from front to back in
every round; the columns are a file that is read backwards, column by column. A
window is repeated where its suffix has a common prefix of ``size`` with that of
an earlier string; these are read from the rounds' records at the end.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import _BASE, _BASE_INV, NULL_ID, U64, byte_values, mix, powers, prefix_sums
from .repeats import HOT, checked, covered, repeated_units, repeats, unpacked
from .session import shared_folder

GRAM = 24


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by block prefixes and suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-(-len(x) // w) * w, x.dtype.type(2**64 - 1), dtype=x.dtype)
    pad[: len(x)] = x
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def byte_segments(offs: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, ...] | None:
    """(key, hash of the content, document index, start in the document, windows, anchor, first byte, bytes) of every segment of a chunk."""
    gram = min(GRAM, size)
    n = len(data)
    if n < size:
        return None
    sums = prefix_sums(byte_values(data) * powers(_BASE, n))
    inverse = powers(_BASE_INV, n + 1)
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
    ranked = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    least = (sliding_min(ranked, size - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offs)
    real = np.flatnonzero(lengths >= size)
    if not len(real):
        return None
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[offs[real]] = 1
    inside[offs[real + 1] - size + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    anchor = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    new |= np.isin(at, offs[real])
    heads = np.flatnonzero(new)
    start, anchor = at[heads], anchor[heads]
    windows = np.diff(np.append(heads, len(at)))
    end = start + windows - 1 + size
    content = mix((sums[end] - sums[start]) * inverse[start] + windows.astype(U64) * U64(0x632BE59BD9B4E019))
    doc = np.searchsorted(offs, start, "right") - 1
    return grams[anchor], content, doc, start - offs[doc], windows, anchor - start, start, end - start


def byte_units(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return data, at[:-1], at[1:], offs


class Scratch:
    """Files of one task in the folder that all share; in memory, as they are small, where that folder isn't a path."""

    def __init__(self, folder: str | None):
        self.folder = folder and os.path.join(folder, uuid.uuid4().hex)
        self.files: dict[str, io.IOBase] = {}

    def __enter__(self) -> Scratch:
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)
        return self

    def __getitem__(self, name: str) -> io.IOBase:
        if name not in self.files:
            self.files[name] = open(os.path.join(self.folder, name), "w+b") if self.folder else io.BytesIO()  # noqa: SIM115
        return self.files[name]

    def __exit__(self, *_) -> None:
        for name, f in self.files.items():
            f.close()
            if self.folder:
                os.remove(os.path.join(self.folder, name))
        if self.folder:
            os.rmdir(self.folder)


_RECORD = np.dtype([("string", "<i4"), ("common", "<i2"), ("symbol", "<i2")])


def repeated_columns(group: np.ndarray, anchor: np.ndarray, raw: list[bytes], size: int, files: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(string, column) of the windows that equal one at the same column of an earlier string of the group. Strings come in order of (group, document, twin, start) and are aligned at their anchors; a window's column counts from the aligned start."""
    m = len(raw)
    lead = int(anchor.max())
    begin = lead - anchor
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=m)
    end = begin + lengths
    columns = int(end.max())
    text = np.zeros((m, columns), dtype=np.uint8)
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    text[np.repeat(np.arange(m), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths - begin, lengths)] = flat
    files["columns"].seek(0)
    files["columns"].write(np.ascontiguousarray(text.T).tobytes())
    del text, flat

    def before(x: int) -> np.ndarray:
        """The symbols at column x - 1, 0 outside of a string."""
        if not x:
            return np.zeros(m, np.int16)
        files["columns"].seek((x - 1) * m)
        symbol = np.frombuffer(files["columns"].read(m), dtype=np.uint8).astype(np.int16) + 1
        symbol[(x - 1 < begin) | (x - 1 >= end)] = 0
        return symbol

    state = np.zeros(m, dtype=_RECORD)
    state["string"] = np.arange(m)
    state["symbol"] = before(columns)
    base = group * 512
    files["found"].seek(0)
    for x in range(columns - 1, -1, -1):
        if x < columns - 1:  # the round before wrote it
            files["state"].seek(0)
            state = np.frombuffer(files["state"].read(m * _RECORD.itemsize), dtype=_RECORD)
        order, common = state["string"], state["common"]
        inserted = base[order] + state["symbol"]
        moved = np.argsort(inserted, kind="stable")
        sorted_ = inserted[moved]
        same = np.flatnonzero((sorted_[1:] == sorted_[:-1]) & (sorted_[1:] % 512 > 0)) + 1
        after = np.zeros(m, dtype=_RECORD)
        after["string"] = order[moved]
        after["common"][same] = np.minimum(range_min(common, moved[same - 1] + 1, moved[same] + 1) + 1, size)
        after["symbol"] = before(x)[after["string"]]
        files["state"].seek(0)
        files["state"].write(after.tobytes())
        if columns - x >= size:
            files["found"].write(after.tobytes())
    rounds = columns - size + 1
    files["found"].seek(0)
    strings, at = [], []
    for x in range(rounds - 1, -1, -1):
        record = np.frombuffer(files["found"].read(m * _RECORD.itemsize), dtype=_RECORD)
        order = record["string"]
        heads = np.flatnonzero(record["common"] < size)
        first = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, m)))
        again = order[(order != first) & (x + size <= end[order]) & (x >= begin[order])]
        strings.append(again)
        at.append(np.full(len(again), x))
    return np.concatenate(strings), np.concatenate(at)


def range_min(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(x[start:end]) for each pair of non-empty ranges, by doubling tables as long as the longest range asks for."""
    out = x[start].copy()
    span = end - start
    level, table = 0, x
    while True:
        here = np.flatnonzero((span >> level) == 1)
        if len(here):
            out[here] = np.minimum(table[start[here]], table[end[here] - (1 << level)])
        level += 1
        if not (span >> level).any():
            return out
        half = 1 << (level - 1)
        table = np.minimum(table[:-half], table[half:])


def shared_windows(size: int, folder: str | None):
    """What ``distinct_strings`` hands over, some strings at a time: places of repeated windows."""

    def take(rows: list[tuple]) -> pa.RecordBatch | None:
        key, place = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 3))
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
        start, _, anchor = unpacked(place)
        with Scratch(folder) as files:
            string, column = repeated_columns(group, anchor, [r[4] for r in rows], size, files)
        if not len(string):
            return None
        order = np.lexsort((column, string))
        string, column = string[order], column[order]
        new = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (column[1:] != column[:-1] + 1))))
        which = string[new]
        return repeats(rows, which, start[which] + column[new] - (anchor.max() - anchor[which]), np.diff(np.append(new, len(string))))

    return take


def _finish(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            texts, again = batch.column(1), batch.column(2)
            flat, cuts = again.values.to_numpy(zero_copy_only=False), again.offsets.to_numpy()
            spans, removed, kept, sizes = [], [], [], []
            for i in range(len(docs)):
                text = (texts[i].as_py() or "").encode("utf-8")
                starts, ends = covered(len(text), flat[cuts[i] : cuts[i + 1]], size) if again[i].is_valid else ((), ())
                digest, at = hashlib.sha256(), 0
                view = memoryview(text)
                for a, b in zip(starts, ends, strict=True):
                    digest.update(view[at:a])
                    at = b
                digest.update(view[at:])
                sizes.append(len(text))
                spans.append(len(starts))
                removed.append(int(sum(ends) - sum(starts)))
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == NULL_ID), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _segments(size: int):
    def segments(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...] | None:
        return byte_segments(offs, data, size)

    return segments


def substring_digests(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, after the bytes of repeated ``size``-byte strings are removed.

    A null text is an empty one. A null id is the least id. Rows that share an
    id and a text are the same document: none of them is earlier than the other.
    Rows of one id with different texts are different documents, ordered by a
    64-bit hash of the text; each loses its own repeats only. An empty table
    gives no rows; other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeated_units(docs, _segments(checked(size)), byte_units, shared_windows(size, folder), _finish(size), schema, size, id_col, text_col, hot=hot)


def _rows(size: int, text_col: str, chars_col: str | None, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again, row = batch.column(1), batch.column(0)
            flat, cuts = again.values.to_numpy(zero_copy_only=False), again.offsets.to_numpy()
            texts = row.field(columns.index(text_col))
            kept = []
            for i in range(len(texts)):
                text = texts[i].as_py()
                if text is not None and again[i].is_valid:
                    raw, at, parts = text.encode("utf-8"), 0, []
                    for a, b in zip(*covered(len(raw), flat[cuts[i] : cuts[i + 1]], size), strict=True):
                        parts.append(raw[at:a])
                        at = b
                    parts.append(raw[at:])
                    text = b"".join(parts).decode("utf-8", "ignore")  # a span can cut a character in two; its other half goes too
                kept.append(text)
            out = []
            for k, c in enumerate(columns):
                column = row.field(k)
                if c == text_col:
                    column = pa.array(kept, column.type)
                elif c == chars_col:
                    column = pa.array([None if t is None else len(t) for t in kept], column.type)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, columns)

    return run


def without_repeats(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with texts without repeated ``size``-byte strings, and their lengths in ``chars_col`` if it exists; null stays null. See ``substring_digests`` for ids."""
    columns = docs.columns
    run = _rows(checked(size), text_col, chars_col if chars_col in columns else None, columns)
    return repeated_units(docs, _segments(size), byte_units, shared_windows(size, shared_folder(docs.sparkSession)), run, docs.schema, size, id_col, text_col, carry=True)
