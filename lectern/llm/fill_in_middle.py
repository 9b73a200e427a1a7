"""Fill-in-middle: texts are cut twice, and prefix, middle and suffix change places between marks.

All rows of a run go through one kernel on their UTF-8 bytes: a lookup gives
each byte its class, two neighbouring classes tell whether a unit starts there,
sums of the starts that begin anew with every document count units, and one
binary search in the sums finds the cuts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import CHUNK, ragged, text_chunks
from .session import ready

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = range(3)
FORMS = ("plain", "psm", "spm")
#: Classes of bytes: inside a code point, a letter or sign, white space, the end of a line, and what stands before a document.
INSIDE, SIGN, BLANK, LINE, NOTHING = range(5)
_CLASS = np.full(256, SIGN, dtype=np.uint8)
_CLASS[0x80:0xC0] = INSIDE
_CLASS[[0x20, 9, 11, 12, 13]] = BLANK
_CLASS[10] = LINE


@lru_cache
def _starts(unit: str) -> np.ndarray:
    """Whether a unit starts at a byte, by the class before it and its own. Words own the white space behind them, lines their end."""
    out = np.zeros((5, 5), dtype=bool)
    if unit == "chars":
        out[:, [SIGN, BLANK, LINE]] = True
    elif unit == "words":
        out[[BLANK, LINE], SIGN] = True
    elif unit == "lines":
        out[LINE, :] = True
    else:
        raise ValueError(f"no unit {unit}: chars, words or lines")
    out[NOTHING, :] = True
    return out


def distinct_marks(marks: tuple[str, ...]) -> tuple[bytes, ...]:
    """The marks as bytes; none may hold, or end with the beginning of, itself or another: then none can arise where a text meets a mark."""
    raw = tuple(m.encode() for m in marks)
    for i, a in enumerate(raw):
        for j, b in enumerate(raw):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks overlap: {marks[i]} and {marks[j]}")
    return raw


def unit_sums(data: np.ndarray, offs: np.ndarray, unit: str) -> np.ndarray:
    """For each byte the number of units that start up to it, over the whole run."""
    classes = _CLASS[data]
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = NOTHING
    return np.cumsum(_starts(unit)[before, classes], dtype=np.int64)


def first_places(data: np.ndarray, offs: np.ndarray, mark: bytes) -> np.ndarray:
    """Where each document holds the mark for the first time, or -1."""
    out = np.full(len(offs) - 1, -1, dtype=np.int64)
    ends = len(data) - len(mark) + 1
    if ends > 0:
        at = np.flatnonzero(data[:ends] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        own = np.searchsorted(offs, at, "right") - 1
        inside = at + len(mark) <= offs[own + 1]
        docs, first = np.unique(own[inside], return_index=True)
        out[docs] = at[inside][first]
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One text for each row of (starts, sizes): its parts of the pool, one behind the other."""
    cuts = np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(pool[ragged(starts.ravel(), sizes.ravel())]))


def transform(data: np.ndarray, offs: np.ndarray, rolls: np.ndarray, unit: str, percent: int, spm_percent: int, marks: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(units, form, units of the prefix, units of the middle, output) of all documents of a run; ``rolls`` has four columns of non-negative integers."""
    sums = unit_sums(data, offs, unit)
    upto = np.concatenate(([0], sums))
    base, n = upto[offs[:-1]], upto[offs[1:]] - upto[offs[:-1]]
    marked = np.zeros(len(n), dtype=bool)
    for m in marks:
        marked |= first_places(data, offs, m) >= 0
    form = np.where((n == 0) | marked | (rolls[:, 2] % 100 >= percent), PLAIN, np.where(rolls[:, 3] % 100 < spm_percent, SPM, PSM))
    ends = np.sort(rolls[:, :2] % (n + 1)[:, None], axis=1)
    places = np.searchsorted(sums, (base[:, None] + ends + 1).ravel()).reshape(-1, 2)
    places = np.where(ends == n[:, None], offs[1:, None], places)  # a cut behind all units is the document's end
    first, second = places.T
    pieces = {"p": (offs[:-1], first), "m": (first, second), "s": (second, offs[1:]), "all": (offs[:-1], offs[1:])}
    pool, at = np.concatenate((data, np.frombuffer(b"".join(marks), np.uint8))), len(data)
    for name, mark in zip("PSM", marks, strict=True):
        pieces[name] = (np.full(len(n), at), np.full(len(n), at + len(mark)))
        at += len(mark)
    starts, sizes = np.zeros((len(n), 6), np.int64), np.zeros((len(n), 6), np.int64)
    for code, order in ((PLAIN, ("all",)), (PSM, "PpSsMm"), (SPM, "SsPpMm")):
        rows = form == code
        for k, name in enumerate(order):
            a, b = pieces[name]
            starts[rows, k], sizes[rows, k] = a[rows], (b - a)[rows]
    return n, form, ends[:, 0], ends[:, 1] - ends[:, 0], gathered(pool, starts, sizes)


def restored(data: np.ndarray, offs: np.ndarray, form: np.ndarray, marks: tuple[bytes, ...]) -> pa.Array:
    """The texts that outputs of these forms were made of, found by the marks; null where they aren't as the form has them."""
    p, s, m = (first_places(data, offs, x) for x in marks)
    lengths = [len(x) for x in marks]
    a, b = offs[:-1], offs[1:]
    psm, spm, plain = form == PSM, form == SPM, form == PLAIN
    good = plain | (psm & (p == a) & (p < s) & (s < m)) | (spm & (s == a) & (s < p) & (p < m))
    prefix = (p + lengths[0], np.where(psm, s, m))
    suffix = (s + lengths[1], np.where(psm, m, p))
    middle = (m + lengths[2], b)
    starts = np.stack([np.where(plain, a, prefix[0]), middle[0], suffix[0]], axis=1)
    ends = np.stack([np.where(plain, b, prefix[1]), np.where(plain, middle[0], middle[1]), np.where(plain, suffix[0], suffix[1])], axis=1)
    texts = gathered(data, np.where(good[:, None], starts, 0), np.where(good[:, None], ends - starts, 0))
    return pa.StringArray.from_buffers(len(texts), *texts.buffers()[1:], pa.array(good).buffers()[1]) if not good.all() else texts


def _transformed(unit: str, percent: int, spm_percent: int, marks: tuple[bytes, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rolls = np.stack([batch.column(2 + k).to_numpy() for k in range(4)], axis=1) if batch.num_rows else np.zeros((0, 4), np.int64)
            for i, j, _, offs, data in text_chunks(batch, limit=4 * CHUNK):
                n, form, prefix, middle, output = transform(data, offs, rolls[i:j], unit, percent, spm_percent, marks)
                none = form == PLAIN
                cols = [batch.column(0).slice(i, j - i), pa.array(n), pa.array(np.array(FORMS)[form]), pa.array(prefix, mask=none), pa.array(middle, mask=none), output]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_units", "form", "prefix_units", "middle_units", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = "chars", percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n_units, form, prefix_units, middle_units, output) of every row.

    The cuts and the form follow from a digest of the seed and the id alone, so
    a lost task gives the same rows again, and rows of one id are cut by the same
    numbers; a null id is hashed as an empty one. A null or empty text, one that
    holds a mark, and ``100 - percent`` of all are plain: the output is the text,
    and there are no cuts. Of the others ``spm_percent`` start with the suffix.
    A unit is a code point, a word with the white space behind it, or a line.
    Columns other than the two are not read; an empty table gives no rows. No
    shuffle; memory follows the longest text.
    """
    ready(docs.sparkSession)
    raw = distinct_marks(marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rolls = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rolls)
    return rows.mapInArrow(_transformed(unit, percent, spm_percent, raw), "doc_id long, n_units long, form string, prefix_units long, middle_units long, output string")


def _undone(marks: tuple[bytes, ...], output_col: str, form_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([FORMS.index(f) if f in FORMS else -1 for f in batch.column(batch.schema.get_field_index(form_col)).to_pylist()], dtype=np.int64)
            place = batch.schema.get_field_index(output_col)
            codes[batch.column(place).is_null().to_numpy(zero_copy_only=False)] = -1
            ids = pa.array(np.zeros(batch.num_rows, np.int64))
            for i, j, _, offs, data in text_chunks(pa.RecordBatch.from_arrays([ids, batch.column(place)], ["doc_id", "text"]), limit=4 * CHUNK):
                part = batch.slice(i, j - i)
                keep = [k for k, name in enumerate(part.schema.names) if name != "restored"]
                cols = [*(part.column(k) for k in keep), restored(data, offs, codes[i:j], marks)]
                yield pa.RecordBatch.from_arrays(cols, [*(part.schema.names[k] for k in keep), "restored"])

    return run


def restore_middle(rows: DataFrame, output_col: str = "output", form_col: str = "form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """All rows and columns, and ``restored``: the text, from the output and its form alone. It is null if either is null or the marks aren't as the form has them; a column of that name is replaced."""
    ready(rows.sparkSession)
    fields = [f for f in rows.schema.fields if f.name != "restored"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(_undone(distinct_marks(marks), output_col, form_col), f"{schema}, restored string")


def middle_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row; see ``fill_in_middle`` for nulls, ties and empty tables."""
    rows = restore_middle(fill_in_middle(docs, id_col, text_col))
    return rows.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
