"""Windows that occur again: the plan that the two substring operators share.

A window is ``size`` consecutive units (bytes or words) of one document. Each
operator names, for every window, an *anchor* inside it by a rule that depends
on the window's content alone. So equal windows have equal anchors at equal
places, and neighbouring windows that share one anchor form a *segment*:

1. Every segment becomes a row (key of the anchor, document, place). Segments of
   one batch that are equal, byte by byte, shrink to their first before anything
   is shuffled; the others are known to be repeated.
2. Rows meet by key. A key of one row needs no more; the others are *asked*.
3. The asked segments' units go out as strings and meet by key, in order. A
   string equal to the one before it is repeated whole; the distinct strings of
   a key go to the operator, which finds the windows that they share. Nothing is
   removed on the word of a hash: strings and windows are compared themselves.
4. What repeats returns to the documents, which drop those units.

A key with more than ``hot`` rows, such as that of a footer with another context
in every document, is not gathered: its windows go out one by one and are dealt
by key and window, so they spread over all tasks and stream by in order.

Steps 3 and 4 read the same exchange of the documents by id, which Spark writes
once. Places are packed in one long: start << 28 | windows << 14 | anchor; a
negative value marks a segment that is known to be repeated.

Rows are told apart by (document id, ``twin``): the twin is a hash of the text
if some id of the table, null included, stands for different texts, and else 0,
which takes next to no room in the exchanges. Rows of one id are ordered by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import CHUNK, NULL_ID, U64, as_long, mix, ragged, same_bytes, text_arrays, text_chunks, word_hashes
from .session import ready, width, written

SEGMENT = "key long, doc long, twin long, place long"
#: part: 0 for strings of segments, else a hash of the single window of a hot key
STRING = "key long, part long, doc long, twin long, place long, string binary"
AGAIN = "doc long, twin long, place long"
#: Rows of one key that meet as strings at most.
HOT = 1 << 13
#: Bytes of strings that an operator gets at once; those of one key always come together.
COLLECTION = 1 << 20
#: 48 bits of a key are enough to let most segments meet none by chance, and take less room.
KEY_BITS = U64(2**48 - 1)
#: Windows are packed in places by 14 bits.
MOST = (1 << 14) - 1

Rows = tuple[np.ndarray, ...]


def packed(start: np.ndarray, windows: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    return (start << 28) | (windows << 14) | anchor


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor)"""
    return place >> 28, (place >> 14) & MOST, place & MOST


def checked(size: int) -> int:
    if not 1 <= size <= MOST:
        raise ValueError(f"windows of 1 to {MOST} units, not {size}")
    return size


def segment_rows(segments: Callable[[np.ndarray, np.ndarray], Rows | None]):
    """Step 1. ``segments`` takes (offs, data) of a chunk and returns (key, hash of the content, document index, start, windows, anchor, first byte, bytes) of its segments, in order, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offs, data = text_arrays(batch, "doc", "text")
            twin = batch.column(batch.schema.get_field_index("twin")).to_numpy()
            parts = []
            for a, b, _, own, chunk in text_chunks(batch, "doc", "text"):
                if (got := segments(own, chunk)) is not None:
                    key, content, doc, start, windows, anchor, at, sizes = got
                    parts.append((key, content, doc + a, packed(start, windows, anchor), at + offs[a], sizes))
            if not parts:
                continue
            key, content, row, place, at, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((twin, ids))] = np.arange(len(ids))
            both = mix(key + mix(content))
            order = np.lexsort((rank[row], both))
            key, both, row, place, at, sizes = (x[order] for x in (key, both, row, place, at, sizes))
            doc, twins_ = ids[row], twin[row]
            again = np.zeros(len(key), dtype=bool)
            again[1:] = both[1:] == both[:-1]
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            later = np.flatnonzero(again)
            f = first[later]
            again[later] = (key[later] == key[f]) & (sizes[later] == sizes[f])
            later, f = later[again[later]], f[again[later]]
            again[later] = same_bytes(data, at[f], at[later], sizes[later])
            same = again & (doc == doc[first]) & (twins_ == twins_[first]) & (place == place[first])  # the same row twice
            key = np.where(again, mix(doc.astype(U64) ^ twins_.astype(U64) ^ place.astype(U64)), key) & KEY_BITS
            place = np.where(again, -place - 1, place)
            keep = ~same
            yield pa.RecordBatch.from_arrays([as_long(key[keep]), pa.array(doc[keep]), pa.array(twins_[keep]), pa.array(place[keep])], ["key", "doc", "twin", "place"])

    return run


def string_rows(units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int, text_col: str):
    """Step 3, before the exchange: the strings of (doc, twin, text, asked). ``units`` takes (offs, data) of a chunk and returns (bytes, first byte of each unit, end of each unit, first unit of each document)."""

    def made(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, u: np.ndarray, many: np.ndarray, columns: Rows, part: bool) -> Iterator[pa.RecordBatch]:
        """Rows of the strings of ``many`` units from unit ``u`` on, in batches of bounded size."""
        a, sizes = begin[u], end[u + many - 1] - begin[u]
        total = np.cumsum(sizes)
        at = 0
        while at < len(u):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * CHUNK, "right")))
            some = slice(at, to)
            offsets = np.concatenate(([0], np.cumsum(sizes[some])))
            raw = flat[ragged(a[some], sizes[some])]
            parts = np.zeros(to - at, np.int64)
            if part:
                parts = (word_hashes(raw, offsets[:-1], offsets[1:]) | U64(1)).view(np.int64)
            strings = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())])
            key, doc, twin, place = (x[some] for x in columns)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(parts), pa.array(doc), pa.array(twin), pa.array(place), strings], ["key", "part", "doc", "twin", "place", "string"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(0), text_of(batch.column(2), text_col)], ["doc", "text"])
            twin, asked = batch.column(1).to_numpy(), batch.column(3)
            cuts = asked.offsets.to_numpy()
            keys, places, hot = (asked.values.field(name).to_numpy(zero_copy_only=False) for name in ("key", "place", "hot"))
            for a, b, ids, offs, data in text_chunks(texts, "doc", "text"):
                flat, begin, end, bounds = units(offs, data)
                row = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
                key, place, warm = (x[cuts[a] : cuts[b]] for x in (keys, places, hot))
                start, windows, _ = unpacked(place)
                fits = start + windows - 1 + size <= np.diff(bounds)[row]
                u = start + bounds[row]
                some = np.flatnonzero(fits & ~warm)
                yield from made(flat, begin, end, u[some], windows[some] - 1 + size, (key[some], ids[row[some]], twin[a:b][row[some]], place[some]), False)
                some = np.flatnonzero(fits & warm)
                step = max(1, CHUNK // (size * 8))
                for at in range(0, len(some), step):
                    part = some[at : at + step]
                    own = np.repeat(part, windows[part])
                    each = ragged(u[part], windows[part])
                    yield from made(flat, begin, end, each, np.full(len(each), size), (key[own], ids[row[own]], twin[a:b][row[own]], packed(each - bounds[row[own]], np.ones(len(each), np.int64))), True)

    return run


def distinct_strings(take: Callable[[list[tuple]], pa.RecordBatch | None]):
    """Step 3, behind the exchange. Rows sorted by (key, part, string, doc, twin, place): places of repeats, negative. ``take`` gets the distinct strings of some keys with several, each as (key, doc, twin, place, string) of its first row."""

    def kept(held: list[tuple]) -> list[tuple]:
        several = [i for i in range(len(held)) if (i and held[i - 1][0] == held[i][0]) or (i + 1 < len(held) and held[i + 1][0] == held[i][0])]
        return sorted((held[i] for i in several), key=lambda r: r[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key, part, doc, twin, place = (b.column(i).to_numpy() for i in range(5))
            strings = b.column(5)
            new = np.ones(n, dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | ~pc.equal(strings.slice(1), strings.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if last is not None:
                new[0] = (key[0], part[0], strings[0].as_py()) != last[:3]
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            head = heads[np.maximum(group, 0)] if len(heads) else np.zeros(n, np.int64)
            firsts = [np.where(group >= 0, x[head], last[3 + i] if last is not None else 0) for i, x in enumerate((doc, twin, place))]
            again = ~new & ((doc != firsts[0]) | (twin != firsts[1]) | (place != firsts[2]))
            if again.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(twin[again]), pa.array(-place[again] - 1)], ["doc", "twin", "place"])
            if len(heads):
                h = int(heads[-1])
                last = int(key[h]), int(part[h]), strings[h].as_py(), int(doc[h]), int(twin[h]), int(place[h])
            whole = heads[part[heads] == 0]
            for row in zip(key[whole].tolist(), doc[whole].tolist(), twin[whole].tolist(), place[whole].tolist(), strings.take(pa.array(whole)).to_pylist(), strict=True):
                if size >= COLLECTION and row[0] != held[-1][0]:
                    if (some := kept(held)) and (out := take(some)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if (some := kept(held)) and (out := take(some)) is not None:
            yield out

    return run


def twins(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, list[str]]:
    """The column that tells rows of one id apart by their texts, 0 if every id has one text, and the columns to meet by; Spark would take a constant out of some of them and shuffle the documents twice. A null text is an empty one."""
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    mixed = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("twin")).groupBy("doc").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).filter("a <> b")
    return (F.lit(0).cast("long"), ["doc"]) if mixed.isEmpty() else (text, ["doc", "twin"])


def repeated_units(
    docs: DataFrame,
    segments: Callable[[np.ndarray, np.ndarray], Rows | None],
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]],
    take: Callable[[list[tuple]], pa.RecordBatch | None],
    finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema,
    size: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    hot: int = HOT,
) -> DataFrame:
    """Run the four steps; see ``segment_rows``, ``string_rows`` and ``distinct_strings`` for the operator's parts. ``finish`` takes (doc, text, again: array of negative places), or with ``carry`` (row, again), and makes the result's rows. With ``carry`` the whole row stands for the text, as a struct (see ``text_of``), so that both steps still read one exchange."""
    ready(docs.sparkSession)
    n = width(docs)
    twin, keys = twins(docs, id_col, text_col)
    row_key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), twin.alias("twin")
    texts = docs.select(*row_key, F.col(text_col).alias("text"))
    rows = texts.mapInArrow(segment_rows(segments), SEGMENT).repartition(2 * n, "key")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1 or place < 0")
    found = written(rows.select("doc", "twin", "key", "place", (F.col("n") > hot).alias("hot")))
    body = F.struct(*[docs[c] for c in docs.columns]).alias("row") if carry else F.col(text_col).alias("text")
    by_id = docs.select(body, *row_key).repartition(n, *keys)
    name = "row" if carry else "text"
    asked = found.filter("place >= 0").groupBy(*keys).agg(F.collect_list(F.struct("key", "place", "hot")).alias("asked"))
    strings = by_id.join(asked, keys).select("doc", "twin", name, "asked").mapInArrow(string_rows(units, size, text_col), STRING)
    again = strings.repartition(n, "key", "part").sortWithinPartitions("key", "part", "string", "doc", "twin", "place").mapInArrow(distinct_strings(take), AGAIN)
    spans = found.filter("place < 0").select("doc", "twin", "place").union(again).groupBy(*keys).agg(F.collect_list("place").alias("again"))
    return by_id.join(spans, keys, "left").select(*(["row"] if carry else ["doc", "text"]), "again").mapInArrow(finish, schema)


def text_of(column: pa.Array, text_col: str) -> pa.Array:
    """The texts of a column that holds texts or whole rows."""
    return column.field(text_col) if pa.types.is_struct(column.type) else column


def repeats(rows: list[tuple], which: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Negative places of ``windows`` windows from ``start`` on, in the documents of the rows (key, doc, twin, ..) numbered ``which``."""
    doc, twin = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(doc[which]), pa.array(twin[which]), pa.array(-packed(start, windows) - 1)], ["doc", "twin", "place"])


def covered(n: int, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged intervals [start, end) of the units that the windows at negative ``places`` cover, within n units."""
    start, windows, _ = unpacked(-places - 1)
    end = np.minimum(start + windows - 1 + size, n)
    start = np.minimum(start, n)
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    if not len(s):
        return s, e
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    s, e = s[new], e[np.concatenate((new[1:] - 1, [len(s) - 1]))]
    real = e > s
    return s[real], e[real]
