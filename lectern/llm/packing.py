"""Best-fit packing of token sequences, certified by dual-feasible functions.

1. Every document is tokenised and cut into pieces of at most ``capacity`` ids
   (only a longer document is cut, and only its first piece may be shorter).
2. The pieces are dealt to partitions of bounded size by a hash. Each partition
   packs its own by best-fit decreasing and bounds its optimum from below with
   dual-feasible functions. Where bins equal the bound, the count is certified.
3. A partition with a gap gives the documents of its emptiest bins away, and a
   certified one those of the last bins that its own rounding up may cost. They
   meet in fewer partitions, which repeat step 2, until a single one is left.
   What a partition gives away is bounded, so each next one is bounded too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import CHUNK, id_array, ragged, text_chunks
from .pretokens import Vocabulary, list_ids
from .session import ready

#: Pieces in a partition of the first round, partitions that meet in one of the next, and pieces that one may give away.
ROWS = 40_000
MEET = 8
GIVEN = 5_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_made: dict[str, TextIds] = {}


class TextIds:
    """Ids by the library tokenizers, as it gives them for whole texts. A text without a string of an added token falls into pre-tokens, of which each distinct one is encoded once; one with such a string is encoded as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = Vocabulary(lambda words: encode_words(self.tokenizer, words))

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of a chunk of texts."""
        raw = data.tobytes()
        whole = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(offs, at, "right")) - 1
                if at + len(token) <= offs[k + 1]:
                    whole.add(k)
                at = raw.find(token, at + 1)
        ids, bounds = self.vocabulary.ids(data, offs)
        if not whole:
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in whole:
            text = raw[offs[k] : offs[k + 1]].decode("utf-8")
            parts[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def clear(self) -> None:
        self.vocabulary.clear()


def tokenizer_ids(path: str) -> TextIds:
    """Made once in each process."""
    if path not in _made:
        _made[path] = TextIds(path)
    return _made[path]


def encode_words(tokenizer, words: list[bytes], together: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each pre-token). Those of a space and letters are encoded ``together``, as a text of them falls into the same pre-tokens again; the others one by one."""
    texts = [w.decode("utf-8") for w in words]
    spaced = [i for i, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
    sizes = np.zeros(len(words), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (pre-tokens, their ids)
    alone = set(range(len(texts))).difference(spaced)
    for at in range(0, len(spaced), together):
        some = np.array(spaced[at : at + together])
        e = tokenizer.encode("".join([texts[i] for i in some.tolist()]), add_special_tokens=False)
        each = np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(some))
        if len(each) == len(some) and each.all():
            sizes[some] = each
            parts.append((some, np.array(e.ids, dtype=np.int32)))
        else:
            alone.update(some.tolist())
    rest = np.array(sorted(alone), dtype=np.int64)
    ids, sizes[rest] = list_ids([e.ids for e in tokenizer.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False)])
    parts.append((rest, ids))
    out = np.empty(int(sizes.sum()), dtype=np.int32)
    starts = np.cumsum(sizes) - sizes
    for some, ids in parts:
        out[ragged(starts[some], sizes[some])] = ids
    return out, sizes


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = tokenizer_ids(path)
        for batch in batches:
            for _, _, ids, offs, data in text_chunks(batch, limit=2 * CHUNK):
                tokens, cuts = vocabulary.ids(data, offs)
                docs, piece, start, length, crc = [], [], [], [], []
                for doc, a, b in zip(ids.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    own = np.append(tokens[a:b], end_id).astype("<u4")
                    at, k = 0, 0
                    while at < len(own):
                        to = at + ((len(own) - at) % capacity or capacity)
                        docs.append(doc)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(own[at:to].tobytes()))
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays([id_array(np.array(docs, dtype=np.int64)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        vocabulary.clear()  # the process lives on for other tasks

    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions u(k) and f(e) of Fekete and Schepers over all k up to 100 and all e up to half the capacity."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)  # exact integers
    count = np.array([int(c) for c in count], dtype=np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 101):
        scaled = size * (k + 1)
        u = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    mass = np.cumsum(count * size)
    many = np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        top = int(many[-1] - many[capacity - e])
        best = max(best, -(-(top * capacity + int(mass[capacity - e] - mass[e - 1])) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which must not increase, and the room left in each bin: every piece goes to the fullest bin that takes it."""
    bins, offsets, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i, n in enumerate(lengths.tolist()):
        fit = open_rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = left = r - n
        if left:
            if not by_room[left]:
                open_rooms |= 1 << left
            by_room[left].append(b)
    return bins, offsets, np.array(room, dtype=np.int64)


def given_away(room: np.ndarray, bins: np.ndarray, gap: int, capacity: int, most: int) -> np.ndarray:
    """Which bins a partition opens again: the emptiest ones, until their room holds two bins and four times the gap, within ``most`` pieces. Without a gap it is only what its rounding up may cost."""
    order = np.argsort(-room, kind="stable")
    pieces = np.bincount(bins, minlength=len(room))[order]
    enough = np.cumsum(room[order]) - room[order] < (4 * gap + 2) * capacity
    keep = enough & (room[order] > 0) & (np.cumsum(pieces) <= most)
    out = np.zeros(len(room), dtype=bool)
    out[order[keep]] = True
    return out


def _pack(capacity: int, turn: int, last: bool, given: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.select(_NAMES).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        reopened = given_away(room, bins, len(room) - bound, capacity, given) if not last else np.zeros(len(room), dtype=bool)
        first = (turn << 56) + (TaskContext.get().partitionId() << 28)
        same = lambda n: pa.array(np.full(len(lengths), n))
        for name, column in (("sequence_id", pa.array(bins + first)), ("offset", pa.array(offsets)), ("partition_bins", same(len(room))), ("partition_bound", same(bound)), ("again", pa.array(reopened[bins]))):
            rows = rows.append_column(name, column)
        yield from rows.combine_chunks().to_batches()

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bins, partition_bound): a row for every piece of every document.

    The last two tell how many bins the partition that packed the piece made, and
    how many any packing of its pieces needs; where they are equal, its count is
    certified. A null or empty text is one piece that holds the end id alone. Null
    and repeated ids are documents like others. An empty table gives no rows;
    other columns are not read.
    """
    ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pool = texts.mapInArrow(_pieces(path, capacity, end_id), _PIECE).checkpoint()
    parts = max(1, math.ceil(pool.count() / rows))
    done, turn = [], 0
    while True:
        # the pool lies in files, so the numbers of its rows stay the same when a task runs again; pieces that are equal in every column spread as well
        dealt = pool.withColumn("_n", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("_n", F.lit(turn)))
        packed = dealt.mapInArrow(_pack(capacity, turn, parts == 1, min(GIVEN, rows // 2)), f"{_PIECE}, sequence_id long, offset long, partition_bins long, partition_bound long, again boolean")
        packed = packed.checkpoint()  # read twice; both must see the same bins
        done.append(packed.filter("not again").drop("again"))
        if parts == 1:
            break
        pool = packed.filter("again").select(*_NAMES)
        parts, turn = math.ceil(parts / MEET), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
