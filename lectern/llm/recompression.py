r"""Exact substring deduplication on words by recompression.

A word (``[^\x20\x09-\x0D]+``) goes if a window of ``size`` words that covers it
also starts earlier in the collection.

Recompression (Jez, "Recompression: a simple and powerful technique for word
equations", 2013) renames a sequence in rounds. A round first takes every
maximal run ``a a .. a`` as one, then splits the letters in two classes by their
names and joins each run of a left letter with the run of a right letter behind
it. The joined pair gets a name of its own. Names are functions of what they
stand for (a 64-bit hash of the letters, the lengths of their runs and the
round), so all partitions name alike, in every round, without asking each other.

Whether a symbol arises depends on its own words and on the neighbours that end
its runs. These words are its *context*, kept beside it. So a symbol whose
context lies within a window arises in every copy of the window, at the same
place. Rounds go on until no symbol has a context of a third of a window at most;
longer ones lie in few windows and would cut the text into many short segments.
The highest-level symbol with the least name, leftmost of equals, is the window's
anchor; single words, which need no context, are always there. An
anchor's key holds the words of its context too, as the window fixes them as
well, and few texts share that much by chance. Symbols that occur again reveal
repeats: the windows around them meet and are compared by their words, so two
strings of one name cost a comparison and never a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import NULL_ID, U64, mix, ragged, range_hashes, spaced, split_words, text_chunks, word_hashes
from .repeats import HOT, checked, covered, repeated_units, repeats

FAR = 1 << 40


class Symbols:
    """The symbols of one level: names, first and last word (half-open), context, and whether the next symbol is of the same document."""

    def __init__(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray):
        self.name, self.start, self.end, self.left, self.right, self.linked = name, start, end, left, right, linked


def words_as_symbols(names: np.ndarray, bounds: np.ndarray) -> Symbols:
    n = len(names)
    at = np.arange(n)
    linked = np.ones(n, dtype=bool)
    linked[bounds[1:][bounds[1:] > 0] - 1] = False
    return Symbols(names, at, at + 1, at, at + 1, linked)


def recompress(s: Symbols, turn: int) -> Symbols:
    """One round: maximal runs, then pairs of a left run and a right run."""
    n = len(s.name)
    if not n:
        return s
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (s.name[1:] != s.name[:-1]) | ~s.linked[:-1]
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], n) - 1
    letter = s.name[head]
    salted = mix(letter + mix(np.array([turn], dtype=U64)))
    run = mix(salted + (tail - head + 1).astype(U64) * U64(0xE7037ED1A0B428DB))
    first_class = (salted >> U64(17)) & U64(1) == 0
    pair = np.zeros(len(head), dtype=bool)
    pair[:-1] = first_class[:-1] & ~first_class[1:] & s.linked[tail[:-1]]
    lead = np.ones(len(head), dtype=bool)
    lead[1:] = ~pair[:-1]
    a = np.flatnonzero(lead)
    b = a + pair[a]
    name = np.where(pair[a], mix(run[a] * U64(0x8EBC6AF09C88C6E3) + run[b]), run[a])
    i, j = head[a], tail[b]
    outer_left = np.where((i > 0) & s.linked[np.maximum(i - 1, 0)], s.left[np.maximum(i - 1, 0)], -FAR)
    outer_right = np.where((j < n - 1) & s.linked[j], s.right[np.minimum(j + 1, n - 1)], FAR)
    own_left, own_right = np.minimum.reduceat(s.left, i), np.maximum.reduceat(s.right, i)
    return Symbols(name, s.start[i], s.end[j], np.minimum(outer_left, own_left), np.maximum(outer_right, own_right), s.linked[j])


def anchors(names: np.ndarray, bounds: np.ndarray, size: int, rounds: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, word) of the anchor of the window that starts at each word; a window that leaves its document gets something that means nothing. Rounds go on as long as they give symbols with a context of ``most`` words (a third of ``size`` by default), or ``rounds`` times."""
    n, most = len(names), most or max(1, size // 3)
    best = np.full(n, 2**64 - 1, dtype=U64)  # 63 - level, 26 bits of the name's rank, word
    level_names = []
    s, level = words_as_symbols(names, bounds), 0
    while True:
        room = size - (s.right - s.left)
        fits = np.flatnonzero(room >= size - most)
        if not len(fits):
            break
        rank = mix(s.name + U64(level))
        key = (U64(63 - level) << U64(58)) | ((rank >> U64(38)) << U64(32)) | s.start.astype(U64)
        of_word = np.zeros(n, dtype=U64)
        of_word[s.start[fits]] = range_hashes(names, s.left[fits], s.right[fits]) + U64(level)
        level_names.append(of_word)
        at, key, room = s.left[fits], key[fits], room[fits]
        for back in range(size):
            ok = room >= back
            if not ok.all():
                at, key, room = at[ok], key[ok], room[ok]
            if not len(at):
                break
            to = at - back
            if to[0] < 0:
                inside = to >= 0
                best[to[inside]] = np.minimum(best[to[inside]], key[inside])
            else:
                best[to] = np.minimum(best[to], key)
        level += 1
        if level == 64 or (rounds is not None and level > rounds):
            break
        s = recompress(s, level)
    word = (best & U64(0xFFFFFFFF)).astype(np.int64)
    own = 63 - (best >> U64(58)).astype(np.int64)
    keys = np.zeros(n, dtype=U64)
    known = best != U64(2**64 - 1)
    for k, of_word in enumerate(level_names):
        on = known & (own == k)
        keys[on] = of_word[word[on]]
    return keys, np.where(known, word, -1)


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, document index) of every window of a chunk."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return ragged(bounds[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def _segments(size: int, rounds: int | None):
    def segments(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...] | None:
        starts, ends, bounds = split_words(data, offs)
        at, doc = window_starts(bounds, size)
        if not len(at):
            return None
        names = word_hashes(data, starts, ends)
        keys, word = anchors(names, bounds, size, rounds)
        key, anchor = keys[at], word[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        first, windows = at[heads], np.diff(np.append(heads, len(at)))
        end = first + windows - 1 + size
        own = doc[heads]
        return key[heads], range_hashes(names, first, end), own, first - bounds[own], windows, 0, starts[first], ends[end - 1] - starts[first]

    return segments


def word_units(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk, with one space behind each."""
    starts, ends, bounds = split_words(data, offs)
    flat, at = spaced(data, starts, ends)
    return flat, at[:-1], at[1:] - 1, bounds


def shared_windows(size: int):
    """What ``distinct_strings`` hands over, some strings at a time: places of windows whose words an earlier string of the key has too. A shared symbol lies in all of them."""

    def take(rows: list[tuple]) -> pa.RecordBatch | None:
        which, places, seen, of = [], [], set(), None
        for i, (key, _, _, place, string) in enumerate(rows):
            if key != of:
                seen, of = set(), key
            cuts = [-1, *(k for k, c in enumerate(string) if c == 32), len(string)]
            start = place >> 28
            for k in range(len(cuts) - size):
                window = string[cuts[k] + 1 : cuts[k + size]]
                if window in seen:
                    which.append(i)
                    places.append(start + k)
                else:
                    seen.add(window)
        return repeats(rows, np.array(which), np.array(places), np.ones(len(which), np.int64)) if which else None

    return take


def _finish(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            again = batch.column(2)
            flat, cuts = again.values.to_numpy(zero_copy_only=False), again.offsets.to_numpy()
            for first, _, ids, offs, data in text_chunks(batch, "doc", "text"):
                starts, ends, bounds = split_words(data, offs)
                kept = np.ones(len(starts), dtype=bool)
                for k in range(len(ids)):
                    if again[first + k].is_valid:
                        a, n = int(bounds[k]), int(bounds[k + 1] - bounds[k])
                        for s, e in zip(*covered(n, flat[cuts[first + k] : cuts[first + k + 1]], size), strict=True):
                            kept[a + s : a + e] = False
                some = np.flatnonzero(kept)
                text, ends_at = spaced(data, starts[some], ends[some])
                raw = memoryview(text.tobytes())
                own = ends_at[np.searchsorted(some, bounds)]
                n_words = np.diff(bounds)
                n_kept = np.diff(np.searchsorted(some, bounds))
                digests = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(n_words), pa.array(n_words - n_kept), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def word_dedup_digests(docs: DataFrame, size: int = 20, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, after the words of repeated ``size``-word windows are removed.

    A null text has no words. A null id is the least id. Rows that share an id
    and a text are the same document: none of them is earlier than the other.
    Rows of one id with different texts are different documents, ordered by a
    64-bit hash of the text; each loses its own repeats only. An empty table
    gives no rows; other columns are not read. ``rounds`` bounds the rounds of
    recompression, which changes the cost and not the result.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return repeated_units(docs, _segments(checked(size), rounds), word_units, shared_windows(size), _finish(size), schema, size, id_col, text_col, hot=hot)


__all__ = ["anchors", "recompress", "word_dedup_digests", "words_as_symbols"]
