r"""Vectorised pre-tokenisation by the public byte-level pattern.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``
cuts a text at places that depend on character classes alone, so one pass over
a chunk's code points finds every cut:

* a run of letters, numbers or other characters starts a token, unless a space
  (U+0020) stands before it: then the token starts at that space;
* a run of white space keeps its last character back if something follows;
  that character is the space above, or a token of its own;
* an apostrophe that starts a token takes one of the seven endings with it, and
  a new token starts behind them.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from .arrays import ragged, same_bytes, word_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White_Space of Unicode (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point, made once in each process."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        got = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
        got[WHITE] = SPACE
        _classes = got
    return _classes


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) in bytes: every token of a chunk of whole UTF-8 texts; document k has tokens bounds[k]:bounds[k+1]."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, np.zeros(len(offs), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    doc = np.searchsorted(at_byte, offs)  # of each document, its first code point
    first = np.zeros(n + 1, dtype=bool)
    first[doc] = True
    first = first[:n]
    cls = classes()[points]
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    # white space: the last character of a run that something follows
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start = run | follows
    joined = np.zeros(n, dtype=bool)
    joined[1:] = run[1:] & ~space[1:] & ~first[1:] & (points[:-1] == 0x20)
    start &= ~joined
    _endings(points, cls, run, first, start)
    begins = np.flatnonzero(start)
    starts = at_byte[begins]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(begins, doc)


def _endings(points: np.ndarray, cls: np.ndarray, run: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Let apostrophes that start a token take their ending."""
    n = len(points)
    at = np.flatnonzero((points == 0x27) & start)
    at = at[(at + 1 < n)]
    at = at[(cls[at + 1] == LETTER) & ~first[at + 1]]
    if not len(at):
        return
    one = points[at + 1]
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    two = np.full(len(at), 0, dtype=np.uint32)
    has = at + 2 < n
    has[has] &= ~run[at[has] + 2]
    two[has] = points[at[has] + 2]
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    behind = at + 1 + size
    ok = behind < n
    behind = behind[ok]
    inside = ~run[behind]
    start[behind[inside]] = True


class Vocabulary:
    """Ids of pre-tokens: each distinct one is encoded once and kept, with its bytes, up to ``most`` of them (or ``most_bytes``) at a time.

    Pre-tokens are found by a hash and then compared byte by byte; one that meets
    another by its hash alone is kept by its bytes instead.
    """

    def __init__(self, encode, most: int = 300_000, most_bytes: int = 64 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.others: dict[bytes, int] = {}
        self.count = 0
        self.ids_of, self.bytes_of = Pool(np.int32), Pool(np.uint8)

    def add(self, words: list[bytes]) -> np.ndarray:
        """Encode new words; their slots."""
        ids, sizes = self.encode(words)
        self.ids_of.add(ids, sizes)
        self.bytes_of.add(np.frombuffer(b"".join(words), dtype=np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        self.count += len(words)
        return np.arange(self.count - len(words), self.count)

    def slots_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        unique, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.count and (self.count + len(unique) > self.most or self.bytes_of.used > self.most_bytes):
            self.clear()
        hashes = unique.tolist()
        get = self.slots.get
        slot = np.fromiter((get(h, -1) for h in hashes), dtype=np.int64, count=len(hashes))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self.add(words_at(data, starts[where[new]], ends[where[new]]))
            self.slots.update(zip([hashes[i] for i in new.tolist()], slot[new].tolist(), strict=True))
        each = slot[back]
        sizes = ends - starts
        same = self.bytes_of.size[each] == sizes
        at = np.flatnonzero(same)
        same[at] = same_bytes(data, starts[at], self.bytes_of.start[each[at]], sizes[at], self.bytes_of.pool)
        for i in np.flatnonzero(~same).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in self.others:
                self.others[word] = int(self.add([word])[0])
            each[i] = self.others[word]
        return each

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the token ids of a chunk, and of each document its first one."""
        starts, ends, bounds = pretokens(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        each = self.slots_of(data, starts, ends)
        sizes = self.ids_of.size[each]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids_of.pool[ragged(self.ids_of.start[each], sizes)], cuts[bounds]


class Pool:
    """Sequences of one type, end to end, by the number in which they came."""

    def __init__(self, dtype):
        self.pool, self.used, self.count = np.zeros(1 << 16, dtype=dtype), 0, 0
        self.start, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(sizes)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(flat), len(self.pool)), self.pool.dtype)))
        if self.count + n > len(self.start):
            more = np.zeros(max(n, len(self.start)), dtype=np.int64)
            self.start, self.size = np.concatenate((self.start, more)), np.concatenate((self.size, more))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + n] = sizes
        self.used += len(flat)
        self.count += n


def words_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def list_ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, size of each list)."""
    flat = pa.array(lists, pa.list_(pa.int32()))
    sizes = np.diff(flat.offsets.to_numpy())
    return flat.values.to_numpy(zero_copy_only=False).astype(np.int32), sizes.astype(np.int64)

