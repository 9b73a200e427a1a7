"""Cutting joined words by a lexicon: a trie of sorted edges, and dynamic programming over the columns of padded tokens.

All tokens of a batch go through at once: every place of a token is a column, and
from each column the words of the lexicon are followed edge by edge in all tokens
that can be cut up to there. Tokens may have lexicons of their own; each is a root
of the one trie.
"""

from __future__ import annotations

from math import log2

import numpy as np

#: Letters of a word at most.
WIDEST = 30


class Trie:
    """Words of several lexicons: (group, word, count, whether it may be shorter than four letters)."""

    def __init__(self, words: list[tuple[int, str, int, bool]], groups: int):
        text = "".join(w for _, w, _, _ in words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        codes = np.searchsorted(self.alphabet, points)
        size = len(self.alphabet) + 1
        lengths = np.array([len(w) for _, w, _, _ in words], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        node = np.array([g for g, _, _, _ in words], dtype=np.int64)
        keys, children, made = [], [], groups
        for depth in range(int(lengths.max()) if len(words) else 0):
            some = np.flatnonzero(lengths > depth)
            key, back = np.unique(node[some] * size + codes[starts[some] + depth], return_inverse=True)
            keys.append(key)
            children.append(made + np.arange(len(key)))
            node[some] = made + back
            made += len(key)
        self.size = size
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], (np.concatenate(children)[order] if keys else np.zeros(0, np.int64))
        self.gain = np.full(made, np.nan)
        for at, (_, w, n, short) in zip(node.tolist(), words, strict=True):
            if n > 0 and (len(w) >= 4 or short):
                self.gain[at] = 1.2 * log2(n + 1)

    def follow(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have an edge of the code, where those lead to)"""
        if not len(self.keys):
            return np.zeros(len(node), dtype=bool), node[:0]
        key = node * self.size + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (code >= 0)
        return found, self.children[at[found]]

    def codes(self, tokens: list[str]) -> np.ndarray:
        """A row of codes for each token of one length; -1 for letters that no word has."""
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).reshape(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == points, at, -1) if len(self.alphabet) else np.full(points.shape, -1)


def _best_cuts(trie: Trie, tokens: list[str], groups: np.ndarray) -> np.ndarray:
    """For tokens of one length: where the last word of the best cut up to each place begins, or -1. Each word adds 1.2 log2(count + 1) + 0.72 min(length, 14) - 5; of equal cuts the one whose last word begins first counts."""
    codes = trie.codes(tokens)
    many, long = codes.shape
    best, begin = np.full((many, long + 1), -np.inf), np.full((many, long + 1), -1)
    best[:, 0] = 0.0
    for start in range(long):
        alive = np.flatnonzero(best[:, start] > -np.inf)
        node = groups[alive]
        for end in range(start + 1, min(start + WIDEST, long) + 1):
            found, node = trie.follow(node, codes[alive, end - 1])
            alive = alive[found]
            if not len(alive):
                break
            score = best[alive, start] + trie.gain[node]
            score = score + 0.72 * min(end - start, 14)
            score = score - 5
            better = score > best[alive, end]  # never, where no word ends
            best[alive[better], end], begin[alive[better], end] = score[better], start
    return begin


def cut_tokens(trie: Trie, tokens: list[str], groups: list[int]) -> list[str | None]:
    """The best cut of each token into words of its lexicon, with spaces between them and its first letter's case; None unless two words or more cover it. Case doesn't matter otherwise."""
    out: list[str | None] = [None] * len(tokens)
    lows = [t.lower() for t in tokens]
    by_length: dict[int, list[int]] = {}
    for k, low in enumerate(lows):
        by_length.setdefault(len(low), []).append(k)
    for long, some in by_length.items():
        if not long:
            continue
        begin = _best_cuts(trie, [lows[k] for k in some], np.array([groups[k] for k in some], dtype=np.int64))
        for row, k in enumerate(some):
            words, end = [], long
            while end > 0 and begin[row, end] >= 0:
                words.append(lows[k][begin[row, end] : end])
                end = int(begin[row, end])
            if end == 0 and len(words) > 1:
                joined = " ".join(reversed(words))
                out[k] = joined[0].upper() + joined[1:] if tokens[k][0].isupper() else joined
    return out
