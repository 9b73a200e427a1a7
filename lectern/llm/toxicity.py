"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers letters, turns look-alikes of other scripts into Latin letters
and everything that is no letter into a space; a second reading of texts with
digits or signs inside words takes these as the letters they stand for
(``m0r0n``). The lexicon holds beginnings of words with the log-odds of their
document frequency among toxic and other texts; it is learnt from labelled rows.
Exception phrases, given or learnt (whole words that begin like an entry but
stand in other texts only), silence the hits inside them. A text's score is a
logistic function of the weight of its hits, as a sum and per thousand
characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import id_array, text_chunks
from .language_id import held_out
from .session import ready

#: Labelled rows, at most about so many, that lexicon and score are fitted on.
SAMPLE = 6000
#: Distinct words of a sampled text that are learnt from, the most frequent ones (scores read whole texts).
WORDS = 5000
#: Entries of the lexicon, and the lengths of the beginnings of words that may be one.
ENTRIES = 2000
LENGTHS = range(3, 13)
LEAST_WEIGHT = 1.5
#: Least log-likelihood ratio of an entry's document frequencies; many beginnings are tried, and some stand out by chance.
LEAST_RATIO = 16.0
#: Look-alikes of Latin letters in other scripts (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ѵ": "v", "һ": "h", "ӏ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser rule", "pond scum")

_SPACE = 32
_tables: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(folded code point of every code point, what a substitute stands for or 0), made once in each process."""
    global _tables
    if _tables is None:
        fold = np.full(0x110000, _SPACE, dtype=np.uint32)
        for i in range(0x30000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                low = low if len(low) == 1 else c
                if 0xFF21 <= ord(low) <= 0xFF5A:  # full-width letters
                    low = chr(ord(low) - 0xFEE0).lower()
                fold[i] = ord(LOOKALIKES.get(low, low))
        stands = np.zeros(0x110000, dtype=np.uint32)
        for a, b in SUBSTITUTES.items():
            stands[ord(a)] = ord(b)
        _tables = fold, stands
    return _tables


def folded(offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[str, str | None]]:
    """For each text of a chunk, its folded form and, where digits or signs stand beside letters, the reading that takes them as letters."""
    fold, stands = tables()
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    cuts = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offs) if len(data) else np.zeros(len(offs), np.int64)
    plain = fold[points]
    can = stands[points]
    letter = plain != _SPACE
    inside = letter.copy()
    for _ in range(3):
        grown = inside.copy()
        grown[1:] |= inside[:-1]
        grown[:-1] |= inside[1:]
        inside = letter | (grown & (can > 0))
    taken = inside & ~letter
    other = np.where(taken, can, plain)
    plain_text = plain.tobytes().decode("utf-32-le")
    other_text = other.tobytes().decode("utf-32-le") if taken.any() else plain_text
    some = np.concatenate(([0], np.cumsum(taken)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield f" {plain_text[a:b]} ", f" {other_text[a:b]} " if some[b] > some[a] else None


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    coefficients: np.ndarray  # bias, log sum, log density

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for word, w in self.weights.items():
            a.add_word(f" {word}", (len(word) + 1, w))
        if len(a):
            a.make_automaton()
        return a

    def probability(self, total: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(total, chars) @ self.coefficients, -40, 40)))


def _design(total: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / np.maximum(chars, 1))), 1)


def matched_weight(automaton, text: str) -> float:
    """The weights of the words hit, each by its greatest entry, without hits inside exception phrases."""
    best: dict[int, float] = {}
    silent: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(text):
        start = end - size + 1
        if w is None:
            silent.append((start, end))
        elif w > best.get(start, 0.0):
            best[start] = w
    if silent and best:
        for a, b in silent:
            for s in [s for s in best if a <= s < b]:
                del best[s]
    return sum(best[k] for k in sorted(best))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct folded words of sampled texts, with counts."""
    for batch in batches:
        words, counts, chars = [], [], []
        for _, _, _, offs, data in text_chunks(batch, "id", "text"):
            for text, other in folded(offs, data):
                c = Counter((other or text).split()).most_common(WORDS)
                words.append([w for w, _ in c])
                counts.append([n for _, n in c])
                chars.append(len(text) - 2)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32())), pa.array(chars, pa.int64())], ["toxic", "words", "counts", "chars"])


def learn(rows: list[tuple[int, list[str], list[int], int]], exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from (toxic, words, their counts, characters). Texts whose words have the same least hashes, which are copies mostly, count once."""
    seen, kept = set(), []
    for row in sorted(rows, key=lambda r: (r[0], sorted(r[1]))):
        print_of = tuple(sorted(zlib.crc32(w.encode()) for w in set(row[1]))[:4])
        if print_of not in seen:
            seen.add(print_of)
            kept.append(row)
    toxic, other = [r for r in kept if r[0]], [r for r in kept if not r[0]]
    starts = lambda words: {w[:k] for w in words for k in LENGTHS if len(w) >= k} | {w for w in words if len(w) >= LENGTHS[0]}
    bad: Counter = Counter()
    for r in toxic:
        bad.update(starts(r[1]))
    least = max(3, len(toxic) // 100)
    bad = Counter({k: n for k, n in bad.items() if n >= least})
    good: Counter = Counter()
    for r in other:
        good.update(s for s in starts(r[1]) if s in bad)
    odds = {k: float(np.log((n + 0.5) / (len(toxic) + 1)) - np.log((good[k] + 0.5) / (len(other) + 1))) for k, n in bad.items()}
    # of a beginning and a longer one that nearly as many toxic texts hold, the longer says what it is
    longer = {k[:-1] for k, n in bad.items() if n >= 0.95 * bad.get(k[:-1], n + 1)}
    ratio = lambda k: likelihood_ratio(bad[k], len(toxic), good[k], len(other))
    ranked = sorted((k for k, w in odds.items() if w >= LEAST_WEIGHT and k not in longer and ratio(k) >= LEAST_RATIO), key=lambda k: (-odds[k] * bad[k], k))[:ENTRIES]
    chosen = set(ranked)
    weights = {k: round(odds[k], 6) for k in ranked if not any(k[:n] in chosen and odds[k[:n]] >= odds[k] - 0.1 for n in range(LENGTHS[0], len(k)))}
    begins = lambda w: any(w[:k] in weights for k in range(LENGTHS[0], len(w)))
    in_other: Counter = Counter(w for r in other for w in set(r[1]) if begins(w))
    in_toxic: set[str] = {w for r in toxic for w in set(r[1]) if begins(w)}
    learnt = sorted(w for w, n in in_other.items() if n >= 2 and w not in in_toxic)
    lexicon = Lexicon(weights, [*exceptions, *learnt], np.array([-2.0, 0.0, 0.0]))
    if not weights:
        share = np.clip((len(toxic) + 0.5) / (len(kept) + 1), 0.01, 0.49)
        lexicon.coefficients = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        return lexicon
    silent = set(learnt)

    def weight(w: str) -> float:
        return 0.0 if w in silent else max((weights[w[:k]] for k in range(LENGTHS[0], len(w) + 1) if w[:k] in weights), default=0.0)

    total = np.array([sum(weight(w) * n for w, n in zip(r[1], r[2], strict=True)) for r in kept])
    lexicon.coefficients = fit_logistic(_design(total, np.array([r[3] for r in kept])), np.array([float(r[0]) for r in kept]))
    return lexicon


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """Dunning's G2 for a of n against b of m."""
    out = 0.0
    for seen, size, total in ((a, n, a + b), (b, m, a + b), (n - a, n, n + m - a - b), (m - b, m, n + m - a - b)):
        if seen > 0:
            out += 2 * seen * np.log(seen * (n + m) / (size * total))
    return float(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's steps with a ridge on all but the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Fit on about ``sample`` labelled rows, taken by a hash of the id, and on twice as many at most. Only their ids and labels, which that bounds, are broadcast; the driver gets up to ``WORDS`` distinct words of each."""
    ready(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(2**53)) < F.lit(int(share * 2**53))).limit(2 * sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = rows.join(F.broadcast(drawn), "id").mapInArrow(_counted, "toxic int, words array<string>, counts array<int>, chars long").limit(2 * sample).toArrow()
    return learn(list(zip(*(table[c].to_pylist() for c in ("toxic", "words", "counts", "chars")), strict=True)))


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for a, b, ids, offs, data in text_chunks(batch):
                total, chars = np.zeros(b - a), np.zeros(b - a)
                for k, (text, other) in enumerate(folded(offs, data)):
                    chars[k] = len(text) - 2
                    if len(automaton):
                        total[k] = matched_weight(automaton, text)
                        if other is not None:
                            total[k] = max(total[k], matched_weight(automaton, other))
                p = lexicon.probability(total, chars)
                yield pa.RecordBatch.from_arrays([id_array(ids), batch.column(2).slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", buckets: int = 5, which: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Rows whose crc32(id as text) mod ``buckets`` is ``which`` are held out and
    never learnt from. A null text is an empty one and gets the score of no
    hits; so does every text if nothing is labelled toxic. Several labels of an
    id count as the greatest. Null and repeated ids give a row for each row (a
    null id is not held out); an empty table gives no rows. No shuffle of texts.
    """
    lexicon = train(docs, labels.filter(~held_out(F.col(id_col), buckets, which)), id_col, text_col, label_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), buckets, which).alias("held_out"))
    return rows.mapInArrow(_score(lexicon), "doc_id long, held_out boolean, score double, predicted int")


def words_of(text: str) -> list[str]:
    """The folded words of one text, for reading and tests."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    plain, other = next(folded(np.array([0, len(raw)]), raw))
    return re.split(r" +", (other or plain).strip())
