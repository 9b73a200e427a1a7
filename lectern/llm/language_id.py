"""Language identification: the family first, then one-versus-one linear machines within it.

A text is the mean of hashed byte n-grams (1 to 3 bytes); A-Z are lower-cased,
and every other ASCII character is a space. One linear support vector machine per family (one against
the rest) picks the family; inside it, one machine for every pair of languages
votes, and the most votes win. Machines have a squared hinge loss and are fitted
by gradient descent with momentum on a bounded sample of labelled rows.

Scoring is a gather: the weights of every n-gram of a chunk are looked up and
summed by document, for all machines at once.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, id_array, text_chunks
from .session import ready

#: Families of closely related languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
BITS = 11
#: Labelled rows of each language that the machines are fitted on, and all languages together.
SAMPLE = 500
SAMPLE_ALL = 4000
STEPS = 120
UNDEFINED = "und"


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    names: list[tuple] = field(default_factory=list)  # ("family", f) or ("pair", f, a, b)
    weights: np.ndarray | None = None  # machine x n-gram
    bias: np.ndarray | None = None


def gram_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams by their first byte; the last places of a chunk hold shorter ones."""
    x = LOWER[data].astype(np.uint32)
    x[(data < 0x80) & ~((x >= 97) & (x <= 122))] = 32
    mask, shift = np.uint32((1 << BITS) - 1), np.uint32(32 - BITS)
    pad = np.concatenate((x, np.full(2, 32, np.uint32)))
    n = len(x)
    one = x
    two = one + pad[1 : n + 1] * np.uint32(257) + np.uint32(7919)
    three = two + pad[2 : n + 2] * np.uint32(66049) + np.uint32(104729)
    return tuple(((c * np.uint32(2654435761)) >> shift) & mask for c in (one, two, three))


def _bounds(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, the range of first bytes of its ``size``-grams."""
    return offs[:-1], np.maximum(offs[1:] - size + 1, offs[:-1])


def features(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The mean n-gram vectors of a chunk's documents: three blocks, each scaled to sum to one."""
    out = np.zeros((len(offs) - 1, 3 << BITS), dtype=np.float32)
    for k, codes in enumerate(gram_codes(data)):
        for d, (a, b) in enumerate(zip(*(x.tolist() for x in _bounds(offs, k + 1)), strict=True)):
            if b > a:
                out[d, k << BITS : (k + 1) << BITS] = np.bincount(codes[a:b], minlength=1 << BITS) / (b - a)
    return out


def scores(model: Model, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Document x machine: the machines' outputs, from whole texts. A document's sums do not depend on its neighbours."""
    docs = len(offs) - 1
    out = np.tile(model.bias, (docs, 1))
    if not len(data):
        return out
    codes = gram_codes(data)
    for k in range(3):
        first, last = _bounds(offs, k + 1)
        some = np.flatnonzero(last > first)
        if not len(some):
            continue
        edges = np.stack((first[some], last[some]), 1).ravel()
        for j in range(len(model.bias)):
            w = np.append(model.weights[j, k << BITS : (k + 1) << BITS][codes[k]], 0.0)
            out[some, j] += np.add.reduceat(w, edges)[::2] / (last - first)[some]
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = STEPS, c: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss; y is -1 or 1, and both classes weigh alike. Features are scaled by their spread while it is fitted."""
    spread = x.std(axis=0) + 1e-4
    centre = x.mean(axis=0)
    z = (x - centre).astype(np.float32, copy=False)
    z /= (spread * np.sqrt(x.shape[1])).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    rate = 0.5 / (2 * float((weight * (1 + np.einsum("ij,ij->i", z, z))).sum()) + c)
    for _ in range(steps):
        slack = np.maximum(0.0, 1 - y * (z @ w + b))
        g = (-2 * weight * slack * y).astype(np.float32)
        vw = (0.9 * vw - rate * (g @ z + c * w)).astype(np.float32)
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    w = w.astype(np.float64) / spread / np.sqrt(x.shape[1])
    return w, float(b - centre @ w)


def fit(x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    of = {lang: name for name, members in families.items() for lang in members}
    known = sorted(set(langs))
    family = [of.get(lang, lang) for lang in langs]
    model = Model(sorted(set(family)), {})
    langs_at, family_at = np.array(langs, dtype=object), np.array(family, dtype=object)
    weights, bias = [], []

    def add(name: tuple, rows: np.ndarray, y: np.ndarray) -> None:
        w, b = fit_machine(x[rows], y.astype(np.float64))
        model.names.append(name)
        weights.append(w)
        bias.append(b)

    for f in model.families:
        model.members[f] = [lang for lang in known if of.get(lang, lang) == f]
        if len(model.families) > 1:
            add(("family", f), np.arange(len(langs)), np.where(family_at == f, 1, -1))
        for a, b in itertools.combinations(model.members[f], 2):
            rows = np.flatnonzero((langs_at == a) | (langs_at == b))
            add(("pair", f, a, b), rows, np.where(langs_at[rows] == a, 1, -1))
    model.weights = np.array(weights, dtype=np.float64).reshape(len(weights), x.shape[1])
    model.bias = np.array(bias, dtype=np.float64)
    return model


def decide(model: Model, s: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each document: the family of the greatest output, then the language of the most votes (ties: the greater sum of margins, then the first name)."""
    n = len(s)
    at = {name: j for j, name in enumerate(model.names)}
    squash = lambda v: 1 / (1 + np.exp(-np.clip(4 * v, -50, 50)))
    if len(model.families) > 1:
        outputs = np.stack([s[:, at["family", f]] for f in model.families], 1)
        pick = outputs.argmax(axis=1)
        sure = squash(outputs[np.arange(n), pick])
    else:
        pick, sure = np.zeros(n, dtype=int), np.ones(n)
    langs: list[str] = [""] * n
    for k, f in enumerate(model.families):
        rows = np.flatnonzero(pick == k)
        members = model.members[f]
        if not len(rows):
            continue
        votes, margin = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
            v = s[rows, at["pair", f, a, b]]
            votes[:, i] += v > 0
            votes[:, j] += v <= 0
            margin[:, i] += v
            margin[:, j] -= v
        best = np.lexsort((np.tile(-np.arange(len(members)), (len(rows), 1)), margin, votes), axis=1)[:, -1]
        if len(members) > 1:
            sure[rows] *= squash(margin[np.arange(len(rows)), best] / (len(members) - 1))
        for r, m in zip(rows.tolist(), best.tolist(), strict=True):
            langs[r] = members[m]
    return langs, np.clip(sure, 0.0, 1.0)


def held_out(doc_id, buckets: int, which: int):
    """Whether crc32 of the id as text falls in the held-out bucket."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(buckets)) == which, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, offs, data in text_chunks(batch, "id", "text"):
            x = features(offs, data)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> Model | None:
    """Fit on a sample of about ``sample`` rows of a language and ``sample_all`` in all, taken by a hash of id and text among rows with a text and a language; of more than a quarter above that some are left out. Whole texts are read; one task gets a vector of fixed length for each sampled row and fits the model, which is all that the driver gets. None without any such row."""
    ready(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_all).collect()}
    if not counts:
        return None
    each = min(sample, max(10, sample_all // len(counts)))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(2**53)) < share * 2**53)
    vectors = drawn.mapInArrow(_vectors, "lang string, x binary").limit(sample_all + sample_all // 4)
    models = vectors.mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (a bounded sample, in one partition), fitted in a task, so that the driver never holds the vectors. Nothing without rows."""
    parts = [(b.column(0).to_pylist(), matrix(b.column(1)).copy()) for b in batches if b.num_rows]
    if parts:
        langs = np.array([lang for some, _ in parts for lang in some], dtype=str)
        x = np.concatenate([m for _, m in parts])
        del parts
        order = np.lexsort(([hash_of(v) for v in x], langs))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x[order], langs[order].tolist()))], pa.binary())], ["model"])


def matrix(vectors: pa.BinaryArray) -> np.ndarray:
    """Vectors of one length as rows, without a copy."""
    _, offsets, data = vectors.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    return np.frombuffer(data, dtype=np.float32, count=(int(at[-1]) - int(at[0])) // 4, offset=int(at[0])).reshape(len(vectors), -1)


def hash_of(blob: bytes | np.ndarray) -> int:
    return zlib.crc32(blob)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b, ids, offs, data in text_chunks(batch, "doc_id", "text"):
                langs, sure = decide(model, scores(model, offs, data)) if model else ([UNDEFINED] * (b - a), np.zeros(b - a))
                for k in range(b - a):
                    if not has_letter(texts[a + k].as_py()):
                        langs[k], sure[k] = UNDEFINED, 0.0
                yield pa.RecordBatch.from_arrays([id_array(ids), batch.column(2).slice(a, b - a), pa.array(langs, pa.string()), pa.array(sure)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 4, which: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Rows of ``labelled`` (the table itself by default) whose crc32(id as text)
    mod ``buckets`` is ``which`` are held out and never learnt from. A null text
    or one without a letter is ``und`` with score 0, and so is everything if
    nothing is labelled. Null and repeated ids give a row for each row (a null
    id is not held out); an empty table gives no rows. No shuffle of texts.
    """
    source = docs if labelled is None else labelled
    model = train(source.filter(~held_out(F.col(id_col), buckets, which)), id_col, text_col, lang_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col), buckets, which).alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
