r"""Near-duplicate join on word shingles: universe-partition pigeonhole with exact verification.

A document's set holds its distinct ``words``-word shingles (words are
``[^\x20\x09-\x0D]+`` after lower-casing A-Z), each with a 64-bit hash. Two sets
of sizes r >= s with Jaccard similarity of at least t differ in at most
``2 r (1 - t) / (1 + t)`` tokens. So, for sets of one *size band*:

* the universe of hashes is cut into m equal ranges (segments); the tokens of a
  set inside one segment are its subset there;
* with budget ``B = bound + 1`` the segments get values v in {0, 1, 2} that sum
  to B at least: by the pigeonhole principle two similar sets agree in a
  segment of value 1, or differ by at most one token in one of value 2, which
  the one-deletion neighbourhood of the subset finds;
* ``allocate`` picks m and the values by cost: index rows plus the chance
  meetings that subsets of one token cause. Ranges of a hash are alike, so all
  segments of a band get one value. Thin subsets (empty ones; for value 2 those
  of one token too) are worth 0, which spare segments pay for; only a set with
  more of them than that indexes them.

Hashes take nothing but differences away, and so does any fixed set of tokens
that is left out of the subsets. Where segments are short, shingles that many
unlike documents share (by a count over one document in ``COMMON_SAMPLE``) are
left out, or else they alone would make subsets equal.

A set is indexed under its own band and, if a larger partner could stand in the
next band, under that band too. Documents of equal words (by a 128-bit digest)
are one class from the start. Then:

1. Of each key the least document is the *head*; every other document of the key
   is compared with it. Heads stay, members stream by, so a task holds two texts.
2. A key whose members, but for the head, are now in one component is done, and
   so is a key of two. Members of the other keys may still be linked with each
   other: they go, as blocks of bounded size, to a breadth-first search that
   expands every document once against those not reached yet that share one of
   its keys; of a candidate component above ``block_tokens`` every pair of blocks
   is searched, so no link is lost and no task grows with a group.

Sets are compared by names of their shingles that are made from the words' bytes
in each task. Final components come from verified links alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, NULL_ID, U64, as_long, mix, prefix_sums, ragged, spaced, split_words, text_chunks, window_hashes, word_hashes, word_names
from .components import connected_components
from .session import exchanges_deleted, ready, width, written

#: Tokens of the sets that one verification task holds.
BLOCK_TOKENS = 1_000_000
#: What a key of one token costs, in index rows, by the meetings that it causes.
CHANCE_COST = 2.0
#: One document in so many is read for common shingles; those that at least ``COMMON`` unlike ones of them hold are common, up to ``COMMON_MOST``.
COMMON_SAMPLE, COMMON, COMMON_MOST = 16, 3, 200_000

#: Segments of fewer tokens, on average, are short.
SHORT = 7

#: Characters of texts that are compared at once.
PAIR_BYTES = 1 << 20
#: Members of a key's head that one task compares with it.
MEMBERS = 512

#: n: the size of the whole set, whose digest is (key, more), or -1 for the key of a segment
_KEYS = "key long, more long, id long, n int"


class Bands:
    """Size bands for a similarity of num/den, and each band's segments."""

    def __init__(self, num: int, den: int, top: int = 1 << 40):
        self.num, self.den = num, den
        self.edges = [1]
        steps = 2 if 8 * num >= 7 * den else 1  # wide bands: fewer sets reach into the next one; narrow: tighter bounds
        while self.edges[-1] < top:
            low = self.edges[-1]
            up = low
            for _ in range(steps):
                up = up * den // num + 1
            self.edges.append(max(low + 1, up))
        self._plans: dict[int, tuple[np.ndarray, np.ndarray, bool] | None] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def cuts(self, band: int) -> tuple[np.ndarray, np.ndarray, int, bool] | None:
        """(lower ends of the segments, their salts, spare segments, whether they have value 2); None where no difference is allowed, so that one key of the whole set says all."""
        if band not in self._plans:
            most = self.edges[band + 1] - 1
            differ = 2 * most * (self.den - self.num) // (self.den + self.num)
            self._plans[band] = None
            if differ:
                m, spare, deletions = allocate(self.edges[band] * self.num / self.den, most, differ)
                lows = np.array([(k << 64) // m for k in range(m)], dtype=U64)
                self._plans[band] = lows, mix(np.arange(m, dtype=U64) + U64(band << 32) + U64(1)), spare, deletions
        return self._plans[band]


def allocate(low: float, most: int, differ: int) -> tuple[int, int, bool]:
    """(segments, spare ones, whether they have value 2) of a band whose sets have ``low`` to ``most`` tokens and differ in up to ``differ``: the cheaper of values 1 or values 2 throughout.

    Spares are the thin subsets to be expected and three deviations more. With
    value 1 a thin subset is one of both sets, so spares count once; with value 2
    either set may lose as many, so they count twice.
    """
    ones = differ + 1
    for _ in range(8):
        thin = ones * np.exp(-low / ones)
        spare = int(np.ceil(thin + 3 * np.sqrt(thin))) + 1
        ones = min(most + differ + 2, differ + 1 + spare)
    cost_ones = ones + CHANCE_COST * low * np.exp(-low / ones)
    twos, lost = (differ + 2) // 2, 0
    for _ in range(8):
        thin = twos * np.exp(-low / twos) * (1 + low / twos)
        lost = int(np.ceil(thin + 3 * np.sqrt(thin))) if thin > 0.02 and twos > 1 else 0  # a single segment holds all tokens
        twos = min(most + differ + 2, (differ + 2) // 2 + 2 * lost)
    cost_twos = twos + most + CHANCE_COST * low * np.exp(-low / twos) * low / twos
    if cost_twos < cost_ones:
        return twos, (twos - (differ + 2) // 2) // 2, True
    return ones, ones - differ - 1, False


def set_keys(u: np.ndarray, bands: Bands, common: np.ndarray | None = None, n: int | None = None) -> list[np.ndarray]:
    """The index keys of one set of ``n`` tokens, given by its sorted distinct hashes, without the ``common`` ones (sorted)."""
    n = len(u) if n is None else n
    out, own = [], bands.of(n)
    tokens = u
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, u), len(common) - 1)
        tokens = u[common[at] != u]
    values = mix(tokens + U64(0x51ED270B))
    sums = prefix_sums(values)
    for band in (own, own + 1):
        if band != own and n * bands.den < bands.edges[band] * bands.num:
            continue
        if (cuts := bands.cuts(band)) is None:
            if band == own:  # only equal sets are similar; their words may still differ in order and number
                out.append(mix(np.array([u.sum(dtype=U64)]) + U64(band << 32)))
            continue
        lows, salts, spare, deletions = cuts
        at = np.searchsorted(tokens, lows)
        ends = np.append(at[1:], len(tokens))
        subset = sums[ends] - sums[at]
        full = ends - at > (1 if deletions else 0)
        if (~full).sum() > spare:
            full[:] = True
        out.append(mix(subset[full] + salts[full]))
        if deletions:
            seg = np.repeat(np.arange(len(salts)), ends - at)
            some = full[seg]
            seg = seg[some]
            out.append(mix(subset[seg] - values[some] + salts[seg]))
    return out


class Sets:
    """The shingle sets of a chunk of texts: ``cuts`` bounds each document's shingles; ``names`` are equal for equal shingles of the chunk only; ``hashes`` are sorted in each document."""

    def __init__(self, offs: np.ndarray, raw: np.ndarray, words: int):
        data = LOWER[raw]
        starts, ends, bounds = split_words(data, offs)
        hashes = word_hashes(data, starts, ends)
        names, many = word_names(data, starts, ends, hashes) if len(starts) else (np.zeros(0, np.int64), 0)
        count = np.diff(bounds)
        here = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        at, doc = ragged(bounds[:-1], here), np.repeat(np.arange(len(here)), here)
        last = bounds[1:][doc]
        short = np.flatnonzero(count[doc] < words)
        wide = window_hashes(hashes, words)
        token = wide[np.minimum(at, len(wide) - 1)] if len(wide) else np.zeros(len(at), U64)
        for i in short.tolist():  # fewer words: the whole sequence is one shingle
            own = hashes[at[i] : last[i]]
            token[i] = mix(np.array([(own * (np.arange(1, len(own) + 1, dtype=U64) * U64(2) + U64(1))).sum(dtype=U64)]) + U64(0xA5A5A5A5 * len(own)))[0]
        name, bits, step = np.zeros(len(at), np.int64), 0, max(1, int(many).bit_length())
        for k in range(words):
            if bits + step > 62:
                name = np.unique(name, return_inverse=True)[1].astype(np.int64)
                bits = max(1, len(name).bit_length())
            inside = at + k < last
            name = (name << step) | np.where(inside, names[np.minimum(at + k, max(0, len(names) - 1))], 0) if len(at) else name
            bits += step
        order = np.lexsort((name, doc))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (name[order[1:]] != name[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        some = order[fresh]
        some = some[np.lexsort((token[some], doc[some]))]
        self.names, self.hashes = name[some], token[some]
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[some], minlength=len(here)))))
        self.words = data, starts, ends, bounds

    def digests(self) -> list[bytes]:
        """128 bits of each document's words."""
        data, starts, ends, bounds = self.words
        flat, at = spaced(data, starts, ends)
        raw = memoryview(flat.tobytes())
        own = at[bounds].tolist()
        return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(own[:-1], own[1:], strict=True)]

    def sizes(self) -> np.ndarray:
        return np.diff(self.cuts)


def sets_of(texts: list[str | None], words: int) -> Sets:
    raw = [(t or "").encode("utf-8") for t in texts]
    return Sets(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8), words)


def _index(words: int, num: int, den: int, common: np.ndarray):
    """Index rows. Of copies in one batch the first is indexed by segments; all have their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            seen: set[bytes] = set()
            for _, _, ids, offs, data in text_chunks(batch, "k", "text"):
                sets = Sets(offs, data, words)
                sizes, digests = sets.sizes(), sets.digests()
                keys, owner = [], []
                for i, digest in enumerate(digests):
                    if sizes[i] and digest not in seen:
                        seen.add(digest)
                        got = set_keys(np.unique(sets.hashes[sets.cuts[i] : sets.cuts[i + 1]]), bands, common, int(sizes[i]))
                        keys += got
                        owner.append((i, sum(map(len, got))))
                whole = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).copy()
                empty = sizes == 0
                whole[empty, 0] = ids[empty]
                key = np.concatenate(keys) if keys else np.zeros(0, U64)
                own = np.repeat([i for i, _ in owner], [n for _, n in owner]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((whole[:, 0], key.view(np.int64)))),
                        pa.array(np.concatenate((whole[:, 1], np.zeros(len(key), np.int64)))),
                        pa.array(np.concatenate((ids, ids[own]))),
                        pa.array(np.concatenate((sizes, np.full(len(key), -1))).astype(np.int32)),
                    ],
                    ["key", "more", "id", "n"],
                )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, n, more, id): (id, least id, n) of whole sets; (id, head, -1) of the other members of a segment's key; and, of keys with three members or more, (id, key, -2) of these. Holds two rows between batches."""
    last: tuple[int, int, int] | None = None
    head, seconds = 0, []  # of the last key: its least id, and the one other member if it is all so far
    for b in batches:
        key, more, ids, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (more[1:] != more[:-1])))
        new[0] = last != (int(key[0]), int(n[0]), int(more[0]))
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = np.where(group >= 0, ids[start[np.maximum(group, 0)]], head) if len(start) else np.full(len(key), head)
        whole = n >= 0
        out = [(ids[whole], np.where(n == 0, ids, least)[whole], n[whole])]
        fresh = ~whole & (ids != least)  # members but the head, each once
        fresh[1:] &= new[1:] | (ids[1:] != ids[:-1])
        fresh[0] &= bool(new[0]) or not seconds or seconds[-1] != ids[0]
        at = np.flatnonzero(fresh)
        out.append((ids[at], least[at], n[at]))
        # how many members beside the head each key has, with what came before this batch
        carried = seconds if group[0] < 0 else []
        many = np.bincount(group[at] + 1, minlength=len(start) + 1)
        many[0] += len(carried)
        large = at[many[group[at] + 1] > 1]
        out.append((ids[large], key[large], np.full(len(large), -2, np.int32)))
        if len(carried) == 1 and many[0] > 1:
            out.append((np.array(carried), key[:1], np.full(1, -2, np.int32)))
        tail = at[group[at] == group[-1]]
        before = carried if group[-1] < 0 else []
        seconds = [*before, *ids[tail].tolist()][-2:] if not whole[-1] else []
        head, last = int(least[-1]), (int(key[-1]), int(n[-1]), int(more[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]).astype(np.int32))], ["id", "least", "n"])


def _compared(words: int, num: int, den: int):
    """Rows (least, salt, first, id, text) sorted so that a head comes before the members that are compared with it: verified links (u, v). Holds some texts at a time."""

    def links(rows: list[tuple[int, bool, int, str]]) -> pa.RecordBatch:
        sets = sets_of([r[3] for r in rows], words)
        sizes, u, v, head = sets.sizes(), [], [], None
        for i, (least, first, doc, _) in enumerate(rows):
            own = sets.names[sets.cuts[i] : sets.cuts[i + 1]]
            if first:
                head, size = own, int(sizes[i])
            elif num * max(size, int(sizes[i])) <= den * min(size, int(sizes[i])):
                both = len(np.intersect1d(head, own, assume_unique=True))
                if both * (num + den) >= num * (size + int(sizes[i])):
                    u.append(doc)
                    v.append(least)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, head = [], 0, None
        for b in batches:
            for least, first, doc, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if first and head is not None and head[0] == least and head[2] == doc:
                    continue  # the head has several rows
                if held >= PAIR_BYTES:
                    yield links(rows)
                    rows, held = [] if first else [head], 0
                row = least, bool(first), doc, text
                if first:
                    head = row
                rows.append(row)
                held += len(text or "")
        if rows:
            yield links(rows)

    return run


def linked(sets: list[np.ndarray], num: int, den: int, bands: Bands | None = None, common: np.ndarray | None = None, names: list[np.ndarray] | None = None) -> np.ndarray:
    """The least index of each set's component under Jaccard similarity of num/den: every set is expanded once, against those not reached yet that share a key. ``sets`` are sorted distinct hashes, ``names`` the tokens that are compared (the hashes by default)."""
    n = len(sets)
    bands = bands or Bands(num, den)
    names = sets if names is None else names
    sizes = np.array([len(s) for s in names], dtype=np.int64)
    flat = np.unique(np.concatenate(names), return_inverse=True)[1].astype(np.int32) if n else np.zeros(0, np.int32)
    offs = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, dtype=np.int32)
    keys = [np.concatenate([mix(np.array([s.sum(dtype=U64)])), *set_keys(s, bands, common, int(size))]) for s, size in zip(sets, sizes, strict=True)]
    owner = np.repeat(np.arange(n), [len(k) for k in keys])
    key = np.concatenate(keys) if n else np.zeros(0, U64)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(key)))
    held = [owner[a : a + k] for a, k in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True)]
    by_set: list[list[int]] = [[] for _ in range(n)]
    for g, members in enumerate(held):
        for x in members.tolist():
            by_set[x].append(g)
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            x = queue.pop()
            near = []
            for g in by_set[x]:
                if len(held[g]):
                    held[g] = held[g][label[held[g]] < 0]
                    near.append(held[g])
            some = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            some = some[(sizes[some] * den >= sizes[x] * num) & (sizes[x] * den >= sizes[some] * num)]
            if not len(some):
                continue
            own = flat[offs[x] : offs[x] + sizes[x]]
            mark[own] = 1
            lens = sizes[some]
            starts = np.cumsum(lens) - lens
            shared = np.add.reduceat(mark[flat[np.repeat(offs[some] - starts, lens) + np.arange(int(lens.sum()))]], starts)
            mark[own] = 0
            hit = some[shared * (num + den) >= num * (sizes[x] + lens)]
            label[hit] = seed
            queue += hit.tolist()
    return label


def _verify(words: int, num: int, den: int, common: np.ndarray):
    """Rows sorted by (group, id): links (id, least id of its verified component within the group)."""
    bands = Bands(num, den)

    def done(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        sets = sets_of(texts, words)
        some = list(zip(sets.cuts[:-1].tolist(), sets.cuts[1:].tolist(), strict=True))
        label = linked([np.unique(sets.hashes[a:b]) for a, b in some], num, den, bands, common, [sets.names[a:b] for a, b in some])
        own = np.array(ids)
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[label[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts = None, [], []
        for b in batches:
            for group, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if group != at:
                    if len(ids) > 1:
                        yield done(ids, texts)
                    at, ids, texts = group, [], []
                if not ids or ids[-1] != doc:
                    ids.append(doc)
                    texts.append(text)
        if len(ids) > 1:
            yield done(ids, texts)

    return run


def _tokens(words: int):
    """(token, least hash of the document's set) of sampled documents; copies mostly have equal least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, offs, data in text_chunks(batch, "k", "text"):
                sets = Sets(offs, data, words)
                some = np.flatnonzero(sets.sizes())
                if len(some):
                    least = np.minimum.reduceat(mix(sets.hashes), sets.cuts[some])
                    yield pa.RecordBatch.from_arrays([as_long(sets.hashes), as_long(np.repeat(least, sets.sizes()[some]))], ["token", "least"])

    return run


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of at most COMMON_MOST shingles that many unlike documents hold."""
    drawn = docs.filter(F.pmod(F.xxhash64("k", F.lit("common")), F.lit(COMMON_SAMPLE)) == 0)
    seen = drawn.mapInArrow(_tokens(words), "token long, least long").groupBy("token", "least").count()
    counts = seen.groupBy("token").agg(F.count("*").alias("unlike"), F.sum("count").alias("all")).filter((F.col("unlike") >= COMMON) & (2 * F.col("unlike") >= F.col("all")))
    rows = counts.orderBy(F.desc("unlike"), "token").limit(COMMON_MOST).select("token").toArrow()
    return np.sort(rows["token"].to_numpy().view(U64)) if rows.num_rows else np.zeros(0, U64)


def row_keys(docs: DataFrame, id_col: str, text_col: str, rest: Column) -> tuple[DataFrame, DataFrame | None]:
    """((k, text, rest), (k, id, twin) or None): k tells documents apart, rows of one id and text being one document. It is the id (NULL_ID for null) where every id has one text; else numbers are given to (id, hash of the text)."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), rest)
    kept = [c for c in rows.columns if c not in ("id", "text")]
    twin = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    mixed = rows.select("id", twin.alias("twin")).groupBy("id").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).filter("a <> b")
    if mixed.isEmpty():
        return rows.select(F.coalesce("id", F.lit(NULL_ID)).alias("k"), "text", *kept), None
    names = rows.select("id", twin.alias("twin")).distinct().withColumn("k", F.monotonically_increasing_id()).checkpoint()
    same = rows.withColumn("twin", twin).alias("a").join(names.alias("b"), F.expr("a.id <=> b.id and a.twin = b.twin"))
    return same.select("b.k", "a.text", *kept), names


def near_components(docs: DataFrame, words: int, num: int, den: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(k, n, component) for every row of ``docs`` (k, text): the size of its set and the least k of its component. What the actions on the way exchange is deleted; all that the result reads is written."""
    with exchanges_deleted(docs.sparkSession):
        return _near_components(docs, words, num, den, block_tokens)


def _near_components(docs: DataFrame, words: int, num: int, den: int, block_tokens: int) -> DataFrame:
    short = (den + num) / (2 * (den - num)) < SHORT
    common = common_shingles(docs, words) if short else np.zeros(0, U64)
    index = docs.mapInArrow(_index(words, num, den, common), _KEYS)
    stars = index.repartition(width(docs, 2), "key").sortWithinPartitions("key", "n", "more", "id").mapInArrow(_stars, "id long, least long, n int")
    stars = written(stars)
    whole = stars.filter("n >= 0")
    pairs = stars.filter("n = -1").select("id", "least").distinct()
    members = stars.filter("n = -2").select("id", F.col("least").alias("key"))
    equal = whole.filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    # the texts of candidates, once
    asked = pairs.select("id").union(pairs.select("least")).distinct()
    texts = docs.join(asked.withColumnRenamed("id", "k"), "k", "left_semi").select("k", "text")
    texts = written(texts)
    many = pairs.groupBy("least").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(many, "least").select("least", F.pmod(F.xxhash64("id"), F.col("parts")).alias("salt"), F.lit(False).alias("first"), F.col("id").alias("k"))
    dealt = dealt.union(many.select("least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("first"), F.col("least").alias("k")))
    rows = texts.join(dealt, "k").select("least", "salt", "first", "k", "text").repartition(width(docs), "least", "salt").sortWithinPartitions("least", "salt", F.desc("first"), "k")
    known = connected_components(rows.mapInArrow(_compared(words, num, den), "u long, v long").union(equal)).checkpoint()
    placed = members.join(known.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("id").alias("low")).filter("a <> b").select("key", "low")
    edges = placed.join(open_keys, "key").select(F.col("id").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct().checkpoint()
    if not edges.isEmpty():
        links = _searched(texts, edges, whole, words, num, den, common, block_tokens)
        known = connected_components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))
    out = whole.join(known.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(F.col("id").alias("k"), F.col("n").cast("long").alias("n"), F.coalesce("component", "id").alias("component"))


def _searched(texts: DataFrame, edges: DataFrame, whole: DataFrame, words: int, num: int, den: int, common: np.ndarray, block_tokens: int) -> DataFrame:
    """Verified links among the candidate components of ``edges``."""
    near = connected_components(edges)
    heads = whole.select("id", "n").distinct().join(near.withColumnRenamed("node", "id"), "id")
    sized = heads.groupBy("component").agg(F.sum("n").alias("tokens"))
    sized = sized.withColumn("blocks", F.ceil(F.when(F.col("tokens") > block_tokens, F.col("tokens") * 2.0 / block_tokens).otherwise(1.0)).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    asked = heads.join(sized, "component").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(F.col("id").alias("k"), F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("group")).distinct()
    rows = texts.join(asked, "k").select("group", "k", "text").repartition(width(texts), "group").sortWithinPartitions("group", "k")
    return rows.mapInArrow(_verify(words, num, den, common), "u long, v long")


def shingle_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the least id reachable over links of Jaccard similarity >=
    num/den on distinct ``words``-word shingles. A text of fewer words is one
    shingle; a null or blank text has none and links with nothing. A null id
    is a document like others (it sorts first and stays null). Rows of one id
    and text are one document, rows of one id and different texts are several.
    An empty table gives no rows; other columns are not read.
    """
    ready(docs.sparkSession)
    rows, names = row_keys(docs, id_col, text_col, F.lit(0).alias("_"))
    found = near_components(rows.select("k", "text"), words, num, den, block_tokens)
    if names is None:
        return found.select(F.nullif(F.col("k"), F.lit(NULL_ID)).alias(id_col), F.col("n").alias("n_shingles"), F.nullif(F.col("component"), F.lit(NULL_ID)).alias("component_id"))
    named = found.join(names, "k")
    least = named.groupBy("component").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("low"))
    return named.join(least, "component").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.nullif(F.col("low"), F.lit(NULL_ID)).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component one row, the one of the least (id, hash of the text) and, of equal ones, of the least hash of all columns. Rows without words stay, all of them. All columns stay, whatever their names."""
    ready(docs.sparkSession)
    row = F.struct(*[docs[c] for c in docs.columns])
    rows, names = row_keys(docs, id_col, text_col, row.alias("row"))
    found = near_components(rows.select("k", "text"), words, num, den)
    if names is None:
        heads = found.filter("k = component").select("k", "n").distinct()
    else:
        first = F.min(F.struct(F.coalesce("id", F.lit(NULL_ID)), "twin", "k", "n")).alias("h")
        heads = found.join(names, "k").groupBy("component").agg(first).select("h.k", "h.n")
    place = Window.partitionBy("k").orderBy(F.xxhash64("row"))
    return rows.select("k", "row").join(heads, "k").withColumn("place", F.row_number().over(place)).filter("place = 1 or n = 0").select("row.*")
