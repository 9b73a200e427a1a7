r"""Quality rules by distribution divergence, in DataFrame functions alone.

Two histograms of a document are compared with those of each reference
language: its characters by class, and its words by "which common word of the
language, or none". The measure is the Jensen-Shannon distance (base 2, the
square root of the divergence, 0 to 1); a document is as far from a language as
the mean of its two distances, and is judged by the nearest language. A text
with fewer characters or words than the guards is left to the base rules, as its
histograms say little.

The base rules and counts: words are ``[^\x20\x09-\x0D]+``; ``n_repeat_words``
counts words in 8-word windows that the text holds at least twice. It is found row
by row: only of a text in which the hash of four words occurs again are the
windows themselves compared, so nothing is shuffled and no other row pays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Shares of character classes in running prose: lower-case letters
#: of ASCII, upper-case ones, letters beyond ASCII, digits, white space, sentence
#: punctuation, other characters.
CLASS_SHARES = {
    "en": (0.785, 0.025, 0.001, 0.005, 0.165, 0.017, 0.002),
    "de": (0.762, 0.048, 0.016, 0.005, 0.146, 0.020, 0.003),
    "fr": (0.742, 0.024, 0.032, 0.005, 0.165, 0.028, 0.004),
    "es": (0.765, 0.022, 0.026, 0.005, 0.164, 0.016, 0.002),
}
#: Fixed values. The most common words of each language, in order of their frequency.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be by at this are from or have an they which one had not but were all we when there can been more if their".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la avec aux d'un son ou mais nous comme tout cette être".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split(),
}
#: The word of rank r makes ZIPF / (r + SHIFT) of all words (the law of Zipf and Mandelbrot).
ZIPF, SHIFT = 0.11, 1.2
#: Characters of the classes, in the same order but for the last: patterns that are taken away one after the other.
CLASSES = ("[a-z]+", "[A-Z]+", r"[\p{L}\p{M}]+", r"[\p{Nd}]+", r"[\x20\x09-\x0D]+", "[.,;:!?'\"()-]+")


def word_shares(lang: str) -> dict[str, float]:
    """The reference's common words with their shares; a word that stands twice counts by its first rank."""
    return {w: ZIPF / (r + SHIFT) for r, w in reversed(list(enumerate(COMMON_WORDS[lang], 1)))}


MIN_CHARS = 200
MIN_WORDS = 30
#: Greatest distance of a kept document's classes and of its words from the nearest language, by the mean of both.
MOST_DISTANCE = 0.30
WINDOW = 8


def _fours(words: Column) -> Column:
    """A hash of each four words in a row."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(one), lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3))), 1, F.greatest(F.size(h) - 3, F.lit(0))))[0]


def _eights(words: Column) -> Column:
    """The windows of eight words, as texts."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))


def _with_repeats(t: DataFrame) -> DataFrame:
    """Add _cover, the words in windows that occur twice: the sorted places of such windows cover 8 words each, less what they share. Each step is a column of its own, or an expression that uses it twice would make it twice; only texts with _repeats pay."""
    on = F.col("_repeats")
    placed = F.sort_array(F.transform(_eights(F.col("_words")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("_placed", F.when(on, placed))
    n = F.size("_placed")
    pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("_same", F.when(on, F.flatten(F.zip_with(F.slice("_placed", 1, n - 1), F.slice("_placed", 2, n - 1), pair))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).alias("n"), p.alias("at"))
    return t.withColumn("_cover", F.when(on, F.aggregate(F.sort_array(F.array_distinct("_same")), start, step, lambda s: s["n"])).otherwise(0)).drop("_placed", "_same")


def js_distance(shares: Column, reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of two distributions over the same bins: an array of shares and the reference's shares."""
    own = F.array(*[F.lit(float(q)) for q in reference])

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(shares, own, part), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def word_distance(present: Column, k: int, listed: float) -> Column:
    """Jensen-Shannon distance of a text's words from language k: ``present`` holds the share p and the shares q by language of each common word of the text, and ``listed`` is what the language's common words make up together. A common word that is absent adds q; all other words are one bin."""

    def both(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + q * F.log2(q / m)

    own = F.transform(F.filter(present, lambda x: F.get(x["q"], F.lit(k)) > 0), lambda x: F.struct(x["p"].alias("p"), F.get(x["q"], F.lit(k)).alias("q")))
    terms = F.aggregate(own, F.lit(listed), lambda s, x: s + both(x["p"], x["q"]) - x["q"])
    rest = F.greatest(F.aggregate(own, F.lit(1.0), lambda s, x: s - x["p"]), F.lit(0.0))
    return F.sqrt(F.greatest((terms + both(rest, F.lit(1.0 - listed))) / 2, F.lit(0.0)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_distance: float = MOST_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, carry: bool = False, distance: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    A null text has no words and fails the base rules, as a blank one does.
    Null and repeated ids give a row for each row; other columns are not read;
    an empty table gives no rows. No shuffle. With ``carry`` the whole row stands
    in a last column, ``row``; ``distance`` adds the distance that the verdict rests on
    (null where it is not asked for).
    """
    row = ["row"] if carry else []
    t = docs.select(*[F.struct(*[docs[c] for c in docs.columns]).alias(c) for c in row], F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.withColumn("_words", F.filter(F.split("_t", "[ \t\n\x0b\f\r]"), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \t\x0b\f\r]"))
    t = t.withColumn("_lines", F.when(F.instr("_t", "\n") > 0, lines).otherwise(F.array().cast("array<string>")))
    # a window that occurs again holds four words that do
    t = t.withColumn("_h4", F.when(F.size("_words") > WINDOW, _fours(F.col("_words"))))
    t = t.withColumn("_repeats", F.coalesce(F.size(F.array_distinct("_h4")) < F.size("_h4"), F.lit(False)))
    t = _with_repeats(t)
    lefts, left = [F.length("_t")], F.col("_t")
    for k, pattern in enumerate(CLASSES):
        t = t.withColumn(f"_left{k}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"_left{k}")
        lefts.append(F.length(left))
    by_word = {lang: word_shares(lang) for lang in COMMON_WORDS}
    every = sorted({w for words in by_word.values() for w in words})
    common = F.filter(F.transform("_words", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))), lambda w: w.isin(every))
    # each common word once, with its repetitions behind it
    t = t.withColumn("_runs", F.regexp_extract_all(F.concat(F.array_join(F.sort_array(common), " "), F.lit(" ")), F.lit(r"([^ ]+ )\1*"), F.lit(0)))
    t = t.select(
        *row,
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_t") - (lefts[4] - lefts[5])).cast("long").alias("word_chars"),
        (F.length(left) - F.length(F.regexp_replace(left, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_cover").cast("long").alias("n_repeat_words"),
        F.length("_t").alias("_chars"),
        F.array(*[(a - b) for a, b in zip(lefts, lefts[1:] + [F.lit(0)], strict=True)]).alias("_classes"),
        "_runs",
    )
    t = t.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    chars, words = F.greatest(F.col("_chars"), F.lit(1)).cast("double"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    by_class = F.transform("_classes", lambda n: n / chars)
    known = F.create_map(*[x for w in every for x in (F.lit(w), F.array(*[F.lit(float(own.get(w, 0.0))) for own in by_word.values()]))])

    def counted(run: Column) -> Column:
        word = F.substring_index(run, " ", 1)
        return F.struct((F.length(run) / (F.length(word) + 1) / words).alias("p"), F.element_at(known, word).alias("q"))

    t = t.withColumn("_present", F.transform("_runs", counted))
    each = [(js_distance(by_class, CLASS_SHARES[lang]) + word_distance(F.col("_present"), k, sum(own.values()))) / 2 for k, (lang, own) in enumerate(by_word.items())]
    judged = (F.col("_chars") >= min_chars) & (F.col("n_words") >= min_words)
    t = t.withColumn("_distance", F.when(judged & ~F.col("base_failed"), F.least(*each)))
    kept = ~F.col("base_failed") & (F.col("_distance").isNull() | (F.col("_distance") <= most_distance))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *(["_distance"] if distance else []), *row)
