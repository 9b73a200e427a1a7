"""Column helpers for text: normal forms, matches with their places, quotes around them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a match; texts lose them first.
OPEN, CLOSE = "\x01", "\x02"
#: A word boundary that knows letters of every script.
EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SPACES = r"[\s\x{00A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]"
#: One that isn't the plain space, and runs of white space that aren't one plain space: what is a plain space already needn't be written again.
ODD_SPACE = f"[[^ -~]&&{SPACES}]"
UNEVEN = f"{ODD_SPACE}{SPACES}*| {SPACES}+"

#: Words without content (fixed values).
STOP_WORDS = (
    "это", "как", "что", "для", "или", "при", "также", "так", "все", "всех", "его", "ее", "она", "они", "над", "под", "без", "после", "перед", "если",
    "где", "когда", "который", "которые", "данных", "работы", "работа", "главе", "глава", "раздел", "текст", "текста", "тексте", "быть", "может",
    "должен", "должна", "должны", "было", "были", "будет", "будут", "чтобы", "этого", "этой", "этих", "этом", "такой", "такие", "такого",
    "требование", "совет",
)


def pattern(regex: str, boundary: str = "intent") -> str:
    """A Java pattern from one written with \\b and \\s: ``intent`` boundaries know all letters, ``ascii`` ones only A-Z, digits and underscore."""
    return regex.replace(r"\b", EDGE if boundary == "intent" else ASCII_EDGE).replace(r"\s", SPACES)


def collapse(text: Column) -> Column:
    """White space runs as one space, without ends."""
    return F.trim(F.regexp_replace(text, UNEVEN, " "))


def norm_text(text: Column) -> Column:
    """The form in which quotes are looked for: lower case, e for io, straight quotes, single spaces."""
    return collapse(F.translate(F.lower(text), "ё«»“”„", 'е"""""'))


def normalize(text: Column) -> Column:
    """Clean extracted text: no carriage returns or zero-width marks, plain spaces, no blanks at line ends, two newlines at most. (Canonical composition is ``nfc``.)"""
    t = F.translate(text, "\r​⁠", "")
    t = F.regexp_replace(F.translate(t, " ", " "), r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


#: Characters below the combining marks, Cyrillic without its own, and common punctuation: texts of these alone are composed already.
COMPOSED = r"\A[\x00-\x{02FF}\x{0400}-\x{0482}\x{048A}-\x{052F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{2116}]*\z"


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no function for it, so Arrow batches go to Python; texts that are composed already, as their characters say, don't."""
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(composed(F.when(~text.rlike(COMPOSED), text)), text)


def compact(text: Column, n: int) -> Column:
    """Collapsed, and cut to n characters with an ellipsis."""
    t = collapse(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def context_quote(text: Column, at: Column, length: Column, before: int, after: int) -> Column:
    """The text around a match that starts at the 0-based place ``at``, collapsed."""
    start = F.greatest(F.lit(0), at - before)
    return collapse(F.substring(text, start + 1, at + length + after - start))


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct content words in order of first use."""
    words = F.split(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)))


def unmarked(text: Column) -> Column:
    """The text with blanks for the characters that mark matches; few texts have any."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, "  ")).otherwise(text)


def marked(text: Column, regex: str) -> Column:
    """The text (without marks) with marks around all matches."""
    return F.regexp_replace(text, regex, F.lit(f"{OPEN}$0{CLOSE}"))


#: Lengths that are summed anew for each match, as a power of two.
STRETCH = 6


def explode_marked(df: DataFrame, keep: tuple[str, ...], text: Column, most: Column | None = None) -> DataFrame:
    """A row for every match of a ``marked`` text, or the first ``most``: ``keep`` columns, ``match_idx`` (0-based), ``match``, ``match_at`` (0-based place).

    The parts between marks and their lengths are columns, as an expression that is read
    twice would run twice. A place is the sum of the lengths before it: those of whole
    stretches are carried along, the few behind them are summed. (A fold that carries all
    matches copies them at each step.)
    """
    rows = df.select(*keep, F.split(text, OPEN).alias("_parts"))
    rows = rows.select(*keep, "_parts", F.transform("_parts", lambda part, i: F.length(part) - F.when(i > 0, 1).otherwise(0)).alias("_lengths"))

    def total(first: Column, n: Column) -> Column:
        return F.aggregate(F.slice("_lengths", first, n), F.lit(0), lambda a, b: a + b)

    whole = F.shiftright(F.size("_lengths") - 1, STRETCH)
    sums = F.aggregate(F.slice(F.sequence(F.lit(0), whole), F.lit(2), whole), F.array(F.lit(0)), lambda s, c: F.array_append(s, F.element_at(s, -1) + total(F.shiftleft(c - 1, STRETCH) + 1, F.lit(1 << STRETCH))))
    rows = rows.select(*keep, "_parts", "_lengths", sums.alias("_sums"))

    def hit(part: Column, i: Column) -> Column:
        before = F.shiftright(i + 1, STRETCH)
        at = F.get(F.col("_sums"), before) + total(F.shiftleft(before, STRETCH) + 1, (i + 1).bitwiseAND((1 << STRETCH) - 1))
        return F.struct(i.alias("match_idx"), F.substring_index(part, CLOSE, 1).alias("match"), at.alias("match_at"))

    # the part before the first mark holds no match
    n = F.greatest(F.size("_parts") - 1, F.lit(0))
    return rows.select(*keep, F.inline(F.transform(F.slice("_parts", F.lit(2), n if most is None else F.least(n, most)), hit)))


def explode_matches(df: DataFrame, text_col: str, regex: str, keep: tuple[str, ...]) -> DataFrame:
    """A row for every match: ``keep`` columns, ``match_idx`` (0-based), ``match``, ``match_at`` (0-based place), without Python."""
    return explode_marked(df.filter(F.col(text_col).rlike(regex)), keep, marked(unmarked(F.col(text_col)), regex))
