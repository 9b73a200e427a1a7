"""An index of what the patterns of a pack can't match without.

Every pattern gives a few *stems*: beginnings of words, short whole words, or
signs (digits, punctuation and how they stand together), of which each of its
matches holds at least one. One pass over a block's words and signs then names
the few patterns that may match it, and only those run. A pattern whose stems
can't be told is asked for every block, so nothing is ever lost.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _constants as K
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import ODD_SPACE

#: Letters of a word's beginning that are kept, and how many alternatives a pattern may have.
LONGEST, MOST = 5, 40
#: Stand-ins for classes that the parser doesn't know: any letter, an upper-case one, a number.
_LETTER, _UPPER, _NUMBER, _OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
_CLASSES = {"L": _LETTER, "Lu": _UPPER, "N": _NUMBER}
#: Upper-case letters that only lower case makes equal to others.
_ALIKE = ("İKÅ", "IKÅ")
WORD, SIGN = "word", "sign"


def _plain_letter(c: str) -> bool:
    """Letters whose cases are one letter each, so that folding can't change a word's length."""
    return c.isalpha() and c not in "ßµſıİ" and (c < "\u0180" or "\u0400" <= c <= "\u045f") and len(c.upper()) == 1


def _is_word(c: str) -> bool:
    return c.isalnum() or c in ("_", _LETTER, _UPPER, _NUMBER)


class _Set:
    """What one element of a pattern can be: its characters, if they are few, and what is known of all of them."""

    def __init__(self, chars: set[str] | None, word: bool | None, sign: str | None):
        self.chars, self.word, self.sign = chars, word, sign


def _members(items: list) -> list[tuple[str, str]] | None:
    """(first, last) of each range of a class; None where it can't be told."""
    out = []
    for op, av in items:
        if op is K.LITERAL:
            out.append((chr(av), chr(av)))
        elif op is K.RANGE:
            out.append((chr(av[0]), chr(av[1])))
        elif op is K.CATEGORY and av is K.CATEGORY_DIGIT:
            out.append(("0", "9"))
        elif op is K.CATEGORY and av is K.CATEGORY_SPACE:
            out.append((" ", " "))
        else:
            return None
    return out


def _one(items: list, cased: bool) -> _Set:
    ranges = _members(items)
    if ranges is None:
        return _Set(None, None, None)
    chars = {chr(c) for a, b in ranges for c in range(ord(a), min(ord(b), ord(a) + MOST) + 1)} if all(ord(b) - ord(a) < MOST for a, b in ranges) else None
    ends = [c for r in ranges for c in r]
    word = True if all(map(_is_word, ends)) else False if chars is not None and not any(map(_is_word, chars)) else None
    signs = {_sign(a, cased) for a, _ in ranges} | {_sign(b, cased) for _, b in ranges}
    return _Set(chars, word, signs.pop() if len(signs) == 1 and (chars is None or len({_sign(c, cased) for c in chars}) == 1) else None)


def _sign(c: str, cased: bool) -> str | None:
    """The sign that a character is folded to; None where its fold isn't sure."""
    if c in "0123456789":
        return "9"
    if c in (_UPPER, _LETTER, _NUMBER, _OTHER) or c.isalnum():
        return "A" if cased and (c == _UPPER or c.isupper()) else None
    return " " if c.isspace() else c


class _Run:
    """What is known while the elements of a pattern go by from left to right."""

    def __init__(self, cased: bool, trusted: bool):
        self.cased, self.trusted = cased, trusted
        self.found: list[frozenset[tuple[str, str]]] = []
        self.words: list[str] | None = None  # beginnings of the word at hand, alternatives
        self.signs = ""
        self.starts = False  # whether a letter here starts a word

    def end_word(self, whole: bool) -> None:
        if self.words and all(self.words):
            self.found.append(frozenset((WORD, w if whole and len(w) < LONGEST else w[:LONGEST] + "*" * (len(w) < LONGEST)) for w in self.words))
        self.words = None

    def end_signs(self) -> None:
        if self.signs:
            self.found.append(frozenset({(SIGN, self.signs)}))
        self.signs = ""

    def cut(self, starts: bool = False, whole: bool = False) -> None:
        self.end_word(whole)
        self.end_signs()
        self.starts = starts

    def one(self, s: _Set) -> None:
        """An element that is there exactly once."""
        if s.word is False:
            self.end_word(True)
            self.starts = True
        elif s.chars and len(s.chars) <= 3 and all(map(_plain_letter, s.chars)):
            if self.words is None and self.starts:
                self.words = [""]
            if self.words is not None and len(self.words) * len(s.chars) <= MOST:
                self.words = [w + c.upper() for w in self.words for c in sorted(s.chars)]
            else:
                self.end_word(False)
            self.starts = False
        else:
            self.end_word(False)
            self.starts = False
        if s.sign is None:
            self.end_signs()
        else:
            self.signs += s.sign


def _weight(alternatives: frozenset[tuple[str, str]]) -> float:
    value = {"9": 1.0, "A": 0.4, " ": 0.2, ".": 0.4, ",": 0.4}
    each = [sum(value.get(c, 2.0) for c in t) if kind == SIGN else 1.3 * len(t.rstrip("*")) + (0.6 if "*" not in t else 0) for kind, t in alternatives]
    return min(each) - 0.1 * len(each)


def _walk(items: list, run: _Run) -> None:
    for op, av in items:
        if op is K.LITERAL:
            run.one(_one([(op, av)], run.cased))
        elif op is K.IN:
            run.one(_Set(None, None, None) if av[0][0] is K.NEGATE else _one(av, run.cased))
        elif op is K.SUBPATTERN and not (av[1] or av[2]):
            _walk(av[3], run)
        elif op is K.BRANCH:
            _branch(av[1], run)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            _repeat(*av, run)
        elif op is K.AT:
            edge = av is K.AT_BOUNDARY and run.trusted
            if edge:
                run.end_word(True)
            run.starts = run.starts or edge or av in (K.AT_BEGINNING, K.AT_BEGINNING_STRING)
        elif op is K.ASSERT_NOT and av[0] < 0 and len(av[1]) == 1 and av[1][0][0] is K.IN:
            out = {chr(v) for o, v in av[1][0][1] if o is K.LITERAL}
            run.starts = run.starts or {_LETTER, _NUMBER, "_"} <= out
        elif op not in (K.ASSERT, K.ASSERT_NOT):
            run.cut()


def _repeat(least: int, most: int, items: list, run: _Run) -> None:
    single = _one(items[0][1] if items[0][0] is K.IN and items[0][1][0][0] is not K.NEGATE else [items[0]], run.cased) if len(items) == 1 and items[0][0] in (K.LITERAL, K.IN) and not (items[0][0] is K.IN and items[0][1][0][0] is K.NEGATE) else None
    if least == most == 1:
        _walk(items, run)
    elif single is not None:
        for _ in range(min(least, 6)):
            run.one(single)
        if most > least:
            # more of the same may follow: what comes next needn't stand right behind
            blank, starts = single.word is False, run.starts
            run.end_word(blank and least > 0)
            run.end_signs()
            run.starts = blank and (starts or least > 0)
            if single.sign is not None and least:
                run.signs = single.sign  # whatever follows stands behind one of these
    elif least:
        inner = _Run(run.cased, run.trusted)
        inner.starts = run.starts
        run.cut()
        _walk(items, inner)
        inner.cut()
        run.found += inner.found
    else:
        run.cut()


def _branch(branches: list[list], run: _Run) -> None:
    """The alternatives need one of the stems of each; a branch that can't tell makes all of them useless."""
    starts, ends, union, sure = run.starts, [], set(), True
    run.cut(starts)
    for b in branches:
        inner = _Run(run.cased, run.trusted)
        inner.starts = starts
        _walk(b, inner)
        ends.append(inner.starts)
        inner.cut()
        if inner.found and sure:
            union |= max(inner.found, key=_weight)
        else:
            sure = False
    if sure and len(union) <= MOST:
        run.found.append(frozenset(union))
    run.starts = all(ends)


def stems_of(regex: str, boundary: str = "intent") -> frozenset[tuple[str, str]] | None:
    """Stems of which every match of the pattern holds one; None if none are known. ``boundary`` as in ``functions.text.pattern``."""
    python = re.sub(r"\\p\{(\w+)\}", lambda m: _CLASSES.get(m[1], _OTHER), regex.replace(r"\z", r"\Z"))
    if _OTHER in python:
        return None
    try:
        tree = parser.parse(python)
    except re.error:
        return None
    flags = tree.state.flags
    run = _Run(cased=not flags & re.IGNORECASE, trusted=boundary == "intent")
    _walk(list(tree), run)
    run.cut()
    return max(run.found, key=_weight) if run.found else None


def _beginning(k: int):
    return lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))


class Index:
    """The stems of a pack (detector, number, pattern, scope), each with the places of its patterns."""

    def __init__(self, specs: Sequence[tuple[str, int, str, str]], boundary: str = "intent"):
        self.places: dict[tuple[str, str], list[int]] = {}
        self.always: list[int] = []
        for n, (_, _, regex, _) in enumerate(specs):
            stems = stems_of(regex, boundary)
            if stems is None:
                self.always.append(n)
            for s in stems or ():
                self.places.setdefault(s, []).append(n)
        self.lengths = sorted({len(t) - 1 for kind, t in self.places if kind == WORD and t.endswith("*")})
        self.signs = sorted(t for kind, t in self.places if kind == SIGN)
        self.words = sorted(t for kind, t in self.places if kind == WORD)

    def candidates(self, rows: DataFrame, text: str = "text", out: str = "_may") -> DataFrame:
        """The rows with the places of the patterns that may match ``text``, each once, in column ``out``.

        Words are folded to upper case, which makes all cases of a letter equal; signs
        are what is left when upper-case letters, digits and white space become one each
        (no sign holds other letters, so they stay as they are). No shuffle.
        """
        none = F.array().cast("array<int>")
        listed = lambda ns: F.array(*map(F.lit, ns)).cast("array<int>")
        parts = [listed(self.always)]
        if self.words:
            folded = F.translate(F.upper(text), *_ALIKE)
            heads = F.array_distinct(F.regexp_extract_all(folded, F.lit(rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_]{{1,{LONGEST}}}"), F.lit(0)))
            rows = rows.withColumn("_heads", heads)
            shorter = [F.transform("_heads", _beginning(k)) for k in self.lengths]
            known = F.array_intersect(F.array(*map(F.lit, self.words)), F.concat("_heads", *shorter))
            places = F.create_map(*(x for w in self.words for x in (F.lit(w), listed(self.places[WORD, w]))))
            parts.append(F.coalesce(F.flatten(F.transform(known, lambda w: places[w])), none))
        if self.signs:
            shape = F.col(text)
            for regex, sign in (("[0-8]", "9"), (r"[\p{Lu}&&[^A]]", "A"), (ODD_SPACE, " ")):
                if any(sign in s for s in self.signs):
                    shape = F.regexp_replace(shape, regex, sign)
            rows = rows.withColumn("_shape", shape)
            parts += [F.when(F.contains("_shape", F.lit(s)), listed(self.places[SIGN, s])).otherwise(none) for s in self.signs]
        return rows.withColumn(out, F.array_distinct(F.concat(*parts))).drop("_heads", "_shape")
