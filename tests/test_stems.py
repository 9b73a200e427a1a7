"""The stem index: every pattern that matches a text is among its candidates, and few others are."""

import random
from re import _constants as K
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import pattern
from lectern.operators import blocks as B
from lectern.operators import detectors as D
from lectern.operators.stems import Index, stems_of
from lectern.plans import theses
from lectern.plans.queries import NEUTRAL

SF = "/root/testdata/sf0.001"
PIECES = ["", " ", "\n", "а", "я", "5", "т", "x", ". ", ", ", "\u00a0", "_", "-", "Слово ", "word ", "№", "\x01"]


def grown(tree, rng):
    """A random text that a parsed pattern may match; classes of letters are Cyrillic here."""
    out = []
    for op, av in tree:
        if op is K.LITERAL:
            out.append(chr(av))
        elif op is K.IN:
            o, v = rng.choice([x for x in av if x[0] is not K.NEGATE])
            if o is K.CATEGORY:
                out.append(rng.choice("0123456789") if v is K.CATEGORY_DIGIT else rng.choice(" \n\u00a0"))
            else:
                out.append(chr(v) if o is K.LITERAL else chr(rng.randint(*v)))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, sub = av
            out += [grown(sub, rng) for _ in range(rng.randint(low, min(high, low + 2)))]
        elif op is K.SUBPATTERN:
            out.append(grown(av[3], rng))
        elif op is K.BRANCH:
            out.append(grown(rng.choice(av[1]), rng))
        elif op is K.ANY:
            out.append(rng.choice("абв "))
    return "".join(out)


def planted(specs, each=6, seed=1):
    rng, rows = random.Random(seed), []
    for _, _, regex, scope in specs:
        tree = parser.parse(regex.replace(r"\p{L}", "[а-яё]").replace("[[а-яё]-]", "[а-яё-]"))
        for _ in range(each):
            text = grown(tree, rng)
            text = rng.choice([text, text.upper(), text.lower(), text.replace("к", "K"), text.replace("і", "İ")])
            rows.append((scope, rng.choice(PIECES) + rng.choice(PIECES) + text + rng.choice(PIECES) + rng.choice(PIECES)))
    return rows


def block_rows(spark, rows):
    return spark.createDataFrame([(s, k, k, f"b{k}", t) for k, (s, t) in enumerate(rows)], "scope string, doc_id long, block_pos int, block_id string, text string")


@pytest.mark.parametrize("boundary", ["intent", "ascii"])
def test_candidates_hold_all_matches(spark, boundary):
    rows = block_rows(spark, planted(D.PACK))
    may = Index(D.PACK, boundary).candidates(rows)
    text = F.translate("text", "\x01\x02", "  ")
    flags = F.array_compact(F.array(*[F.when(text.rlike(pattern(r, boundary)), F.lit(n)) for n, (_, _, r, _) in enumerate(D.PACK)]))
    lost = may.withColumn("_does", flags).filter(F.size(F.array_except("_does", "_may")) > 0).select("text", F.array_except("_does", "_may")).collect()
    assert lost == []
    found = {n for r in may.select(flags.alias("f")).collect() for n in r.f}
    if boundary == "intent":
        assert len(found) >= len(D.PACK) - 2  # the planted texts reach nearly every pattern


def test_hits_equal_those_of_all_patterns(spark, monkeypatch):
    rows = block_rows(spark, [(scope, t) for s, t in planted(D.PACK, each=3, seed=2) for scope in {s, "all"}])
    got = sorted(map(repr, D.hits(rows, D.PACK).collect()))
    monkeypatch.setattr(Index, "candidates", lambda self, rows, text="text", out="_may": rows.withColumn(out, F.sequence(F.lit(0), F.lit(len(D.PACK) - 1))))
    assert got == sorted(map(repr, D.hits(rows, D.PACK).collect()))
    assert got


def test_few_patterns_run(spark):
    b = B.blocks(theses.theses(spark, SF)).withColumn("scope", F.lit("all"))
    n = b.count()
    assert D.candidates(b, [(d, i, r, "all") for d, i, r, _ in D.PACK]).count() < 3 * n


def test_stems_are_known_for_the_packs():
    assert all(stems_of(r) for _, _, r, _ in D.PACK) and all(stems_of(r) for _, _, r, _ in NEUTRAL)


@pytest.mark.parametrize(
    ("regex", "stems"),
    [
        (r"(?iu)\bнужно\b", {("word", "НУЖНО")}), (r"(?iu)нужно", None), (r"\bа\s+но", {("word", "НО*")}), (r"\bтак\b", {("word", "ТАК")}), (r"(?iu)\bтак", {("word", "ТАК*")}),
        (r"\b(?:да|нет)\b", {("word", "ДА*"), ("word", "НЕТ*")}), (r"\b(?:да|\d*)", None), (r"x*", None), (r"(?iu)[её]ж", None), (r"\d{4,}", {("sign", "9999")}), (r"(?i:\bда\b)\d", {("sign", "9")}),
        (r"\bда?м", {("word", "Д*")}), (r"broken(", None), (r"\p{Sc}5", None), (r"\bstraße\b", {("word", "STRA*")}),
    ],
)
def test_stems(regex, stems):
    got = stems_of(regex)
    assert (None if got is None else set(got)) == stems


def test_empty_pack_null_text_and_unknown_patterns(spark):
    rows = block_rows(spark, [("all", None), ("all", ""), ("all", "xyz")])
    assert D.hits(rows, [("d", 0, "y", "all")]).count() == 1
    assert D.hits(rows, [("d", 0, r"\bxyz\b", "all")]).count() == 1
    assert [r._may for r in Index([("d", 0, r"\bxyz\b", "all"), ("d", 1, "%", "all")]).candidates(rows).collect()] == [[], [], [0]]
