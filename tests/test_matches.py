"""Matches of a pack at size: each pattern runs once, places are linear, and a cap is known where matches are found."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import collapse, explode_matches
from lectern.operators import detectors as D
from lectern.operators import scopes as S
from lectern.plans import queries as Q

SF = "/root/testdata/sf0.001"
CODE = ["def", "class", "import", "from a import b", "SELECT x FROM", "INSERT INTO", "update t set", "Requirements:", "RULES:", "Generate   only", "return\nONLY", "No  commentary", "```", "İmport", "claſs", "ınsert into", "word", "7", "AB", "1.5"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 127, 128, 129, 5000])
def test_places_of_many_matches(spark, n):
    text = "é" + "".join(f"x{k} " + "я" * (k % 7) for k in range(n))
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = [(r.match_idx, r.match, r.match_at) for r in explode_matches(df, "text", r"x\d+", ("id",)).orderBy("match_idx").collect()]
    assert got == [(k, m[0], m.start()) for k, m in enumerate(re.finditer(r"x\d+", text))]


def code_rows(spark, n=400):
    rng = random.Random(5)
    texts = ["".join(rng.choice(CODE if rng.random() < 0.05 else CODE[-4:]) + rng.choice([" ", " ", "\n", " ", "", "\x85"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return spark.createDataFrame([("all", k % 40, k, f"b{k}", t) for k, t in enumerate(texts)], "scope string, doc_id long, block_pos int, block_id string, text string")


def test_no_prompt_is_missed(spark):
    """Whatever part of a text is a prompt, the text may be one."""
    rows = code_rows(spark)
    part = F.explode(F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(3)), lambda at: collapse(F.substring("text", at + 1, F.lit(40)))))
    parts = rows.withColumn("may", S.may_be_prompt(F.col("text"))).select("may", part.alias("quote")).filter(S.is_prompt(F.col("quote")))
    assert parts.count() > 40 and parts.filter("not may").count() == 0
    assert spark.createDataFrame([("some words: and a rule",)], "t string").filter(S.may_be_prompt(F.col("t"))).count() == 0


@pytest.mark.parametrize("most", [1, 3, 12])
def test_a_cap_that_is_known_leaves_the_same(spark, most):
    rows = code_rows(spark).unionByName(spark.createDataFrame([("all", 77, k, f"b{k}", "AB 7 CD 8.5 " * 40) for k in range(3)], "scope string, doc_id long, block_pos int, block_id string, text string"))
    pack = [("d", 0, "[A-Z]{2,10}", "all"), ("d", 1, r"\d", "all"), ("e", 0, r"\d", "all")]
    all_hits, few = D.hits(rows, pack), D.hits(rows, pack, most=most)
    want = sorted(map(repr, D.capped(all_hits, most).collect()))
    assert want == sorted(map(repr, D.capped(few, most).collect())) and len(want) > 40
    assert few.filter("doc_id = 77").count() == 3 * 3 * most


def test_documents_are_read_and_matched_once(spark):
    tree = plan(Q.pattern_hits(spark, SF))
    assert tree.count("parquet") == 1  # two scans before, one for each scope
    for _, _, regex, _ in Q.NEUTRAL:
        assert len(re.findall(re.escape(f"{regex}, ") + r".{0,3}\$0", tree)) == 1  # each ran three times for a row
    assert "array_insert" not in tree.split("inline(")[1].split("\n")[0]  # no fold carries the matches


def test_scopes_in_one_pass(spark):
    b = Q.lines(spark, SF)
    none = spark.createDataFrame([], "doc_id long, field string, block_pos int")
    cols = ["scope", "doc_id", "block_pos", "block_id", "text"]
    want = S.scoped(b, none, running=b).filter("scope in ('all', 'headings')").select(cols)
    assert sorted(map(repr, S.running_scopes(b).select(cols).collect())) == sorted(map(repr, want.collect()))


def test_white_space_forms_are_the_same(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab  \t\n  ﻿ \x85é ") for _ in range(12)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spaces = r"[\s\x{00A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]+"
    assert df.filter(collapse(F.col("t")) != F.trim(F.regexp_replace("t", spaces, " "))).count() == 0
    assert df.filter(F.regexp_replace("t", r"\t[ \t]*| [ \t]+", " ") != F.regexp_replace("t", r"[ \t]+", " ")).count() == 0


def test_a_block_gives_no_more_hits_than_are_kept(spark):
    generator = plan(Q.evidence_topk(spark, SF)).split("inline(")[1].split("\n")[0]
    assert "least(" in generator  # every match of a block went to the window before
    assert "least(" not in plan(Q.pattern_hits(spark, SF)).split("inline(")[1].split("\n")[0]  # which counts all
