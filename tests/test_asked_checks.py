"""The catalogue runs the checks that its rules ask for, over theses that are dealt before they are read."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import terms as T
from lectern.plans import checking as C
from lectern.plans import theses

SF = "/root/testdata/sf0.001"


def test_theses_are_dealt_over_all_slots(spark):
    """A table of customers is one small file; its theses were made, and read again by most plans, in one task."""
    assert theses.theses(spark, SF).rdd.getNumPartitions() >= 4


def test_what_no_rule_asks_for_is_not_run(spark):
    docs = theses.theses(spark, SF).filter("doc_id <= 30").localCheckpoint()
    b = B.blocks(docs).localCheckpoint()
    none = spark.createDataFrame([], "doc_id long, section_id string, type string, label string, state string, start_pos int, end_pos int")
    kept = []

    def keep(rows):
        kept.append(rows)
        return rows.localCheckpoint()

    def results(*rules, titles=lambda: pytest.fail("no rule reads titles")):
        kept.clear()
        asked = theses.rule_table(spark).filter(F.col("rule_id").isin(*rules))
        rows = C.check_catalogue(docs.select("doc_id"), b, asked, titles, none, T.known_terms(spark), keep)
        return {(r.doc_id, r.rule_id): r.status for r in rows.collect()}

    bad = lambda p: {k: "violation" if k % p == 0 else "pass" for k in range(31)}
    assert results("CORE-3-1") == {(k, "CORE-3-1"): s for k, s in bad(5).items()} and len(kept) == 3
    assert results("CORE-17") == {(k, "CORE-17"): s for k, s in bad(16).items()} and len(kept) == 3
    assert results("CORE-5-4", "CORE-14") == {(k, "CORE-5-4"): s for k, s in bad(19).items()} and len(kept) == 3
    assert results("CORE-14") == {}
