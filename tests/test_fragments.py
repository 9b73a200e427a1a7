"""Fragments are made where a document's blocks lie, and each block is in a virtual fragment once."""

from pyspark.sql import functions as F

from lectern.plans import queries as Q
from lectern.plans import routing as P

SCHEMA = "doc_id long, section_id string, type string, state string, block_pos int, block_id string, text string"


def test_blocks_of_dealt_documents_are_not_exchanged(spark, tmp_path):
    spark.range(1, 40).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (Q.fragment_blocks, Q.routed_fragments):
            plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
            assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_sections_that_overlap_and_explicit_conclusions(spark):
    rows = [(1, "a", "title", "confirmed", k, f"b{k}", "Текст") for k in range(3)] + [(1, "b", "introduction", "confirmed", k, f"b{k}", "Текст") for k in range(2, 5)]
    rows += [(1, "c", "chapter", "ambiguous", k, f"b{k}", "Выводы по главе" if k == 70 else "Текст") for k in range(5, 75)]
    rows += [(2, "c", "chapter", "confirmed", 0, "b0", "Выводы"), (2, "x", "chapter_conclusions", "confirmed", 1, "b1", "Текст"), (None, "n", "title", None, 0, "b0", "Текст")]
    got = {}
    for r in P.fragments(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.doc_id, r.fragment_id, r.complete), []).append(r.block_pos)
    got = {k: sorted(v) for k, v in got.items()}
    assert got == {
        (1, "a", True): [0, 1, 2], (1, "b", True): [2, 3, 4], (1, "c", False): list(range(5, 75)), (1, "c-conclusions", False): list(range(70, 75)),
        (1, "virtual-title_goal", True): [0, 1, 2],
        (1, "virtual-scientific_core", False): [*range(5), *range(5, 9), *range(65, 75)],
        (1, "virtual-defense_chapters", False): [*range(5, 8), *range(63, 75)],
        (1, "virtual-conclusion_global", False): [0, 1, 2, *range(70, 75)],
        (2, "c", True): [0], (2, "x", True): [1], (2, "virtual-scientific_core", True): [0], (2, "virtual-defense_chapters", True): [0, 1], (2, "virtual-conclusion_global", True): [1],
        (None, "n", None): [0],
    }
