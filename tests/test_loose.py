"""Answers of odd form, and requests that end with a fatal one."""

import json

from pyspark.sql import functions as F

from lectern.functions import loose as J
from lectern.operators import sections as M
from lectern.plans import provider as V


def test_fields_of_any_type(spark):
    docs = ['{"a": "x", "n": "5", "l": [1, {"b": 2}, null, "t", [3]]}', '{"a": {"b": 1}, "n": [1], "l": "no list"}', '{"a": 7, "n": 2.6}', "[1, 2]", "broken{", None]
    rows = spark.createDataFrame([(t,) for t in docs], "t string").withColumn("v", J.parsed(F.col("t")))
    v = F.col("v")
    got = rows.select(J.text(v, "$.a").alias("a"), J.value(v, "$.n", "int").alias("n"), J.texts(v, "$.l").alias("l"), F.size(J.objects(v, "$.l")).alias("o"), F.size(J.items(v)).alias("i")).collect()
    assert [tuple(r) for r in got] == [("x", 5, ["1", "t"], 1, 0), (None, None, [], 0, 0), ("7", 2, [], 0, 0), (None, None, [], 0, 2), (None, None, [], 0, 0), (None, None, [], 0, 0)]


def test_one_bad_section_spoils_itself_alone(spark):
    answer = {
        "sections": [
            {"type": "goal", "label": 5, "startBlockId": "b1", "endBlockId": "b2", "anchorBlockIds": ["b1", {"x": 1}, 3], "confidence": "0.5", "quote": ["q"]},
            "junk",
            {"type": ["goal"], "confidence": {"a": 1}, "anchorBlockIds": "b1"},
        ],
        "issues": [{"code": "c", "message": "m", "sectionIndexes": [0, "1", "x", None]}, 7, {"message": ["m"]}],
    }
    rows = spark.createDataFrame([(1, f"Here:\n```json\n{json.dumps(answer)}\n```"), (2, "no json"), (3, '{"sections": {}}')], "doc_id long, raw string")
    got = [(r.raw_idx, r.type, r.label, r.anchorBlockIds, r.confidence, r.quote) for r in M.parse_answer(rows).orderBy("raw_idx").collect()]
    assert got == [(0, "goal", "5", ["b1", "3"], 0.5, None), (1, None, None, [], None, None), (2, None, None, [], None, None)]
    sections = spark.createDataFrame([(1, 0, "section-1"), (1, 1, "section-2")], "doc_id long, raw_idx int, section_id string")
    assert [tuple(r) for r in M.model_issues(rows, sections).collect()] == [(1, "c", "m", "warning", ["section-1", "section-2"])]


def test_a_fatal_answer_ends_a_partition(spark):
    requests = spark.createDataFrame([(k, m) for k, m in enumerate(["a", "flaky", "stop", "b", "c"])], "doc_id long, message string").coalesce(1)

    def call(m):
        if m == "stop":
            raise V.Fatal("401")
        if m == "flaky":
            raise RuntimeError("again")
        return m.upper()

    got = {r.message: (r.raw, r.error) for r in V.answered(requests, call).collect()}
    assert got["a"] == ("A", None) or got["a"][1].startswith("not sent")
    assert got["stop"] == (None, "Fatal: 401") and sum(e is not None and e.startswith("not sent after Fatal: 401") for _, e in got.values()) + sum(r is not None for r, _ in got.values()) + (got["flaky"] == (None, "RuntimeError: again")) == 4


def test_content_in_parts(spark):
    rows = spark.createDataFrame([('[{"text": "a"}, {"type": "image"}, {"text": 5}]',), ("[not json",), ("plain",), (None,)], "t string")
    assert [r.x for r in rows.select(V.content_text(F.col("t")).alias("x")).collect()] == ["a5", "[not json", "plain", None]
