"""Reports as text and as files."""

import pytest
from pyspark.sql import Row

from lectern.plans import queries as Q
from lectern.plans import report as W
from lectern.sources import files
from lectern.sources.named_files import NamedFilesWriter, write_named

SF = "/root/testdata/sf0.001"


def found(folder):
    return {p.relative_to(folder).as_posix(): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_reports_become_files(spark, tmp_path):
    texts = Q.whole_reports(spark, SF)
    files.write_reports(texts, str(tmp_path / "out"))
    assert found(tmp_path / "out") == {f"{r.doc_id}.md": r.text for r in texts.collect()}


def test_a_killed_and_repeated_task_leaves_each_file_once(tmp_path):
    writer = NamedFilesWriter(str(tmp_path / "out"), overwrite=False)

    def dying():
        yield Row(name="a.md", content="half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    first = writer.write(iter([Row(name="a.md", content="1"), Row(name="b.md", content=None)]))
    writer.write(iter([Row(name="a.md", content="1"), Row(name="b.md", content=None)]))  # a second attempt that isn't committed
    second = writer.write(iter([Row(name="c.md", content=b"\x00\xff")]))
    assert all("_temporary" in p.parts for p in (tmp_path / "out").rglob("*"))
    writer.commit([first, writer.write(iter([])), second, None])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.md", "b.md", "c.md"]
    assert (tmp_path / "out/a.md").read_text() == "1" and (tmp_path / "out/c.md").read_bytes() == b"\x00\xff"


def test_abort_names_and_modes(spark, tmp_path):
    out = tmp_path / "out"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "name string, content string")
    write_named(rows(("a", "1"), ("b", "2")), str(out))
    write_named(rows(("b", "3"), ("c", "4")), f"file:{out}", overwrite=False)
    assert found(out) == {"a": "1", "b": "3", "c": "4"}
    for bad in (rows(("d", "1"), ("d", "2")), rows(("x/y", "1")), rows((None, "1"))):
        with pytest.raises(Exception, match="names occur more than once|not the name of a file"):
            write_named(bad, str(out), overwrite=False)
        assert found(out) == {"a": "1", "b": "3", "c": "4"}
    write_named(rows(("e", "5")), str(out))
    assert found(out) == {"e": "5"}
    write_named(rows(("e", "5")).limit(0), str(out))
    assert found(out) == {}


RESULTS = "doc_id long, rule_id string, rule_order int, status string, severity string, weight double, layer string, detector_id string"


def test_counts_of_all_levels(spark):
    rows = [(1, f"r{k}", k, s, v, 1.0, "core", None) for k, (s, v) in enumerate([("violation", "critical"), ("violation", "minor"), ("pass", "critical"), ("uncertain", None), (None, "info")])]
    r = W.report_counts(spark.createDataFrame(rows, RESULTS)).first()
    assert (r.n, r.n_violation, r.n_pass, r.n_uncertain, r.n_not_checked, r.n_critical, r.n_minor, r.n_info) == (5, 2, 1, 1, 0, 1, 1, 0)


def test_a_report_of_missing_columns(spark):
    results = spark.createDataFrame([(1, "r0", 0, "violation", "major", 3.0, "core", None), (1, "r1", 1, "pass", "major", 3.0, "core", None), (1, "r2", 2, "pass", "major", 3.0, "core", None)], RESULTS)
    rules = spark.createDataFrame([("r0", "T", "Must", "core", 2)], "rule_id string, title string, requirement string, source_label string, source_line int")
    meta = spark.createDataFrame([(1, "n")], "doc_id long, name string")
    text = W.report_texts(W.head_lines(results, meta), W.result_lines(results, rules)).first().text
    assert "/100\n" in text and "67/100" in text and "### r0 — T\n" in text and "### r1\n\n- **Результат:** \n" in text
    assert text.count("\n## ") == 6 and "## Неопределённо (0)\n" in text


def test_usage_counts_packets_once(spark):
    calls = spark.createDataFrame([(1, 1, 10, 5, 7, 1, 4), (1, 2, 10, 5, 7, 1, 4), (1, 1, 3, 0, 1, None, None), (2, 1, 1, 1, 1, None, None)], "doc_id long, attempt int, est_tokens long, wait_ms long, duration_ms long, packet int, candidates int")
    got = sorted(map(tuple, W.call_usage(calls).collect()))
    assert got == [(1, 3, 1, 1, 4, 23, 10, 15), (2, 1, 0, 0, 0, 1, 1, 1)]
