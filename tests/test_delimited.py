"""Delimited files cut in splits, against one reading of the same bytes."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.sources import delimited as Z
from lectern.sources import files

ODD = '﻿a,b,"c, ""d"""\r\n"x\ny",mid"dle,"qu"oted,\r\r\n,,\n"""",""\n"open to the end\n1,2'


def sequential(text, sep=","):
    """The rows as a state machine over characters gives them."""
    text = text.removeprefix("﻿")
    rows, row, field, quoted, k = [], [], "", False, 0
    while k < len(text):
        c = text[k]
        if c == '"':
            if quoted and text[k + 1 : k + 2] == '"':
                field += '"'
                k += 1
            else:
                quoted = not quoted
        elif not quoted and c == sep:
            row.append(field)
            field = ""
        elif not quoted and c in "\r\n":
            rows.append([*row, field])
            row, field = [], ""
        else:
            field += c
        k += 1
    return [r for r in [*rows, [*row, field]] if any(r)]


def in_splits(path, size):
    """All splits read one by one, each with the state that the marks before it give."""
    options = {"path": str(path), "splitbytes": str(size)}
    counts = [r for s in Z.DelimitedReader(options | {"count": "true"}).partitions() for r in Z.DelimitedReader(options | {"count": "true"}).read(s)]
    inside, total = [], 0
    for name, start, marks in counts:
        if total % 2:
            inside.append([name, start])
        total += marks
    reader = Z.DelimitedReader(options | {"inside": json.dumps(inside)})
    return [r for s in reader.partitions() for r in reader.read(s)]


def test_odd_forms():
    assert Z.plain_rows(ODD.encode()) == sequential(ODD)
    assert Z.plain_rows(b"") == [] and Z.plain_rows(b"\n\r\n,,\n") == []


@pytest.mark.parametrize("more", [1, 3, 1 << 16])
def test_every_split_size_gives_the_same(tmp_path, monkeypatch, more):
    monkeypatch.setattr(Z, "MORE", more)
    rng = random.Random(5)
    for n, text in enumerate([ODD, "", "﻿", "a", "\n\n", '"', "".join(rng.choice('ab,"\n\ré') for _ in range(120))]):
        raw = text.encode()
        path = tmp_path / f"f{n}.csv"
        path.write_bytes(raw)
        for size in range(1, len(raw) + 2):
            got = in_splits(path, size)
            assert [f for _, _, f in got] == sequential(text), (text, size)
            assert [a for _, a, _ in got] == sorted({a for _, a, _ in got})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='ab,"\n\ré;', max_size=60), st.integers(1, 20))
def test_random_texts(tmp_path_factory, text, size):
    path = tmp_path_factory.mktemp("d") / "t.csv"
    path.write_text(text, newline="")
    assert [f for _, _, f in in_splits(path, size)] == sequential(text)


def test_read_as_a_source(spark, tmp_path):
    texts = {"a.csv": ODD * 20, "b.csv": 'h,k\n"1\n2",3\n' * 50, "c.csv": "", "_skipped.csv": "x"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    for size in (7, 64, Z.SPLIT):
        got = {}
        for r in Z.read_delimited(spark, str(tmp_path), split_bytes=size).orderBy("path", "at").collect():
            got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.fields)
        assert got == {k: sequential(t) for k, t in texts.items() if t and not k.startswith("_")}
    assert Z.read_delimited(spark, f"file:{tmp_path}/b.csv").count() == 100


def test_headers(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.csv").write_text(f"k,v\n{n},x\n{n}\n", newline="")
    assert sorted(map(tuple, Z.by_header(Z.read_delimited(spark, str(tmp_path), split_bytes=3)).collect()), key=str) == [("1", "x"), ("1", None), ("2", "x"), ("2", None)]
    (tmp_path / "3.csv").write_text("other\n", newline="")
    with pytest.raises(ValueError):
        Z.by_header(Z.read_delimited(spark, str(tmp_path)))


def test_written_lines_come_back(spark, tmp_path):
    values = [("a", 'say "hi"', 1), ("x,y", "two\nlines\r\n", None), ("é", "", 3), ('"', ",", 4)]
    rows = spark.createDataFrame(values, "a string, b string, n int")
    Z.delimited_text(rows).coalesce(1).write.text(str(tmp_path / "out"))
    got = sorted(r.fields for r in Z.read_delimited(spark, str(tmp_path / "out"), split_bytes=5).collect())
    assert got == sorted([a, b, "" if n is None else str(n)] for a, b, n in values)


def test_rules_with_a_byte_order_mark_and_toggles(spark, tmp_path):
    (tmp_path / "core.csv").write_bytes("﻿Group,Number,Requirement,Correct,Incorrect\r\n\"Группа 1. Стиль\",1.1,Писать \"так, а\" не иначе.,–,плохо\r\nx,,y,,\r\n".encode())
    r = files.read_core_rules(spark, str(tmp_path / "core.csv")).collect()
    assert [(x.rule_id, x.category, x.requirement, x.correct, x.incorrect) for x in r] == [("CORE-1-1", "Стиль", "Писать так, а не иначе.", None, "плохо")]
    (tmp_path / "soft.csv").write_bytes("n;c;r;i\n7;Стиль;\"Длинное;\nтребование\";нет\n".encode())
    assert [tuple(x)[:6] for x in files.read_soft_rules(spark, str(tmp_path / "soft.csv")).collect()] == [("SOFT-007", "soft:7", "soft", "7", "Стиль", "Длинное; требование")]


def test_routing_file(spark, tmp_path):
    (tmp_path / "routing.json").write_text(json.dumps({"version": 1, "rules": {"CORE-1-1": {"strategy": "llm", "selectors": ["title_goal"], "exhaustive": True}, "SOFT-007": {"strategy": "manual", "reason": "by hand", "selectors": 5}}}))
    rows = sorted(map(tuple, files.read_routing(spark, str(tmp_path / "routing.json")).collect()))
    assert rows == [("CORE-1-1", "llm", ["title_goal"], True, None, None), ("SOFT-007", "manual", None, None, None, "by hand")]
