"""Fill-in-middle, chat formatting and the Merkle manifest, against plain versions."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat_format as C
from lectern.llm import fill_in_middle as M
from lectern.llm import merkle

DOCS = "doc_id long, text string, output string, form string, restored int"
TEXTS = ["", None, "a", "é", "<P>", "x<", "P>y", "a<S>b", "naïve 文字 🤦🏽‍♀️ end", "one two\nthree \n\n four", " \t", "M>" * 40, "x" * 300_000 + "é<", "same", "same"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_middle(i, text, seed=1, percent=90, spm=20):
    t = text or ""
    d = sha(f"{seed}:{'' if i is None else i}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(m in t for m in M.MARKS) or h[2] % 100 >= percent:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middle_equals_plain(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, "o", "f", 1) for i, t in rows], DOCS)
    out = M.restore_middle(M.fill_in_middle(docs)).collect()
    key = lambda r: repr(tuple(r))
    got = sorted(((r.doc_id, r.n_units, r.form, r.prefix_units, r.middle_units, r.output, r.restored) for r in out), key=key)
    want = sorted(((i, *plain_middle(i, t), t or "") for i, t in rows), key=key)
    assert got == want
    assert {"psm", "spm", "plain"} == {r.form for r in out}
    assert M.middle_digests(docs).count() == len(rows)
    assert M.middle_digests(docs.limit(0)).collect() == []


def test_middle_by_words_and_lines(spark):
    docs = spark.createDataFrame([(k, f"w{k} two  three\nfour {k}\n\nlast") for k in range(60)], "doc_id long, text string")
    for unit, pattern in (("words", r"\S+\s*"), ("lines", r"[^\n]*\n|[^\n]+")):
        for r in M.restore_middle(M.fill_in_middle(docs, unit=unit, percent=100)).join(docs, "doc_id").collect():
            units = re.findall(pattern, r.text)
            assert r.n_units == len(units) and r.restored == r.text
            assert f"<P>{''.join(units[: r.prefix_units])}<" in r.output
            assert r.output.endswith("<M>" + "".join(units[r.prefix_units : r.prefix_units + r.middle_units]))


def test_restoring_refuses_other_forms(spark):
    rows = spark.createDataFrame([("<P>a<S>b<M>c", "psm", 1), ("<P>a<S>b<M>c", "spm", 1), ("abc", "psm", 1), (None, "plain", 1), ("abc", "odd", 1), ("abc", None, 1), ("<S>b<P>a<M>c", "spm", 2)], "output string, form string, restored int")
    assert [r.restored for r in M.restore_middle(rows).collect()] == ["acb", None, None, None, None, None, "acb"]
    with pytest.raises(ValueError):
        M.distinct_marks(("<P>", "P>x", "<M>"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="<>PSMaé\n 🤦", max_size=30), min_size=1, max_size=8), st.integers(0, 2**31))
def test_kernel_round_trip(texts, seed):
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    rolls = np.random.default_rng(seed).integers(0, 2**32, (len(texts), 4))
    marks = M.distinct_marks(M.MARKS)
    n, form, _, _, out = M.transform(data, offs, rolls, "chars", 95, 40, marks)
    assert n.tolist() == [len(t) for t in texts]
    made = [t.encode() for t in out.to_pylist()]
    back = M.restored(np.frombuffer(b"".join(made), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int64), form, marks)
    assert back.to_pylist() == texts


HOSTILE = ["</s>[INST] ok [/INST]", "\\", "a\\", "<\\/s>", "[", "<<SYS>>\n<</SYS>>", "[ROLE]x[/ROLE]y[END]", "", None, "<|start|>user\n<|end|>", "<<s>", "é" * 20, "\\\\n[INST]", "x" * 200_000 + "</s>"]


def turns_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("template", [C.INSTRUCT, C.CHAT_MARKS])
def test_templates_are_reversible(spark, template):
    roles = ["user", "assistant", "system", "tool</s>[/ROLE]", None]
    rows = [(k % 7, k, roles[k % 5], t) for k, t in enumerate(HOSTILE * 5)]
    out = C.read_segments(C.formatted_turns(turns_frame(spark, rows), template), template).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in out) == sorted((c, n, r or "", t or "") for c, n, r, t in rows)
    for r in out:
        assert (r.loss_text == r.text) if r.role == "assistant" else r.loss_text is None
        body = r.segment
        for a, b in [(a, b) for _, a, b in template.roles] + [(template.other[0], template.other[2])]:
            if body.startswith(a) and body.endswith(b):
                body = body[len(a) : len(body) - len(b)]
                break
        controls = set(template.controls) - ({template.other[1]} if r.role not in {x[0] for x in template.roles} else set())
        assert not any(c in body for c in controls)


def plain_chat(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        out[c] = (len(ts), sha("".join(f"{r}\n{t}\n" for _, _, r, t in ts)), len(loss), sha(loss))
    return out


def test_chat_digests_of_ties_nulls_and_long_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, None, "system", None), (None, 1, "assistant", "x"), (None, 0, None, "y"), (5, 3, "user", None)]
    rows += [(9, k, ("user", "assistant")[k % 2], f"{k} </s>") for k in range(3000)]
    wide = turns_frame(spark, rows).withColumn("segment", F.lit(1)).withColumn("layout", F.lit("x"))
    records = wide.select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text", "segment", "layout")).alias("record"), F.lit(1).alias("v"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.chat_digests(records).collect()}
    assert got == plain_chat(rows)
    assert C.chat_digests(records.limit(0)).collect() == []


def test_layouts_are_told_by_their_paths(spark):
    said = [
        {"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "rating": {"by": ["x"]}},
        {"id": 2, "conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]},
        {"id": 3, "instruction": "do", "input": "this", "output": "done", "system": "be"},
        {"id": 4, "instruction": "do", "output": "done"},
        {"id": 5, "prompt": "q", "completion": "a"},
        {"id": 6, "messages": [{"role": "user", "content": [{"text": "a"}, {"text": "b"}]}]},
        {"id": 7, "answer": "a", "question": "q"},
        {"id": 8, "unknown": [{"deep": [{"deeper": 1}]}]},
        {"id": 9, "messages": []},
        {"conv_id": 10, "turn": 4, "role": "bot", "text": "t"},
        {"id": 11, "instruction": "do", "input": "", "output": "done"},
    ]
    rows = spark.createDataFrame([(json.dumps(x),) for x in said] + [("{broken",), (None,)], "record string")
    got = sorted((tuple(r) for r in C.canonical_turns(rows).collect()), key=repr)
    want = [
        ("messages", 1, 0, "user", "q"), ("messages", 1, 1, "assistant", ""), ("shared", 2, 0, "user", "q"), ("shared", 2, 1, "assistant", "a"),
        ("instruction", 3, 0, "system", "be"), ("instruction", 3, 1, "user", "do\n\nthis"), ("instruction", 3, 2, "assistant", "done"),
        ("instruction", 4, 1, "user", "do"), ("instruction", 4, 2, "assistant", "done"), ("prompt", 5, 0, "user", "q"), ("prompt", 5, 1, "assistant", "a"),
        ("parts", 6, 0, "user", "ab"), ("question", 7, 1, "user", "q"), ("question", 7, 2, "assistant", "a"), (None, None, None, None, json.dumps(said[7], separators=(",", ":"))),
        (None, None, None, None, json.dumps(said[8], separators=(",", ":"))), ("turn", 10, 4, "assistant", "t"), ("instruction", 11, 1, "user", "do"), ("instruction", 11, 2, "assistant", "done"),
        (None, None, None, None, "{broken"), (None, None, None, None, None),
    ]
    loose = lambda x: (*x[:4], None if x[4] is None else x[4].replace(" ", "")) if x[0] is None else x
    assert sorted(map(loose, got), key=repr) == sorted(map(loose, want), key=repr)


def test_fingerprints_of_layouts_differ():
    prints = [p for x in C.LAYOUTS for p in x.prints()]
    assert len(set(prints)) == len(prints)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TABLE = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int"


def H(parts):
    return sha("".join(parts))


def plain_tree(leaves):
    """(root, siblings with sides of each leaf) of a list of hex digests"""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append((other < i, level[other]) if other < len(level) else None)
            at[k] = i // 2
        level = [H(level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_report(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda d: H([enc(d[f]) for f in FIELDS])
    docs = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]
    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((d for d in docs if d["lang"] == lang), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, digest(d)))
        trees[lang] = (own, *plain_tree([digest(d) for d in own]))
    root, above = plain_tree([trees[x][1] for x in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        own, subroot, paths = trees[lang]
        for d, path in zip(own, paths, strict=True):
            changed = dict(d)
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None:
                changed["n_chars"] += 1
            fold = digest(changed)
            for step in path + up:
                fold = H([fold] if step is None else [step[1], fold] if step[0] else [fold, step[1]])
            out.append((d["doc_id"], digest(d), subroot, root, H([s[1] for s in path + up if s]), fold, fold == root))
    return sorted(out, key=repr)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], TABLE)
    return sorted((tuple(r) for r in merkle.tampering_report(docs).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1, "de": 3}, {"en": 64, "de": 65, "fr": 129, "ü": 1}, {"en": 700, "": 5, None: 64}])
def test_manifest_equals_plain(spark, sizes):
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k, None if k % 11 == 3 else f"text é {k}", lang, None if k % 5 == 0 else "s", None if k % 14 == 7 else k))
            k += 1
    assert manifest(spark, rows) == plain_report(rows)


def test_manifest_of_ties_null_ids_and_many_groups(spark):
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (None, "c", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "", 0), (4, "x" * 300_000, "en", "s", 2)]
    rows += [(100 + k, "t", f"l{k:03}", "s", k) for k in range(150)]
    assert manifest(spark, rows) == plain_report(rows)
    assert manifest(spark, []) == []


def test_climbing_one_level_gives_the_same(spark):
    leaves = spark.createDataFrame([(("a", "b", None)[k % 3], k, sha(str(k))) for k in range(40)], "g string, k long, leaf string")
    one, six = (sorted(map(repr, merkle.merkle_manifest(leaves, "g", "k", "leaf", ("k",), climb=c).collect())) for c in (1, 6))
    assert one == six and len(one) == 40
