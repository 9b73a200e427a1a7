"""The pipeline's stages, one after the other, against plain versions of their decisions."""

import re

import numpy as np

import corpus_pipeline
from lectern.llm import queries, stages
from lectern.llm.quality import quality_verdicts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = np.random.default_rng(8)
    common = "the of and to in a is that for it was with".split()
    words = common * 6 + ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9))) for _ in range(120)]
    texts = []
    for i in range(60):
        w = rng.choice(words, rng.integers(60, 140)).tolist()
        if i % 10 == 3:
            w = texts[-1].split()
            w[5] = "edited"
        texts.append(" ".join(w) + ".")
    texts += ["short text", None, "$$$ ### " * 50, texts[0]]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), COLUMNS)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "shingle_join", "suffix_dedup", "best_fit_packing"]
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stages.written(stage(spark, at, str(tmp_path)))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        kept.append((name, out))
        at = out
    got = dict(kept)
    good = {r.doc_id for r in quality_verdicts(docs).filter("kept").collect()}
    assert {r.doc_id for r in got["quality_rules"].collect()} == good and not good & {60, 61, 62}
    assert {r.doc_id for r in got["language_id"].collect()} == good

    def five(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    heads = {r.doc_id: five(r.text) for r in got["shingle_join"].collect()}
    everything = {r.doc_id: five(r.text) for r in got["language_id"].collect()}
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert all(not near(heads[a], heads[b]) for a in heads for b in heads if a < b)
    assert all(any(near(s, heads[h]) for h in heads) for s in everything.values()) and len(heads) < len(everything)
    cut = {r.doc_id: r for r in got["suffix_dedup"].collect()}
    assert set(cut) == set(heads) and all(r.n_chars == len(r.text) for r in cut.values())
    assert {r.doc_id for r in got["best_fit_packing"].collect()} == set(heads)


def test_run_and_registry(spark, tmp_path):
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) if n.startswith("op")] and len(queries.QUERIES) == 13


def test_stages_of_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert stages.keep_quality(none).count() == 0 and stages.keep_languages(none).count() == 0
    assert stages.keep_one_of_near(none, 5, 4, 5).count() == 0 and stages.drop_repeats(none, 100).count() == 0
    odd = spark.createDataFrame([(None, "un deux trois quatre cinq six", None, None, None), (1, None, None, None, None), (2, "", "fr", "s", 0)], COLUMNS)
    assert stages.keep_languages(odd).count() == 1
    assert stages.keep_one_of_near(odd, 5, 4, 5).count() == 3 and stages.drop_repeats(odd, 100).count() == 3
