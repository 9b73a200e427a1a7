"""Packets of hot groups, canonical composition, and jobs that don't parse."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import nfc
from lectern.plans import routing as P
from lectern.sources import files


@pytest.mark.parametrize("stretch", [1, 7, 4096, None])
def test_packets_of_hot_and_null_groups(spark, stretch):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "b", None]), k, "x") for k in rng.sample(range(-50, 2000), 300)]
    df = spark.createDataFrame(rows, "source string, doc_id long, packets string")
    got = sorted(map(tuple, P.packets(df, 12, ("source",), "doc_id", stretch).collect()), key=repr)
    want = []
    for s in {r[0] for r in rows}:
        want += [(s, d, "x", k // 12) for k, d in enumerate(sorted(r[1] for r in rows if r[0] == s))]
    assert got == sorted(want, key=repr)
    assert P.packets(df.limit(0), 12, ("source",), "doc_id", stretch).collect() == []


def test_composition(spark):
    texts = ["е́", "plain", "й", "Å", "Ω", "한", None, "", "ё — «x» № …", "ệ", "豈", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in rows.select(nfc(F.col("t")).alias("n")).collect()] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_malformed_jobs_stay(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"job_id": 1, "status": "queued"}]')
    (tmp_path / "b.json").write_text("{broken")
    rows = sorted(((r.job_id, r.status, r.malformed) for r in files.read_jobs(spark, str(tmp_path), "job_id long, status string").collect()), key=repr)
    assert rows == [(1, "queued", None), (None, None, "{broken")]
