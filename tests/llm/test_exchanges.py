"""What rounds exchange on the way to near duplicates is deleted with each of them."""

from lectern.llm.session import CLEANUP
from lectern.llm.shingle_join import shingle_components


def test_no_exchange_stays_behind_the_rounds(spark):
    text = [f"word{k} of some{k % 5} text{k % 3}" for k in range(40)]
    rows = [(d, " ".join(text[: 30 + d % 7])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get(CLEANUP)
    known = set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(" ").split())
    found = shingle_components(docs, words=3, num=9, den=10)
    left = set(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(" ").split()) - known
    assert not left and spark.conf.get(CLEANUP) == before
    assert len({r.component_id for r in found.collect()}) < 60
