"""Cache or extract, repeated uploads, and categories in the order of an alphabet."""

import datetime as dt

from pyspark.sql import functions as F

from lectern.plans import extraction as E
from lectern.plans import jobs as J
from lectern.streaming import load
from lectern.streaming.jobs import run_to_end


def test_a_ledger_extracts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def extract(rows):
        def run(batches):
            for b in batches:
                for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    seen.add(1)
                    yield k, len(c)

        import pyarrow as pa

        def arrow(batches):
            out = list(run(batches))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["key", "size"])

        return rows.mapInArrow(arrow, "key string, size long")

    files = spark.createDataFrame([(1, "abc", 9), (2, "abc", 9), (3, "", 9), (4, None, 9), (4, "x", 9)], "id long, content string, size long")
    at = str(tmp_path / "ledger")
    rows, n = E.extracted(files.filter("id < 3"), at, "v1", extract)
    assert n == 1 and sorted((r.id, r.size) for r in rows.collect()) == [(1, 3), (2, 3)]
    rows, n = E.extracted(files, at, "v1", extract)
    assert n == 2 and sorted(((r.id, r.size) for r in rows.collect()), key=repr) == [(1, 3), (2, 3), (3, 0), (4, 1), (4, None)]
    assert seen.value == 3
    assert E.extracted(files, at, "v1", extract)[1] == 0 and seen.value == 3
    assert E.extracted(files, at, "v2", extract)[1] == 3 and seen.value == 6
    assert E.extracted(files.limit(0), at, "v3", extract)[0].collect() == []


def test_two_writers_of_one_content_count_once(spark, tmp_path):
    at = str(tmp_path / "ledger")
    extract = lambda rows: rows.select("key", F.length("content").cast("long").alias("size"))
    files = spark.createDataFrame([(1, "abc")], "id long, content string")
    E.extracted(files, at, "v1", extract)
    spark.read.parquet(f"{at}/*").write.parquet(f"{at}/v1-other")
    assert E.extracted(files, at, "v1", extract)[0].count() == 1


def test_uploads_that_repeat_in_any_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", 1, at(0)), ("a", 1, at(3)), ("b", 1, at(5)), ("a", 2, at(6)), ("a", 1, at(2)), ("b", 1, at(9)), (None, None, at(10)), (None, None, at(11))]
    for sizes in ([8], [1] * 8, [3, 5]):
        folder, k = tmp_path / f"{len(sizes)}", 0
        for n in sizes:
            spark.createDataFrame(rows[k : k + n], "name string, size long, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
            k += n
        stream = spark.readStream.schema("name string, size long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        run_to_end(spark, load.fresh_uploads(stream), f"{folder}/out", f"{folder}/check")
        got = [(r.name, r.size) for r in spark.read.parquet(f"{folder}/out").collect()]
        assert sorted(got, key=repr) == sorted({r[:2] for r in rows}, key=repr)


def test_categories_in_the_order_of_the_alphabet(spark):
    words = ["ёлка", "Ель", "ель", "жук", "еда", "Ёж", "из-за", "изба", "абзац", "Абзац"]
    rows = spark.createDataFrame([(w,) for w in words * 2], "c string")
    got = [r.c for r in J.ordered_facet(rows, "c").orderBy("place").collect()]
    assert [w.lower() for w in got] == ["абзац", "абзац", "еда", "ёж", "ёлка", "ель", "ель", "жук", "из-за", "изба"]
    assert {r.n for r in J.ordered_facet(rows, "c").collect()} == {2}
    assert sorted({r.c for r in J.search_words(rows, ("c",), "ЕЛЬ").collect()}) == ["Ель", "ель"]
