"""Tables that are written on the way of the catalogue."""

from lectern.plans import theses


def test_nothing_is_broadcast_by_its_size_into_a_kept_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(theses, "shared_folder", lambda *_: str(tmp_path))
    keys = theses._BROADCASTS
    before = {k: spark.conf.get(k, None) for k in keys}
    seen = {}

    class Rows:
        sparkSession = spark
        schema = spark.range(3).schema
        write = property(lambda self: self)

        def parquet(self, path):
            seen.update({k: spark.conf.get(k, None) for k in keys})
            spark.range(3).write.parquet(path)

    assert theses.kept(Rows()).count() == 3
    assert set(seen.values()) == {"-1"} and before == {k: spark.conf.get(k, None) for k in keys}
