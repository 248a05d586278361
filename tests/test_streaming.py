from datetime import datetime

from pyspark.sql import functions as F

from quillspark.streaming import windows
from quillspark.tables.store import Rules, Store


def test_windows_and_sessions(spark):
    rows = [(datetime(2026, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 40, 41)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    w = windows.tumbling(df, "ts", "30 minutes", ["kind"], [F.count(F.lit(1)).alias("n")])
    assert sorted(r.n for r in w.collect()) == [2, 2]
    assert windows.sessions(df, "ts", "10 minutes", ["kind"], [F.sum("value").alias("s")]).count() == 2


def test_changes_stream_into_a_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for t in ("a", "b"):
        store.create(t, "id long, v long", Rules(["id"]))
    store.insert("a", spark.createDataFrame([(1, 10), (2, 20)], "id long, v long"))
    store.update("a", {"v": "v + 1"}, "id = 2")
    stream = store.change_stream("a").where("op = 'insert'").select("id", "v")
    q = windows.upsert_stream(stream, store, "b", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in store.table("b").collect()) == [(1, 10), (2, 20)]
