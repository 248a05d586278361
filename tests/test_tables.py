import random

import pytest

from quillspark.tables.store import ConstraintError, Rules, Store, last_writer_wins


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_upserts_and_generated_columns(spark, store):
    store.create("counters", "id long, tally long, label string, twice long", Rules(["id"], defaults={"label": "'x'"}, generated={"twice": "tally * 2"}))
    new = spark.createDataFrame([(1, 5), (2, 7)], "id long, tally long")
    assert rows(store.insert("counters", new), "id") == [(1, 5, "x", 10), (2, 7, "x", 14)]
    with pytest.raises(ConstraintError):
        store.insert("counters", new)
    store.insert("counters", spark.createDataFrame([(2, 1), (3, 1)], "id long, tally long"), "update", {"tally": "old.tally + excluded.tally"})
    assert rows(store.table("counters"), "id") == [(1, 5, "x", 10), (2, 8, "x", 16), (3, 1, "x", 2)]
    store.insert("counters", spark.createDataFrame([(3, 9), (4, 4)], "id long, tally long"), "ignore")
    store.insert("counters", spark.createDataFrame([(1, 0)], "id long, tally long"), "replace")
    store.insert("counters", spark.createDataFrame([(None, 6)], "id long, tally long"))
    assert rows(store.table("counters").select("id", "tally"), "id") == [(1, 0), (2, 8), (3, 1), (4, 4), (5, 6)]
    ops = {tuple(r) for r in store.changes("counters").select("op", "id").collect()}
    assert {("update", 2), ("insert", 4), ("update", 1)} <= ops


def test_constraints_and_cascades(spark, store):
    store.create("p", "id long, v long", Rules(["id"], ["v"], [["v"]], ["v > 0"]))
    store.create("c", "id long, p long", Rules(["id"], foreign_keys=[{"columns": ["p"], "table": "p", "references": ["id"], "on_delete": "cascade"}]))
    store.insert("p", spark.createDataFrame([(1, 1), (2, 2)], "id long, v long"))
    for bad in ([(3, None)], [(3, 0)], [(3, 2)]):
        with pytest.raises(ConstraintError):
            store.insert("p", spark.createDataFrame(bad, "id long, v long"))
    with pytest.raises(ConstraintError):
        store.insert("c", spark.createDataFrame([(1, 9)], "id long, p long"))
    store.insert("c", spark.createDataFrame([(1, 1), (2, None), (3, 2)], "id long, p long"))
    assert rows(store.delete("p", "id = 1"), "id") == [(1, 1)]
    assert rows(store.table("c"), "id") == [(2, None), (3, 2)]


def test_time_travel_and_rollback(spark, store):
    store.create("a", "id long, b long", Rules(["id"], versioned=True))
    store.insert("a", spark.createDataFrame([(1, 10), (2, 20)], "id long, b long"), now=100)
    store.update("a", {"b": "b + 1"}, "id = 1", now=200)
    store.delete("a", "id = 2", now=300)
    assert rows(store.as_of("a", 150), "id") == [(1, 10), (2, 20)]
    assert rows(store.as_of("a", 250), "id") == [(1, 11), (2, 20)]
    assert rows(store.as_of("a", 350), "id") == [(1, 11)] and rows(store.as_of("a", 50), "id") == []
    store.begin()
    store.update("a", {"b": "0"})
    store.rollback()
    assert rows(store.table("a"), "id") == [(1, 11)]
    assert rows(store.as_of("a", 10**12), "id") == [(1, 11)] and store.changes("a").where("b = 0").count() == 0
    assert rows(store.history("a"), "id", "_valid_from") == [(1, 10, 100, 200), (1, 11, 200, 2**63 - 1), (2, 20, 100, 300)]
    store.begin()
    store.insert("a", spark.createDataFrame([(5, 5)], "id long, b long"))
    store.savepoint("s")
    store.insert("a", spark.createDataFrame([(6, 6)], "id long, b long"))
    store.rollback("s")
    store.commit()
    assert rows(store.table("a"), "id") == [(1, 11), (5, 5)]
    with pytest.raises(ValueError):
        store.rollback()


def test_statements_write_only_the_buckets_they_touch(spark, store):
    store.create("t", "id long, v long", Rules(["id"]))
    store.insert("t", spark.range(100).selectExpr("id", "id as v"))
    before = store._state("t")["files"]
    store.update("t", {"v": "0"}, "id = 3")
    after = store._state("t")["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and rows(store.table("t").selectExpr("sum(v) AS v"), "v") == [(4950 - 3,)]
    store.vacuum("t")
    assert store.table("t").count() == 100 and len(store.fs.names(f"{store.root}/t/data")) == 1
    assert {r.column: (r.rows, r.nulls, r.greatest) for r in store.analyze("t").collect()} == {"id": (100, 0, "99"), "v": (100, 0, "99")}


def test_partial_unique_and_update_actions(spark, store):
    store.create("p", "id long, code string, live boolean", Rules(["id"], unique=[{"columns": ["code"], "where": "live"}]))
    store.create("c", "id long, p long", Rules(["id"], foreign_keys=[{"columns": ["p"], "table": "p", "references": ["id"], "on_update": "cascade", "on_delete": "set null"}]))
    store.insert("p", spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", False)], "id long, code string, live boolean"))
    with pytest.raises(ConstraintError):
        store.update("p", {"live": "true"}, "id = 2")
    store.insert("c", spark.createDataFrame([(1, 1), (2, 2)], "id long, p long"))
    store.update("p", {"id": "id + 10"}, "id = 1")
    assert rows(store.table("c"), "id") == [(1, 11), (2, 2)]
    store.delete("p", "id = 2")
    assert rows(store.table("c"), "id") == [(1, 11), (2, None)]
    store.alter("p", rename=("live", "active"))
    with pytest.raises(ConstraintError):
        store.insert("p", spark.createDataFrame([(9, "a", True)], "id long, code string, active boolean"))
    assert rows(store.table_info("p").select("name", "pk"), "name") == [("active", 0), ("code", 0), ("id", 1)]


def test_alter(spark, store):
    store.create("t", "id long", Rules(["id"]))
    store.insert("t", spark.createDataFrame([(1,)], "id long"))
    store.alter("t", add=("n", "long", "7"))
    store.alter("t", rename=("n", "m"))
    assert rows(store.table("t"), "id") == [(1, 7)] and store.columns("t")[1] == ("m", "bigint")
    with pytest.raises(ConstraintError):
        store.alter("t", drop="id")


def test_random_changes_match_a_dict(spark, store):
    rng, shadow = random.Random(7), {}
    store.create("r", "id long, v long", Rules(["id"]))
    for _ in range(8):
        k, v = rng.randrange(5), rng.randrange(100)
        if rng.random() < 0.6:
            store.insert("r", spark.createDataFrame([(k, v)], "id long, v long"), "replace")
            shadow[k] = v
        else:
            store.delete("r", f"id = {k}")
            shadow.pop(k, None)
    assert dict(rows(store.table("r"), "id")) == shadow


def test_last_writer_wins(spark):
    schema = "id long, v string, wall long, counter long, node string"
    a = spark.createDataFrame([(1, "old", 5, 0, "a"), (2, "old", 9, 0, "a"), (3, "old", 5, 1, "b")], schema)
    b = spark.createDataFrame([(1, "new", 6, 0, "a"), (2, "new", 8, 9, "z"), (3, "tie", 5, 1, "b"), (4, "new", 1, 0, "a")], schema)
    assert rows(last_writer_wins(a, b, ["id"]).select("id", "v"), "id") == [(1, "new"), (2, "old"), (3, "tie"), (4, "new")]
