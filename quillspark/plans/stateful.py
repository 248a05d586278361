"""Tables with changes, memory recall, chunks and event-time windows over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.memory import recall as memory
from quillspark.plans.registry import Registry, read
from quillspark.session import shared_folder
from quillspark.sources import texts
from quillspark.streaming import windows
from quillspark.tables.store import Rules, Store, last_writer_wins

add = Registry()
QUERIES, SQL = add.queries, add.sql


def new_store(spark) -> Store:
    """An empty store in the shared folder."""
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


@add("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS balance FROM customer
    UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier""")
def upsert_merge(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    store = new_store(spark)
    store.create("account", "c_custkey long, balance double", Rules(["c_custkey"]))
    store.insert("account", c.select("c_custkey", F.col("c_acctbal").alias("balance")))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(100.0).alias("balance"))
    new = new.unionByName(s.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("balance")))  # no customer has a key below 0
    store.insert("account", new, "update", {"balance": "old.balance + excluded.balance"})
    return store.table("account")


@add("SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_acctbal < 0")
def delete_returning(spark, sf_dir):
    store = new_store(spark)
    store.create("account", "c_custkey long, balance double", Rules(["c_custkey"]))
    store.insert("account", read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")))
    return store.delete("account", "balance < 0")


@add("SELECT c_custkey, c_acctbal AS balance FROM customer")
def time_travel(spark, sf_dir):
    store = new_store(spark)
    store.create("account", "c_custkey long, balance double", Rules(["c_custkey"], versioned=True))
    store.insert("account", read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")), now=1000)
    store.update("account", {"balance": "0"}, "c_custkey % 2 = 0", now=2000)
    return store.as_of("account", 1500)


@add("SELECT 'update' AS op, s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'insert', s_suppkey, s_acctbal FROM supplier")
def change_feed(spark, sf_dir):
    store = new_store(spark)
    store.create("s", "s_suppkey long, s_nationkey int, s_acctbal double", Rules(["s_suppkey"]))
    store.insert("s", read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    store.update("s", {"s_acctbal": "s_acctbal * 2"}, "s_nationkey = 3")
    return store.changes("s").select("op", "s_suppkey", "s_acctbal")


@add("""
    SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY user_id""")
def lww_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("wall"), F.col("event_id").alias("counter"), F.lit("n").alias("node"))
    return last_writer_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"]).select("user_id", "event_id")


@add()
def text_chunks(spark, sf_dir):
    return texts.chunk_column(read(spark, sf_dir, "documents"), "doc_id", "text")


@add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    w = windows.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return w.select("window_start", "event_type", "n", "total")


def _entries(spark, sf_dir):
    m = read(spark, sf_dir, "device_memory").dropDuplicates(["mem_id"])
    epoch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    return m.select(
        F.col("mem_id").alias("id"), "content", F.lit(None).cast("array<float>").alias("vector"), epoch("created_at").alias("timestamp"), F.coalesce("importance", F.lit(0.5)).alias("importance"),
        F.array().cast("array<string>").alias("tags"), F.array((F.col("mem_id") + 1)).alias("associations"), "namespace", F.lit(None).cast("string").alias("session"), "external_id", F.lit(None).cast("string").alias("model"),
        epoch("expires_at").alias("expires_at"), F.lit(1).cast("long").alias("revision"), F.sha2("content", 256).alias("sha256"),
    )


NOW = 1_790_000_000


@add()
def memory_recall(spark, sf_dir):
    found = memory.recall(_entries(spark, sf_dir), "vector index recovery log", now=NOW, half_life=30 * 86400.0, hops=1)
    return found.select("id", F.round("score", 4).alias("score"))


@add(f"""
    SELECT mem_id AS id FROM (SELECT DISTINCT ON (mem_id) * FROM device_memory)
    WHERE (expires_at IS NULL OR floor(epoch_us(expires_at) / 1000000) > {NOW}) AND 0.6 * coalesce(importance, 0.5) + 0.4 * exp(-ln(2) * greatest(0, {NOW} - floor(epoch_us(created_at) / 1000000)) / 2592000) >= 0.3""")
def memory_prune(spark, sf_dir):
    return memory.prune(_entries(spark, sf_dir), NOW, 0.3, 30 * 86400.0).select("id")


@add("""
    WITH m AS (SELECT DISTINCT ON (mem_id) * FROM device_memory)
    SELECT mem_id AS id, CASE WHEN mem_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS revision, CASE WHEN mem_id % 10 = 0 THEN sha256(content || '!') ELSE sha256(content) END AS sha256 FROM m""")
def memory_upsert(spark, sf_dir):
    old = _entries(spark, sf_dir)
    new = old.where("id % 10 = 0").withColumn("content", F.concat("content", F.lit("!"))).withColumn("namespace", F.upper("namespace"))
    return memory.upsert(old, new, NOW).select("id", "revision", "sha256")


def _bm25_sql(terms: list[str]) -> str:
    """CTEs over device_memory: m (a row a record), s (id, norm): the normalised BM25 scores of a query's terms."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
    m AS (SELECT DISTINCT ON (mem_id) mem_id AS id, content, coalesce(importance, 0.5) AS importance, namespace, exp(-ln(2) * greatest(0, {NOW} - floor(epoch_us(created_at) / 1000000)) / 2592000) AS r,
        expires_at IS NULL OR floor(epoch_us(expires_at) / 1000000) > {NOW} AS alive FROM device_memory),
    d AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_-]+'), lambda t: strlen(t) > 1) AS t FROM m WHERE alive),
    n AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM d), q AS (SELECT unnest([{listed}]) AS term),
    tf AS (SELECT id, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM d, q), f AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
    w AS (SELECT id, sum(greatest(0.1, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN f USING (term), n WHERE tf > 0 GROUP BY id),
    s AS (SELECT id, score, score / (SELECT max(score) FROM w) AS norm FROM w)"""


_TERMS = ["vector", "index", "recovery", "log"]


@add(f"WITH {_bm25_sql(_TERMS)} SELECT id, round(0.35 * norm + 0.1 * r + 0.1 * importance, 6) AS score FROM s JOIN m USING (id)".replace("\\\\", "\\"))
def memory_recall_words(spark, sf_dir):
    return memory.recall(_entries(spark, sf_dir), "vector index recovery log", now=NOW, k=1 << 30).select("id", F.round("score", 6).alias("score"))


@add(f"WITH {_bm25_sql(_TERMS)} SELECT id, round(0.35 * norm + 0.1 * r + 0.1 * importance, 6) AS score FROM s JOIN m USING (id) WHERE 0.35 * norm + 0.1 * r + 0.1 * importance >= 0.25".replace("\\\\", "\\"))
def memory_recall_min_score(spark, sf_dir):
    return memory.recall(_entries(spark, sf_dir), "vector index recovery log", now=NOW, k=1 << 30, min_score=0.25).select("id", F.round("score", 6).alias("score"))


@add(f"""
    WITH {_bm25_sql(_TERMS)}, x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS k FROM s ORDER BY score DESC, id LIMIT 128)
    SELECT id, round(0.8 * 21.0 / (20 + k) + 0.1 * r + 0.1 * importance, 6) AS score FROM x JOIN m USING (id)""".replace("\\\\", "\\"))
def memory_search_indexed(spark, sf_dir):
    return memory.search_indexed(_entries(spark, sf_dir), "vector index recovery log", now=NOW, k=1000).select("id", F.round("score", 6).alias("score"))


@add(f"""
    WITH m AS (SELECT DISTINCT ON (mem_id) * FROM device_memory), x AS (SELECT mem_id FROM m WHERE floor(epoch_us(expires_at) / 1000000) <= {NOW})
    SELECT mem_id AS id, CASE WHEN mem_id + 1 IN (SELECT mem_id FROM x) THEN 0 ELSE 1 END AS n FROM m WHERE mem_id NOT IN (SELECT mem_id FROM x)""")
def memory_purge(spark, sf_dir):
    return memory.purge(_entries(spark, sf_dir), NOW).select("id", F.size("associations").alias("n"))


@add("SELECT DISTINCT mem_id AS id FROM device_memory WHERE namespace IS NULL OR lower(namespace) <> (SELECT min(lower(namespace)) FROM device_memory)")
def memory_delete_scoped(spark, sf_dir):
    e = _entries(spark, sf_dir)
    first = e.agg(F.min(F.lower("namespace"))).first()[0]
    return memory.delete_scoped(e, memory.Scope(namespace=first.upper())).select("id")


@add("SELECT 1 AS stale, count(DISTINCT mem_id) AS n FROM device_memory")
def memory_compare_and_set(spark, sf_dir):
    old = _entries(spark, sf_dir)
    stale = 0
    try:
        memory.compare_and_set(old, old.withColumn("expected_revision", F.lit(7)), NOW)
    except memory.RevisionError:
        stale = 1
    new = memory.compare_and_set(old, old.withColumn("expected_revision", F.lit(1)), NOW)
    return new.agg(F.lit(stale).alias("stale"), F.count_if(F.expr("revision = 2 or external_id is null")).alias("n"))
