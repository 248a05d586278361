"""Statements of the SQL dialect over tables of a store filled from the test tables, and its scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.dialect import Session
from quillspark.plans.registry import Registry, read
from quillspark.plans.stateful import new_store
from quillspark.tables.collections import Collection
from quillspark.tables.store import ConstraintError

add = Registry()
QUERIES, SQL = add.queries, add.sql


def _session(spark, sf_dir, *tables) -> Session:
    """A session over an empty store; the test tables are views."""
    for t in tables:
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    return Session(spark, new_store(spark))


def _accounts(spark, sf_dir, more: str = "") -> Session:
    s = _session(spark, sf_dir, "customer", "supplier")
    s.sql(f"CREATE TABLE acc (id INTEGER PRIMARY KEY, balance REAL NOT NULL, seg TEXT DEFAULT 'none'){more}")
    s.sql("INSERT INTO acc SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
    return s


def _run(*statements: str, more: str = ""):
    """The last statement's result after the others, over customers' accounts."""

    def query(spark, sf_dir):
        s = _accounts(spark, sf_dir, more)
        for x in statements[:-1]:
            s.sql(x)
        return s.sql(statements[-1])

    return query


def _add(name: str, oracle: str, *statements: str, more: str = "") -> None:
    QUERIES[name] = _run(*statements, more=more)
    SQL[name] = oracle


_ACC = "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS seg FROM customer"
_add("insert_returning", "SELECT s_suppkey + 1000000000 AS id, 'none' AS seg, s_acctbal * 2 AS twice FROM supplier", "INSERT INTO acc (id, balance) SELECT s_suppkey + 1000000000, s_acctbal FROM supplier RETURNING id, seg, balance * 2 AS twice")
_add("insert_ignore", f"{_ACC} UNION ALL SELECT s_suppkey + 100, s_acctbal, 'new' FROM supplier WHERE s_suppkey + 100 NOT IN (SELECT c_custkey FROM customer)", "INSERT OR IGNORE INTO acc SELECT s_suppkey + 100, s_acctbal, 'new' FROM supplier", "SELECT id, balance, seg FROM acc")
_add("insert_replace", f"SELECT s_suppkey + 5 AS id, s_acctbal AS balance, 'new' AS seg FROM supplier UNION ALL SELECT * FROM ({_ACC}) WHERE id NOT IN (SELECT s_suppkey + 5 FROM supplier)", "REPLACE INTO acc SELECT s_suppkey + 5, s_acctbal, 'new' FROM supplier", "SELECT id, balance, seg FROM acc")
_add("insert_upsert_where", "SELECT s_suppkey AS id, c_acctbal + s_acctbal AS balance FROM supplier JOIN customer ON c_custkey = s_suppkey WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
     "INSERT INTO acc SELECT s_suppkey, s_acctbal, 'x' FROM supplier ON CONFLICT (id) DO UPDATE SET balance = balance + excluded.balance WHERE excluded.balance > 0 RETURNING id, balance")
_add("insert_do_nothing", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer", "INSERT INTO acc SELECT c_custkey, 0, 'x' FROM customer ON CONFLICT DO NOTHING", "SELECT count(*) AS n, round(sum(balance), 2) AS total FROM acc")
_add("insert_auto_key", "SELECT max(c_custkey) + 3 AS top, count(*) + 3 AS n FROM customer", "INSERT INTO acc (balance) VALUES (1.5), (2), (-3e2)", "SELECT max(id) AS top, count(*) AS n FROM acc")
_add("update_returning", "SELECT c_custkey AS id, round(c_acctbal * 1.1, 2) AS balance FROM customer WHERE c_mktsegment ILIKE 'b%'", "UPDATE acc SET balance = balance * 1.1, seg = upper(seg) WHERE seg LIKE 'b%' RETURNING id, round(balance, 2) AS balance")
_add("delete_where", f"{_ACC} WHERE NOT c_acctbal < 0", "DELETE FROM acc WHERE balance < 0", "SELECT * FROM acc")
_add("rollback_savepoint", "SELECT c_custkey AS id, c_acctbal + 1 AS balance FROM customer", "BEGIN", "UPDATE acc SET balance = balance + 1", "SAVEPOINT one", "DELETE FROM acc WHERE id > 10", "ROLLBACK TO one", "COMMIT", "SELECT id, balance FROM acc")
_add("generated_column", "SELECT c_custkey AS id, c_acctbal * 3 AS triple FROM customer", "CREATE TABLE g (id INTEGER PRIMARY KEY, b REAL CHECK (b IS NOT NULL), triple REAL GENERATED ALWAYS AS (b * 3) STORED)", "INSERT INTO g (id, b) SELECT id, balance FROM acc", "SELECT id, triple FROM g")
_add("create_table_as", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1", "CREATE TABLE s AS SELECT seg, count(*) AS n FROM acc GROUP BY seg", "SELECT * FROM s")
_add("view_reference", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0", "CREATE VIEW rich AS SELECT * FROM acc WHERE balance > 0", "SELECT count(*) AS n FROM rich")
_add("alter_columns", "SELECT c_custkey AS id, c_acctbal AS amount, 7 AS extra FROM customer", "ALTER TABLE acc ADD COLUMN extra INTEGER DEFAULT 7", "ALTER TABLE acc RENAME COLUMN balance TO amount", "ALTER TABLE acc DROP COLUMN seg", "SELECT id, amount, extra FROM acc")
_add("pragma_table_info", "SELECT * FROM (VALUES (0, 'id', 'bigint', 1, NULL, 1), (1, 'balance', 'double', 1, NULL, 0), (2, 'seg', 'string', 0, '''none''', 0)) t(cid, name, type, \"notnull\", dflt_value, pk)", "PRAGMA table_info(acc)")
_add("analyze_table", "SELECT 'acc' AS \"table\", 'id' AS \"column\", count(*) AS rows, 0 AS nulls, min(c_custkey)::VARCHAR AS least, max(c_custkey)::VARCHAR AS greatest FROM customer", "ANALYZE acc", "SELECT 1")
QUERIES["analyze_table"] = lambda spark, sf_dir: _run("ANALYZE acc")(spark, sf_dir).where("column = 'id'").select("table", "column", "rows", "nulls", "least", "greatest")
_add("time_travel_sql", _ACC, "CREATE TABLE v (id INTEGER PRIMARY KEY, balance REAL, seg TEXT) WITH SYSTEM VERSIONING", "SELECT 1")


def _travel(spark, sf_dir):
    s = _accounts(spark, sf_dir)
    s.sql("CREATE TABLE v (id INTEGER PRIMARY KEY, balance REAL, seg TEXT) WITH SYSTEM VERSIONING")
    s.store.insert("v", s.table("acc"), now=1000)
    s.store.update("v", {"balance": "0"}, now=2000)
    return s.sql("SELECT id, balance, seg FROM v AS OF TIMESTAMP 1500")


QUERIES["time_travel_sql"] = _travel


@add("SELECT c_custkey AS id, c_acctbal AS balance, 1000 AS valid_from, CASE WHEN c_custkey % 2 = 0 THEN 2000 END AS valid_to FROM customer UNION ALL SELECT c_custkey, 0, 2000, NULL FROM customer WHERE c_custkey % 2 = 0")
def rollback_history(spark, sf_dir):
    s = _session(spark, sf_dir, "customer")
    s.sql("CREATE TABLE v (id INTEGER PRIMARY KEY, balance REAL) WITH SYSTEM VERSIONING")
    s.store.insert("v", s.sql("SELECT c_custkey AS id, c_acctbal AS balance FROM customer"), now=1000)
    s.store.update("v", {"balance": "0"}, "id % 2 = 0", now=2000)
    s.sql("BEGIN")
    s.sql("UPDATE v SET balance = 99")
    s.sql("ROLLBACK")
    h = s.store.history("v")
    return h.select("id", "balance", F.col("_valid_from").alias("valid_from"), F.when(F.col("_valid_to") < 10**12, F.col("_valid_to")).alias("valid_to"))


def _family(spark, sf_dir, actions: str) -> Session:
    s = _session(spark, sf_dir, "nation", "customer")
    s.sql("CREATE TABLE n (id INTEGER PRIMARY KEY, region INTEGER)")
    s.sql(f"CREATE TABLE c (id INTEGER PRIMARY KEY, nation INTEGER, FOREIGN KEY (nation) REFERENCES n (id) {actions})")
    s.sql("INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation")
    s.sql("INSERT INTO c SELECT c_custkey, c_nationkey FROM customer")
    return s


@add("SELECT c_custkey AS id, c_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def cascade_delete(spark, sf_dir):
    s = _family(spark, sf_dir, "ON DELETE CASCADE")
    s.sql("DELETE FROM n WHERE region = 2")
    return s.sql("SELECT id, nation FROM c")


@add("SELECT c_custkey AS id, CASE WHEN n_regionkey <> 2 THEN c_nationkey END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def delete_set_null(spark, sf_dir):
    s = _family(spark, sf_dir, "ON DELETE SET NULL")
    s.sql("DELETE FROM n WHERE region = 2")
    return s.sql("SELECT id, nation FROM c")


@add("SELECT c_custkey AS id, c_nationkey + CASE WHEN n_regionkey = 2 THEN 1000 ELSE 0 END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def update_cascade(spark, sf_dir):
    s = _family(spark, sf_dir, "ON UPDATE CASCADE")
    s.sql("UPDATE n SET id = id + 1000 WHERE region = 2")
    return s.sql("SELECT id, nation FROM c")


def _refused(s: Session, *statements: str):
    """rule, refused, and the rows that the table has after each statement."""
    out = []
    for x in statements:
        try:
            s.sql(x)
            out.append((x, False))
        except ConstraintError:
            out.append((x, True))
    return s.spark.createDataFrame([(i, r) for i, (_, r) in enumerate(out)], "step int, refused boolean")


@add("SELECT step, refused FROM (VALUES (0, true), (1, true), (2, true), (3, true), (4, false), (5, true), (6, false)) t(step, refused)")
def unique_violation(spark, sf_dir):
    s = _session(spark, sf_dir, "customer")
    s.sql("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT UNIQUE, n INTEGER NOT NULL CHECK (n >= 0), live BOOLEAN)")
    s.sql("CREATE UNIQUE INDEX one_live ON u (n) WHERE live")
    s.sql("INSERT INTO u SELECT c_custkey, c_name, 1, false FROM customer")
    return _refused(s, "INSERT INTO u SELECT min(c_custkey), 'x', 1, false FROM customer", "INSERT INTO u SELECT -1, min(c_name), 1, false FROM customer", "INSERT INTO u VALUES (-2, 'y', NULL, false)", "UPDATE u SET n = -1",
                    "INSERT INTO u VALUES (-3, 'z', 8, true)", "INSERT INTO u VALUES (-4, 'w', 8, true)", "INSERT INTO u VALUES (-5, 'v', 8, false)")


@add("SELECT refused FROM (VALUES (true), (true), (false)) t(refused)")
def foreign_key_restrict(spark, sf_dir):
    s = _family(spark, sf_dir, "")
    return _refused(s, "DELETE FROM n WHERE region = 2", "INSERT INTO c VALUES (-1, 77)", "INSERT INTO c VALUES (-1, NULL)").select("refused")


# Expressions.
def _expr(name: str, tables: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _session(spark, sf_dir, *tables.split()).sql(text)
    SQL[name] = oracle


_expr("sql_dates", "orders", """
    SELECT o_orderkey, DATE(CAST(o_orderdate AS TEXT), '+1 month') AS m, DATETIME(CAST(o_orderdate AS TEXT), 'start of year', '+36 hours') AS y, TIME('10:20') AS t, STRFTIME('%Y-%j %w', CAST(o_orderdate AS TEXT)) AS f, UNIXEPOCH(CAST(o_orderdate AS TEXT)) AS e,
    JULIANDAY(CAST(o_orderdate AS TEXT)) AS jd, DATE('nonsense') AS bad FROM orders""", """
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS y, '10:20:00' AS t, strftime(o_orderdate, '%Y-%j %w') AS f, epoch(o_orderdate)::BIGINT AS e,
    epoch_ms(o_orderdate) / 86400000.0 + 2440587.5 AS jd, NULL::VARCHAR AS bad FROM orders""")
_expr("sql_casts", "part", """
    SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_name AS INTEGER) AS junk, CAST(p_brand AS REAL) AS r, CAST(CAST(p_size AS REAL) AS TEXT) AS whole, CAST(0.00001 AS TEXT) AS small, CAST(1.5e20 AS TEXT) AS big, CAST('yes' AS BOOLEAN) AS b, HEX(CAST('aé' AS BLOB)) AS blob,
    TYPEOF(p_size) AS ti, TYPEOF(p_retailprice) AS tr, TYPEOF(p_name) AS tt, TYPEOF(NULL) AS tn FROM part""", """
    SELECT p_partkey, trunc(p_retailprice)::BIGINT AS i, 0 AS junk, 0.0::DOUBLE AS r, p_size::VARCHAR AS whole, '0.00001' AS small, '150000000000000000000' AS big, 1 AS b, '61C3A9' AS blob, 'integer' AS ti, 'real' AS tr, 'text' AS tt, 'null' AS tn FROM part""")
_expr("sql_json", "events", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS a, props ->> 'k' AS b, e.props.k AS c FROM events e WHERE e.props.k > 10", "SELECT event_id, json_extract_string(props, '$.k') AS a, props ->> 'k' AS b, props ->> 'k' AS c FROM events WHERE (props ->> 'k')::INT > 10")
_expr("sql_strings", "supplier", "SELECT s_suppkey, SUBSTR(s_name, -3, 4) AS a, TRIM('xx' || s_name || 'x', 'x') AS b, LTRIM('  q ') AS c, HEX(s_suppkey) AS d, CONCAT(s_name, NULL, s_suppkey) AS e, IIF(s_acctbal > 0, 'in', 'out') AS f, ROUND(s_acctbal, -2) AS g, SQRT(-1) AS h, MOD(s_suppkey, 0) AS i FROM supplier WHERE s_name LIKE 'SUPP%'",
      "SELECT s_suppkey, substr(s_name, 1, 4) AS a, s_name AS b, 'q ' AS c, hex(s_suppkey::VARCHAR) AS d, s_name || s_suppkey AS e, CASE WHEN s_acctbal > 0 THEN 'in' ELSE 'out' END AS f, round(s_acctbal) AS g, NULL::DOUBLE AS h, NULL::BIGINT AS i FROM supplier WHERE s_name ILIKE 'supp%'")
_expr("sql_vectors", "embeddings", "SELECT vec_id, round(VECTOR_COSINE(embedding, embedding), 6) AS same, VECTOR_L2(embedding, '[1, 2]') AS other FROM embeddings", "SELECT vec_id, 0.0::DOUBLE AS same, 1.7976931348623157e308::DOUBLE AS other FROM embeddings")
_expr("sql_match", "documents", "SELECT doc_id FROM documents WHERE text MATCH 'coolant zebra' AND lang LIKE 'EN'", "SELECT doc_id FROM documents WHERE lang ILIKE 'en' AND list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+'), ['coolant', 'zebra'])")
_expr("compound_order_limit", "customer supplier", "SELECT c_nationkey AS k, 'c' AS w FROM customer UNION SELECT s_nationkey, 's' FROM supplier ORDER BY k DESC, w LIMIT 7 OFFSET 2", "SELECT c_nationkey AS k, 'c' AS w FROM customer UNION SELECT s_nationkey, 's' FROM supplier ORDER BY k DESC, w LIMIT 7 OFFSET 2")


@add("SELECT 1 AS found")
def explain_plan(spark, sf_dir):
    plan = _session(spark, sf_dir, "orders").sql("EXPLAIN QUERY PLAN SELECT o_custkey FROM orders WHERE o_orderkey = 5")
    return plan.where("plan LIKE '%PushedFilters%EqualTo(o_orderkey%'").selectExpr("1 AS found").distinct()


@add("SELECT 1 AS refused")
def recursive_intersect_refused(spark, sf_dir):
    s = _session(spark, sf_dir, "nation")
    try:
        s.sql("WITH RECURSIVE t(n) AS (SELECT n_nationkey FROM nation INTERSECT SELECT n + 1 FROM t) SELECT n FROM t")
    except ValueError:
        return spark.createDataFrame([(1,)], "refused int")
    return spark.createDataFrame([(0,)], "refused int")


_FTS = """
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+'), lambda x: strlen(x) > 1) AS w FROM documents),
    a AS (SELECT count(*) AS n, greatest(1, avg(coalesce(len(w), 0))) AS avgdl FROM t),
    h AS (SELECT doc_id, len(w) AS dl, q AS term, len(list_filter(w, lambda x: x = q)) AS tf FROM t, (SELECT unnest(['coolant', 'pump']) AS q) WHERE list_contains(w, q)),
    d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT doc_id AS rowid, round(-sum(greatest(0.1, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN d USING (term), a GROUP BY doc_id"""


@add(_FTS)
def fts_match_rank(spark, sf_dir):
    s = _session(spark, sf_dir, "documents")
    s.sql("CREATE VIRTUAL TABLE docs USING fts5(body)")
    s.sql("INSERT INTO docs (rowid, body) SELECT doc_id, text FROM documents")
    return s.sql("SELECT rowid, round(bm25(docs), 6) AS score FROM docs WHERE docs MATCH 'coolant pump' ORDER BY rank")


# Collections of documents.
_EVENT = "to_json({'user': user_id, 'kind': event_type, 'value': value})"


@add("SELECT event_id AS id, user_id::VARCHAR AS user FROM events WHERE event_type = 'click'")
def collection_find(spark, sf_dir):
    c = Collection(new_store(spark), "things")
    c.insert(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), "value")).alias("doc")))
    return c.find({"kind": "click"}).select("id", F.get_json_object("doc", "$.user").alias("user"))


@add("SELECT count(*) AS n, true AS changed, false AS absent, 'new' AS kind FROM events")
def collection_changes(spark, sf_dir):
    c = Collection(new_store(spark), "things")
    c.insert(read(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", "value")).alias("doc")))
    changed = c.update(3, {"event_type": "it's new", "k": "new"}) and c.delete(1) and c.insert([{"k": 1}]).count() == 1
    return spark.createDataFrame([(c.count(), changed, c.delete(-5), c.get(3)["k"])], "n long, changed boolean, absent boolean, kind string")


# Decisions about texts.
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[\\s!-/:-@\\[-`{{-~]+'), lambda x: x <> ''))"
_PREFIX = "CASE WHEN x = y THEN 1.0 WHEN strlen(x) >= 4 AND strlen(y) >= 4 AND (starts_with(x, y) OR starts_with(y, x)) THEN 0.7 ELSE 0.0 END"


@add(f"""
    WITH m AS (SELECT DISTINCT user_message AS s, {_WORDS.format(x="coalesce(user_message, '')")} AS w FROM tap_chat_logs WHERE user_message IS NOT NULL),
    p AS (SELECT s, w, unnest(CASE WHEN len(w) = 0 THEN [''] ELSE w END) AS x FROM m),
    o AS (SELECT s, any_value(w) AS w, y, sum({_PREFIX}) AS hits FROM p, (SELECT unnest(['pump', 'index', 'sensor']) AS y) GROUP BY s, y),
    z AS (SELECT s, y, CASE WHEN len(w) = 0 THEN 0 ELSE 0.2 * list_contains(w, y)::INT / sqrt(len(w)) + 1.2 * least(1, hits) END AS score FROM o)
    SELECT s, arg_max(y, round(score, 9) * 10 - CASE y WHEN 'pump' THEN 1e-12 WHEN 'index' THEN 2e-12 ELSE 3e-12 END) AS label FROM z GROUP BY s""")
def text_classify(spark, sf_dir):
    s = _session(spark, sf_dir, "tap_chat_logs")
    return s.sql("SELECT DISTINCT user_message AS s, TEXT_CLASSIFY(user_message, 'pump, index, sensor') AS label FROM tap_chat_logs WHERE user_message IS NOT NULL")


@add(f"""
    WITH m AS (SELECT DISTINCT user_message AS s, {_WORDS.format(x="user_message")} AS w FROM tap_chat_logs WHERE user_message IS NOT NULL),
    k AS (SELECT s, len(w) AS n, len(list_intersect(w, ['the', 'pump', 'sensor'])) AS c FROM m)
    SELECT s, round(1 / (1 + exp(-3.5 * (0.4 * CASE WHEN n = 0 THEN 0 ELSE c / sqrt(3.0 * n) END + 1.2 * c / 3.0))), 6) AS score FROM k""")
def text_score(spark, sf_dir):
    s = _session(spark, sf_dir, "tap_chat_logs")
    return s.sql("SELECT DISTINCT user_message AS s, ROUND(TEXT_SCORE(user_message, 'the pump sensor'), 6) AS score FROM tap_chat_logs WHERE user_message IS NOT NULL")


@add("SELECT n, v FROM (VALUES (1, 1), (2, 0), (3, 0), (4, 0)) t(n, v)")
def text_verify(spark, sf_dir):
    s = _session(spark, sf_dir)
    return s.sql("""
        SELECT 1 AS n, TEXT_VERIFY('the pump runs at full speed', 'pump runs at full speed') AS v UNION ALL SELECT 2, TEXT_VERIFY('the pump runs at full speed', 'the pump does not run at full speed')
        UNION ALL SELECT 3, TEXT_VERIFY('the dog chased the big cat', 'the big cat chased the dog') UNION ALL SELECT 4, TEXT_VERIFY('the pump runs', 'bananas are yellow fruit')""")
