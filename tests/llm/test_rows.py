import numpy as np

from quillspark.llm import conversations, mixing, neighbours, tokens

HISTORY = "id long, session_id string, role string, content string, created_at long, ingested_at timestamp_ntz, hour long, exchange long"


# Problem 3.
def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 64))
    x = (centres[rng.integers(60, size=3000)] + 0.4 * rng.normal(size=(3000, 64))) * rng.uniform(0.1, 9, (3000, 1))
    x[10:20] = x[5] * 2  # a crowd of one direction
    rows = [(i, v.astype("f4").tolist(), "c") for i, v in enumerate(x)]
    rows += [(9000, None, "c"), (9001, [], "c"), (9002, [0.0] * 64, "c"), (9003, [float("nan")] * 64, "c"), (9004, [1.0] * 63, "c"), (7, x[7].astype("f4").tolist(), "c")]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, cell string")
    found = neighbours.nearest_neighbours(df, cell_rows=100).toPandas()
    u = (x.astype("f4") / np.linalg.norm(x.astype("f4"), axis=1, keepdims=True)).astype("f8")
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = found.groupby("id").neighbour.apply(list).to_dict()
    assert len(got) == 3000 and all(len(v) == 5 and len(set(v)) == 5 for v in got.values())
    recall = np.mean([np.mean([s[i, j] >= np.sort(s[i])[-5] - 1e-3 for j in got[i]]) for i in range(0, 3000, 20)])
    assert recall >= 0.95
    assert got[12] == [5, 10, 11, 13, 14]
    pairs = neighbours.neighbour_pairs(neighbours.nearest_neighbours(df.limit(50)))
    assert pairs.where("id_a >= id_b").count() == 0 and pairs.count() == pairs.distinct().count()
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0
    assert neighbours.nearest_neighbours(df.where("id < 3")).count() == 6


def test_large_areas_are_dealt_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 64)))], "id long, embedding array<double>")
    whole = {tuple(r) for r in neighbours.nearest_neighbours(df, probes=99, rerank=600, margin=2).select("id", "neighbour").collect()}
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    found = neighbours.nearest_neighbours(df, probes=99, rerank=600, margin=2)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in neighbours.nearest_neighbours(df, probes=99, rerank=600, margin=2).select("id", "neighbour").collect()} == whole


def test_cells_are_fitted_in_tasks_where_there_are_many(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 64))
    x = (centres[rng.integers(200, size=6000)] + 0.3 * rng.normal(size=(6000, 64))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "FLAT_CELLS", 16)
    got = neighbours.nearest_neighbours(df, cell_rows=60).groupBy("id").agg({"neighbour": "collect_list"}).toPandas().set_index("id").iloc[:, 0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = np.arange(0, 6000, 20)
    s = u[ask] @ u.T
    s[np.arange(len(ask)), ask] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    assert len(got) == 6000 and np.mean([len({*got[i]} & {*w.tolist()}) / 5 for i, w in zip(ask.tolist(), want)]) >= 0.95


def test_anisotropic_codes_keep_large_products_better():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64)).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = neighbours.fit_books(x)
    codes = neighbours.encode(x, books)
    back = np.concatenate([books[m][codes[:, m]] for m in range(16)], axis=1)
    parallel = np.einsum("nd,nd->n", x - back, x)
    assert np.abs(parallel).mean() < 0.25 * np.linalg.norm(x - back, axis=1).mean()
    t = neighbours._tables(x[:3], books)
    scanned = sum(t[:, m].take(neighbours._pairs(codes)[m], axis=1) for m in range(8))
    assert np.allclose(scanned, x[:3] @ back.T, atol=1e-4)


# Problem 7.
def test_conversations(spark):
    rows, n = [], 0

    def add(session, *turns):
        nonlocal n
        for role, content, at in turns:
            n += 1
            rows.append((n, session, role, content, at, None, 1, 1))

    add("ok", (" Human", "a?", 1_767_000_000), ("AI", "b", 1_767_000_005), ("system", "note", 1_767_000_006), ("user", "c?", 1_767_009_000_000), ("bot ", "d", 1_767_009_001))
    add("late", ("assistant", "b", 2_000_000_005), ("human", "a?", 2_000_000_000))
    add("twice", ("human", "a", 1), ("ai", "b", 2), ("ai", "c", 3))
    add("open", ("human", "a", 1), ("ai", "b", 2), ("human", "c", 3))
    add("reply first", ("ai", "b", 1), ("human", "a", 2), ("ai", "b", 3))
    add("blank", ("human", "a", 1), ("ai", "​ ", 2))
    add("null", ("human", "a", 1), ("ai", None, 2))
    add("role", ("human", "a", 1), ("ai", "b", 2), ("tool", "x", 3))
    add("time", ("human", "a", None), ("ai", "b", 2))
    add("system only", ("system", "a", 1))
    add("tie", ("human", "a", 5), ("ai", "b", 5))
    add("copy", ("human", "a", 5), ("ai", "b", 6), ("ai", "b", 6), ("human", "a", 5))
    add(None, ("human", "a", 5))
    add(" ", ("human", "a", 5))
    add("days", *[(r, f"m{i}", i * 50_000) for i, r in enumerate(["human", "ai"] * 6)])
    add("long", ("human", "q" * 300_000, 1), ("ai", "b", 2))
    df = spark.createDataFrame(rows, HISTORY)
    states = {r.session_id: r.keep for r in conversations.session_states(df).collect()}
    kept = {"ok", "late", "tie", "copy", "days", "long"}
    assert {s for s, k in states.items() if k} == kept and len(states) == 14
    talk = conversations.conversations(df).where("session_id = 'days'").orderBy("ts", "id").collect()
    assert [r.exchange for r in talk] == [i // 2 for i in range(12)] and all(r.parent_id == p.id for p, r in zip(talk[::2], talk[1::2]))
    assert {r.session_id for r in conversations.conversations(df).select("session_id").distinct().collect()} == kept
    assert conversations.session_states(df.limit(0)).count() == 0 and conversations.conversations(df.limit(0)).count() == 0


def test_links_choose_the_likeliest_question(spark):
    rows = [(1, "s", "human", "where is the pump?", 100, None, 0, 0), (2, "s", "human", "how large is the archive?", 101, None, 0, 0), (3, "s", "ai", "the pump is where it was", 102, None, 0, 0)]
    turns = conversations.exchanges(conversations.message_rows(spark.createDataFrame(rows, HISTORY)))
    assert [(r.id, r.parent_id) for r in conversations.reply_links(turns).collect()] == [(3, 1)]


def test_sessions_are_judged_by_their_links(spark, monkeypatch):
    rows = [(1, "s", "human", "a", 100, None, 0, 0), (2, "s", "ai", "b", 101, None, 0, 0), (3, "t", "human", "a", 100, None, 0, 0), (4, "t", "ai", "b", 101, None, 0, 0)]
    df = spark.createDataFrame(rows, HISTORY)
    assert {r.session_id: (r.keep, r.broken_exchanges) for r in conversations.session_states(df).collect()} == {"s": (True, 0), "t": (True, 0)}
    link = conversations.reply_links
    monkeypatch.setattr(conversations, "reply_links", lambda turns: link(turns).where("session_id = 's'"))
    assert {r.session_id: (r.keep, r.broken_exchanges) for r in conversations.session_states(df).collect()} == {"s": (True, 0), "t": (False, 1)}


# Problem 9.
def test_mixture_meets_its_shares(spark):
    docs = [(i, "word " * (5 + i % 40), s, "h", 1) for s, lo, hi in (("a", 0, 3000), ("b", 3000, 3400), ("c", 3400, 3420)) for i in range(lo, hi)]
    docs += [(9000, "word", None, "h", 1), (9001, None, "a", "h", 1), (9002, "", "a", "h", 1), (9003, "word " * 100, "other", "h", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, h string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.3, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats long")
    budget = {r.source: r for r in mixing.source_budgets(mixing.listed_tokens(df, targets), targets).collect()}
    assert [s for s in budget if budget[s].short] == ["c"] and budget["gone"].available == 0
    used: dict = {}
    for r in mixing.mix(df, targets).collect():
        used.setdefault(r.source, []).append((r.tokens * r.repeats, r.repeats))
    for s, cap in (("a", 1), ("b", 3), ("c", 4)):
        total = sum(t for t, _ in used[s])
        assert max(n for _, n in used[s]) <= cap
        if s == "c":
            assert total == 4 * budget[s].available
        else:
            assert budget[s].budget - 60 <= total <= budget[s].budget
    shares = {r.source: r.actual_share for r in mixing.actual_shares(mixing.mix(df, targets), targets).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["gone"] == 0
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0
    assert tokens.count_tokens("word word") == 2


def test_short_sources_come_from_the_plan(spark, monkeypatch):
    docs = [(i, "word " * (5 + i % 7), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2), ("c", 0.4, 1), ("gone", 0.1, 3), ("none", 0.0, 3)], "source string, target_share double, max_repeats long")
    rounds = []
    slot = mixing._slot
    monkeypatch.setattr(mixing, "_slot", lambda level: rounds.append(level) or slot(level))
    assert sorted(r.source for r in mixing.short_sources(df, targets).collect()) == ["b", "c", "gone"] and rounds[:2] == [0, 1]
    plan = mixing.mixture_plan(df, targets)[1]
    for r in mixing.source_budgets(mixing.listed_tokens(df, targets), targets).collect():
        assert plan[r.source][3] == r.short
    assert mixing.short_sources(df.limit(0), targets).count() == 0 and mixing.short_sources(df, targets.limit(0)).count() == 0


def test_interleaved_replies_are_linked_by_what_they_share(spark, monkeypatch):
    turns = [("user", "How do I reset the coolant pump?", 100), ("user", "Where is the vector index stored?", 110), ("ai", "The coolant pump has a reset key.", 115), ("ai", "The vector index is stored beside the table.", 120)]
    df = spark.createDataFrame([(i, "s", r, t, at, None, 1, 1) for i, (r, t, at) in enumerate(turns)], HISTORY)
    links = lambda: {r.id: r.parent_id for r in conversations.reply_links(conversations.exchanges(conversations.message_rows(df))).collect()}
    assert links() == {2: 0, 3: 1}
    monkeypatch.setattr(conversations, "W_OVERLAP", 0.0)
    assert links() == {2: 1, 3: 1}  # by time alone
    assert not conversations.session_states(df).first().keep


def test_scores_are_computed_only_where_they_decide(spark):
    sessions = {"whole": "ur", "asked twice": "uu", "replied twice": "rr", "interleaved": "uurr", "open": "uru", "late question": "rur"}
    rows = [(10 * n + i + 1, s, {"u": "human", "r": "ai"}[c], f"pump {i}", 100 + i, None, 1, 1) for n, (s, turns) in enumerate(sessions.items()) for i, c in enumerate(turns)]
    df = spark.createDataFrame(rows, HISTORY)
    scored = lambda out: "array_intersect" in out._jdf.queryExecution().optimizedPlan().toString()
    states, talk = conversations.session_states(df), conversations.conversations(df)
    assert not scored(states) and not scored(talk) and scored(conversations.reply_links(conversations.exchanges(conversations.message_rows(df))))
    assert {r.session_id: (r.keep, r.broken_exchanges) for r in states.collect()} == {s: (s == "whole", int(s != "whole")) for s in sessions}
    assert sorted((r.session_id, r.id, r.parent_id or -1) for r in talk.collect()) == [("whole", 1, -1), ("whole", 2, 1)]
