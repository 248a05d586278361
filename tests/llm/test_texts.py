import random

import pytest

from pyspark.sql import functions as F

from quillspark.llm import chunking, languages, nearcopies, packing, pairs, scans, stuffing, tokens

PDF = "chunk_id long, source string, page long, chunk_index long, heading string, content string, char_count long, k string, words string"


# Problem 1.
PAGE = "The sensor reports a warning whenever the coolant pump vibrates.\nThe long-term archive needs a second opinion from the lab."


def pages(n=40):
    rows = [(i, f"s{i % 4}", i // 4 + 1, 0, None, f"Rovozar Guide 7 draft\n{PAGE}", 0, "x", "y") for i in range(n)]
    bad = "Rovozar Guide 7 draft\nThe sensor rcports a warn-\ning whenever the c0olant pump vibrates.\nThe long-\nterm archive needs a sec0nd opinion.\n— 7 —"
    return [*rows, (900, "s0", 7, 0, None, bad, 0, "x", "y")]


def test_scans_find_and_repair_each_noise(spark):
    out = {r.chunk_id: r for r in scans.repaired(spark.createDataFrame(pages(), PDF)).collect()}
    assert out[900].defects == ["header", "hyphen", "misread", "page_number"]
    assert out[900].content == "The sensor reports a warning whenever the coolant pump vibrates. The long-term archive needs a second opinion."
    assert out[0].defects == ["header"] and out[0].content == PAGE.replace("\n", " ")


def test_scans_take_null_blank_and_long_texts(spark):
    long = "a" * 200_000 + " " + "." * 50_000 + "x"
    rows = [(1, None, None, 0, None, None, 0, "", ""), (2, "s", 1, 0, None, "", 0, "", ""), (3, "s", None, 0, None, long, 0, "", ""), (3, "s", None, 0, None, long, 0, "", "")]
    out = sorted((r.chunk_id, tuple(r.defects), len(r.content or "")) for r in scans.repaired(spark.createDataFrame(rows, PDF)).collect())
    assert out[0] == (1, (), 0) and out[1] == (2, (), 0) and len(out) == 4
    assert scans.repaired(spark.createDataFrame([], PDF)).count() == 0


@pytest.mark.parametrize("line, page, yes", [("- 12 -", 12, True), ("Page 3 of 9", 3, True), ("PAGE 2", 2, True), ("[4]", 4, True), ("iv", 4, True), ("7 / 30", 7, True), ("— 5 —", 5, True), ("5749", 7, False), ("12 bolts", 12, False), ("", 1, False), ("3", None, False)])
def test_page_numbers(line, page, yes):
    assert scans.is_page_number(line, page) is yes


def test_readings_undo_several_confusions():
    assert scans.undone("ca1ibrafion", "calibration") == (("l", "1"), ("t", "f")) and scans.undone("slieet", "sheet") == (("h", "li"),) and scans.undone("iintil", "until") and scans.undone("pump", "lamp") is None


def test_misread_words_that_are_rare_in_the_collection(spark):
    texts = ["The alimentation of the pump is new.", "Check the alimentation of the valve.", "Her alimentation of the belt.", "Check the alirnentation of the belt.", "We saw a modern engine.", "Our new modem works well."]
    out = {r.chunk_id: r for r in scans.repaired(spark.createDataFrame([(i, "s", i + 1, 0, None, t, 0, "x", "y") for i, t in enumerate(texts)], PDF)).collect()}
    assert out[3].content == "Check the alimentation of the belt." and out[3].defects == ["misread"]
    assert all(out[i].content == texts[i] and out[i].defects == [] for i in (0, 1, 2, 4, 5))


def test_words_of_one_key_and_their_neighbours(spark):
    long = "w" + "imn" * 20  # many confusions in a long word
    seen = long.replace("m", "rn").replace("i", "1").replace("w", "vv")
    rows = [("place", 100), ("p1ace", 2), ("plaoe", 1), (long, 300), (seen, 1), ("modern", 80), ("modem", 1), ("_x_1", 5)]
    got = {(r.w, r.reading): r.seen for r in scans.word_readings(spark.createDataFrame(rows, "w string, n long")).collect()}
    assert got[("p1ace", "place")] == "l>1" and ("plaoe", "place") not in got and got[(seen, long)].count(">") == 41 and ("_x_1", "x") not in got
    fixes = {"c1r": [("cir", -5.0, 100, 1, True), ("clr", -5.0, 90, 1, True)]}
    options = [["the"], ["c1r", "cir", "clr"]]
    assert scans.correct_line(["the", "c1r"], options, fixes, {"the": 100, "the clr": 50, "the c1r": 1}, 10_000.0) == ["the", "clr"]
    assert scans.correct_line(["the", "c1r"], options, fixes, {"the": 100, "the c1r": 1}, 10_000.0) == ["the", "cir"]


# Problem 2.
def test_pieces_cover_the_text_within_the_limit():
    rng = random.Random(5)
    for _ in range(120):
        text = "".join(rng.choice(["word ", "Sentence ends. ", "\n\n", "# Head\n", "x" * rng.randrange(400), "é́"]) for _ in range(rng.randrange(1, 300)))
        spans = chunking.split_spans(text)
        assert all(0 < b - a <= 1200 for a, b in spans)
        joined = "".join(text[max(a, e) : b] for (a, b), e in zip(spans, [0, *(b for _, b in spans)]))
        assert joined == text
        assert all(60 <= b0 - a1 <= 150 for (_, b0), (a1, _) in zip(spans, spans[1:]))


def test_pieces_end_at_natural_boundaries():
    text = ("A short sentence stands here. " * 30 + "\n\n") * 4
    ends = [text[b - 2 : b] for _, b in chunking.split_spans(text)[:-1]]
    assert set(ends) <= {". ", "\n\n"}
    assert chunking.split_spans("") == [] and chunking.split_spans("x" * 1200) == [(0, 1200)]


def test_oversized_rows_only(spark):
    rows = [(1, None, 1, 0, None, "y" * 1201, 5, "a", "b"), (2, None, 1, 0, None, "y" * 1200, 9999, "a", "b"), (3, None, 1, 0, None, None, 9999, "a", "b"), (4, None, 1, 0, None, "z " * 300_000, 0, "a", "b")]
    out = chunking.split_oversized(spark.createDataFrame(rows, PDF))
    assert {r.chunk_id for r in out.collect()} == {1, 4}
    assert out.where("char_count <> length(content) or char_count > 1200").count() == 0


# Problem 4.
def test_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocab, [1 / (i + 1) for i in range(300)], k=rng.randrange(3, 60))
        for _ in range(rng.randrange(1, 5)):
            copy = [w for w in base if rng.random() > 0.06] + rng.choices(vocab, k=rng.randrange(0, 3))
            rng.shuffle(copy)
            texts.append(" ".join(copy))
    texts += [None, "", " .,;", "Only", "only!", "w1 " * 5000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")]
    df = spark.createDataFrame(rows, "mem_id long, content string, h string")
    words = {i: set((t or "").lower().replace("!", "").replace(".", " ").replace(",", " ").replace(";", " ").split()) for i, t in enumerate(texts)}
    for t, hots in ((0.75, (1, 300)), (0.5, (300,)), (1.0, (300,))):
        want = {(a, b) for a in words for b in words if a < b and words[a] and words[b] and len(words[a] & words[b]) >= t * len(words[a] | words[b]) - 1e-9}
        members, _ = nearcopies.near_copies(df, "mem_id", "content", t)
        reps = nearcopies.word_classes(df, "mem_id", "content").where("k = rep").selectExpr("rep as r", "h")
        for hot in hots:
            pairs_ = nearcopies.all_pairs(members, nearcopies.similar_classes(reps, t, hot))
            assert {tuple(r) for r in pairs_.collect()} == want, (t, hot)
    # Paths still hot after the last word are dealt to cells.
    reps = nearcopies.word_classes(df, "mem_id", "content").where("k = rep").selectExpr("rep as r", "h")
    want = {tuple(r) for r in nearcopies.similar_classes(reps, 0.75).collect()}
    assert {tuple(r) for r in nearcopies.similar_classes(reps, 0.75, 1, 2, 1).collect()} == want
    members, links = nearcopies.near_copies(df, "mem_id", "content", 0.75)
    assert "Broadcast" not in nearcopies.all_pairs(members, links)._jdf.queryExecution().executedPlan().toString()
    groups = nearcopies.copy_groups(members, links).collect()
    assert len(groups) == sum(bool(w) for w in words.values())
    assert nearcopies.all_pairs(*nearcopies.near_copies(df.limit(0), "mem_id", "content")).count() == 0


def test_groups_join_copies_over_other_copies(spark):
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join([*(f"x{j}" for j in range(k)), *base[k:]]) for k in range(0, 8, 2)]  # each is near the one before only
    texts += ["other words stand here", "here stand other words", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "mem_id long, content string")
    got = {r.k: r for r in nearcopies.copy_groups(*nearcopies.near_copies(df, "mem_id", "content", 0.75)).collect()}
    assert {k: r.group_id for k, r in got.items()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}
    assert [got[k].class_id for k in range(7)] == [0, 1, 2, 3, 4, 4, 6] and [got[k].links for k in range(7)] == [1, 2, 2, 1, 0, 0, 0]


# Problem 5.
EN = ["The sensor reports a warning whenever the pump vibrates.", "Store the index in the table and commit the batch.", "Before closing the cover, check the filter and note the reading.", "Two screws hold the plate against the frame of the pump."]
DE = ["Bei hoher Last muss die Pumpe geprüft und notiert werden.", "Nach jedem Import bleibt die Klappe geschlossen, solange die Anlage arbeitet.", "Zwei Schrauben halten das Gehäuse am Rahmen der Pumpe.", "Der Index wird neben der Tabelle gespeichert und danach gelöscht."]
LABELLED = "tbl string, rec_id long, label string, content string"


def labelled(n=80):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        own, lab = (EN, "en") if i % 2 else (DE, "de-DE")
        rows.append(("t", i, lab if i % 9 else ("de" if lab == "en" else "EN"), " ".join(rng.sample(own, 3))))
    return rows


def test_language_cases(spark):
    rows = [*labelled(), ("t", 500, None, EN[0] + " " + EN[1]), ("t", 501, "en", EN[0] + " " + DE[1]), ("t", 502, "English ", EN[2]), ("t", 503, "und", None), ("t", 504, "", ""), ("t", 505, "de", "12 34 !!"), ("t", 506, "fr", DE[0] * 300)]
    found = languages.segments(spark.createDataFrame(rows, LABELLED))
    cases = {(r.rec_id, r.lang) for r in languages.label_cases(found).collect()}
    wrong = {(i, "en" if i % 2 else "de") for i in range(80) if i % 9 == 0}
    assert cases == wrong | {(500, "en"), (501, "en"), (501, "de"), (506, "de")}
    assert all(0 <= r.confidence <= 1 and r.start <= r.end for r in found.collect())
    assert {r.rec_id for r in found.where("lang is null").collect()} == {503, 504, 505}


def test_languages_without_rows_or_labels(spark):
    assert languages.segments(spark.createDataFrame([], LABELLED)).count() == 0
    assert languages.segments(spark.createDataFrame([("t", 1, None, EN[0])], LABELLED)).where("lang is null").count() == 1


def test_label_spellings():
    got = [languages.label_of(x) for x in (" EN", "en-GB", "eng", "English", "Malay", "msa", "ms_MY", "und", "", None, "??", "xx")]
    assert got == ["en"] * 4 + ["ms"] * 3 + [None] * 5


# Problem 6.
CHAT = "id long, user_message string, bot_reply string, is_safe long, ingested_at timestamp_ntz, k string, defect string"


def test_pair_defects(spark):
    from datetime import datetime

    t0 = datetime(2026, 1, 1)
    fill = [(1000 + i, f"How do I reset the pump {i}?", f"Open the console and select the pump. Then wait for {i} seconds. {EN[i % 4]}", 1, t0, "", "") for i in range(120)]
    fill += [(2000 + i, "Wie setze ich die Pumpe zurück?", f"Öffnen Sie die Konsole und wählen Sie die Pumpe. {DE[i % 4]}", 1, t0, "", "") for i in range(120)]
    q = "Where do I find the filter after the upgrade of the pump?"
    cases = {1: (q, None, "empty"), 2: (q, " ​\n", "empty"), 3: (q, "[empty]", "empty"), 4: (q, q, "copy"), 5: (q, "> " + q.upper(), "copy"), 6: (q, "You asked: " + q, "copy"), 7: (q, q + " Open the console and select the pump.", None),
             8: (q, "I'm sorry, but I can't help with that.", "refusal"), 9: (q, "Hello! I must decline this request.", "refusal"), 10: (q, "Sorry, I can't answer that. Open the console and select the pump.", None),
             11: (q, "Öffnen Sie die Konsole und wählen Sie die Pumpe. " + DE[0], "other_language"), 12: (q + " Please answer in German.", "Öffnen Sie die Konsole und wählen Sie die Pumpe. " + DE[0], None),
             13: (q, "Open the console and select the", "truncated"), 14: (q, EN[0] + " Store the index in the", "truncated"), 15: (q, "Open the console and select the pump", None), 16: (None, "Open the console and select the pump.", None), 18: (q, "👍", None)}
    rows = [(i, m, r, 1, t0, "", "") for i, (m, r, _) in cases.items()]
    rows += [(17, q, "Yes. " * 40_000, 1, t0, "", ""), (19, q, "I can't help with that.", 0, t0, "", ""), (20, q, "N/A", None, t0, "", ""), (20, q, "Fine.", 1, datetime(2026, 1, 2), "", "")]
    df = spark.createDataFrame(fill + rows, CHAT)
    out = {r.id: r.defect for r in pairs.find_defects(df).collect()}
    want = {i: d for i, (_, _, d) in cases.items() if d} | {20: "empty"}
    assert {i: d for i, d in out.items() if i < 1000} == want
    assert pairs.find_defects(df.limit(0)).count() == 0


def test_long_refusals():
    long = "Hello! " + "I cannot help with that request, whatever the reason given. I must decline to go on with this topic. " * 8
    assert len(long) > 800 and pairs.is_refusal(long)
    assert not pairs.is_refusal(long + "The pump is in the cellar.") and not pairs.is_refusal("...\n") and not pairs.is_refusal("x " * 500_000 + "I cannot help.\nYes.")


# Problem 8.
def test_packing_is_tight_and_complete(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 900), "g") for i in range(300)] + [(900, "word " * 6000, "g"), (901, None, "g"), (902, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    for group in (8000, 50):
        packed = packing.pack_documents(df, group_items=group)
        boxes = packing.containers(packed).collect()
        assert max(b.tokens for b in boxes) <= 2048
        per = {r.doc_id: (r.t, r.n) for r in packed.groupBy("doc_id").agg({"tokens": "sum", "piece_index": "count"}).withColumnsRenamed({"sum(tokens)": "t", "count(piece_index)": "n"}).collect()}
        assert per == {i: (n := tokens.count_tokens(t), max(1, -(-n // 2048))) for i, t, _ in rows}
        assert len(boxes) <= 1.05 * sum(n for n, _ in per.values()) / 2048 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_best_fit_keeps_every_capacity():
    import numpy as np

    sizes = np.array([5] * 30 + [0] * 4)
    k = packing.best_fit(sizes, 20, 3)
    assert all((k == c).sum() <= 3 and sizes[k == c].sum() <= 20 for c in set(k))
    k = packing.best_fit(np.array([10, 10, 10]), 40, 9, 100)
    assert len(set(k)) == 3


def test_all_three_capacities_bind(spark):
    sizes = [30] * 200 + [700, 900, 1100, 1300] * 20 + [150] * 60
    df = spark.createDataFrame([(i, "word " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    rows: dict = {}
    for r in packing.pack_documents(df, **packing.BOUNDED).collect():
        rows.setdefault(r.container, []).append(r.tokens)
    most = packing.BOUNDED["max_attention"]
    assert all(sum(b) <= 2048 and len(b) <= 12 and (sum(t * t for t in b) <= most or len(b) == 1) for b in rows.values())
    least = min(sizes)
    full = lambda b: sum(b) + least > 2048
    assert any(len(b) == 12 and not full(b) for b in rows.values()) and any(full(b) for b in rows.values())
    assert len(rows) > len({r.container for r in packing.pack_documents(df).collect()})


def test_documents_are_packed_under_an_attention_cost(spark):
    df = spark.createDataFrame([(i, "word " * (100 + 90 * (i % 9))) for i in range(60)] + [(900, "word " * 5000)], "doc_id long, text string")
    for group in (8000, 20):
        rows = packing.pack_documents(df, group_items=group, max_attention=600_000).collect()
        boxes: dict = {}
        for r in rows:
            boxes.setdefault(r.container, []).append(r.tokens)
        assert all(sum(t * t for t in b) <= 600_000 or len(b) == 1 for b in boxes.values())
        assert {r.doc_id for r in rows} == {*range(60), 900} and any(sum(t * t for t in b) > 600_000 for b in boxes.values())


def test_tokens_in_parts_equal_tokens_at_once():
    text = "Each row of chunk_keys points to the log. " * 4000
    assert tokens.count_tokens(text) == len(tokens.encoder(tokens.VOCABULARY).encode_ordinary(text))
    assert tokens.count_tokens(None) == tokens.count_tokens("") == 0


# Problem 10.
def test_stuffed_pages(spark):
    prose = "The sensor reports a warning whenever the pump vibrates. Before closing the cover, check the filter and note the reading. "
    links = "\n".join(f"pump part {i} http://shop{i}.example/a?id={i}" for i in range(30))
    cases = {1: "Pump valve cheap pump! Buy pump best valve. Order pump valve pump sale! Valve pump discount pump. " * 8, 2: links, 3: EN[0] + "\n" + links, 4: " ".join(f"#pumpvalve{i % 7}" for i in range(60)), 5: "pump | cheap pump | valve | buy valve | " * 12}
    fine = {10: prose * 5, 11: "\n".join(f"[pump](http://a.example/{i}): {EN[i % 4]} {EN[(i + 1) % 4]}" for i in range(12)), 12: "def f(x):\n    return x + 1\n" * 20, 13: prose * 6 + "\npump http://a.example/x", 14: None, 15: "", 16: "\n".join("* " + x for x in EN)}
    unique = {20: "\n".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}zeb {chr(110 + i % 9)}orq{chr(97 + i)}" for i in range(26))}  # a list of words found nowhere else
    rows = [(i, t, f"h{i % 5}", "z") for i, t in {**cases, **fine, **unique}.items()] + [(100 + i, prose * 3 + EN[i % 4], f"h{i % 9}", "z") for i in range(40)] + [(200, "x" * 300_000, None, "z"), (1, cases[1], "h1", "z")]
    rows += [(30 + i, " ".join(reversed(t.split(" "))) if i != 2 else t, "other", "z") for i, t in cases.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, phrase string")
    found = [r.doc_id for r in stuffing.stuffed_pages(df).collect()]
    assert sorted(x for x in found if x < 30) == sorted(cases)
    # Without other hosts the same pages aren't flagged, however dense their lists.
    alone = df.where("doc_id < 30 or doc_id between 100 and 199").withColumn("source", F.lit("one"))
    assert stuffing.stuffed_pages(alone).count() == 0
    dense = {r.doc_id for r in stuffing.page_scores(alone).where(f"density >= {stuffing.DENSITY}").collect()}
    assert dense >= {*cases, *unique}
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0
    # The host is the url's where there is one.
    by_url = df.where("doc_id < 30 or doc_id between 100 and 199").selectExpr("doc_id", "text", "'one' as source", "concat('https://', source, '.example/', doc_id) as url")
    assert {r.doc_id for r in stuffing.stuffed_pages(by_url).collect()} == {r.doc_id for r in stuffing.stuffed_pages(df.where("doc_id < 30 or doc_id between 100 and 199")).collect()} > {2}
