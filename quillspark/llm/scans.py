"""Problem 1: text from scanned pages is repaired into continuous paragraphs.

Words are corrected by a noisy channel: a reading costs the chance of the character confusions that would turn it into
what stands there, estimated from the collection itself, and gains the likelihood of its words, each given the one before
it, from counts of words and of pairs of neighbouring words over all chunks; Viterbi's algorithm finds the best readings
of each line. Candidates are the distinct words of the collection that fold to the same key: every character is written
as what it can be mistaken for, so words that any number of confusions turns into one another have one key, whatever
their length. Each chunk gets the counts that its own lattice needs by joins, in which frequent words are salted, so no
table of the collection is held by a task or the driver. Words divided at a line end are joined where the collection knows the
joined word better than the compound; running heads are lines that recur in at least four chunks of their source, with
misread characters folded together; page numbers are lines with nothing but the number of their page.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpointed

HEAD_CHUNKS = 4
#: Share of a reading's count that a misread form may have, plain or with a figure or sign inside; weight of a word's chance after the one before it, the rest being its chance anywhere.
PLAIN_SHARE, MIXED_SHARE, BIGRAM = 0.08, 0.5, 0.6
#: Inverse of the share of all words from which a word or pair is salted in joins (there are fewer such than this), and the salts.
HEAVY, SALTS = 20_000, 16
#: Chance of any confusion in a character, before they are counted.
PRIOR = 0.003

# Fixed values: (meant, seen) pairs of characters that are commonly mistaken, the words for "page" and "of", and marks of division.
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("t", "f"), ("i", "l"), ("n", "ri"), ("s", "5"), ("o", "0"), ("l", "1"), ("i", "1"), ("u", "ii"), ("d", "cl"), ("g", "q"), ("m", "rn"), ("h", "li"), ("b", "6"), ("w", "vv"),
    ("g", "9"), ("z", "2"), ("b", "8"), ("l", "|"), ("i", "|"), ("i", "!"), ("s", "$"), ("e", "3"), ("t", "7"), ("g", "6"),
)
PAGE_WORDS = "page|pg|pag|seite|s|halaman|hal|muka surat|página|pagina|pág|p"
OF_WORDS = "of|von|de|sur|daripada|dari|aus"
DIVIDERS = "-‐‑­¬"

# Each run is tried from its start only, so that a very long text without blanks takes linear time.
_TRIM = r"^[^\p{L}\p{N}@|$!]+|(?<![^\p{L}\p{N}@|$])[^\p{L}\p{N}@|$]+$"
_TRIM_PY = re.compile(r"^[^\w@|$!]+|(?<![^\w@|$])[^\w@|$]+$")
_DIVIDED = re.compile(rf"(?<![^\W_])([^\W_]+(?:-[^\W_]+)*)([{DIVIDERS}]) ?\n[ \t]*([^\W\d_]+)")
_PAGE = re.compile(rf"^[\W_]*(?:(?:{PAGE_WORDS})\b\.?\s*)?([0-9ivxlc]{{1,6}}|[0-9oils|!bszq]{{1,4}})(?:\s*(?:/|\||{OF_WORDS})\s*[0-9]{{1,5}})?[\W_]*$", re.I)
_ROMAN = (("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1))


def _roman(n: int) -> str:
    out = "c" * (n // 100)
    n %= 100
    for s, v in _ROMAN:
        while n >= v:
            out, n = out + s, n - v
    return out


_FIGURES = str.maketrans("oilbszqgOILBSZQG|!", "011652990116529911")


def is_page_number(line: str, page: int | None) -> bool:
    """True if the line is nothing but the number of its page, in figures (misread ones too) or Roman numerals, with or without decoration, a word for page and the count of pages."""
    m = _PAGE.match(line.strip())
    if not m or page is None:
        return False
    x = m.group(1).lower()
    return x == str(page) or x == _roman(page) or (any(c.isdigit() for c in x) and x.translate(_FIGURES) == str(page))


def _folded(line: Column) -> Column:
    """A line in lower case without figures at its ends and with mistaken characters folded together."""
    x = F.lower(line)
    x = F.regexp_replace(x, r"^[\W_]*\d{1,4}(?:\s*/\s*\d+)?(?=\s{2,}|\s*[|·—–-])[\W_]*|(?:\s{2,}|[|·—–-]\s*)\d{1,4}(?:\s*/\s*\d+)?[\W_]*$", "")
    x = F.regexp_replace(x, r"\s+", " ")
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("ri", "n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.translate(x, "0156@9q|!82$37ftcel", "oisbaggiibzsettteei"))


def running_heads(df: DataFrame) -> DataFrame:
    """chunk_id, heads (indices of the lines that are running heads or feet of the chunk's source).

    Chunks are counted per source and folded line after a partial count, so a source that holds a third of all rows is
    no hot key. A null source has no running heads.
    """
    lines = df.where("source is not null and content is not null").select("chunk_id", "source", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    title = F.col("line").rlike(r"^[\W\d_]*\p{Lu}") & ~F.col("line").rlike(r"[.,;:]\s*$") & F.col("line").rlike(r"\p{L}{3}")
    lines = lines.where(title).select("chunk_id", "source", "i", _folded(F.col("line")).alias("fold")).where(F.length("fold") >= 5)
    often = lines.select("source", "fold", "chunk_id").distinct().groupBy("source", "fold").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAD_CHUNKS)
    return lines.hint("merge").join(often.select("source", "fold").hint("merge"), ["source", "fold"], "left_semi").groupBy("chunk_id").agg(F.collect_set("i").alias("heads"))


def _words(content: Column) -> Column:
    """The words of a text in lower case; parts of divided words are left out."""
    whole = F.regexp_replace(content, rf"(?<!\S)\S+[{DIVIDERS}] ?\n[ \t]*[^\s]+", " \u0000 ")
    return F.transform(F.filter(F.split(F.lower(whole), r"\s+"), lambda x: x != ""), lambda x: F.regexp_replace(x, _TRIM, ""))


def _key(word: Column) -> Column:
    """The same for words that confusions turn into one another: each character as what it can be mistaken for, so a group of characters has the key of the one it stands for."""
    x = F.translate(word, "c3@f7l1|!0$59q68b2", "eeattiiiiossgggggz")
    for a, b in (("m", "rn"), ("n", "ri"), ("u", "ii"), ("h", "ii"), ("d", "ei"), ("w", "vv")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def undone(word: str, reading: str) -> tuple[tuple[str, str], ...] | None:
    """The fewest confusions (meant, seen) that turn a reading into a word, or None."""
    best: dict[tuple[int, int], tuple[int, tuple[int, int], tuple[str, str] | None]] = {(0, 0): (0, (0, 0), None)}
    todo = [(0, 0)]
    while todo:  # by place in the word: every step goes on in both
        i, j = heapq.heappop(todo)
        n = best[i, j][0]
        steps = [(i + 1, j + 1, n, None)] if i < len(word) and j < len(reading) and word[i] == reading[j] else []
        steps += [(i + len(s), j + len(m), n + 1, (m, s)) for m, s in CONFUSIONS if word.startswith(s, i) and reading.startswith(m, j)]
        for a, b, many, step in steps:
            if (a, b) not in best:
                heapq.heappush(todo, (a, b))
            elif many >= best[a, b][0]:
                continue
            best[a, b] = (many, (i, j), step)
    at, out = (len(word), len(reading)), []
    if at not in best:
        return None
    while at != (0, 0):
        _, at, step = best[at]
        if step:
            out.append(step)
    return tuple(reversed(out))


def _is_mixed(word: str) -> bool:
    return any(not c.isalpha() and c not in "-'’" for c in word)


def word_readings(counts: DataFrame) -> DataFrame:
    """w, reading, seen (confusions undone, as text), n_w, n, firm: readings in the collection of the words that may be misread.

    firm: the word's count is a small share of the reading's. Other readings of plain words count only where their
    neighbours speak for them.
    """

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ways = [undone(w, r) for w, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            keep = pa.array([x is not None for x in ways], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in b.columns), pa.array([" ".join(f"{m}>{s}" for m, s in x) for x in ways if x is not None], pa.string())], names=["w", "reading", "n_w", "n", "firm", "seen"])

    keyed = counts.where((F.length("w") > 2) & ~F.contains("w", F.lit("_"))).select("w", "n", _key(F.col("w")).alias("key"))
    mixed = F.col("w").rlike(r"[^\p{L}'’-]")
    left = keyed.where(~F.col("w").rlike(r"^(?:[a-z]{1,3}-?)?[\d.,:/%+-]+$")).withColumnRenamed("n", "n_w")
    right = keyed.where(~F.col("w").rlike(r"[^\p{L}'’-]")).withColumnsRenamed({"w": "reading"})
    firm = F.col("n_w") <= F.col("n") * F.when(mixed, MIXED_SHARE).otherwise(PLAIN_SHARE)
    pairs = left.hint("merge").join(right.hint("merge"), "key").where("w <> reading").withColumn("firm", firm).where(F.col("firm") | ~mixed)
    return pairs.select("w", "reading", "n_w", "n", "firm").mapInArrow(explain, "w string, reading string, n_w long, n long, firm boolean, seen string").select("w", "reading", "seen", "n_w", "n", "firm")


def _lattices(text: str, fixes: dict[str, list]) -> Iterator[tuple[list[str], list[str], list[list[str]]]]:
    """(raw tokens, words, candidates of each) of the lines that have a word with another reading."""
    for line in text.split("\n"):
        raw = line.split()
        words = [_TRIM_PY.sub("", x.lower()) for x in raw]
        if any(w in fixes for w in words):
            yield raw, words, [[w, *(r for r, *_ in fixes.get(w, ()))] for w in words]


def _needs(text: str, fixes: dict[str, list]) -> set[str]:
    """Keys whose counts decide about a chunk: pairs of words of its lattices, and the forms of its divided words."""
    out: set[str] = set()
    for _, words, options in _lattices(text, fixes):
        for a, b in zip(options, options[1:]):
            if len(a) > 1 or len(b) > 1:
                out.update(f"{x} {y}" for x in a for y in b)
                out.update((*a, *b))
    for m in _DIVIDED.finditer(text):
        a, b = m.group(1).lower(), m.group(3).lower()
        out.update((a + b, f"{a}-{b}", b))
    return out


def _supported(words: list[str], options: list[list[str]], fixes: dict[str, list], counts: dict[str, int]) -> tuple[list[list[str]], set[int]]:
    """options without the readings that aren't firm and that no neighbour supports; the places where one of those stays.

    A neighbour supports it if it stands next to the reading elsewhere and nowhere else next to the word.
    """
    out, places = [], set()
    for i, (w, opts) in enumerate(zip(words, options)):
        doubtful = {r for r, _, _, _, firm in fixes.get(w, ()) if not firm}
        if doubtful:
            around = lambda x: sum(counts.get(k, 0) for k in ([f"{words[i - 1]} {x}"] if i else []) + ([f"{x} {words[i + 1]}"] if i + 1 < len(words) else []))  # noqa: B023, E731
            alone = around(w) <= (i > 0) + (i + 1 < len(words))
            kept = {r for r in doubtful if alone and around(r) > 0}
            opts = [r for r in opts if r not in doubtful or r in kept]
            if kept:
                places.add(i)
        out.append(opts)
    return out, places


def correct_line(words: list[str], options: list[list[str]], fixes: dict[str, list], counts: dict[str, int], total: float) -> list[str]:
    """The likeliest reading of each word of a line, by Viterbi's algorithm over the candidates."""

    options, doubtful = _supported(words, options, fixes, counts)

    def anywhere(i: int, r: str) -> tuple[float, float]:
        """(chance of a reading anywhere, cost of the confusions that it undoes)."""
        w = words[i]
        if w not in fixes:
            return max(1, counts.get(w, 1)) / total, 0.0
        rows = fixes[w]
        if r == w:
            if i in doubtful:  # without this one
                return max(0.1, rows[0][3] - 1 - PLAIN_SHARE / 2 * max(x[2] for x in rows)) / total, 0.0
            firm = [x[2] for x in rows if x[4]]
            return (0.05 if _is_mixed(w) else max(0.1, rows[0][3] - PLAIN_SHARE / 2 * max(firm, default=0))) / total, 0.0
        cost, n = next((x[1], x[2]) for x in rows if x[0] == r)
        return n / total, cost

    # chance, cost, and whether it is a written form whose count its readings explain
    known = [{r: (*(x := anywhere(i, r)), r == words[i] and r in fixes and x[0] * total < 0.2) for r in opts} for i, opts in enumerate(options)]

    def score(i: int, a: str | None, b: str) -> float:
        """The logarithm of P(b | a), the pair's share of a's places smoothed by the chance of b anywhere, with the cost of b's confusions."""
        chance, cost, explained = known[i][b]
        if a is None:
            return math.log(chance) + cost
        written = a == words[i - 1] and (a in fixes or words[i] in fixes)  # what stands here is no evidence for itself
        after = max(0, counts.get(f"{a} {b}", 0) - (written and b == words[i])) / max(1, counts.get(a, 0) - written)
        if explained or known[i - 1][a][2]:  # such a form has no neighbours of its own
            after = 0.0
        return math.log(BIGRAM * min(1.0, after) + (1 - BIGRAM) * chance) + cost

    best = {r: (score(0, None, r), [r]) for r in options[0]}
    for i, opts in enumerate(options[1:], 1):
        if len(opts) == len(best) == 1:  # nothing to choose
            ((s, path),) = best.values()
            best = {opts[0]: (s, [*path, opts[0]])}
            continue
        best = {r: max((s + score(i, p, r), [*path, r]) for p, (s, path) in best.items()) for r in opts}
    return max(best.values())[1]


def _salted(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, by: str) -> DataFrame:
    """left joined with right, which has each key once, with the rows of heavy keys dealt to salts by a column."""
    flags = F.broadcast(heavy.select(key, F.lit(SALTS).alias("_salts")))  # fewer than HEAVY rows
    a = left.join(flags, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    b = right.join(flags, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a.hint("merge").join(b.hint("merge"), [key, "_salt"]).drop("_salt")


def _like(raw: str, word: str, reading: str) -> str:
    """raw with its word replaced by the reading, in the case of the original."""
    at = raw.lower().find(word)
    seen = raw[at : at + len(word)]
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        reading = reading.upper()
    elif letters and seen[:1].isupper() or (not seen[:1].isalpha() and raw[:1].isupper()):
        reading = reading[:1].upper() + reading[1:]
    return raw[:at] + reading + raw[at + len(word) :]


def is_divided(a: str, mark: str, b: str, counts: dict[str, int]) -> bool:
    """True if a and b, with mark at the line end, are one word written without a hyphen."""
    joined, compound = counts.get(a + b, 0), counts.get(f"{a}-{b}", 0)
    if joined or compound:
        return joined > compound
    return mark in "­¬" or counts.get(b, 0) == 0


def repair(text: str, page: int | None, heads: set[int], fixes: dict[str, list], counts: dict[str, int], total: float) -> tuple[list[str], str]:
    """(defects, repaired text) of one chunk."""
    found: set[str] = set()
    lines = []
    for i, line in enumerate(text.split("\n")):
        if i in heads:
            found.add("header")
            line = None
        elif is_page_number(line, page):
            found.add("page_number")
            line = None
        lines.append(line)
    done: dict[tuple[str, ...], list[str]] = {}
    for _, words, options in _lattices(text, fixes):
        done[tuple(words)] = fixed = correct_line(words, options, fixes, counts, total)
        if fixed != words:
            found.add("misread")
    for m in _DIVIDED.finditer(text):
        if is_divided(m.group(1).lower(), m.group(2), m.group(3).lower(), counts):
            found.add("hyphen")
            break
    body = "\n".join(x for x in lines if x is not None)
    body = _DIVIDED.sub(lambda m: m.group(1) + ("" if is_divided(m.group(1).lower(), m.group(2), m.group(3).lower(), counts) else "-") + m.group(3), body)
    out = []
    for paragraph in re.split(r"\n[ \t]*\n", body):
        fixed = []
        for line in paragraph.split("\n"):
            raw = line.split()
            words = [_TRIM_PY.sub("", x.lower()) for x in raw]
            if any(w in fixes for w in words):
                fixed_words = done.get(tuple(words))
                if fixed_words is None:  # a line that changed where a divided word was joined
                    fixed_words = correct_line(words, [[w, *(r for r, *_ in fixes.get(w, ()))] for w in words], fixes, counts, total)
                raw = [x if r == w else _like(x, w, r) for x, w, r in zip(raw, words, fixed_words)]
            fixed += raw
        if fixed:
            out.append(" ".join(fixed))
    return sorted(found), "\n\n".join(out)


def repaired(df: DataFrame) -> DataFrame:
    """One row per chunk: chunk_id, defects (array of hyphen, misread, header, page_number), content (repaired).

    df has chunk_id, source, page, content; heading isn't needed. A null content stays null and has no defect; an empty
    one stays empty. A null page has no page numbers. Equal chunk_ids share their counts.
    """
    text = df.select("chunk_id", "source", "page", "content")
    words = text.where("content is not null").select("chunk_id", _words(F.col("content")).alias("words"))
    after = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    both = F.filter(F.zip_with("words", after, lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b))), lambda x: x.isNotNull())
    tallies = checkpointed(words.select(F.explode(F.concat(F.filter("words", lambda x: x != ""), both)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    single = tallies.where(~F.contains("w", F.lit(" ")))
    total = float(single.agg(F.sum("n")).first()[0] or 1)
    heavy = tallies.where(F.col("n") > total / HEAVY).select("w")
    readings = checkpointed(word_readings(single))
    # The chance of each confusion: how often it explains a word, among the characters that it could have struck.
    struck = readings.where("firm and instr(seen, ' ') = 0").groupBy("seen").agg(F.sum("n_w").alias("hits"), F.sum("n").alias("of")).collect()  # one row a confusion
    chance = {r.seen: min(0.2, max(PRIOR / 10, r.hits / (r.of + 1))) for r in struck}
    cost = F.aggregate(F.transform(F.split("seen", " "), lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for p in (chance | {"": 1.0}).items() for y in (p[0], math.log(p[1]))]), x), F.lit(math.log(PRIOR)))), F.lit(0.0), lambda a, b: a + b)
    by_word = readings.select("w", F.struct("reading", cost.alias("cost"), "n", "n_w", "firm").alias("r")).groupBy("w").agg(F.collect_list("r").alias("r"))
    listed = words.select("chunk_id", F.explode(F.array_distinct("words")).alias("w"))
    fixes = _salted(listed, by_word, "w", heavy, "chunk_id").groupBy("chunk_id").agg(F.collect_list(F.struct("w", "r")).alias("fixes"))
    fixes = checkpointed(fixes)

    def unpack(col: list | None) -> dict[str, list]:
        return {x["w"]: [(y["reading"], y["cost"], y["n"], y["n_w"], y["firm"]) for y in x["r"]] for x in col or ()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for k, t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                need = _needs(t, unpack(f))
                ids += [k] * len(need)
                keys += need
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.string())], names=["chunk_id", "w"])

    id_type = df.schema["chunk_id"].dataType.simpleString()
    needs = text.where("content is not null").select("chunk_id", "content").hint("merge").join(fixes.hint("merge"), "chunk_id", "left").select("chunk_id", "content", "fixes").mapInArrow(ask, f"chunk_id {id_type}, w string")
    counted = _salted(needs, tallies, "w", heavy, "chunk_id").groupBy("chunk_id").agg(F.collect_list(F.struct("w", "n")).alias("counts"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            defects, out = [], []
            for t, p, h, f, c in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                d, x = ([], None) if t is None else repair(t, p, set(h or ()), unpack(f), {y["w"]: y["n"] for y in c or ()}, total)
                defects.append(d)
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(defects, pa.list_(pa.string())), pa.array(out, pa.string())], names=["chunk_id", "defects", "content"])

    whole = text.hint("merge").join(running_heads(text).hint("merge"), "chunk_id", "left").hint("merge").join(fixes.hint("merge"), "chunk_id", "left").hint("merge").join(counted.hint("merge"), "chunk_id", "left").select("chunk_id", "content", F.col("page").cast("long"), "heads", "fixes", "counts")
    return whole.mapInArrow(mend, f"chunk_id {id_type}, defects array<string>, content string")
