"""Problem 10: pages of repeated keywords, links or product tags instead of sentences.

Each page is cut into segments: lines, cells, sentences. A segment is prose if it has enough words and enough of them
are words of sentences, code if it has the marks of code, else list material: keywords, links, tags. The words of
sentences are grown from function words on all pages: those far commoner in sentences with function words than in items
without any.

The list material is cut into phrases. Items end at separators, figures and codes; an item counts as shingles of two
words, since keywords stand in any order; a link counts by its domain and by its path. Phrases are exploded and the
distinct hosts of each are counted in the whole collection.

A page is flagged if its list material is stitched mostly from phrases that stand on another host too (replication), and
if most of the page is list material (list density). Neither is enough: a list of names found nowhere else isn't
flagged, and neither is a page of sentences, however common its phrases.

Sentences aren't exploded: what stands in them can't make a page a list, so it can't change the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a phrase shingle. Keywords follow one another in random order, so that longer ones hardly ever recur (README).
SHINGLE = 2
#: Least share of a page that is list material, and of the list material that is replicated.
DENSITY, REPLICATED = 0.5, 0.5
#: Inverse of the share of all sentence words from which a word can be one of the dictionary, which has fewer than so many.
VOCABULARY = 100_000
#: Inverse of the share of all phrase rows from which a phrase is heavy: fewer than so many are sent to every task.
HEAVY = 20_000

# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in into on at by for from with without is are was were be been has have had it its this that these those not no if when while because so than then as which who whose must may can do does before after over under through between against per each every both all any out up down off once until unless although otherwise we you they he she our your their",
    "ms": "yang dan atau di ke dari daripada pada dengan untuk bagi oleh ialah adalah akan telah tidak jangan jika apabila ketika semasa sebelum selepas supaya kerana tetapi manakala sehingga kepada dalam antara setiap itu ini sedia kekal boleh mesti sejak mulai tanpa walaupun kecuali hendaklah juga lebih sudah belum semua mereka kami kita anda saya",
    "fr": "le la les l un une des du de d et ou mais à au aux en dans sur sous par pour avec sans ne pas est sont a ont été être qui que qu quand alors si car afin ce cette ces son sa ses leur avant après depuis pendant chaque toutes tous entre contre vers plus moins puis donc où il elle ils nous vous se s sinon dès",
    "de": "der die das den dem des ein eine einen einem einer und oder aber in im an am auf aus bei mit nach von vor zu zum zur für über unter durch ohne ist sind war wird werden hat haben nicht kein wenn weil während bis damit als wie dass sich man es er sie wir ihr jede jeder alle noch nur auch sonst solange sobald darf muss kann zwischen gegen ab laut",
    "es": "el la los las un una unos de del al y o pero en con sin por para sobre bajo ante tras entre hasta desde contra hacia es son fue ha han no que se su sus lo le si cuando mientras porque como más menos cada todo toda este esta debe puede antes después aunque donde quien ni ya",
}
_LINKING = frozenset("d de des du del la le les l el los las un une una of the a an".split())
_BY_WORD: dict[str, tuple[int, ...]] = {}
for _i, _text in enumerate(FUNCTION_WORDS.values()):
    for _w in _text.split():
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _i)

_CUT = re.compile(r"\n+|\s+[|»›•·→]+\s+|(?<=[.!?。！？])\s+|;\s+(?=#)|,\s+(?=#)|(?<=\S)\s+(?=#\w)")
_MARKED = re.compile(r"[|»›•·→#]|[^\S \n]")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[a-z0-9][\w-]*(?:\.[a-z0-9][\w-]*)+/\S*|<a\s[^>]*>|</a>", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: A compound with hyphens is one word where sentences are told from lists: the "in" of "built-in" is no function word.
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_MAYBE_LINK = re.compile(r"/|www\.|<a\s|</a", re.I)
#: What ends an item within a line: separators, and figures or codes with what is attached to them.
_ITEM = re.compile(r"[,;:/|»›•·→\t!?()\[\]<>\"]+|\s+[-–—*.]+\s+|(?<![^\W_])[^\W\d_]{1,3}-?\d[\w.]*|\d[\w.]*|#|[.](?=\s|$)")
_CODE = re.compile(
    r"[{};]\s*$|^\s*(?:def |class |import |from \w+ import|return\b|if .*:$|for .*:$|while .*:$|else:|try:|SELECT\b|INSERT\b|UPDATE\b|DELETE\b|CREATE\b|FROM\b|WHERE\b|GROUP BY|ORDER BY|JOIN\b|WITH\b|let |const |var |fn |func |function |#include|public |private |//|--\s|\$ )"
    r"|\w\(.*\)|[=!<>]=|\w\s{0,20}=\s{0,20}[\w\"'\[{(]|->|=>|::"
)


def _segments(text: str) -> list[str]:
    """Lines, cells and sentences; blanks at their ends may be left. Texts without marks of lists are cut by plain replacement."""
    if _MARKED.search(text):
        return _CUT.split(text)
    for end in ".!?。！？":
        text = text.replace(end + " ", end + "\n")
    return text.split("\n")


def _by_seeds(words: list[str]) -> bool:
    """At least four words, and one in nine or more of them function words of one language other than linking words of names."""
    if len(words) < 4:
        return False
    votes = [0] * len(FUNCTION_WORDS)
    for w in words:
        if w not in _LINKING:
            for i in _BY_WORD.get(w, ()):
                votes[i] += 1
    return max(votes) * 9 >= len(words)


def _bare(segment: str) -> str:
    """A segment without its links."""
    return _LINK.sub(" ", segment) if _MAYBE_LINK.search(segment) else segment


def _tally(texts: list[str | None], inside: Counter, outside: Counter) -> None:
    """Counts segments by word: sentences with function words, and items without any."""
    for t in texts:
        for x in _segments(t) if t else ():
            ended = x.rstrip()[-1:] in ".!?…。！？"
            words = _COMPOUND.findall(_bare(x).lower()) if x else []
            if not words:
                continue
            if ended:
                if len(words) > 5 and _by_seeds(words):
                    inside.update(set(words))
            elif not any(w in _BY_WORD and w not in _LINKING for w in words):
                outside.update(set(words))


def sentence_words(df: DataFrame, text: str) -> frozenset[str]:
    """The function words, and words far commoner in sentences with function words than in items without any, over all rows.

    A word needs one in ``VOCABULARY`` of all sentence words, and three places, so the dictionary is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()

        def full() -> pa.RecordBatch:
            words = list(inside.keys() | outside.keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([inside[w] for w in words], pa.int64()), pa.array([outside[w] for w in words], pa.int64())], names=["w", "i", "o"])
            inside.clear()
            outside.clear()
            return out

        for b in batches:
            _tally(b.column(0).to_pylist(), inside, outside)
            if len(inside) + len(outside) > 200_000:
                yield full()
        yield full()

    from quillspark.session import checkpointed

    counts = checkpointed(df.select(F.col(text).alias("t")).mapInArrow(count, "w string, i long, o long").groupBy("w").agg(F.sum("i").alias("i"), F.sum("o").alias("o")))
    n, m = counts.agg(F.coalesce(F.sum("i"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    n, m = n or 1, m or 1
    picked = counts.where((F.col("i") >= max(3, n / VOCABULARY)) & (F.col("i") / n > 4 * (F.col("o") + 0.5) / m)).select("w").collect()  # no more than VOCABULARY
    return frozenset({r.w for r in picked} | (_BY_WORD.keys() - _LINKING))


def _prose(words: list[str], grown: frozenset[str]) -> bool:
    """At least four words, and a quarter or more of them words of sentences; before those are known, function words."""
    if len(words) < 4:
        return False
    return 4 * sum(w in grown for w in words) >= len(words) if grown else _by_seeds(words)


def _key(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words).encode()) - (1 << 63)


def phrases_of(items: list[list[str]]) -> Iterator[tuple[list[str], float]]:
    """The phrases of items with their weights in characters: an item of up to SHINGLE words whole, a longer one as shingles."""
    for x in items:
        runs = max(1, len(x) - SHINGLE + 1)
        for i in range(runs):
            yield x[i : i + SHINGLE], sum(map(len, x)) / runs


def page_evidence(text: str, grown: frozenset[str] = frozenset()) -> tuple[float, float, list[int], list[float]]:
    """density and link share of a page's list material; its phrases' hashes and their weights in characters.

    density: characters of list material among all; link share: those of links among list material. An empty text has 0
    of each and no phrase.
    """
    prose = code = listed = links = 0
    weights: Counter = Counter()
    items: list[list[str]] = []
    for line in _segments(text):
        if not line or not line.strip():
            continue
        size = len(line.strip())
        bare = _bare(line)
        words = _COMPOUND.findall(bare.lower())
        linked = len(line) - len(bare)
        if _prose(words, grown):
            inside = size - min(size, linked)
            prose += inside
            links += size - inside
            listed += size - inside
        elif not linked and line.count(",") < 4 and _CODE.search(line) and "#" not in line[:1]:
            code += size
            continue
        else:
            listed += size
            links += linked
            items += [w for x in _ITEM.split(bare.lower()) if (w := _WORD.findall(x))]
        if linked:
            for m in _LINK.finditer(line):
                x = m.group().lower().split("//")[-1].removeprefix("<a href=").strip("\"'<>/")
                domain, _, path = x.removeprefix("www.").partition("/")
                for p in ([domain], _WORD.findall(path)):
                    if p and p[0]:
                        weights[_key(p)] += len(m.group()) / 2
    for p, n in phrases_of(items):
        weights[_key(p)] += n
    total = prose + code + listed
    return (listed / total if total else 0.0), (min(1.0, links / listed) if listed else 0.0), list(weights), [float(x) for x in weights.values()]


def _host(df: DataFrame, host: str, url: str) -> Column:
    """The host of the url, else the source; a null one is a host of its own."""
    known = [F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))] if url in df.columns else []
    return F.coalesce(*(F.when(x != "", x) for x in known), F.col(host).cast("string"), F.lit(""))


def page_scores(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", url: str = "url") -> DataFrame:
    """One row per page that has list material: key, density, link_share, replicated.

    replicated is the share, by characters, of its phrases that stand on another host as well. Null, empty and pure prose
    texts give no row. A page stored twice under its key is scored twice.

    (phrase, host) pairs are combined before the shuffle that counts hosts. Phrases that hold more than one in ``HEAVY``
    of all rows, fewer than ``HEAVY``, are joined to the pages by broadcast, the others by a second shuffle, in which no
    phrase has more than that share.
    """
    kind = df.schema[key].dataType.simpleString()
    grown = sentence_words(df, text)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            out = [page_evidence(t, grown) if t else (0.0, 0.0, [], []) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), *(pa.array(np.array([x[i] for x in out], "f8")) for i in range(2)),
                pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.list_(pa.float32())),
            ], names=["k", "host", "density", "link_share", "phrases", "weights"])

    source = df.select(F.col(key).alias("k"), F.xxhash64(_host(df, host, url)).alias("host"), F.col(text).alias("t"))
    pages = source.mapInArrow(look, f"k {kind}, host long, density double, link_share double, phrases array<bigint>, weights array<float>").where("density > 0")
    from quillspark.session import checkpointed

    pages = checkpointed(pages.withColumn("row", F.monotonically_increasing_id()))
    each = pages.select("row", "host", F.explode(F.arrays_zip("phrases", "weights")).alias("x")).select("row", "host", F.col("x.phrases").alias("phrase"), F.col("x.weights").alias("weight"))
    # A phrase stands on another host if its hosts' least and greatest hashes differ; both are combined before the shuffle.
    hosts = checkpointed(each.groupBy("phrase").agg(F.min("host").alias("lo"), F.max("host").alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase", (F.col("lo") < F.col("hi")).alias("elsewhere"), "n"))
    heavy_from = (pages.agg(F.sum(F.size("phrases"))).first()[0] or 0) / HEAVY
    heavy = hosts.where(F.col("n") > max(1, heavy_from)).select("phrase", "elsewhere")
    marked = each.join(F.broadcast(heavy), "phrase", "left")
    light = marked.where("elsewhere is null").select("row", "phrase", "weight").hint("merge").join(hosts.where("elsewhere").where(F.col("n") <= max(1, heavy_from)).select("phrase").hint("merge"), "phrase")
    there = marked.where("elsewhere").select("row", "weight").unionAll(light.select("row", "weight")).groupBy("row").agg(F.sum("weight").alias("there"))
    all_of = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    scored = pages.hint("merge").join(there.hint("merge"), "row", "left")
    return scored.select(F.col("k").alias(key), "density", "link_share", F.when(F.size("weights") > 0, F.coalesce("there", F.lit(0.0)) / all_of).otherwise(0.0).alias("replicated"))


def stuffed_pages(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", url: str = "url") -> DataFrame:
    """key of each page most of whose text is keywords, links or tags that stand on other hosts too, once."""
    return page_scores(df, key, text, host, url).where((F.col("density") >= DENSITY) & (F.col("replicated") >= REPLICATED)).select(key).distinct()
