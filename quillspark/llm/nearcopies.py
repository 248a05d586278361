"""Problem 4: near-copies by the words they share, with adaptive multi-match prefixes.

The words of each record are ordered by how few records hold them. Two records of n and m words at a Jaccard similarity
of t or more share at least o = t / (1 + t) * (n + m) words, so their first l common words stand in prefixes of
n - o + l and m - o + l words. Records are put in classes of size, each ``STEP`` times the one before, and meet once for
each pair of classes that can be similar, with the prefix that this pair needs. A record lengthens its prefix where the
estimated cost says so: the records under each word of its prefix, for each pair of classes, are the candidates that the
word would give it, and where they are over ``HOT``, the word alone makes no candidates but only together with a second
word from the prefix longer by one, then a third, up to ``LEVELS``. Whether a path of words goes on is known alike to all
records that hold it, so no pair is lost.

A path that is still hot after ``LEVELS`` words is dealt to a grid of cells by the records' keys, whose side grows with
its count, so that no task holds more than about ``CELL`` squared of its pairs.

Records that meet under a path are compared by a signature of 256 bits: each word flips one bit, so two records differ in
at least as many words as their signatures do in bits. What is left is compared word by word.

Words that stand in more than one of ``HEAVY`` of all (record, word) rows are fewer than ``HEAVY``; they are the only ones
sent to every task. The counts of all other words reach the records by a join.

Records with the same words are one class, whose least key stands for it; only classes are compared.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpointed

THRESHOLD = 0.8
#: Records under a path of words from which the path is lengthened, most words in a path, records of a path from which it is dealt to cells, and the ratio of size classes.
HOT, LEVELS, CELL, STEP = 300, 4, 4096, 1.1
#: Inverse of the share of all word occurrences from which a word is heavy: there are fewer such words than this.
HEAVY = 20_000
#: Bits of a table of hot paths: sixteen for each, between these powers of two. Over the larger one ``HOT`` is doubled until they fit.
LEAST_BITS, MOST_BITS = 16, 30
_BLOCK, _PAIRS = 100_000, 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    """Distinct maximal runs of letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def word_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per record with words: k, rep (the least key with the same words), h (sorted hashes of the words).

    Where a key has several texts, the one with the least hash counts.
    """
    once = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.col(text).alias("t"))
    least = once.groupBy("k").agg(F.min(F.struct("x", "t")).alias("y"))
    hashed = least.select("k", F.sort_array(F.transform(words_of(F.col("y.t")), lambda x: F.xxhash64(x))).alias("h")).where(F.size("h") > 0)
    marked = checkpointed(hashed.select("k", "h", F.xxhash64("h").alias("d"), F.xxhash64(F.reverse("h"), F.size("h")).alias("e")))
    reps = marked.groupBy("d", "e").agg(F.min("k").alias("rep"))
    return marked.join(reps.hint("merge"), ["d", "e"]).select("k", "rep", "h")


def _mixed(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (path ^ word) * _MULTIPLY
    return x ^ (x >> np.uint64(29))


@functools.cache
def _floor(k: int) -> int:
    """The least size in class k."""
    return math.ceil(STEP**k - 1e-9)


@functools.cache
def meetings(n: int, t: float) -> np.ndarray:
    """Rows (seed, side, spare) for each pair of size classes in which a record of n words can find similar ones.

    side: 0 both in one class, 1 in the smaller, 2 in the larger; spare: n less the words that a pair shares at least.
    """
    k = 0
    while _floor(k + 1) <= n:
        k += 1
    least, out, j = math.ceil(n * t - 1e-9), [], k
    while j > 0 and _floor(j) > least:
        j -= 1
    while _floor(j) * t <= n + 1e-9:
        if _floor(j + 1) > max(least, _floor(j)):  # the class isn't empty
            shared = math.ceil((n + max(_floor(j), least)) * t / (1 + t) - 1e-9)
            if n >= shared:
                out.append((1000 * min(j, k) + abs(j - k) + 1, (j > k) + 2 * (j < k), n - shared))
        j += 1
    return np.array(out, "i8").reshape(-1, 3)


def _signatures(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Four words of 64 bits for each run of hashes; runs aren't empty."""
    out = []
    for quarter in range(4):
        bit = np.where((flat >> 6 & 3) == quarter, np.uint64(1) << (flat & 63).astype("u8"), np.uint64(0))
        out.append(np.bitwise_xor.reduceat(bit, starts).view("i8") if len(starts) else np.zeros(0, "i8"))
    return out


def _ordered(reps: DataFrame, t: float, levels: int, kind: str) -> DataFrame:
    """r, n, first (position of the first word that another record holds), w (the words from there to the longest prefix), s0 to s3 (signature)."""
    each = reps.select("r", F.explode("h").alias("w"))
    held = checkpointed(each.groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    total = held.agg(F.sum("df")).first()[0] or 0
    heavy_from = max(1, total // HEAVY)
    heavy = {r.w: r.df for r in held.where(F.col("df") > heavy_from).collect()}  # fewer than HEAVY rows
    known = np.fromiter(sorted(heavy), "i8", len(heavy))
    counts = np.fromiter((heavy[x] for x in known.tolist()), "i8", len(heavy))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each record that aren't heavy."""
        for b in batches:
            flat, size = b.column(1).flatten().to_numpy(), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            light = ~_is_in(flat, known)
            doc = np.repeat(np.arange(len(b)), size)[light]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(flat[light])], names=["r", "w"])

    light = reps.select("r", "h").mapInArrow(rare, f"r {kind}, w long").join(held.where((F.col("df") > 1) & (F.col("df") <= heavy_from)).hint("merge"), "w")
    light = light.groupBy("r").agg(F.collect_list("w").alias("lw"), F.collect_list("df").alias("ldf"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype("i8")
            flat = b.column(1).flatten().to_numpy()
            starts = np.r_[0, np.cumsum(size)[:-1]]
            frequent = _is_in(flat, known)
            doc = np.repeat(np.arange(len(b)), size)[frequent]
            word = flat[frequent]
            often = counts[np.searchsorted(known, word)] if len(known) else word
            few = np.nan_to_num(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)).astype("i8")
            doc = np.r_[doc, np.repeat(np.arange(len(b)), few)]
            word, often = np.r_[word, b.column(2).flatten().to_numpy()].astype("i8"), np.r_[often, b.column(3).flatten().to_numpy()].astype("i8")
            at = np.lexsort((word, often, doc))
            doc, word = doc[at], word[at]
            shared = np.bincount(doc, minlength=len(b))
            first = size - shared
            keep = np.maximum(size - np.ceil(size * t - 1e-9).astype("i8") + levels - first, 0)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(shared) - shared, shared)
            word = word[place < keep[doc]]
            ends = np.cumsum(np.minimum(keep, shared))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("i4")), pa.array(word))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(first), lists, *map(pa.array, _signatures(flat, starts))], names=["r", "n", "first", "w", "s0", "s1", "s2", "s3"])

    return reps.hint("merge").join(light.hint("merge"), "r", "left").select("r", "h", "lw", "ldf").mapInArrow(order, f"r {kind}, n long, first long, w array<bigint>, s0 long, s1 long, s2 long, s3 long")


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class _Table:
    """A set of paths by the first bits of their hashes: a path that shares a slot with one of them is in it too."""

    def __init__(self, bits: int, packed: bytes) -> None:
        self.bits, self.packed = bits, packed

    def has(self, path: np.ndarray) -> np.ndarray:
        slot = path >> np.uint64(64 - self.bits)
        byte = np.frombuffer(self.packed, "u1")[(slot >> np.uint64(3)).astype("i8")]
        return (byte >> (slot & np.uint64(7)).astype("u1") & 1).astype(bool)


def _table(paths: DataFrame, over: int) -> tuple[_Table | None, int]:
    """The paths (path, c) of more than over records, and the bound used: over, doubled until the table holds them. The bits are set in tasks."""
    n = paths.where(F.col("c") > over).count()
    while n > 1 << (MOST_BITS - 4):
        over *= 2
        n = paths.where(F.col("c") > over).count()
    if not n:
        return None, over
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length()))
    slot = (F.shiftrightunsigned("path", 64 - bits)).alias("slot")
    pages = paths.where(F.col("c") > over).select(slot).distinct().groupBy(F.shiftrightunsigned("slot", 13).alias("page")).agg(F.collect_list(F.col("slot").bitwiseAND(8191).cast("int")).alias("x"))  # at most 8192 slots a page

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                page = np.zeros(8192, "u1")
                page[x] = 1
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["page", "x"])

    packed = bytearray(max(1, (1 << bits) // 8))
    for r in pages.mapInArrow(pack, "page long, x binary").collect():  # 1 KB each, no more than the table
        packed[r.page * 1024 : (r.page + 1) * 1024] = r.x
    return _Table(bits, bytes(packed)), over


def _paths(docs: DataFrame, hot: list[_Table], wide: list[_Table], t: float, only_last: bool, kind: str) -> DataFrame:
    """path, r, meta, s0 to s3: the paths of words of each record, for each pair of size classes.

    hot[i] has the paths of i + 1 words that go on; wide[i] the last ones dealt to 4 ** (i + 1) blocks. only_last: those
    of len(hot) + 1 words, path only, to be counted; else all at which a record stops. meta holds n, pos, level and side.
    """
    kind = docs.schema["r"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                yield from step(whole.slice(at, 2000))

    def step(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, first = b.column(1).to_numpy(), b.column(2).to_numpy()
        many = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False).astype("i8")
        words = b.column(3).flatten().to_numpy().view("u8")
        offset = np.cumsum(many) - many
        meets = [meetings(x, t) for x in n.tolist()]
        times = np.array([len(m) for m in meets], "i8")
        if not times.sum():
            return
        seed, side, spare = np.concatenate(meets).T
        doc, path, start = np.repeat(np.arange(len(b)), times), _mixed(seed.astype("u8"), np.zeros(len(seed), "u8")), np.zeros(len(seed), "i8")
        out = []
        for level in range(len(hot) + 1):
            upto = np.minimum(many[doc], spare + level + 1 - first[doc])
            count = np.maximum(upto - start, 0)
            of = np.repeat(np.arange(len(doc)), count)
            i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
            doc, side, spare = doc[of], side[of], spare[of]
            path = _mixed(path[of], words[offset[doc] + i])
            on = hot[level].has(path) if level < len(hot) else np.zeros(len(path), bool)
            if level == len(hot) or not only_last:
                out.append((path[~on], doc[~on], n[doc[~on]] << 32 | (first[doc] + i + 1)[~on] << 8 | (level + 1) << 4 | side[~on]))
            doc, side, spare, path, start = doc[on], side[on], spare[on], path[on], i[on] + 1
        path, doc, meta = (np.concatenate(x) for x in zip(*out))
        if only_last:
            yield pa.RecordBatch.from_arrays([pa.array(path.view("i8"))], names=["path"])
            return
        path, doc, meta = _dealt(path, doc, meta, wide, b.column(4).to_numpy())
        for a in range(0, len(path), _BLOCK):
            rows = pa.array(doc[a : a + _BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(path[a : a + _BLOCK].view("i8")), b.column(0).take(rows), pa.array(meta[a : a + _BLOCK]), *(b.column(i).take(rows) for i in range(4, 8))], names=["path", "r", "meta", "s0", "s1", "s2", "s3"])

    return docs.mapInArrow(walk, "path long" if only_last else f"path long, r {kind}, meta long, s0 long, s1 long, s2 long, s3 long")


def _dealt(path: np.ndarray, doc: np.ndarray, meta: np.ndarray, wide: list[_Table], by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of wide paths, once for each cell of the path's grid that their records stand in. by: a number of each record that deals it to a block."""
    blocks = np.ones(len(path), "i8")
    for i, table in enumerate(wide):
        blocks[table.has(path)] = 4 ** (i + 1)
    if not (blocks > 1).any():
        return path, doc, meta
    of = np.repeat(np.arange(len(path)), blocks)
    other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    blocks, side = blocks[of], meta[of] & 3
    own = (_mixed(by[doc[of]].view("u8"), np.uint64(5)) >> np.uint64(40)).astype("i8") % blocks
    row, column = np.where(side == 2, other, own), np.where(side == 2, own, other)
    row, column = np.where(side == 0, np.minimum(own, other), row), np.where(side == 0, np.maximum(own, other), column)
    side = np.where((side == 0) & (own != other), np.where(own < other, 1, 2), side)
    cell = np.where(blocks > 1, row * blocks + column + 1, 0).astype("u8")
    return np.where(cell > 0, _mixed(path[of], cell), path[of]), doc[of], meta[of] & ~3 | side


def _meet(paths: DataFrame, t: float, kind: str) -> DataFrame:
    """a, b: the records that meet under a path and that sizes, places and signatures allow to be similar; a pair may come more than once.

    Rows come sorted by path; a path's rows, few after it was lengthened and dealt, are held until all are there.
    """

    def pairs(path: np.ndarray, meta: np.ndarray, signs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        side = meta & 3
        edge = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (side[1:] != side[:-1])])
        run = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(path)]))
        end = np.r_[edge[1:], len(path)]
        follows = np.r_[path[edge[1:]] == path[edge[:-1]], False] & (side[edge] == 1) & np.r_[side[edge[1:]] == 2, False]
        lo = np.where(side == 0, np.arange(len(path)) + 1, end[run])
        hi = np.where(side == 0, end[run], np.where(follows[run], np.r_[end[1:], len(path)][run], end[run]))
        count = hi - lo
        n, pos, level = meta >> 32, meta >> 8 & 0xFFFFFF, meta >> 4 & 15
        left, right, total = [], [], np.cumsum(count)
        at = 0
        while at < len(path):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            a = np.repeat(np.arange(at, upto), count[at:upto])
            b = np.arange(len(a)) - np.repeat(total[at:upto] - count[at:upto] - (total[at - 1] if at else 0), count[at:upto]) + lo[a]
            na, nb = n[a], n[b]
            need = np.ceil((na + nb) * (t / (1 + t)) - 1e-9).astype("i8")
            ok = (np.minimum(na, nb) >= np.maximum(na, nb) * t - 1e-9) & (level[a] + np.minimum(na - pos[a], nb - pos[b]) >= need)
            a, b, most = a[ok], b[ok], (na + nb - 2 * need)[ok]
            differ = sum(np.bitwise_count(s[a] ^ s[b]).astype("i8") for s in signs) if len(a) else most
            left.append(a[differ <= most])
            right.append(b[differ <= most])
            at = upto
        return np.concatenate(left), np.concatenate(right)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            a, b = pairs(table.column(0).to_numpy(), table.column(2).to_numpy(), [table.column(i).to_numpy().view("u8") for i in range(3, 7)])
            keys = table.column(1).combine_chunks()
            found = pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b))}).group_by(["a", "b"]).aggregate([]).combine_chunks()
            return found.to_batches()[0] if len(found) else None

        rows = 0
        for x in batches:
            held.append(x)
            rows += len(x)
            if rows >= _BLOCK:
                table = pa.Table.from_batches(held)
                path = table.column(0).to_numpy()
                cut = int(np.searchsorted(path, path[-1]))
                if cut:
                    out = emit(table.slice(0, cut))
                    if out is not None:
                        yield out
                    held = table.slice(cut).to_batches()
                    rows = len(table) - cut
        if held:
            out = emit(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return paths.repartition("path").sortWithinPartitions("path", F.col("meta").bitwiseAND(3)).mapInArrow(meet, f"a {kind}, b {kind}")


def similar_classes(reps: DataFrame, t: float = THRESHOLD, hot_from: int = HOT, levels: int = LEVELS, cell: int = CELL) -> DataFrame:
    """a, b, common, either: the pairs of classes (r, h) whose Jaccard similarity is t or more; a < b. t must be over 0."""
    if not 0 < t <= 1:
        raise ValueError("the similarity must be within 0 (excluded) and 1")
    kind = reps.schema["r"].dataType.simpleString()
    docs = checkpointed(_ordered(reps, t, levels, kind))
    hot: list[_Table] = []
    wide: list[_Table] = []
    for level in range(levels):
        counts = checkpointed(_paths(docs, hot, [], t, True, kind).groupBy("path").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > min(hot_from, cell)))
        if level < levels - 1:
            table, _ = _table(counts, hot_from)
            if table is None:
                break
            hot.append(table)
            continue
        over = cell
        while (table := _table(counts, over)[0]) is not None:
            wide.append(table)
            over *= 4
    pairs = _meet(_paths(docs, hot, wide, t, False, kind), t, kind).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = reps.select(F.col("r").alias("a"), F.col("h").alias("ha"))
    right = reps.select(F.col("r").alias("b"), F.col("h").alias("hb"))
    both = pairs.hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b").select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("common"), (F.size("ha") + F.size("hb")).alias("n"))
    either = F.col("n") - F.col("common")
    return both.where(F.col("common") >= either * t - 1e-9).select("a", "b", "common", either.alias("either"))


def near_copies(df: DataFrame, key: str, text: str, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership: k, rep; links: a, b, common, either) of the records of df.

    A record stored twice under its key is one. Records without a word, null ones too, are in no class.
    """
    classes = checkpointed(word_classes(df, key, text))
    reps = classes.where("k = rep").select(F.col("rep").alias("r"), "h")
    return classes.select("k", "rep"), similar_classes(reps, t)


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """a, b: the pairs of records within a class and between linked classes; a < b. As many as there are: `copy_groups` names classes instead."""
    x, y = (members.select(F.col("k").alias(k), F.col("rep").alias(r)).hint("merge") for k, r in (("x", "rx"), ("y", "ry")))
    within = x.join(y, F.col("rx") == F.col("ry")).where("x < y").select("x", "y")
    across = links.select(F.col("a").alias("rx"), F.col("b").alias("ry")).hint("merge").join(x, "rx").hint("merge").join(y, "ry").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def copy_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: k, class_id, links (how many other classes its class is linked to), group_id.

    group_id is the least key among all records that links join to the record, directly or over others.
    """
    from quillspark.graph.algorithms import components

    links = checkpointed(links.select("a", "b"))
    ends = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    groups = components(members.select(F.col("rep").alias("id")), links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("rep"), F.col("component").alias("group_id"))
    return members.hint("merge").join(ends.hint("merge"), "rep", "left").hint("merge").join(groups.hint("merge"), "rep").select("k", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), "group_id")
