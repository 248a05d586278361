"""Problem 3: the k most similar vectors for every vector, by score-aware quantisation.

Spherical k-means puts every vector in a cell of about ``CELL_ROWS`` and the cells in areas, so both grow in number with
the collection and not in size. Up to ``FLAT_CELLS`` cells are fitted at once on a bounded sample; more are fitted in
tasks, coarse group by coarse group, on a share of the rows, and only their centres are sent to the driver, half a byte
for each vector of the collection. A vector is quantised as in score-aware quantisation: sixteen subspaces of four
dimensions with sixteen centres each, fitted and coded with an anisotropic loss that weighs the residual parallel to the
vector ``ETA`` times as much as the orthogonal one, since only the parallel part shifts large inner products. Each query
looks into the cells whose centres are at most ``MARGIN`` less similar to it than the nearest one, ``PROBES`` at most:
four-bit table scans over the codes give approximate scores (two codes share a byte and a table of 256 sums), the best
``RERANK`` go to exact scores, in single precision.

Every vector is sent once as data and once per area it looks into, with the list of cells. An area with many vectors or
many queries is dealt to a grid of data blocks by query blocks, so a task holds at most about ``BLOCK_ROWS`` of each.
Vectors with exactly the same direction are one entry, so copies can't fill a cell; of each batch's copies only the
k + 1 least ids are sent as data.

The scan covers cells near the query only, so neighbours may be missed; the recall against brute force is measured in
the tests and stated in the README. With no more than ``PROBES`` cells and a margin of 2 the scan covers everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, DIM = 5, 64
#: Rows of the sample for fitting and of those the codebooks are fitted on; vectors a cell; cells fitted at once, and cells at all (over them, cells and rerankings grow); rows a cell in the fitting share.
SAMPLE_ROWS, BOOK_ROWS, CELL_ROWS, FLAT_CELLS, MOST_CELLS, FIT_ROWS = 16_384, 8_192, 500, 2_048, 1 << 18, 40
#: Most cells looked into, the margin of similarity for them, candidates reranked, cells an area, rows a block, coarse groups searched for cells.
PROBES, MARGIN, RERANK, AREA_CELLS, BLOCK_ROWS, GROUPS = 12, 0.1, 64, 24, 40_000, 8
#: Where the cells within the margin hold about fewer vectors than so many times k, further ones are looked into.
ENOUGH = 10
SUBSPACES, CENTRES, ETA, ROUNDS = 16, 16, 4.0, 8


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors x; an empty centre is put on a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        total = np.zeros((k, x.shape[1]), "f8")
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        empty = norm == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        norm[empty] = 1
        c = (total / norm[:, None]).astype("f4")
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int, step: int = 4096) -> np.ndarray:
    """The k centres with the largest inner products, best first."""
    k = min(k, len(c))
    out = np.empty((len(x), k), "i4")
    for a in range(0, len(x), step):
        s = x[a : a + step] @ c.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(k), s.shape)
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a : a + step] = np.take_along_axis(top, order, 1)
    return out


def _losses(x: np.ndarray, books: np.ndarray, m: int, rest: np.ndarray) -> np.ndarray:
    """Anisotropic loss of each row for each centre of subspace m; rest: the parallel residual from the other subspaces."""
    d = DIM // SUBSPACES
    part = x[:, m * d : (m + 1) * d]
    diff = part[:, None, :] - books[m][None]
    parallel = np.einsum("ncd,nd->nc", diff, part) + rest[:, None]
    return np.einsum("ncd,ncd->nc", diff, diff) + (ETA - 1) * parallel**2


def encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (n, SUBSPACES) of unit rows by coordinate descent over the subspaces."""
    d = DIM // SUBSPACES
    codes = np.zeros((len(x), SUBSPACES), "u1")
    parallel = np.zeros((len(x), SUBSPACES), "f4")
    for m in range(SUBSPACES):
        part = x[:, m * d : (m + 1) * d]
        codes[:, m] = ((part[:, None] - books[m][None]) ** 2).sum(2).argmin(1)
        parallel[:, m] = np.einsum("nd,nd->n", part - books[m][codes[:, m]], part)
    for _ in range(sweeps):
        for m in range(SUBSPACES):
            rest = parallel.sum(1) - parallel[:, m]
            codes[:, m] = _losses(x, books, m, rest).argmin(1)
            part = x[:, m * d : (m + 1) * d]
            parallel[:, m] = np.einsum("nd,nd->n", part - books[m][codes[:, m]], part)
    return codes


def fit_books(x: np.ndarray, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Centres (SUBSPACES, CENTRES, d) that lower the anisotropic loss: coding and weighted least squares in turn."""
    rng = np.random.default_rng(seed)
    d = DIM // SUBSPACES
    books = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m * d : (m + 1) * d] for m in range(SUBSPACES)]).astype("f4")
    for _ in range(rounds):
        codes = encode(x, books, 1)
        for m in range(SUBSPACES):
            part = x[:, m * d : (m + 1) * d]
            others = sum(np.einsum("nd,nd->n", x[:, j * d : (j + 1) * d] - books[j][codes[:, j]], x[:, j * d : (j + 1) * d]) for j in range(SUBSPACES) if j != m)
            for c in range(CENTRES):
                own = codes[:, m] == c
                if not own.any():
                    books[m, c] = part[rng.integers(len(part))]
                    continue
                p = part[own]
                target = others[own] + np.einsum("nd,nd->n", p, p)
                left = own.sum() * np.eye(d) + (ETA - 1) * p.T @ p
                books[m, c] = np.linalg.solve(left, p.sum(0) + (ETA - 1) * (p * target[:, None]).sum(0))
    return books


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, (SUBSPACES / 2, n)."""
    return np.ascontiguousarray((codes[:, 0::2] * CENTRES + codes[:, 1::2]).T)


def _tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(n, SUBSPACES / 2, 256) sums of the inner products of each query with two subspaces' centres."""
    d = DIM // SUBSPACES
    each = np.einsum("nmd,mcd->nmc", q.reshape(len(q), SUBSPACES, d), books)
    return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(q), SUBSPACES // 2, CENTRES * CENTRES)


def scan_cell(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, packed: np.ndarray, books: np.ndarray, k: int = K, rerank: int = RERANK, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores), (n, k): each query's best entries of one cell, itself left out; -1 where there are fewer."""
    rows, scores = np.full((len(q), k), -1, "i8"), np.full((len(q), k), -np.inf, "f4")
    many = len(x)
    for a in range(0, len(q), step):
        part = q[a : a + step]
        if many > rerank:
            tables = _tables(part, books).astype("f4")
            about = np.zeros((len(part), many), "f4")
            for m in range(SUBSPACES // 2):
                about += tables[:, m].take(packed[m], axis=1)
            pick = np.argpartition(-about, rerank - 1, axis=1)[:, :rerank]
            exact = np.einsum("nd,nrd->nr", part, x[pick])
        else:
            pick = np.broadcast_to(np.arange(many), (len(part), many))
            exact = part @ x.T
        ids = x_rows[pick]
        exact = np.where(ids == q_rows[a : a + step, None], -np.inf, exact)
        order = np.lexsort((ids, -exact), axis=1)[:, :k]
        n = order.shape[1]
        rows[a : a + step, :n] = np.take_along_axis(ids, order, 1)
        scores[a : a + step, :n] = np.take_along_axis(exact, order, 1)
    rows[~np.isfinite(scores)] = -1
    return rows, scores


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """key and vector of the rows with dim finite numbers, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def _unit(col: pa.Array) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype("f4").reshape(len(col), -1)
    wide = x.astype("f8")
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype("f4")


class Cells:
    """Centres of cells, the area of each, about how many vectors it holds, and where there are many, the coarse group that each belongs to."""

    def __init__(self, centres: np.ndarray, areas: np.ndarray, sizes: np.ndarray, coarse: np.ndarray | None = None, group: np.ndarray | None = None) -> None:
        self.centres, self.areas, self.sizes, self.coarse = centres, areas, sizes, coarse
        self.members = None if group is None else [np.flatnonzero(group == g) for g in range(len(coarse))]

    def best(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, similarities), best first, -1 where there are fewer: of all cells, or of those in the GROUPS nearest coarse groups."""
        if self.members is None:
            top = nearest(x, self.centres, k)
            return top, np.einsum("nd,nkd->nk", x, self.centres[top])
        groups = nearest(x, self.coarse, GROUPS)
        ids, sims = np.full((len(x), groups.shape[1] * k), -1, "i4"), np.full((len(x), groups.shape[1] * k), -2, "f4")
        for g in np.unique(groups):
            own = self.members[g]
            row, at = np.nonzero(groups == g)
            if not len(own):
                continue
            score = x[row] @ self.centres[own].T
            n = min(k, len(own))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            place = at[:, None] * k + np.arange(n)
            ids[row[:, None], place], sims[row[:, None], place] = own[top], np.take_along_axis(score, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def fit_cells(rows: DataFrame, sample: np.ndarray, n: int, cell_rows: int = CELL_ROWS, flat: int | None = None) -> Cells:
    """Cells for n vectors; rows: id, v."""
    flat = flat or FLAT_CELLS
    want = int(min(MOST_CELLS, max(1, n // cell_rows)))
    if want <= flat:
        centres = kmeans(sample, min(want, max(1, len(sample) // 8)))
        sizes = np.bincount(nearest(sample, centres, 1)[:, 0], minlength=len(centres)) * (n / len(sample))
        return Cells(centres, nearest(centres, kmeans(centres, max(1, len(centres) // AREA_CELLS), 10), 1)[:, 0], sizes)
    coarse = kmeans(sample, max(2, min(1024, round(want**0.5))))
    share = min(1.0, FIT_ROWS * want / n)
    part = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    per = want / max(1.0, n * share)
    salts = 16  # a group's rows are dealt to salts, each of which makes its share of the group's cells

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _unit(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x, coarse, 1)[:, 0]), _binary(x)], names=["g", "v"])

    def fit(table: pa.Table) -> pa.Table:
        x = _floats(table.column("v"))
        c = kmeans(x, max(1, round(len(x) * per)))
        return pa.table({"g": pa.array([table.column("g")[0].as_py()] * len(c), pa.int32()), "v": _binary(c), "c": pa.array(np.bincount(nearest(x, c, 1)[:, 0], minlength=len(c)))})

    fitted = part.mapInArrow(place, "g int, v binary").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    sized = fitted.groupBy("g").agg(F.count(F.lit(1)).alias("c"))  # one row a coarse group
    dealt = fitted.join(F.broadcast(sized), "g").withColumn("salt", F.when(F.col("c") > BLOCK_ROWS, F.col("salt")).otherwise(0)).select("g", "v", "salt")
    got = dealt.groupBy("g", "salt").applyInArrow(fit, "g int, v binary, c long").toArrow()
    centres, group = _floats(got.column("v")), got.column("g").to_numpy()
    areas = np.zeros(len(centres), "i4")
    made = 0
    for g in range(len(coarse)):
        own = np.flatnonzero(group == g)
        if len(own):
            areas[own] = made + nearest(centres[own], kmeans(centres[own], max(1, round(len(own) / AREA_CELLS)), 5), 1)[:, 0]
            made = int(areas[own].max()) + 1
    return Cells(centres, areas, got.column("c").to_numpy() / share, coarse, group)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of single precision as binary values."""
    x = np.ascontiguousarray(x, "f4")
    ends = np.arange(len(x) + 1, dtype="i4") * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _floats(col: pa.ChunkedArray) -> np.ndarray:
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    size = len(col[0].as_py()) // 4 if len(col) else DIM
    first = np.frombuffer(col.buffers()[1], "i4")[col.offset] if len(col) else 0
    return np.frombuffer(col.buffers()[2], "f4", len(col) * size, first).reshape(-1, size) if len(col) else np.zeros((0, DIM), "f4")


def nearest_neighbours(df: DataFrame, key: str = "id", vector: str = "embedding", k: int = K, probes: int = PROBES, rerank: int = RERANK, cell_rows: int = CELL_ROWS, margin: float = MARGIN) -> DataFrame:
    """id, neighbour, rank (1 to k), score (cosine): the k most similar other ids of each id with a usable vector.

    A row stored twice under its id is one; where an id has different vectors, each asks and answers, and the best scores
    count. Ids with the same direction are each other's neighbours at 1; ties go to the smaller id. An id has fewer than k
    neighbours only if the cells it looks into have. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    n = df.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(SAMPLE_ROWS).toArrow()
    if not len(picked):
        picked = rows.select("v").limit(SAMPLE_ROWS).toArrow()
    if not len(picked):
        return spark.createDataFrame([], "id long, neighbour long, rank int, score double")
    sample = _unit(picked.column(0).combine_chunks())
    cells = fit_cells(rows, sample, n, cell_rows)
    rerank = max(rerank, k + 1, rerank * (n // cell_rows) // MOST_CELLS)
    model = spark.sparkContext.broadcast((cells, fit_books(sample[:BOOK_ROWS])))  # half a byte for each vector, 64 MB at most

    def looks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, area, home cell or -1, place in best) for each area that a row looks into; the cells it looks into, -1 for none."""
        cells = model.value[0]
        best, sims = cells.best(x, probes)
        size = np.where(best >= 0, cells.sizes[best], 0)
        near = sims >= sims[:, :1] - margin
        best = np.where(near | (np.cumsum(size, 1) - size < ENOUGH * k), best, -1)  # cells that hold few vectors aren't enough
        area = np.where(best >= 0, cells.areas[best], -1)
        row, at = np.nonzero(area >= 0)
        pair = row * (int(cells.areas.max()) + 1) + area[row, at]
        _, first = np.unique(pair, return_index=True)
        row, at = row[first], at[first]
        return row, area[row, at], np.where(at == 0, best[row, 0], -1), best

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                row, area, home, _ = looks(_unit(b.column(1)))
                asked, stored = np.bincount(area), np.bincount(area[home >= 0], minlength=area.max() + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(asked), pa.array(stored)], names=["area", "asked", "stored"])

    # Rows per area, to deal large ones over several tasks: one row an area.
    sizes = rows.mapInArrow(tally, "area long, asked long, stored long").groupBy("area").agg(F.sum("asked").alias("asked"), F.sum("stored").alias("stored")).collect() if n > BLOCK_ROWS else []
    blocks = np.ones((int(cells.areas.max()) + 1, 2), "i8")
    for r in sizes:
        blocks[r.area] = max(1, -(-r.stored // BLOCK_ROWS)), max(1, -(-r.asked // BLOCK_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 4096):
                b = whole.slice(start, 4096)
                ids, x = b.column(0).to_numpy(), _unit(b.column(1))
                row, area, home, best = looks(x)
                # Of copies only the least ids are data.
                stored = np.zeros(len(b), bool)
                _, same = np.unique(np.ascontiguousarray(x).view(f"V{4 * x.shape[1]}").ravel(), return_inverse=True)
                order = np.lexsort((ids, same))
                stored[order[np.arange(len(b)) - np.searchsorted(same[order], same[order]) <= k]] = True
                home = np.where(stored[row], home, -1)
                by_data = (np.abs(x * np.float32(1e4)).astype("i8").sum(1) * 2654435761 >> 8)[row] % blocks[area, 0]
                by_query = (ids.astype("i8") * 2654435761 >> 8)[row] % blocks[area, 1]
                nd, nq = blocks[area, 0], blocks[area, 1]
                times = np.where(home >= 0, nd * nq, nd)
                of = np.repeat(np.arange(len(row)), times)
                j = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                is_home = home[of] >= 0
                d, q = np.where(is_home, j // nq[of], j), np.where(is_home, j % nq[of], by_query[of])
                data, asks = is_home & (d == by_data[of]), q == by_query[of]
                of, d, q, data, asks = (y[data | asks] for y in (of, d, q, data, asks))
                mine = np.where(cells.areas[best[row[of]]] == area[of][:, None], best[row[of]], -1)
                look = np.where(asks[:, None], mine, -1)
                keep = look >= 0
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep.sum(1))].astype("i4")), pa.array(look[keep].astype("i4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[of]]), pa.array(area[of].astype("i4")), pa.array(d.astype("i4")), pa.array(q.astype("i4")), pa.array(np.where(data, home[of], -1).astype("i4")), lists, _binary(x[row[of]])],
                    names=["id", "area", "d", "q", "cell", "look", "v"],
                )

    # Two partitions a block, so that few tasks get several.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * int(blocks.prod(1).sum()))
    placed = rows.mapInArrow(place, "id long, area int, d int, q int, cell int, look array<int>, v binary").repartition(tasks, "area", "d", "q")

    def search(table: pa.Table) -> pa.Table:
        books = model.value[1]
        vec, ids, cell = _floats(table.column("v")), table.column("id").to_numpy(), table.column("cell").to_numpy()
        none = pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], _FOUND)})
        # entries: one per direction, under the least id; members keep the k + 1 least ids, enough for any answer
        data = np.flatnonzero(cell >= 0)
        if not len(data):
            return none
        data = data[np.argsort(ids[data], kind="stable")]
        _, first, entry = np.unique(np.ascontiguousarray(vec[data]).view(f"V{4 * vec.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids[data], entry))
        fresh = np.r_[True, (np.diff(entry[order]) != 0) | (np.diff(ids[data][order]) != 0)]  # an id once per direction
        order = order[fresh]
        place = np.arange(len(order)) - np.searchsorted(entry[order], entry[order])
        order = order[place <= k]
        crowd = np.bincount(entry[order], minlength=len(first))
        members, begins = ids[data][order], np.cumsum(crowd) - crowd
        x, cell_of = vec[data[first]], cell[data[first]]
        packed = _pairs(encode(x, books))
        order = np.argsort(cell_of, kind="stable")
        starts = {c: (a, b) for c, a, b in zip(*_runs(cell_of[order]))}
        look = table.column("look").combine_chunks()
        look = pa.concat_arrays(look.chunks) if isinstance(look, pa.ChunkedArray) else look
        per = look.value_lengths().to_numpy(zero_copy_only=False)
        asker, asked = np.repeat(np.arange(len(ids)), per), look.flatten().to_numpy()
        by = np.argsort(asked, kind="stable")
        got_q, got_n, got_s = [], [], []
        for c, a, b in zip(*_runs(asked[by])) if len(by) else ():
            if c not in starts:
                continue
            q, at = asker[by[a:b]], order[slice(*starts[c])]
            rows, scores = scan_cell(vec[q], np.full(len(q), -2), x[at], at, packed[:, at], books, k + 1, rerank)
            keep = rows >= 0
            got_q.append(np.repeat(q, keep.sum(1)))
            got_n.append(rows[keep])
            got_s.append(scores[keep])
        if not got_q:
            return none
        who, e, s = np.concatenate(got_q), np.concatenate(got_n), np.concatenate(got_s)
        times = crowd[e]
        at = np.repeat(np.arange(len(e)), times)
        nb = members[begins[e][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
        who, s = ids[who][at], s[at]
        other = who != nb
        who, nb, s = who[other], nb[other], s[other]
        order = np.lexsort((-s, nb, who))
        order = order[np.r_[True, (np.diff(who[order]) != 0) | (np.diff(nb[order]) != 0)][: len(order)]]  # a neighbour once
        order = order[np.lexsort((nb[order], -s[order], who[order]))]
        who, nb, s = who[order], nb[order], s[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        who, nb, s = who[top], nb[top], s[top]
        edges = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, "i8")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[edges, len(who)].astype("i4")), pa.StructArray.from_arrays([pa.array(-s), pa.array(nb)], fields=list(_FOUND.value_type)))
        return pa.table({"id": pa.array(who[edges]), "found": lists.cast(_FOUND)})

    found = placed.groupBy("area", "d", "q").applyInArrow(search, "id long, found array<struct<s: float, n: bigint>>")
    best = found.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("x"))  # a few areas' k best an id
    once = F.filter("x", lambda y, i: F.array_position(F.transform("x", lambda z: z.n), y.n) == i + 1)
    return best.select("id", F.posexplode(F.slice(once, 1, k)).alias("p", "y")).select("id", F.col("y.n").alias("neighbour"), (F.col("p") + 1).alias("rank"), (-F.col("y.s").cast("double")).alias("score"))


_FOUND = pa.list_(pa.struct([pa.field("s", pa.float32()), pa.field("n", pa.int64())]))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values, starts and ends of the runs of equal values."""
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[edge], edge, np.r_[edge[1:], len(x)]


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """id_a, id_b: each pair of ids of which one is among the other's neighbours, once; id_a < id_b."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
