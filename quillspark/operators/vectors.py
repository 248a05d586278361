"""Vector metrics, exact and approximate search, and quantisation, over array columns.

A vector is a column of arrays of numbers. The collection is scanned by Spark; the query, the codebooks and the
centroids, of a size set by parameters, go to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from which codebooks and centroids are fitted, at most.
FIT_ROWS = 20_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; 0 where the lengths differ or a vector is null."""
    a, b = _c(a), _c(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(total, F.lit(0.0))).otherwise(F.lit(0.0))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Within -1..1; 0 for vectors of unequal length, empty, zero, null or not finite ones."""
    a, b = _c(a), _c(b)
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    usable = value.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & ~F.isnan(value)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0)).cast("double")


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - similarity; 1 where there is none."""
    return 1.0 - F.coalesce(cosine_similarity(a, b), F.lit(0.0))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance; the largest double for vectors of unequal length or null ones."""
    a, b = _c(a), _c(b)
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares)).otherwise(F.lit(1.7976931348623157e308))


METRICS = {"cosine": cosine_distance, "l2": l2_distance, "dot": lambda a, b: -dot(a, b)}


def nearest(df: DataFrame, vector: str, query: list[float], k: int, key: str, metric: str = "cosine", where: Column | str | None = None, distance: str = "distance") -> DataFrame:
    """The k rows nearest to the query among those for which where holds, nearest first, with their distance.

    Filters before it ranks; ties go to the smaller key; null vectors are left out; k = 0 gives no rows. Only k rows a
    task are sorted and sent.
    """
    rows = df.where(where) if where is not None else df
    return rows.where(F.col(vector).isNotNull()).withColumn(distance, METRICS[metric](F.col(vector), _literal(query))).orderBy(distance, key).limit(k)


# Scalar quantisation.
def sq8_encode(v: Column | str) -> Column:
    """struct<lo, step, codes>: 255 steps between a vector's own least and greatest number; a constant vector has step 0."""
    v = _c(v)
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    step = (hi - lo) / 255.0
    codes = F.transform(v, lambda x: F.when(step == 0, 0).otherwise(F.round((x.cast("double") - lo) / step)).cast("smallint"))
    return F.struct(lo.alias("lo"), step.alias("step"), codes.alias("codes"))


def sq8_decode(code: Column | str) -> Column:
    c = _c(code)
    return F.transform(c["codes"], lambda x: c["lo"] + c["step"] * x.cast("double"))


def sq8_l2(code: Column | str, query: list[float]) -> Column:
    """Distance of a coded vector and a query in full precision."""
    return F.sqrt(F.aggregate(F.zip_with(sq8_decode(code), _literal(query), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))


def sq8_dot(code: Column | str, query: list[float]) -> Column:
    return F.aggregate(F.zip_with(sq8_decode(code), _literal(query), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def sq8_cosine(code: Column | str, query: list[float]) -> Column:
    """Cosine distance; 1 for a zero vector."""
    size = F.sqrt(F.aggregate(sq8_decode(code), F.lit(0.0), lambda a, x: a + x * x)) * float(np.linalg.norm(query))
    return F.when(size > 0, 1 - sq8_dot(code, query) / size).otherwise(1.0)


# Fitting on a bounded sample.
def sample_vectors(df: DataFrame, key: str, vector: str, rows: int = FIT_ROWS) -> np.ndarray:
    """At most rows vectors, those with the least hashed keys in a fixed share of the hash space."""
    n = df.count()
    share = min(1.0, rows / max(1, n))
    part = df.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))).select(key, vector).limit(rows).toPandas()
    return np.stack(part.sort_values(key)[vector].to_numpy()).astype("f4") if len(part) else np.zeros((0, 0), "f4")


def lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced starting rows; the first of equal centres wins, an empty one stays."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = assign(x, c)
        for j in range(k):
            own = x[at == j]
            if len(own):
                c[j] = own.mean(0)
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _map_vectors(df: DataFrame, vector: str, name: str, kind: str, f) -> DataFrame:
    """df with a column name computed by f(matrix) over Arrow batches; null vectors give null."""

    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = s.notna().to_numpy()
            out = np.full(len(s), None, object)
            if ok.any():
                got = f(np.stack(s[ok].to_numpy()).astype("f4"))
                for i, x in zip(np.flatnonzero(ok), got):
                    out[i] = x
            yield pd.Series(out)

    return df.withColumn(name, apply(F.col(vector)))


class ProductQuantizer:
    """Codes of one byte a subspace; asymmetric distances by table."""

    def __init__(self, sample: np.ndarray, subspaces: int = 8, centres: int = 256, rounds: int = 3) -> None:
        if sample.shape[1] % subspaces:
            raise ValueError("the dimension must be a multiple of the number of subspaces")
        self.books = [lloyd(p, min(256, centres), rounds) for p in np.split(sample, subspaces, axis=1)]

    def encode(self, df: DataFrame, vector: str, name: str = "pq") -> DataFrame:
        books = self.books

        def codes(x: np.ndarray) -> list[bytes]:
            return [r.tobytes() for r in np.stack([assign(p, b) for p, b in zip(np.split(x, len(books), axis=1), books)], axis=1).astype("u1")]

        return _map_vectors(df, vector, name, "binary", codes)

    def decode(self, code: bytes) -> np.ndarray:
        return np.concatenate([b[c] for b, c in zip(self.books, code)])

    def nearest(self, coded: DataFrame, query: list[float], k: int, key: str, name: str = "pq") -> DataFrame:
        """The k codes with the least table distance to the query, with distance."""
        parts = np.split(np.array(query, "f4"), len(self.books))
        tables = [((b - p) ** 2).sum(1) for b, p in zip(self.books, parts)]

        @F.pandas_udf("double")
        def distance(codes: pd.Series) -> pd.Series:
            m = np.frombuffer(b"".join(codes), "u1").reshape(len(codes), -1)
            return pd.Series(np.sqrt(sum(t[m[:, j]] for j, t in enumerate(tables)).astype("f8")))

        return coded.where(F.col(name).isNotNull()).withColumn("distance", distance(F.col(name))).orderBy("distance", key).limit(k)


class BitQuantizer:
    """One or two bits a dimension after a random rotation: sign flips and a Walsh-Hadamard transform, cut to the vectors' own dimensions.

    Two bits are the sign and whether a number is over the middle of the rotated vector's sizes.
    """

    def __init__(self, dim: int, seed: int = 0x1337C0DE, bits: int = 1) -> None:
        if bits not in (1, 2):
            raise ValueError("codes have one or two bits a dimension")
        self.dim, self.bits = dim, bits
        self.size = 1 << max(3, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], self.size).astype("f4")

    def rotate(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size), "f4")
        y[:, : x.shape[1]] = x
        y *= self.signs
        h = 1
        while h < self.size:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), self.size)
            h *= 2
        return y[:, : self.dim] / np.sqrt(self.size)

    def encode(self, df: DataFrame, vector: str, name: str = "bits") -> DataFrame:
        return _map_vectors(df, vector, name, "array<bigint>", lambda x: list(self._words(x)))

    def _words(self, x: np.ndarray) -> np.ndarray:
        y = self.rotate(x)
        planes = [y >= 0] if self.bits == 1 else [y >= 0, np.abs(y) > np.median(np.abs(y), axis=1, keepdims=True)]
        bits = np.concatenate([np.packbits(p, axis=1, bitorder="little") for p in planes], axis=1)
        full = np.zeros((len(x), -(-bits.shape[1] // 8) * 8), "u1")
        full[:, : bits.shape[1]] = bits
        return full.view("i8")

    def hamming(self, name: str, query: list[float]) -> Column:
        """Bits in which a coded vector differs from the query; an estimate of the angle, in the JVM."""
        words = self._words(np.array([query], "f4"))[0]
        return sum((F.bit_count(F.col(name)[i].bitwiseXOR(F.lit(int(w)))) for i, w in enumerate(words)), F.lit(0))


    def asymmetric(self, df: DataFrame, query: list[float], name: str = "bits", out: str = "similarity") -> DataFrame:
        """df with the estimated cosine of coded vectors with a query in full precision."""
        q = self.rotate(np.array([query], "f4"))[0]
        dim, size, two = self.dim, -(-self.dim // 8), self.bits == 2

        @F.pandas_udf("double")
        def cosine(codes: pd.Series) -> pd.Series:
            ok = codes.notna().to_numpy()
            got = np.full(len(codes), np.nan)
            if ok.any():
                raw = np.stack(codes[ok].to_numpy()).astype("i8").view("u1").reshape(int(ok.sum()), -1)
                sign = np.unpackbits(raw[:, :size], axis=1, bitorder="little")[:, :dim] * 2.0 - 1
                # The levels are the mean sizes of the lower and upper half of a normal distribution's numbers.
                level = 1 + np.unpackbits(raw[:, size : 2 * size], axis=1, bitorder="little")[:, :dim] * (1.2731 / 0.3229 - 1) if two else 1.0
                x = sign * level
                got[ok] = x @ q / np.maximum(np.linalg.norm(x, axis=1) * max(np.linalg.norm(q), 1e-30), 1e-30)
            return pd.Series(got)

        return df.withColumn(out, cosine(F.col(name)))


class InvertedFile:
    """Cells around k-means centroids fitted on a bounded sample; a search reads the cells nearest to the query only.

    Written with ``partitionBy('cell')``, the cells are directories, and the filter on them prunes the scan.
    """

    def __init__(self, sample: np.ndarray, cells: int = 16, rounds: int = 8, cosine: bool = True) -> None:
        self.cosine = cosine
        c = lloyd(_unit(sample) if cosine else sample, cells, rounds)
        self.centroids = _unit(c) if cosine else c

    def assign(self, df: DataFrame, vector: str, name: str = "cell") -> DataFrame:
        c, cosine = self.centroids, self.cosine
        return _map_vectors(df, vector, name, "int", lambda x: assign(_unit(x) if cosine else x, c).tolist())

    def probes(self, query: list[float], n: int = 4) -> list[int]:
        q = np.array([query], "f4")
        q = _unit(q) if self.cosine else q
        d = (self.centroids**2).sum(1) - 2 * (self.centroids @ q[0])
        return np.argsort(d, kind="stable")[:n].tolist()

    def nearest(self, indexed: DataFrame, vector: str, query: list[float], k: int, key: str, n_probe: int = 4, name: str = "cell") -> DataFrame:
        return nearest(indexed.where(F.col(name).isin(self.probes(query, n_probe))), vector, query, k, key, "cosine" if self.cosine else "l2")

    def nearest_coded(self, indexed: DataFrame, bits: BitQuantizer, vector: str, query: list[float], k: int, key: str, n_probe: int = 4, rerank: int = 10, name: str = "cell", coded: str = "bits") -> DataFrame:
        """As nearest, but the rows of the probed cells are ranked by their bit codes, and only the best k times rerank by their vectors."""
        best = bits.asymmetric(indexed.where(F.col(name).isin(self.probes(query, n_probe)) & F.col(coded).isNotNull()), query, coded, "_sim").orderBy(F.desc("_sim"), key).limit(k * rerank).drop("_sim")
        return nearest(best, vector, query, k, key, "cosine" if self.cosine else "l2")
