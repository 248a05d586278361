"""Vector and text search over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import retrieval, vectors
from quillspark.plans.registry import Registry, read

add = Registry()
QUERIES, SQL = add.queries, add.sql

#: The query vector: a wave of as many numbers as the table's vectors have.
def _wave(spark, sf_dir) -> list[float]:
    dim = len(read(spark, sf_dir, "embeddings").select("embedding").first()[0])
    return [((i * 37) % 19 - 9) / 10 for i in range(dim)]


_Q = "(SELECT list(((i * 37) % 19 - 9) / 10.0::DOUBLE ORDER BY i) FROM range((SELECT len(embedding) FROM embeddings LIMIT 1)) r(i))"


@add(f"SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 4) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    return vectors.nearest(read(spark, sf_dir, "embeddings"), "embedding", _wave(spark, sf_dir), 10, "vec_id").select("vec_id", "label", F.round("distance", 4).alias("distance"))


@add(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), 4) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 10")
def knn_l2(spark, sf_dir):
    return vectors.nearest(read(spark, sf_dir, "embeddings"), "embedding", _wave(spark, sf_dir), 10, "vec_id", "l2").select("vec_id", F.round("distance", 4).alias("distance"))


@add(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 4) AS distance FROM embeddings WHERE label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), vec_id LIMIT 5")
def knn_filtered(spark, sf_dir):
    return vectors.nearest(read(spark, sf_dir, "embeddings"), "embedding", _wave(spark, sf_dir), 5, "vec_id", where="label = 3").select("vec_id", F.round("distance", 4).alias("distance"))


@add(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[]), 4) AS ip FROM embeddings")
def vector_dot(spark, sf_dir):
    q = F.array(*(F.lit(x) for x in _wave(spark, sf_dir)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot("embedding", q), 4).alias("ip"))


@add("""
    SELECT vec_id, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: abs(x - (lo + step * round((x - lo) / step)))), 'max'), 5) AS worst
    FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) / 255 AS step FROM embeddings)""")
def sq8_roundtrip(spark, sf_dir):
    coded = read(spark, sf_dir, "embeddings").withColumn("c", vectors.sq8_encode("embedding"))
    off = F.array_max(F.zip_with("embedding", vectors.sq8_decode("c"), lambda x, y: F.abs(x.cast("double") - y)))
    return coded.select("vec_id", F.round(off, 5).alias("worst"))


@add()
def pq_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    pq = vectors.ProductQuantizer(vectors.sample_vectors(e, "vec_id", "embedding"))
    return pq.nearest(pq.encode(e, "embedding"), _wave(spark, sf_dir), 10, "vec_id").select("vec_id", F.round("distance", 4).alias("distance"))


@add()
def rabitq_rank(spark, sf_dir):
    e, q = read(spark, sf_dir, "embeddings"), _wave(spark, sf_dir)
    bits = vectors.BitQuantizer(len(q))
    return bits.encode(e, "embedding").select("vec_id", bits.hamming("bits", q).alias("hamming")).orderBy("hamming", "vec_id").limit(20)


@add()
def ivf_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    index = vectors.InvertedFile(vectors.sample_vectors(e, "vec_id", "embedding"))
    return index.nearest(index.assign(e, "embedding"), "embedding", _wave(spark, sf_dir), 10, "vec_id", 8).select("vec_id", F.round("distance", 4).alias("distance"))


_BM25 = """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+'), lambda t: strlen(t) > 1) AS t FROM documents),
    n AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM d),
    q AS (SELECT unnest(['vector', 'index', 'pump', 'clockwise']) AS term),
    tf AS (SELECT doc_id, len(t) AS dl, q.term, len(list_filter(t, lambda x: x = q.term)) AS tf FROM d, q),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
    s AS (SELECT doc_id, sum(greatest(0.1, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY doc_id)"""
_BM25 = _BM25.replace("\\\\", "\\")


@add(_BM25 + " SELECT doc_id, round(score, 4) AS score, round(score / (SELECT max(score) FROM s), 4) AS norm FROM s ORDER BY s.score DESC, doc_id LIMIT 15")
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", "Vector index: pump, clockwise", 15)
    return found.select("doc_id", F.round("score", 4).alias("score"), F.round("norm", 4).alias("norm"))


@add(_BM25 + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s ORDER BY score DESC, doc_id LIMIT 50),
    l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)
    SELECT doc_id, round(sum(w / (60 + r)), 6) AS score FROM (SELECT doc_id, r, 1.0 AS w FROM a UNION ALL SELECT doc_id, r, 0.5 FROM l) GROUP BY doc_id""")
def rrf_fusion(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    words = retrieval.bm25(docs, "doc_id", "text", "vector index pump clockwise", 50).select("doc_id", "score")
    long = docs.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "n_chars")
    return retrieval.fuse([(words, "score", 1.0), (long, "n_chars", 0.5)], "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@add("SELECT doc_id, 1.0::DOUBLE AS length FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')".replace("\\\\", "\\"))
def embed_documents(spark, sf_dir):
    e = retrieval.embed(read(spark, sf_dir, "documents").where(F.col("text").rlike(r"[\p{L}\p{N}]")), "text")
    return e.select("doc_id", F.round(vectors.norm("embedding"), 4).alias("length"))
