"""Reciprocal rank fusion, and the hybrid of vector and lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators import graph, knn, lexical, quantize

RRF_K = 60


def merge(vector: DataFrame, lexical_hits: DataFrame, k: int = 3, rrf_k: int = RRF_K) -> DataFrame:
    """Both (qid, id, rank) -> qid, id, score, rank. An item scores 1 / (rrf_k + rank) in each list
    that has it; equal scores: vector hits first by rank, then the others by theirs."""
    v = vector.select("qid", "id", F.col("rank").alias("vr"))
    b = lexical_hits.select("qid", "id", F.col("rank").alias("br"))
    part = lambda c: F.coalesce(1 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = v.join(b, ["qid", "id"], "full_outer").withColumn("score", part("vr") + part("br"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vr").asc_nulls_last(), F.col("br").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


#: Fewer chunks than this are searched by their codes, and the breadth of a graph search from there on.
FEW, BREADTH = 10, 50


def routed(queries: DataFrame, chunks: DataFrame, k: int, index: DataFrame | None = None) -> DataFrame:
    """queries (qid, emb), chunks (id, emb) -> qid, id, dist, rank, by cosine: few chunks by their
    quantised vectors, more by the layered graph (index, or one that is built now)."""
    n = chunks.count()
    if n < FEW:
        return quantize.search_batch(queries, chunks, k)
    return graph.search(graph.build(chunks) if index is None else index, queries, k, BREADTH)


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 3, rrf_k: int = RRF_K, near: DataFrame | None = None) -> DataFrame:
    """queries (qid, text, emb), chunks (id, title, text, emb) -> qid, id, score, rank. Either list
    has 4 k hits; the vector one has no distance limit, and is near, if that is given."""
    near = knn.search_batch(queries, chunks, 4 * k) if near is None else near
    words = lexical.score(queries, chunks.select("id", lexical.indexed_text().alias("content")), 4 * k)
    return merge(near, words, k, rrf_k)


def vector_hits(queries: DataFrame, chunks: DataFrame, k: int = 3, max_dist: float = 0.9, near: DataFrame | None = None) -> DataFrame:
    """Of each query's 2 k nearest the first k that are near enough."""
    near = knn.search_batch(queries, chunks, 2 * k) if near is None else near
    return near.where(F.col("dist") <= max_dist).where(F.col("rank") <= k)
