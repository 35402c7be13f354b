"""Nearest neighbours: exact, filtered, batched, by several metrics and by several indexes.

Items are rows (id, metadata, category, emb). The index that is asked for is the one that answers:
"bruteforce" is a scan with a bounded heap in each task and then the best of all, "kdtree" a search
of trees, which is exact as well, and every other name a search of layered graphs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.operators import distance

Table = Callable[[np.ndarray, np.ndarray], np.ndarray]
ALGORITHMS = ("bruteforce", "kdtree", "hnsw")
#: Queries of up to so many bytes are sent along with the scan, so that items are not shuffled; more are
#: dealt into blocks. A task measures so many queries at a time.
QUERY_BYTES, QUERY_BLOCK = 16 << 20, 2048
#: Places of a batch's distances: products of matrices differ in the last ones, and ranks must not.
PLACES = 12
#: A filtered search looks at so many times k neighbours before it filters.
OVERSAMPLE = 5


def _checked(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def with_distance(items: DataFrame, query: Sequence[float], metric: str | None = "cosine") -> DataFrame:
    return items.withColumn("dist", distance.metric(metric)(F.col("emb"), distance.vector(query)))


def search(items: DataFrame, query: Sequence[float], k: int = 5, metric: str | None = "cosine", algo: str = "bruteforce", index=None) -> DataFrame:
    """The k nearest items, ties to the smaller id. index is a graph's (operators.graph) or a tree's
    two tables (operators.kdtree) of these items, if there is one: otherwise it is built now."""
    fits = items.where(F.size("emb") == len(query))
    if algo == "bruteforce":
        return with_distance(fits, query, metric).orderBy("dist", "id").limit(_checked(k))
    asked = items.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, emb array<double>")
    found = by_index(asked, fits, k, metric, algo, index).select("id", "dist")
    return items.join(F.broadcast(found), "id").select(*items.columns, "dist").orderBy("dist", "id")  # k rows


def by_index(queries: DataFrame, items: DataFrame, k: int = 5, metric: str | None = "cosine", algo: str = "hnsw", index=None) -> DataFrame:
    """queries (qid, emb), items (id, emb) -> qid, id, dist, rank, by the index of that name."""
    from lodeline.operators import graph, kdtree  # which import this module

    _checked(k)
    if algo == "bruteforce":
        return search_batch(queries, items, k, distance.metric_name(metric))
    if algo == "kdtree":
        return kdtree.search(*(index or kdtree.build(items, metric)), queries, k, metric)
    return graph.search(graph.build(items) if index is None else index, queries, k, metric=metric)


def search_filtered(
    items: DataFrame, query: Sequence[float], k: int = 5, metric: str | None = "cosine", algo: str = "bruteforce", category: str | None = None, push_down: bool = False, index=None
) -> DataFrame:
    """As search, of one category. The filter comes after the max(min(5 k, n), k) nearest, so fewer
    than k may be left; push_down filters first, as scans prefer. Case is ignored, and space around
    the filter; a filter of spaces only filters nothing."""
    if not category:
        return search(items, query, k, metric, algo, index)
    of = _of_category(category)
    if push_down:
        return search(items.where(of), query, k, metric, algo)
    return search(items, query, OVERSAMPLE * _checked(k), metric, algo, index).where(of).orderBy("dist", "id").limit(k)


def _of_category(category: str) -> Column:
    name = category.strip().lower()
    return F.lower("category") == name if name else F.lit(True)


def search_filtered_batch(queries: DataFrame, items: DataFrame, k: int = 5, metric: str = "cosine", category: str = "", push_down: bool = False) -> DataFrame:
    """search_filtered for many queries (qid, emb) at once -> qid, id, dist, rank."""
    of = _of_category(category)
    if push_down:
        return search_batch(queries, items.where(of), k, metric)
    near = search_batch(queries, items, OVERSAMPLE * _checked(k), metric).drop("rank")
    return best(near.join(items.where(of).select("id"), "id", "left_semi"), k)


def _batch(ids: np.ndarray, queries: np.ndarray, k: int, metric: str | Table):
    """A scan that keeps each query's k nearest of every batch of rows of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            emb = b.column("emb")
            fits = np.diff(emb.offsets.to_numpy()) == queries.shape[1] if b.num_rows else np.zeros(0, bool)
            rows = b.filter(pa.array(fits & ~np.asarray(emb.is_null())))
            if not rows.num_rows:
                continue
            emb = rows.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
            row_id = rows.column("id").to_numpy()
            for s in range(0, len(ids), QUERY_BLOCK):
                m = queries[s : s + QUERY_BLOCK]
                d = np.round(metric(m, emb) if callable(metric) else distance.table(m, emb, metric), PLACES) + 0.0
                keep = min(k, d.shape[1])
                edge = np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep]
                q, r = np.nonzero(d <= edge)  # ties at the edge too: ids decide later
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + q]), pa.array(row_id[r]), pa.array(d[q, r])], ["qid", "id", "dist"])

    return run


def _matrices(qid: pa.Array, emb: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries of each length; empty and null ones find nothing."""
    size, flat, ids = np.diff(emb.offsets.to_numpy()), emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64), qid.to_numpy()
    start = np.cumsum(size) - size
    return [(ids[size == n], flat[(start[size == n][:, None] + np.arange(n)).reshape(-1)].reshape(-1, n)) for n in np.unique(size) if n]


def best(found: DataFrame, k: int, by: str = "qid") -> DataFrame:
    w = Window.partitionBy(by).orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def search_batch(queries: DataFrame, items: DataFrame, k: int = 5, metric: str | Table = "cosine", query_bytes: int = QUERY_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """queries (qid, emb), items (id, emb) -> qid, id, dist, rank: the k nearest of a query's length.
    metric is a name or a function of two matrices. Queries of more than query_bytes are dealt into
    blocks that each meet all items."""
    _checked(k)
    schema = "qid long, id long, dist double"
    queries = queries.select(F.col("qid").cast("long"), F.col("emb").cast("array<double>")).where("emb is not null")
    items = items.select(F.col("id").cast("long"), F.col("emb").cast("array<double>"))
    n, cells = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("emb")), F.lit(0))).first()
    if 8 * cells <= query_bytes:
        sent = queries.toArrow().combine_chunks()  # bounded
        each = _matrices(*(c.combine_chunks() for c in sent.columns)) if n else []
        found = [items.mapInArrow(_batch(ids, m, k, metric), schema) for ids, m in each] or [items.sparkSession.createDataFrame([], schema)]
        return best(reduce(DataFrame.unionByName, found), k)
    blocks = -(-n // query_block)
    asking = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    pieces = max(1, items.sparkSession.sparkContext.defaultParallelism)
    asking = asking.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    asked = items.withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            for ids, m in _matrices(left["qid"].combine_chunks(), left["emb"].combine_chunks()):
                out += _batch(ids, m, k, metric)(iter(right.select(["id", "emb"]).combine_chunks().to_batches()))
        return pa.Table.from_batches(out) if out else pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})

    keys = ["block", "piece"]
    return best(asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, schema), k)


def compare_metrics(items: DataFrame, query: Sequence[float], k: int = 5) -> DataFrame:
    """metric, id, metadata, dist, rank: the k nearest by each metric. Distances are rounded to 5
    places before they are ranked; ties go to the smaller id. Empty vectors are left out."""
    asked = items.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, emb array<double>")
    return compare_metrics_batch(asked, items, k).drop("qid")


def compare_metrics_batch(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """compare_metrics for many queries (qid, emb) -> qid, metric, id, metadata, dist, rank."""
    places = lambda name: lambda a, b: np.round(distance.table(a, b, name), 5)
    each = [search_batch(queries, items, k, places(m)).withColumn("metric", F.lit(m)) for m in distance.METRICS]
    found = each[0].unionByName(each[1]).unionByName(each[2])
    return found.join(items.select("id", "metadata"), "id").select("qid", "metric", "id", "metadata", "dist", "rank")


def categories(items: DataFrame) -> DataFrame:
    return items.select("category").distinct().orderBy("category")


def benchmark(items: DataFrame, query: Sequence[float], k: int = 5, metric: str = "cosine", graph_index=None, tree_index=None) -> DataFrame:
    """One row: microseconds of one search by each index, and the number of items. The graph's and
    the trees' indexes are built before, unless they are given, and not timed."""
    from lodeline.operators import graph, kdtree  # which import this module

    fits = items.where(F.size("emb") == len(query))
    indexes = {"hnsw": (graph.build(fits).cache() if graph_index is None else graph_index), "kdtree": tuple(x.cache() for x in kdtree.build(fits, metric)) if tree_index is None else tree_index}
    own = [x for x, given in ((indexes["hnsw"], graph_index), *((t, tree_index) for t in indexes["kdtree"])) if given is None]
    took = {}
    try:
        for x in own:
            x.count()
        for algo in ALGORITHMS:
            start = time.perf_counter()
            search(items, query, k, metric, algo, indexes.get(algo)).select("id", "dist").collect()
            took[algo] = int((time.perf_counter() - start) * 1e6)
    finally:
        for x in own:
            x.unpersist()
    return items.agg(F.count("*").alias("item_count")).select(*[F.lit(took[a]).cast("long").alias(f"{a}_us") for a in ALGORITHMS], "item_count")


def hits(found: DataFrame) -> DataFrame:
    """What a search shows of its results."""
    return found.select("id", "metadata", "category", F.round("dist", 6).alias("dist"))


def parse_vector(c: Column) -> Column:
    """Comma-separated numbers as a vector: blanks are dropped, one bad token empties it all."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    none = F.array().cast("array<double>")
    return F.when(F.exists(numbers, lambda x: x.isNull()), none).otherwise(F.coalesce(numbers, none))
