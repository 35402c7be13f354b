"""What both vector searches share: rows that take part, and blocks of queries against blocks of rows.

Rows lie in cells, and a query asks some of them. A cell's rows are cut into blocks, and so are the
queries that ask it; a block of queries meets a block of rows in one cogroup. A row goes only to as
many tasks as there are blocks of queries that ask its cell, and no task holds more than a block of
either, however many queries or equal vectors there are. Each task returns the best k of its block,
and a window keeps the best of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    v = vector.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(a), -1) if len(a) else np.zeros((0, 0), dtype)


def lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The other way round."""
    offsets = np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), kind))


def asked_blocks(asking: DataFrame, rows: DataFrame, sizes: dict[tuple[int, int], int], query_block: int, row_block: int):
    """asking, rows: (size, cell, row, ...), sizes: rows of each (size, cell) -> their cogroup by block
    of queries and block of rows. The counts of queries and of rows, one number a length and cell,
    go to the driver and into the plan."""
    asks = {(r["size"], r["cell"]): r["n"] for r in asking.groupBy("size", "cell").agg(F.count("*").alias("n")).collect()}
    both = asking.sparkSession.createDataFrame([(s, c, -(-sizes[s, c] // row_block), -(-n // query_block)) for (s, c), n in asks.items() if (s, c) in sizes], "size int, cell int, salts int, blocks int")
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # rows are dealt by a hash of the row, so equal vectors or ids spread out; cells that nobody asks go
    asking = asking.join(F.broadcast(both), ["size", "cell"]).withColumn("qb", deal("blocks", 1)).withColumn("salt", every("salts"))
    rows = rows.join(F.broadcast(both), ["size", "cell"]).withColumn("salt", deal("salts", 2)).withColumn("qb", every("blocks"))
    keys = ["size", "cell", "salt", "qb"]
    return asking.drop("salts", "blocks").groupBy(*keys).cogroup(rows.drop("salts", "blocks").groupBy(*keys))


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """found (query_row, query_id, vec_id, score) -> each query's best k, ranked from 1."""
    w = Window.partitionBy("query_row").orderBy(order, F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def smallest(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to the smaller id; sorted. All places tied with the
    k-th are looked at."""
    if len(score) > k:
        edge = np.partition(score, k - 1)[k - 1]
        at = np.flatnonzero(score <= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], score[at]))][:k]
