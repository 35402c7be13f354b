"""Scalar quantisation to 8 bits: one scale and one zero point for a whole collection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.operators import distance, knn

FLAT = 1e-9


def parameters(items: DataFrame) -> DataFrame:
    """One row: lowest, scale, flat (all values are alike). An empty collection has scale 1, lowest 0.
    Arithmetic is in single precision, as the codes'."""
    low, high = F.min(F.array_min("emb")).cast("float"), F.max(F.array_max("emb")).cast("float")
    ends = items.where(F.size("emb") > 0).agg(low.alias("low"), high.alias("high"))
    width = (F.col("high") - F.col("low")).cast("float")
    flat = F.coalesce(width < FLAT, F.lit(True))
    return ends.select(
        F.coalesce("low", F.lit(0.0).cast("float")).alias("lowest"),
        F.when(flat, F.lit(1.0)).otherwise(width / F.lit(255.0)).cast("float").alias("scale"),
        flat.alias("flat"),
    )


def encode(items: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """items with code, lowest and scale: rounded half to even, clipped to a byte; 0 where flat."""
    p = F.broadcast(parameters(items) if params is None else params)  # one row

    def code(x: Column) -> Column:
        # single precision at each step
        steps = ((x.cast("float") - F.col("lowest")).cast("float") / F.col("scale")).cast("float")
        return F.least(F.greatest(F.rint(steps.cast("double")) - 128, F.lit(-128.0)), F.lit(127.0)).cast("tinyint")

    coded = F.when(F.col("flat"), F.transform("emb", lambda x: F.lit(0).cast("tinyint"))).otherwise(F.transform("emb", code))
    return items.crossJoin(p).withColumn("code", coded).drop("flat")


def decode(codes: Column, scale: Column, lowest: Column) -> Column:
    """(code + 128) * scale + lowest; codes of a flat collection so come back 128 too high."""
    return F.transform(codes, lambda c: (c.cast("double") + 128) * scale.cast("double") + lowest.cast("double"))


def search(items: DataFrame, query: Sequence[float], k: int = 5) -> DataFrame:
    """The k nearest decoded vectors, always by cosine, with 1e-9 added to each norm."""
    rows = encode(items.where(F.size("emb") == len(query)))
    rows = rows.withColumn("decoded", decode(F.col("code"), F.col("scale"), F.col("lowest")))
    q = distance.vector(query)
    dist = 1 - distance.dot(F.col("decoded"), q) / ((distance.norm(F.col("decoded")) + 1e-9) * (distance.norm(q) + 1e-9))
    return rows.withColumn("dist", dist).drop("decoded", "scale", "lowest", "code").orderBy("dist", "id").limit(k)


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine distances with 1e-9 added to each norm."""
    nq, nr = np.sqrt((queries * queries).sum(1)) + 1e-9, np.sqrt((rows * rows).sum(1)) + 1e-9
    return 1 - queries @ rows.T / (nq[:, None] * nr[None, :])


def search_batch(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """search for many queries (qid, emb) at once -> qid, id, dist, rank."""
    rows = encode(items.where(F.size("emb") > 0))
    return knn.search_batch(queries, rows.select("id", decode(F.col("code"), F.col("scale"), F.col("lowest")).alias("emb")), k, cosine)


def stats(items: DataFrame) -> DataFrame:
    """One row: bytes as floats and as codes, what is saved, ratio, and the parameters (null if empty)."""
    sizes = items.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size("emb")), F.lit(0)).alias("dims"))
    cells = F.col("count") * F.col("dims")
    return sizes.crossJoin(F.broadcast(parameters(items))).select(
        F.col("count"),
        F.col("dims").cast("long").alias("dims"),
        (cells * 4).cast("long").alias("float32_bytes"),
        cells.cast("long").alias("int8_bytes"),
        (cells * 3).cast("long").alias("saved_bytes"),
        F.lit(4.0).alias("compression_ratio"),
        F.when(F.col("count") > 0, F.round(F.col("scale").cast("double"), 8)).alias("scale"),
        F.when(F.col("count") > 0, F.round(F.col("lowest").cast("double"), 8)).alias("zero_point"),
    )
