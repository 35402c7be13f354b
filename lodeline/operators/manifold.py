"""Three principal axes by seeded power iteration, and statistics of categories in that space.

The scan reduces to a Gram matrix of dimensions x dimensions, summed over partitions; iterating on
it is the same as iterating on the centred rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, ROUNDS, STILL, NOTHING = 42, 120, 1e-12, 1e-10


def _sums(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and Gram matrix of the vectors: one row from each task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("emb").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            n += len(x)
            total, gram = (x.sum(0), x.T @ x) if total is None else (total + x.sum(0), gram + x.T @ x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([gram.reshape(-1).tolist()])], ["n", "total", "gram"])

    parts = rows.select("emb").mapInArrow(run, "n long, total array<double>, gram array<double>")
    # element by element, so that the driver gets one Gram matrix however many tasks there are
    flat = parts.select("n", F.posexplode(F.concat("total", "gram")).alias("at", "x"))
    got = flat.groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("at").collect()
    if not got:
        return 0, np.zeros(0), np.zeros((0, 0))
    x = np.array([r["x"] for r in got])
    d = int((np.sqrt(4 * len(x) + 1) - 1) / 2)
    return got[0]["n"], x[:d], x[d:].reshape(d, d)


def axes(n: int, total: np.ndarray, gram: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Three axes, one below the other; each starts at random and is kept off those before."""
    d = len(total)
    scatter = gram - np.outer(total, total) / n
    draw, found = random.Random(seed), []

    def off(v: np.ndarray) -> np.ndarray:
        for axis in found:
            v = v - (v @ axis) * axis
        return v

    for _ in range(3):
        v = off(np.array([draw.uniform(-1.0, 1.0) for _ in range(d)]))
        if np.linalg.norm(v) < NOTHING:
            found.append(np.eye(d)[0])
            continue
        v = v / np.linalg.norm(v)
        for _ in range(ROUNDS):
            w = off(scatter @ v)
            size = np.linalg.norm(w)
            if size < NOTHING:
                break
            w, v = w / size, v
            moved, v = ((w - v) ** 2).sum(), w
            if moved < STILL:
                break
        found.append(v)
    return np.stack(found)


def pca_3d(items: DataFrame) -> DataFrame:
    """items with x, y, z, rounded to 4 places. Of fewer than three items the first three
    components are taken; a missing third one is the item's place."""
    rows = items.where(F.size("emb") > 0)
    n, total, gram = _sums(rows)
    if n < 3:
        first = lambda j, other: F.round(F.coalesce(F.get(F.col("emb").cast("array<double>"), F.lit(j)), other), 4)
        few = [r["id"] for r in rows.select("id").orderBy("id").limit(3).collect()]
        place = F.coalesce(*[F.when(F.col("id") == i, F.lit(float(k))) for k, i in enumerate(few)], F.lit(0.0))
        return rows.withColumns({"x": first(0, F.lit(0.0)), "y": first(1, F.lit(0.0)), "z": first(2, place)})
    to = axes(n, total, gram)
    mean = total / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("emb")
            x = e.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(mean)))
            p = np.round((x - mean) @ to.T, 4)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 2])], [*b.schema.names, "x", "y", "z"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, x double, y double, z double")


def clusters(points: DataFrame) -> DataFrame:
    """points (category, x, y, z) -> category, cx, cy, cz, radius, variance, count: centroid,
    largest distance from it and mean squared distance; rounded to 4 places at the end."""
    means = points.groupBy("category").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    means = means.withColumnRenamed("category", "of")
    rows = points.join(means, F.col("category").eqNullSafe(F.col("of")))
    square = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2
    r = lambda c: F.round(c, 4)
    return rows.groupBy("category", "mx", "my", "mz").agg(F.max(square).alias("most"), F.avg(square).alias("mean"), F.count("*").alias("count")).select(
        "category", r(F.col("mx")).alias("cx"), r(F.col("my")).alias("cy"), r(F.col("mz")).alias("cz"), r(F.sqrt("most")).alias("radius"), r(F.col("mean")).alias("variance"), "count"
    )
