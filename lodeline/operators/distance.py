"""Distances between array columns, in double precision, and the same over matrices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
TINY = 1e-9
METRICS = ("cosine", "euclidean", "manhattan")


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def _fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    both = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cos, not clamped; 1 if a norm is below TINY. Pass norms that are known already."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na < TINY) | (nb < TINY), F.lit(1.0)).otherwise(1 - dot(a, b) / (na * nb))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def _clamped(a: Column, b: Column) -> tuple[Column, Column]:
    na, nb = norm(a), norm(b)
    bad = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b)) | (na == 0) | (nb == 0)
    return F.coalesce(bad, F.lit(True)), F.least(F.greatest(dot(a, b) / (na * nb), F.lit(-1.0)), F.lit(1.0))


def clamped_distance(a: Column, b: Column) -> Column:
    """Cosine distance of sentence vectors: 1 for empty, unlike long or zero ones."""
    bad, sim = _clamped(a, b)
    return F.when(bad, F.lit(1.0)).otherwise(1 - sim)


def clamped_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity of sentence vectors: 0 for empty, unlike long or zero ones."""
    bad, sim = _clamped(a, b)
    return F.when(bad, F.lit(0.0)).otherwise(sim)


def metric_name(name: str | None) -> str:
    """Upper and lower case are alike; none is cosine; every unknown name is Euclidean."""
    low = (name or "cosine").lower()
    return low if low in METRICS else "euclidean"


def metric(name: str | None) -> Callable[[Column, Column], Column]:
    return {"cosine": cosine, "euclidean": euclidean, "manhattan": manhattan}[metric_name(name)]


def table(queries: np.ndarray, rows: np.ndarray, name: str) -> np.ndarray:
    """Distances of all queries (down) to all rows (across)."""
    name = metric_name(name)
    if name == "manhattan":
        return np.stack([np.abs(rows - q).sum(1) for q in queries]) if len(queries) else np.zeros((0, len(rows)))
    if name == "euclidean":
        return np.stack([np.sqrt(((rows - q) ** 2).sum(1)) for q in queries]) if len(queries) else np.zeros((0, len(rows)))
    nq, nr = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    scale = nq[:, None] * nr[None, :]
    zero = (nq[:, None] < TINY) | (nr[None, :] < TINY)
    return np.where(zero, 1.0, 1 - queries @ rows.T / np.where(zero, 1.0, scale))
