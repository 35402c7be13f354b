"""Trees that cut space by one dimension after the other: build, insert, rebuild and exact search.

A tree stands for a shard of bounded size, many shards side by side, and is two tables: its cuts and
its items, each with the path of the leaf that it lies in. A search goes down the nearer side first
and leaves a side out once its cut is farther than the k-th nearest so far. That is exact for
Euclidean and Manhattan distance; for cosine the tree holds unit vectors, whose Euclidean distance
orders them alike, so that it is exact too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators import distance, knn

#: Items of a shard, and of a leaf that is built, at most.
SHARD_ROWS, LEAF = 8192, 32
CUTS = "shard long, path string, axis int, cut double"
LEAVES = "shard long, id long, emb array<double>, path string"


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    """What the tree is cut by. Zero vectors stay: they are as far from all others, see _bound."""
    if metric != "cosine":
        return v
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(size < distance.TINY, 1.0, size)


def _bound(worst: float, metric: str) -> float:
    """How far a cut may be so that something nearer than worst lies behind it."""
    # unit vectors at cosine distance c are sqrt(2 c) apart; beyond 1 nothing is left out, for zero vectors
    return (np.sqrt(2 * max(worst, 0.0)) if worst < 1 - 1e-9 else np.inf) + 1e-9 if metric == "cosine" else worst


class Tree:
    """cuts: path -> (axis, value); items of a side go by component < value to the left."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, paths: list[str], cuts: dict[str, tuple[int, float]], metric: str):
        self.ids, self.vectors, self.cuts, self.metric = ids, vectors, cuts, metric
        by = pd.Series(np.arange(len(ids))).groupby(np.array(paths, object)) if len(ids) else []
        self.leaves = {path: at.to_numpy() for path, at in by}

    def search(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and distances of the k nearest, ties to the smaller id; how many were measured."""
        q, measured = _unit(v, self.metric), 0
        at, d = np.zeros(0, np.int64), np.zeros(0)
        waiting = [("", 0.0)]
        while waiting:
            path, gap = waiting.pop()
            worst = d[k - 1] if len(d) >= k else np.inf
            if gap > _bound(worst, self.metric):
                continue
            while path in self.cuts:
                axis, cut = self.cuts[path]
                side = "01"[int(q[axis] >= cut)]
                waiting.append((path + "10"[int(side)], abs(q[axis] - cut)))
                path += side
            own = self.leaves.get(path)
            if own is not None:
                measured += len(own)
                at = np.concatenate([at, own])
                d = np.concatenate([d, np.round(distance.table(v[None], self.vectors[own], self.metric)[0], knn.PLACES) + 0.0])
                order = np.lexsort((self.ids[at], d))[:k]
                at, d = at[order], d[order]
        return at, d, measured


def grow(vectors: np.ndarray, at: np.ndarray, leaf: int, path: str = "", depth: int = 0) -> tuple[list[tuple[str, int, float]], list[tuple[int, str]]]:
    """Cuts (path, axis, value) and leaves (place, path) of the vectors at: by each dimension in turn,
    at the median; a dimension in which all are alike is passed over."""
    if len(at) > leaf:
        for turn in range(vectors.shape[1]):
            axis = (depth + turn) % vectors.shape[1]
            x = vectors[at, axis]
            cut = float(np.partition(x, len(x) // 2)[len(x) // 2])
            if not (x < cut).any():  # the median is the smallest: cut above it
                above = x[x > cut]
                if not len(above):
                    continue
                cut = float(above.min())
            left = x < cut
            a = grow(vectors, at[left], leaf, path + "0", depth + turn + 1)
            b = grow(vectors, at[~left], leaf, path + "1", depth + turn + 1)
            return [(path, axis, cut), *a[0], *b[0]], a[1] + b[1]
    return [], [(int(i), path) for i in at]


def build(items: DataFrame, metric: str | None = "cosine", shards: int | None = None, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """items (id, emb, ...) -> cuts (shard, path, axis, cut) and leaves (shard, id, emb, path). Items
    without vector are left out."""
    name = distance.metric_name(metric)
    shards = max(1, -(-items.count() // SHARD_ROWS)) if shards is None else shards
    rows = items.where(F.size("emb") > 0).select(F.col("id").cast("long"), F.col("emb").cast("array<double>"))
    rows = rows.withColumn("shard", F.pmod("id", F.lit(shards)).cast("long"))

    def of(frame: pd.DataFrame):
        frame = frame.sort_values("id", ignore_index=True)
        return frame, *grow(_unit(np.stack(frame["emb"].to_numpy()).astype(float), name), np.arange(len(frame)), leaf)

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame, cuts, _ = of(frame)
        return pd.DataFrame(cuts, columns=["path", "axis", "cut"]).assign(shard=int(frame["shard"].iloc[0]))[["shard", "path", "axis", "cut"]]

    def lie(frame: pd.DataFrame) -> pd.DataFrame:
        frame, _, leaves = of(frame)
        at, paths = zip(*leaves, strict=True)
        return frame.iloc[list(at)].assign(path=list(paths))[["shard", "id", "emb", "path"]]

    return rows.groupBy("shard").applyInPandas(cut, CUTS), rows.groupBy("shard").applyInPandas(lie, LEAVES)


def insert(cuts: DataFrame, leaves: DataFrame, items: DataFrame, metric: str | None = "cosine") -> DataFrame:
    """leaves with more items, each in the leaf that the cuts of its shard lead to. The cuts stay, so
    a tree that has grown much is better built again, as it is after a deletion."""
    name = distance.metric_name(metric)
    shards = cuts.select("shard").unionByName(leaves.select("shard")).agg(F.coalesce(F.max("shard"), F.lit(0)) + 1).first()[0]
    new = items.where(F.size("emb") > 0).select(F.col("id").cast("long"), F.col("emb").cast("array<double>"))
    new = new.withColumn("shard", F.pmod("id", F.lit(shards)).cast("long"))

    def go(own: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(more):
            return pd.DataFrame(columns=["shard", "id", "emb", "path"])
        by = {p: (a, c) for p, a, c in zip(own["path"], own["axis"], own["cut"], strict=True)}
        paths = []
        for v in _unit(np.stack(more["emb"].to_numpy()).astype(float), name):
            path = ""
            while path in by:
                path += "01"[int(v[by[path][0]] >= by[path][1])]
            paths.append(path)
        return more.assign(path=paths)[["shard", "id", "emb", "path"]]

    return leaves.unionByName(cuts.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(go, LEAVES))


def search(cuts: DataFrame, leaves: DataFrame, queries: DataFrame, k: int = 5, metric: str | None = "cosine") -> DataFrame:
    """A tree built for the metric, queries (qid, emb) -> qid, id, dist, rank: the exact k nearest,
    ties to the smaller id. Queries of another length than the vectors find nothing."""
    name = distance.metric_name(metric)
    asks = leaves.select(F.col("shard").alias("of_shard")).distinct().crossJoin(queries.select(F.col("qid").cast("long"), F.col("emb").cast("array<double>")))
    none = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    whole = leaves.select("shard", "id", "emb", "path", *none(("axis", "int"), ("cut", "double")))
    whole = whole.unionByName(cuts.select("shard", *none(("id", "long"), ("emb", "array<double>")), "path", "axis", "cut"))

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows, lies = [], own["emb"].notna()
        items, cut = own[lies], own[~lies]
        if len(items) and len(asked):
            by = {p: (int(a), c) for p, a, c in zip(cut["path"], cut["axis"], cut["cut"], strict=True)}
            tree = Tree(items["id"].to_numpy(np.int64), np.stack(items["emb"].to_numpy()).astype(float), items["path"].tolist(), by, name)
            for q, v in zip(asked["qid"], asked["emb"], strict=True):
                if len(v) == tree.vectors.shape[1]:
                    at, d, _ = tree.search(np.asarray(v, float), k)
                    rows += [(q, tree.ids[i], x) for i, x in zip(at, d, strict=True)]
        return pd.DataFrame(rows, columns=["qid", "id", "dist"])

    return knn.best(whole.groupBy("shard").cogroup(asks.groupBy("of_shard")).applyInPandas(run, "qid long, id long, dist double"), k)
