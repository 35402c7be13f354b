"""Nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids split the space into cells; a vector is kept with its cell, the product-quantised
residual from the cell's centroid, and how far its code lies from it. A query searches its own cell
first, and then every cell that may hold a nearer row than the k-th known: a sample's rows and its
own cell give that distance, the cell's centroid and radius the bound. In a cell asymmetric distances
(query residual against decoded residual), less the code's error, rule rows out, and all others are
measured exactly on the original vectors. So no row is missed, wherever rows and queries lie: the
model, fitted on a bounded sample, decides only how much is left out. Every row is indexed.

A cell's rows and the queries that ask it are cut into blocks, so that a cell that holds a third of
all rows is spread over many tasks. Vectors of different lengths have models of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import staged
from lodeline.llm.vectors import asked_blocks, best, matrix, takes_part

#: Rows that centroids and code words are fitted on, at most.
FIT_SAMPLE = 16_384
#: Code words of each part, dimensions of a part, and rounds of k-means.
WORDS, PART, ROUNDS = 256, 4, 8
#: Cells: the root of the rows, divided by this, up to MOST_CELLS.
CELL_DIVISOR, MOST_CELLS = 2, 4096
#: Numbers of the sample's rows that queries are held against before they search, at most.
FIRST = 1 << 20
#: Rows of a cell block that a query measures exactly, before its limit is drawn closer.
RERANK = 64
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
#: Numbers of a table of distances, at most: larger ones are made in blocks of rows.
TABLE = 1 << 22
#: Rounding of a squared distance that comes of an inner product, as a share of the squares; and of a distance.
SLACK, CLOSE = 1e-12, 1 + 1e-12


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    d *= -2
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)[None, :]
    return np.maximum(d, 0, out=d)


def _blocks(x: np.ndarray, b: np.ndarray) -> Iterator[slice]:
    """Rows of x whose distances to b are one table."""
    step = max(1, TABLE // max(1, len(b)))
    return (slice(i, i + step) for i in range(0, len(x), step))


def closest(x: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of b, the first of equals, and the squared distance."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in _blocks(x, b):
        d = _squares(x[s], b)
        at[s] = d.argmin(1)
        far[s] = d[np.arange(len(d)), at[s]]
    return at, far


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of distinct rows; fewer than k where x has fewer distinct rows. An empty cell is
    given the row that is farthest from its centroid."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)] if k else x[:0]
    for _ in range(rounds if k < len(distinct) else 0):
        near, d = closest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c)
        for i, j in zip(np.flatnonzero(n == 0), np.argsort(-d), strict=False):
            c[i] = x[j]
    return c


@dataclass
class Model:
    """Of bounded size: cells x dimensions, parts x words x dimensions of a part, and rows of the sample.
    Cells are places from the origin, so that vectors far off zero lose no digits."""

    origin: np.ndarray
    cells: np.ndarray
    words: list[np.ndarray]
    sample: np.ndarray
    k: int

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i : i + PART] for i in range(0, x.shape[1], PART)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its cell, code, distance from the cell's centroid, and distance from what its
        code says."""
        x = x - self.origin
        cell, _ = closest(x, self.cells)
        left = x - self.cells[cell]
        code = np.stack([closest(p, w)[0] for p, w in zip(self.parts(left), self.words, strict=True)], 1).astype(np.uint8)
        return cell, code, norms(left), norms(left - self.decode(code))

    def decode(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([w[code[:, j]] for j, w in enumerate(self.words)], 1)

    def limits(self, x: np.ndarray) -> np.ndarray:
        """For each row of the table a distance within which k others lie: k + 1 rows of the sample do."""
        out = np.full(len(x), np.inf)
        for s in _blocks(x, self.sample) if len(self.sample) > self.k else ():
            at = np.argpartition(_squares(x[s] - self.origin, self.sample - self.origin), self.k, 1)[:, : self.k + 1]
            for i in range(self.k + 1):
                out[s] = np.maximum(out[s] if i else 0.0, norms(x[s] - self.sample[at[:, i]]))
        return out

    def asked(self, x: np.ndarray, limit: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells, of that radius each (less than 0: empty), may hold rows within each query's limit."""
        x = x - self.origin
        far = _squares(x, self.cells) - SLACK * ((x * x).sum(1)[:, None] + (self.cells**2).sum(1)[None, :])
        return (np.sqrt(np.maximum(far, 0)) <= (limit[:, None] + radius[None, :]) * CLOSE) & (radius >= 0)[None, :]


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def fit(sample: np.ndarray, n_rows: int, k: int) -> Model:
    """The model of n_rows rows, of which sample is a part, for searches of k."""
    origin = sample.mean(0)
    moved = sample - origin
    cells = kmeans(moved, max(1, min(MOST_CELLS, len(sample), round(n_rows**0.5 / CELL_DIVISOR))))
    left = moved - cells[closest(moved, cells)[0]]
    words = [kmeans(left[:, i : i + PART], WORDS, 4, i + 1) for i in range(0, sample.shape[1], PART)]
    return Model(origin, cells, words, sample[: max(k + 1, FIRST // sample.shape[1])], k)


def few(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places: of equal vectors the k + 1 of the smallest ids, as one of them may be the query itself."""
    _, of = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).reshape(-1), return_inverse=True)
    order = np.lexsort((ids, of))
    return np.sort(order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) <= k])


def search_block(model: Model, cell: int, q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell's rows c (row, id, v, code, err) the k nearest of each query q (row, v, limit) within
    its limit: places of queries and of rows, and distances."""
    keep = few(c["v"], c["id"], k)
    c = {name: x[keep] for name, x in c.items()}
    centre = model.origin + model.cells[cell]
    v, told = q["v"] - centre, model.decode(c["code"])
    size = SLACK * (v * v).sum(1)
    low = _squares(v, told) - (size[:, None] + SLACK * (told * told).sum(1)[None, :])
    low = np.sqrt(np.maximum(low, 0, out=low), out=low)
    low -= c["err"][None, :]
    limit = q["limit"] * CLOSE
    rows = low <= limit[:, None]
    rows &= q["row"][:, None] != c["row"][None, :]
    at = np.flatnonzero(rows.any(0))
    if not len(at):
        return at, at, np.zeros(0)
    # all that is left at once; what may be nearest is measured on the vectors themselves
    left = c["v"][at] - centre
    own = SLACK * (left * left).sum(1)
    near = _squares(v, left) - (size[:, None] + own[None, :])
    rows = rows[:, at]
    near[~rows] = np.inf
    limit = limit * limit * CLOSE
    many = np.flatnonzero((rows & (near <= limit[:, None])).sum(1) > max(k, rerank))
    if len(many):
        kth = np.partition(near[many], k - 1, 1)[:, k - 1] + 2 * (size[many] + own.max())
        limit[many] = np.minimum(limit[many], kth)
    i, j = np.nonzero(rows & (near <= limit[:, None]))
    step = max(1, TABLE // 8 // v.shape[1])
    score = np.concatenate([norms(q["v"][i[s : s + step]] - c["v"][at[j[s : s + step]]]) for s in range(0, len(i), step)] or [np.zeros(0)])
    order = np.lexsort((c["id"][at[j]], score, i))
    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
    return i[order], keep[at[j[order]]], score[order]


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 10, fit_sample: int = FIT_SAMPLE, rerank: int = RERANK, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row where
    is_query holds its k nearest by Euclidean distance, ties to the smaller vec_id.

    Candidates are all rows of the query's length but its own, repeated ids and vectors included; a
    repeated query is answered for each row. A query gets k rows if there are as many, else all.
    Rows without vec_id, and vectors that are null, zero or hold null or non-finite components, take
    no part. An empty table, or one without queries, gives an empty result. Other columns are not
    looked at."""
    schema = "query_row long, query_id long, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & takes_part(F.col("v")) & F.exists("v", lambda x: x != 0))
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}  # one row a length
    sample: dict[int, list] = {n: [] for n in lengths}
    for r in rows.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_sample).toArrow()["v"]:
        x = r.values.to_numpy()
        sample[len(x)].append(x)
    # a length that the sample does not have is rare: one cell, and codes that rule nothing out
    plain = lambda n: Model(np.zeros(n), np.zeros((1, n)), [np.zeros((1, len(range(i, min(i + PART, n))))) for i in range(0, n, PART)], np.zeros((0, n)), k)
    models = {n: fit(np.array(own), lengths[n], k) if own else plain(n) for n, own in sample.items()}

    def by_size(b: pa.RecordBatch, size: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        for n in np.unique(size).tolist():
            part = b.filter(pa.array(size == n))
            yield n, part, matrix(part.column("v"), np.float64)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part, v in by_size(b, np.diff(b.column("v").offsets.to_numpy())):
                cell, code, out, err = models[n].encode(v)
                own = [pa.array(np.full(len(cell), n), pa.int32()), pa.array(cell, pa.int32()), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(out), pa.array(err)]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], ["vec_id", "v", "asks", "size", "cell", "code", "out", "err"])

    indexed = rows.mapInArrow(index, "vec_id long, v array<double>, asks boolean, size int, cell int, code binary, out double, err double")
    indexed = staged(indexed.withColumn("row", F.monotonically_increasing_id()), "ivf")
    sizes, radius = {}, {n: np.full(len(m.cells), -1.0) for n, m in models.items()}
    for r in indexed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("out").alias("out")).collect():  # one row a length and cell
        sizes[r["size"], r["cell"]] = r["n"]
        radius[r["size"]][r["cell"]] = r["out"]
    asking = "row long, vec_id long, v array<double>, size int, cell int, limit double"
    names = [x.split()[0] for x in asking.split(", ")]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part, v in by_size(b, b.column("size").to_numpy()):
                yield pa.RecordBatch.from_arrays([*part.select(names[:-1]).columns, pa.array(models[n].limits(v))], names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part, v in by_size(b, b.column("size").to_numpy()):
                limit, home = part.column("limit").to_numpy(), part.column("cell").to_numpy()
                for s in _blocks(v, models[n].cells):
                    asked = models[n].asked(v[s], limit[s], radius[n])
                    asked[np.arange(len(asked)), home[s]] = False
                    i, cell = np.nonzero(asked)
                    some = part.take(pa.array(i + s.start))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()) if c == "cell" else some.column(c) for c in names], names)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        side = lambda t: {"row": t["row"].to_numpy(), "id": t["vec_id"].to_numpy(), "v": matrix(t["v"], np.float64)}
        q, c = side(left), side(right)
        q["limit"], c["err"] = left["limit"].to_numpy(), right["err"].to_numpy()
        c["code"] = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
        i, j, score = search_block(models[left["size"][0].as_py()], left["cell"][0].as_py(), q, c, k, rerank)
        return pa.table({"query_row": q["row"][i], "query_id": q["id"][i], "vec_id": c["id"][j], "score": score})

    search = lambda asks: asked_blocks(asks, indexed.drop("asks", "out"), sizes, query_block, row_block).applyInArrow(meet, schema)
    asks = staged(indexed.where("asks").mapInArrow(first, asking), "ivf-asks")
    home = staged(search(asks), "ivf-home")
    # k for each block of a query's cell, at most
    known = home.groupBy("query_row").agg(F.try_element_at(F.sort_array(F.collect_list("score")), F.lit(k)).alias("known"))
    closer = asks.join(known.withColumnRenamed("query_row", "row"), "row", "left").withColumn("limit", F.least("limit", "known"))
    found = search(staged(closer.select(names).mapInArrow(others, asking), "ivf-others"))
    return best(home.unionByName(found), k, F.col("score"))
