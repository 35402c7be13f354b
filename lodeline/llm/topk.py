"""Exact top-k by inner product, with pivot-table elimination.

Distances from every vector to many pivots are computed once and kept as a table. Two bounds on the
distance of a query and a candidate follow from the table alone. By the triangle inequality it is at
least the largest difference of their distances to a pivot. And as distances to the pivots fix where
a vector's image in the space that the pivots span lies, and how far the vector is from that space,
it is at least the distance of the two images with the difference of the two heights over it; this
is never less than the first. Since <q, c> = (|q|^2 + |c|^2 - d(q, c)^2) / 2 either bounds the inner
product from above.

Rows are kept in cells, by their nearest pivot. A first pass over a bounded sample gives each query
a score that its k-th best one reaches surely. The first bound, over a cell's ranges of distances,
then leaves out whole cells before anything is shuffled; the second one ranks the candidates of a
cell, and a query stops as soon as its k-th best score lies above every bound that is left: the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import staged
from lodeline.llm.vectors import asked_blocks, best, lists, matrix, takes_part

#: Pivots, as a share of the dimensions: so many give bounds that leave most candidates out even where
#: vectors point everywhere alike; and at most so many.
PIVOT_SHARE, MOST_PIVOTS = 0.8, 256
#: Pivots and first candidates are picked among so many rows: a bounded sample, since any give exact
#: results.
SAMPLE = 2048
#: Queries of a block, rows of a block, and cells.
QUERY_BLOCK, ROW_BLOCK, CELLS = 4096, 4096, 256
#: A pivot counts for the second bound if it is so far from the span of those before, of all distances.
APART = 1e-3
#: Less than every score.
NOTHING = -(1 << 62)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before."""
    chosen = sample[:1]
    near = ((sample - sample[0]) ** 2).sum(1) if len(sample) else np.zeros(0)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen = np.vstack([chosen, sample[near.argmax()]])
        near = np.minimum(near, ((sample - chosen[-1]) ** 2).sum(1))
    return chosen


class Pivots:
    """Pivots, and how distances to them become places in the space that they span."""

    def __init__(self, points: np.ndarray):
        self.points = points
        base = points - points[:1]
        self.used, axes = [], []
        scale = np.sqrt((base**2).sum(1)).max(initial=0.0)
        for i in range(1, len(points)):
            left = base[i]
            for _ in range(2):  # twice, for the rounding
                for axis in axes:
                    left = left - (left @ axis) * axis
            if np.sqrt(left @ left) > APART * scale:
                axes.append(left / np.sqrt(left @ left))
                self.used.append(i)
        self.axes = np.array(axes).reshape(len(axes), points.shape[1])
        self.lower = base[self.used] @ self.axes.T  # lower triangular

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in self.points], 1)) if len(self.points) else np.zeros((len(v), 0))

    def places(self, far: np.ndarray) -> np.ndarray:
        """Distances -> coordinates of the image, and the height over the space, as the last one."""
        if not far.shape[1]:
            return np.zeros((len(far), 1))
        square = far**2
        size = ((self.points[self.used] - self.points[0]) ** 2).sum(1)
        # <x - p0, pi - p0> from |x - p0|, |x - pi| and |pi - p0|
        product = (square[:, :1] - square[:, self.used] + size) / 2
        y = np.linalg.solve(self.lower, product.T).T if self.used else np.zeros((len(far), 0))
        return np.column_stack([y, np.sqrt(np.maximum(0, square[:, 0] - (y * y).sum(1)))])


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can leave their exact integers."""
    top = lambda m: int(np.abs(m).max(initial=0))
    if top(queries) * top(rows) * max(1, rows.shape[1]) < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def slack(qq: np.ndarray, cc: np.ndarray) -> np.ndarray:
    """What is added to bounds, which are doubles, on scores, which are integers."""
    return 1e-7 * (qq[:, None] + cc[None, :]) + 1e-3


def search_block(pivots: Pivots, q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """q, c: row, id, v (integers) and far (distances to pivots); q with least, a score below which
    nothing is asked. For each query the places of its best k candidates and their scores; how many
    products were evaluated in all."""
    norm = lambda v: (v.astype(np.float64) ** 2).sum(1)
    qq, cc, qp, cp = norm(q["v"]), norm(c["v"]), pivots.places(q["far"]), pivots.places(c["far"])
    # (|q|^2 + |c|^2 - |qp - cp|^2) / 2
    bound = ((qq - (qp * qp).sum(1))[:, None] + (cc - (cp * cp).sum(1))[None, :]) / 2 + qp @ cp.T + slack(qq, cc)
    places, scores, evaluated = [], [], 0
    for i in range(len(qq)):
        order = np.flatnonzero((bound[i] >= q["least"][i]) & (c["row"] != q["row"][i]))
        order = order[np.argsort(-bound[i, order], kind="stable")]
        at, score, start, step = order[:0], np.zeros(0, np.int64), 0, 8 * k
        while start < len(order) and (len(score) < k or bound[i, order[start]] >= score[k - 1]):
            part = order[start : start + step]
            at, score = np.concatenate([at, part]), np.concatenate([score, products(q["v"][i : i + 1], c["v"][part])[0]])
            top = np.lexsort((c["id"][at], -score))[:k]
            at, score = at[top], score[top]
            evaluated, start, step = evaluated + len(part), start + len(part), 2 * step
        places.append(at)
        scores.append(score)
    return places, scores, evaluated


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """vectors (vec_id, vector of integers, ...) -> query_id, rank, vec_id, score: for each row
    where is_query holds the k rows of the highest inner product, ties to the smaller vec_id.

    Candidates are all rows but the query's own; a row that repeats its vec_id is a candidate, and
    a repeated query is answered for each row. Rows without vec_id or vector, or with a null
    component, take no part. Only vectors of one length are compared, empty ones too. An empty
    table, or one without queries, gives an empty result. Other columns are not looked at."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("vector").cast("array<bigint>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id is not null and v is not null and forall(v, x -> x is not null)")
    # lengths that the sample does not have need no pivots: their bounds leave nothing out
    pivots, first = {}, {}
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v", "vec_id").collect():  # bounded
        sample.setdefault(len(r[0]), []).append(r)
    for n, own in sample.items():
        points = np.array([r[0] for r in own], np.float64).reshape(len(own), n)
        pivots[n] = Pivots(choose_pivots(points, min(most_pivots, max(1, round(PIVOT_SHARE * n)))))
        first[n] = (np.array([r[1] for r in own], np.int64), points.astype(np.int64))
    plain = lambda n: Pivots(np.zeros((0, n)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in np.unique(sizes := np.diff(b.column("v").offsets.to_numpy())).tolist():
                part = b.filter(pa.array(sizes == n))
                v, own = matrix(part.column("v"), np.int64).reshape(part.num_rows, n), pivots.get(n) or plain(n)
                far = own.distances(v.astype(np.float64))
                cell = far[:, :CELLS].argmin(1) if far.shape[1] else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("asks"), lists(far, pa.float64()), pa.array(np.full(len(v), n), pa.int32()), pa.array(cell, pa.int32()), pa.array((v.astype(np.float64) ** 2).sum(1))], ["vec_id", "v", "asks", "far", "size", "cell", "square"])

    measured = rows.mapInArrow(measure, "vec_id long, v array<bigint>, asks boolean, far array<double>, size int, cell int, square double")
    measured = staged(measured.withColumn("row", F.monotonically_increasing_id()), "pivot-table")
    # one row a length, cell and pivot: the ranges of the distances, and the largest square of a norm
    ranges: dict[tuple[int, int], dict] = {}
    spread = measured.select("size", "cell", "square", F.posexplode_outer("far").alias("at", "x")).groupBy("size", "cell", "at")
    for r in spread.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max("square").alias("square"), F.count("*").alias("n")).collect():
        own = ranges.setdefault((r["size"], r["cell"]), {"n": r["n"], "square": r["square"], "low": {}, "high": {}})
        if r["at"] is not None:
            own["low"][r["at"]], own["high"][r["at"]] = r["low"], r["high"]
    cells: dict[int, tuple[np.ndarray, ...]] = {}
    for n in {s for s, _ in ranges}:
        own = sorted(c for s, c in ranges if s == n)
        table = lambda k, n=n, own=own: np.array([[ranges[n, c][k][i] for i in sorted(ranges[n, c][k])] for c in own]).reshape(len(own), -1)
        cells[n] = (np.array(own), table("low"), table("high"), np.array([ranges[n, c]["square"] for c in own]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with a score that its k-th best reaches, and the cells that may hold more."""
        for b in batches:
            for n in np.unique(sizes := b.column("size").to_numpy()).tolist():
                part = b.filter(pa.array(sizes == n))
                v, far = matrix(part.column("v"), np.int64).reshape(part.num_rows, n), matrix(part.column("far"), np.float64).reshape(part.num_rows, -1)
                least = np.full(len(v), NOTHING)
                if n in first:
                    ids, points = first[n]
                    score = products(v, points)
                    # rows of the query's own id are left out: one of them is the query
                    score[part.column("vec_id").to_numpy()[:, None] == ids[None, :]] = NOTHING
                    if score.shape[1] >= k:
                        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                own, low, high, square = cells[n]
                gap = np.zeros((len(v), len(own)))
                for i in range(far.shape[1]):
                    np.maximum(gap, np.maximum(low[None, :, i] - far[:, i, None], far[:, i, None] - high[None, :, i]), out=gap)
                qq = (v.astype(np.float64) ** 2).sum(1)
                i, c = np.nonzero((qq[:, None] + square[None, :] - gap * gap) / 2 + slack(qq, square) >= least[:, None])
                some = part.select(["row", "vec_id", "v", "far"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(i), n), pa.int32()), pa.array(own[c], pa.int32()), pa.array(least[i])], ["row", "vec_id", "v", "far", "size", "cell", "least"])

    asking = measured.where("asks").select("row", "vec_id", "v", "far", "size").mapInArrow(probe, "row long, vec_id long, v array<bigint>, far array<double>, size int, cell int, least long")
    schema = "query_row long, query_id long, vec_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t: pa.Table) -> dict[str, np.ndarray]:
            n = t["size"][0].as_py()
            return {"row": t["row"].to_numpy(), "id": t["vec_id"].to_numpy(), "v": matrix(t["v"], np.int64).reshape(t.num_rows, n), "far": matrix(t["far"], np.float64).reshape(t.num_rows, -1)}

        if not left.num_rows or not right.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int64()) for x in schema.split(", ")})
        q, c, n = side(left), side(right), left["size"][0].as_py()
        q["least"] = left["least"].to_numpy()
        at, score, _ = search_block(pivots.get(n) or plain(n), q, c, k)
        n = [len(a) for a in at]
        return pa.table({"query_row": np.repeat(q["row"], n), "query_id": np.repeat(q["id"], n), "vec_id": c["id"][np.concatenate(at)], "score": np.concatenate(score)})

    found = asked_blocks(staged(asking, "pivot-asks"), measured.select("row", "vec_id", "v", "far", "size", "cell"), {key: x["n"] for key, x in ranges.items()}, query_block, row_block).applyInArrow(meet, schema)
    return best(found, k, F.col("score").desc())


def quantised(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding) -> vec_id, vector: floor(256 * x) of each component, as
    double. Vectors that are null or hold null or non-finite components go."""
    return embeddings.where(takes_part(F.col("embedding"))).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 256).cast("bigint")).alias("vector"))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
