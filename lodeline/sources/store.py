"""Stores of items and chunks: seeds, snapshots, inserts and deletes.

A store is a DataFrame. Inserts append, deletes are anti-joins, and both give a new DataFrame.
Snapshots are Parquet folders, or JSON documents {version, dims, items} for exchange.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.scratch import staged

ITEM = "id long, metadata string, category string, emb array<double>"
CHUNK = "id long, title string, text string, emb array<double>"
VERSION = 1

#: Twenty rows to begin with: four categories of five, each high in four dimensions of its own.
#: Fixed values.
SEED_ROWS = (
    ("Linked List: nodes connected by pointers", "cs", (0.90, 0.85, 0.72, 0.68, 0.12, 0.08, 0.15, 0.10, 0.05, 0.08, 0.06, 0.09, 0.07, 0.11, 0.08, 0.06)),
    ("Binary Search Tree: O(log n) search and insert", "cs", (0.88, 0.82, 0.78, 0.74, 0.15, 0.10, 0.08, 0.12, 0.06, 0.07, 0.08, 0.05, 0.09, 0.06, 0.07, 0.10)),
    ("Dynamic Programming: memoization overlapping subproblems", "cs", (0.82, 0.76, 0.88, 0.80, 0.20, 0.18, 0.12, 0.09, 0.07, 0.06, 0.08, 0.07, 0.08, 0.09, 0.06, 0.07)),
    ("Graph BFS and DFS: breadth and depth first traversal", "cs", (0.85, 0.80, 0.75, 0.82, 0.18, 0.14, 0.10, 0.08, 0.06, 0.09, 0.07, 0.06, 0.10, 0.08, 0.09, 0.07)),
    ("Hash Table: O(1) lookup with collision chaining", "cs", (0.87, 0.78, 0.70, 0.76, 0.13, 0.11, 0.09, 0.14, 0.08, 0.07, 0.06, 0.08, 0.07, 0.10, 0.08, 0.09)),
    ("Calculus: derivatives integrals and limits", "math", (0.12, 0.15, 0.18, 0.10, 0.91, 0.86, 0.78, 0.72, 0.08, 0.06, 0.07, 0.09, 0.07, 0.08, 0.06, 0.10)),
    ("Linear Algebra: matrices eigenvalues eigenvectors", "math", (0.20, 0.18, 0.15, 0.12, 0.88, 0.90, 0.82, 0.76, 0.09, 0.07, 0.08, 0.06, 0.10, 0.07, 0.08, 0.09)),
    ("Probability: distributions random variables Bayes theorem", "math", (0.15, 0.12, 0.20, 0.18, 0.84, 0.80, 0.88, 0.82, 0.07, 0.08, 0.06, 0.10, 0.09, 0.06, 0.09, 0.08)),
    ("Number Theory: primes modular arithmetic RSA cryptography", "math", (0.22, 0.16, 0.14, 0.20, 0.80, 0.85, 0.76, 0.90, 0.08, 0.09, 0.07, 0.06, 0.08, 0.10, 0.07, 0.06)),
    ("Combinatorics: permutations combinations generating functions", "math", (0.18, 0.20, 0.16, 0.14, 0.86, 0.78, 0.84, 0.80, 0.06, 0.07, 0.09, 0.08, 0.06, 0.09, 0.10, 0.07)),
    ("Neapolitan Pizza: wood-fired dough San Marzano tomatoes", "food", (0.08, 0.06, 0.09, 0.07, 0.07, 0.08, 0.06, 0.09, 0.90, 0.86, 0.78, 0.72, 0.08, 0.06, 0.09, 0.07)),
    ("Sushi: vinegared rice raw fish and nori rolls", "food", (0.06, 0.08, 0.07, 0.09, 0.09, 0.06, 0.08, 0.07, 0.86, 0.90, 0.82, 0.76, 0.07, 0.09, 0.06, 0.08)),
    ("Ramen: noodle soup with chashu pork and soft-boiled eggs", "food", (0.09, 0.07, 0.06, 0.08, 0.08, 0.09, 0.07, 0.06, 0.82, 0.78, 0.90, 0.84, 0.09, 0.07, 0.08, 0.06)),
    ("Tacos: corn tortillas with carnitas salsa and cilantro", "food", (0.07, 0.09, 0.08, 0.06, 0.06, 0.07, 0.09, 0.08, 0.78, 0.82, 0.86, 0.90, 0.06, 0.08, 0.07, 0.09)),
    ("Croissant: laminated pastry with buttery flaky layers", "food", (0.06, 0.07, 0.10, 0.09, 0.10, 0.06, 0.07, 0.10, 0.85, 0.80, 0.76, 0.82, 0.09, 0.07, 0.10, 0.06)),
    ("Basketball: fast-paced shooting dribbling slam dunks", "sports", (0.09, 0.07, 0.08, 0.10, 0.08, 0.09, 0.07, 0.06, 0.08, 0.07, 0.09, 0.06, 0.91, 0.85, 0.78, 0.72)),
    ("Football: tackles touchdowns field goals and strategy", "sports", (0.07, 0.09, 0.06, 0.08, 0.09, 0.07, 0.10, 0.08, 0.07, 0.09, 0.08, 0.07, 0.87, 0.89, 0.82, 0.76)),
    ("Tennis: racket volleys groundstrokes and Wimbledon serves", "sports", (0.08, 0.06, 0.09, 0.07, 0.07, 0.08, 0.06, 0.09, 0.09, 0.06, 0.07, 0.08, 0.83, 0.80, 0.88, 0.82)),
    ("Chess: openings endgames tactics strategic board game", "sports", (0.25, 0.20, 0.22, 0.18, 0.22, 0.18, 0.20, 0.15, 0.06, 0.08, 0.07, 0.09, 0.80, 0.84, 0.78, 0.90)),
    ("Swimming: butterfly freestyle backstroke Olympic competition", "sports", (0.06, 0.08, 0.07, 0.09, 0.08, 0.06, 0.09, 0.07, 0.10, 0.08, 0.06, 0.07, 0.85, 0.82, 0.86, 0.80)),
)


def seed_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m, c, list(v)) for i, (m, c, v) in enumerate(SEED_ROWS, 1)], ITEM)


def listed(store: DataFrame) -> DataFrame:
    """All rows in order of insertion."""
    return store.orderBy("id")


def insert(store: DataFrame, rows: DataFrame, dims: int | None = None) -> DataFrame:
    """store with rows, whose ids go on from the largest one. With dims, vectors of another length
    are an error. The new rows are staged."""
    if dims is not None and not rows.where(F.size("emb") != dims).isEmpty():
        raise ValueError(f"vectors must have {dims} dimensions")
    last = store.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # numbered by partition, so that no task sees all new rows; staged, as another run may deal them
    # to other partitions
    numbered = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    new = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")
    new = new.withColumn("id", F.lit(last) + 1 + F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return store.unionByName(new.select(*store.columns))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti").select(*store.columns)


#: Names the folder of the snapshot that counts.
CURRENT = "CURRENT"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder of the snapshot at path; None if there is none."""
    fs, mark = _path(spark, path, CURRENT)
    if not fs.exists(mark):
        return None
    stream = fs.open(mark)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{name}"


def save(store: DataFrame, path: str) -> int:
    """A Parquet snapshot at path; the number of rows. The rows go to a new folder first, then a mark
    that names it is put in the place of the old one, so a reader has the old snapshot or the new one,
    never a part; the folders before the one that was current go. A store that was loaded from path can
    be saved there: what it reads stays until the save after the next."""
    spark = store.sparkSession
    name, before = f"snapshot-{uuid.uuid4().hex}", _current(spark, path)
    store.write.parquet(f"{path}/{name}")
    fs, mark = _path(spark, path, CURRENT)
    _, new = _path(spark, path, f"{name}.mark")
    out = fs.create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(mark.toUri(), spark._jsc.hadoopConfiguration()).rename(new, mark, _overwrite(spark))
    for s in fs.listStatus(_path(spark, path)[1]):
        old = s.getPath().getName()
        if old.startswith("snapshot-") and old != name and f"{path}/{old}" != before:
            fs.delete(s.getPath(), True)
    return spark.read.parquet(f"{path}/{name}").count()


def _overwrite(spark: SparkSession):
    """Hadoop's option for a rename that replaces, as the array that the call takes."""
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    return options


def load(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """The Parquet snapshot at path; empty if there is none."""
    current = _current(spark, path)
    return spark.read.schema(schema).parquet(current) if current else spark.createDataFrame([], schema)


def save_json(store: DataFrame, path: str, dims: int) -> int:
    """One JSON document {version, dims, items}, for exchange of small stores: one task writes it."""
    rows = F.sort_array(F.collect_list(F.struct("id", *[c for c in store.columns if c != "id"])))
    doc = store.agg(F.lit(VERSION).alias("version"), F.lit(dims).alias("dims"), rows.alias("items"))
    doc.coalesce(1).write.mode("overwrite").json(path)
    return store.count()


def load_json(spark: SparkSession, path: str, schema: str = ITEM, reassign: bool = False) -> DataFrame:
    """Items of a JSON snapshot. A missing path and unreadable JSON give none, and items without id
    or vector are skipped. reassign numbers them anew, in order, as a restart does."""
    if not snapshot_info(spark, path)["exists"]:
        return spark.createDataFrame([], schema)
    whole = f"version int, dims int, items array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>>"
    try:
        read = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    rows = read.select(F.inline("items")).where("id is not null and emb is not null and forall(emb, x -> x is not null)")
    if reassign:
        rows = rows.withColumn("id", F.row_number().over(Window.orderBy("id")).cast("long"))
    return rows


def snapshot_info(spark: SparkSession, path: str) -> dict:
    """Whether there is a snapshot at path, and its bytes: of the current one, or of all files."""
    fs, where = _path(spark, _current(spark, path) or path)
    exists = fs.exists(where)
    return {"path": path, "exists": exists, "size_bytes": fs.getContentSummary(where).getLength() if exists else 0}


def restore(seed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The seed and those rows of a snapshot whose metadata it does not have."""
    return insert(seed, snapshot.join(seed.select("metadata"), "metadata", "left_anti").select(*seed.columns))
