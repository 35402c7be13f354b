"""From raw documents to encoded training text, in five stages.

Each stage works on all that the one before kept; all but the last return the columns of documents.
Between stages the table is written as Parquet and read again, so a lost executor never costs more
than the tasks that it ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import mixing, neardup, pieces, quality, suffixes
from lodeline.llm.shared import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all of a document's columns), doc_id, t: columns of any name stay out of the way. Rows
    are named by doc_id and a hash of the text, so rows that repeat a doc_id stay apart."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))


def _matching(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """rows joined to marks of the same doc_id and t; null doc_ids match."""
    marks = marks.withColumnsRenamed({"doc_id": "mark_id", "t": "mark_t"})
    return rows.join(marks, F.col("doc_id").eqNullSafe(F.col("mark_id")) & F.col("t").eqNullSafe(F.col("mark_t")), how)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows without doc_id, text or source are judged like others (a null site is one of its own);
    null and empty texts by their site only, texts of any length whole; rows alike share their
    fate, and so do other columns' contents. A tie at the threshold keeps. An empty table stays
    empty."""
    judged = quality.assess(quality.sites(docs), quality.table_labels(table(spark, sf_dir, "labels")))
    return _matching(_keyed(docs), judged.where("not keep").select("doc_id", "t").distinct(), "left_anti").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by near-duplicate texts (five-word shingles, similarity of
    0.8) the one with the smallest doc_id stays, of rows alike in doc_id and text one.

    A null doc_id is larger than all others, of several the smallest hash of the text stays.
    Documents without words, null and empty ones too, all stay. Texts of any length are compared
    whole. An empty table stays empty."""
    found = staged(neardup.near_duplicates(docs, width=5, percent=80), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("first")
    kept = found.where("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.t", F.lit(True).alias("worded"))
    blank = found.where("component is null").select("doc_id", "t").distinct().withColumn("worded", F.lit(False))
    rows = _matching(_keyed(docs), kept.unionByName(blank), "inner")
    repeated = found.where("component is not null").groupBy("doc_id", "t").count().where("count > 1")
    if not repeated.isEmpty():  # rows alike: one of each stays
        rows = rows.where("worded").dropDuplicates(["doc_id", "t"]).unionByName(rows.where("not worded"))
    return rows.select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes or more that stands earlier too is cut out of the texts; a
    character of which a part is cut goes too. n_chars is what is left.

    Earlier is a smaller doc_id, null being the largest, or the same document; rows alike in doc_id
    and text are one document and are cut alike. Null texts stay null, empty and short ones as they
    are; long ones are searched whole. An empty table stays empty."""
    changed = suffixes.repeats(docs, window=suffixes.WINDOW, decoded=True).dropDuplicates(["doc_id", "t"])
    rows = _keyed(docs).withColumn("t", suffixes.text_key(F.col("row.text")))
    rows = _matching(rows, changed, "left")
    new = {"text": F.coalesce("left", "row.text"), "n_chars": F.when(F.col("left").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long"))}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document is there as often as the mix takes it,
    so not at all, once or twice.

    Each row has a queue place of its own, rows alike too; the shuffle follows doc_id and text, so
    reruns agree. A null source is a source of its own. Null and empty texts, and those without
    words, have nothing to take and go. An empty table stays empty."""
    rows = staged(_keyed(docs).withColumn("number", F.monotonically_increasing_id()), "numbered")
    named = rows.select(F.struct("doc_id", "t").alias("doc_id"), "number", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mixing.mix(named, row="number").select("number", F.expr("if(size > 0, taken div size, 0)").cast("int").alias("times")).where("times > 0")
    return rows.join(taken, "number").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as piece ids, with their number; columns of these names are replaced. Null and empty
    texts have no ids, long ones are encoded whole. Rows alike stay; an empty table stays empty."""
    return pieces.encode(docs).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix),
    ("sentencepiece encoding", encode),
]

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
