"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import ann, licenses, mixing, neardup, pieces, quality, suffixes, tokencounts, topk, urls
from lodeline.llm.shared import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = pieces.decode(encoded.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "token_ids"))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "text_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    blocked = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return urls.judge(table(spark, sf_dir, "pages"), blocked)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents that no label calls toxic: those are deleted again."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return tokencounts.rollup(table(spark, sf_dir, "documents"), "byte_bpe_50k/1", toxic)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"), window=100)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.table_labels(table(spark, sf_dir, "labels"))
    return quality.assess(quality.sites(table(spark, sf_dir, "documents")), labels).drop("t")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filter": op2_url_filter,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_ann_search": op4_ann_search,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_exact_topk": op9_exact_topk,
    "op10_quality": op10_quality,
}

#: Full results, where SQL expresses them.
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": urls.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op6_mixing": mixing.SQL,
    "op7_suffix_dedup": suffixes.SQL,
    "op8_license_scan": licenses.SQL,
    "op9_exact_topk": topk.SQL,
}
