"""Second-stage ranking of candidates, by overlap or by a model's grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.functions.models import Generate, generate_column


def rerank(candidates: DataFrame, strategy: str = "cross", generate: Generate | None = None, k: int = 3) -> DataFrame:
    """candidates (qid, query, id, title, text, original_rank) -> with rerank_score, reasoning and
    new_rank: each query's best k, ties by the original rank. Grades come from a model only if the
    strategy is "llm" and there is one; every other strategy is the overlap score."""
    if strategy == "llm" and generate is not None:
        replies = candidates.withColumn("_reply", generate_column(tx.grade_prompt(F.col("query"), F.col("title"), F.col("text")), generate))
        scored = replies.withColumns({"rerank_score": tx.grade(F.col("_reply")), "reasoning": tx.grade_reason(F.col("_reply"))}).drop("_reply")
    else:
        scored = tx.cross_score(candidates, "rerank_score")
        scored = scored.withColumn("reasoning", tx.cross_reason(F.col("rerank_score")))
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), "original_rank")
    return scored.withColumn("new_rank", F.row_number().over(w).cast("long")).where(F.col("new_rank") <= k)
