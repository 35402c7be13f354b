"""Documents that arrive as a stream: chunked, embedded and appended, one commit a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeline.functions import text as tx
from lodeline.functions.models import Embed, embed_column, hashing_embedder
from lodeline.operators.semantic import PERCENTILE, semantic_chunks


def chunks(docs: DataFrame, embed: Embed = hashing_embedder, strategy: str = "fixed", percentile: float = PERCENTILE) -> DataFrame:
    """docs (id, title, text) -> doc_id, place, title, text, emb. Titles tell place and strategy;
    every strategy but "semantic" cuts by words. A chunk without vector is an error downstream, so
    it is left out here, and its document's other chunks stay."""
    if strategy == "semantic":
        cut = semantic_chunks(docs, embed, percentile).join(docs.select("id", "title"), "id")
        sizes = cut.groupBy("id").agg(F.count("*").alias("n"))
        rows = cut.join(sizes, "id").select("id", "title", "place", F.col("chunk").alias("text"), "n")
    else:
        cut = tx.fixed_chunks(docs.select("id", "title", "text"))
        rows = cut.select("id", "title", F.size("chunks").alias("n"), F.posexplode("chunks").alias("place", "text"))
    titled = tx.chunk_title(F.col("title"), F.col("place") + 1, F.col("n"), strategy)
    out = rows.select(F.col("id").alias("doc_id"), F.col("place").cast("long").alias("place"), titled.alias("title"), "text")
    return out.withColumn("emb", embed_column(F.col("text"), embed)).where(F.size("emb") > 0)


def stream(docs: DataFrame, path: str, checkpoint: str, embed: Embed = hashing_embedder, strategy: str = "fixed", once: bool = False) -> StreamingQuery:
    """Starts appending a stream of documents to the chunk table at path. Each batch has a folder
    of its own that a repeated batch overwrites, so no chunk is there twice."""

    def commit(batch: DataFrame, number: int) -> None:
        chunks(batch, embed, strategy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
