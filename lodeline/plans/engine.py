"""The whole interface as one object: each route of the service is a method.

Stores are DataFrames and so are results; nothing is kept in the driver but the settings. The
graphs that searches walk are built when one is first needed, and staged in the shared folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.functions.models import Embed, Generate, generate_column, hashing_embedder
from lodeline.operators import fusion, graph, grounding, knn, lexical, manifold, quantize, semantic
from lodeline.operators.rerank import rerank
from lodeline.scratch import staged
from lodeline.sources import store
from lodeline.streaming.ingest import chunks

PIPELINES = ("vector", "hybrid", "rerank", "hyde")


class Engine:
    def __init__(self, spark: SparkSession, items: DataFrame | None = None, documents: DataFrame | None = None, dims: int = 16, embed: Embed = hashing_embedder, generate: Generate | None = None, available: Callable[[], bool] | None = None):
        self.spark, self.dims, self.embed, self.generate = spark, dims, embed, generate
        self.available = available or (lambda: generate is not None)
        self.items = store.seed_items(spark) if items is None else items
        self.documents = spark.createDataFrame([], store.CHUNK) if documents is None else documents
        self._graphs: dict[str, DataFrame] = {}

    def graph(self, of: str = "items") -> DataFrame:
        """The index of the items, or of the documents."""
        if of not in self._graphs:
            self._graphs[of] = staged(graph.build(self.items if of == "items" else self.documents), f"graph-{of}")
        return self._graphs[of]

    def _remove(self, of: str, gone: int) -> bool:
        rows: DataFrame = getattr(self, of)
        there = not rows.where(F.col("id") == gone).isEmpty()
        setattr(self, of, rows.where(F.col("id") != gone))
        if there and of in self._graphs:
            lost = self.spark.createDataFrame([(gone,)], "id long")
            self._graphs[of] = staged(graph.delete(self._graphs[of], lost), f"graph-{of}")
        return there

    # ---- items

    def search(self, v: str | Sequence[float], k: int = 5, metric: str = "cosine", algo: str = "hnsw", category: str | None = None) -> DataFrame:
        index = None if algo in ("bruteforce", "kdtree") else self.graph()
        return knn.hits(knn.search_filtered(self.items, self._vector(v), k, metric, algo, category, index=index))

    def insert(self, metadata: str, category: str, embedding: Sequence[float]) -> int:
        row = self.spark.createDataFrame([(0, metadata, category or "", list(map(float, embedding)))], store.ITEM)
        self.items = store.insert(self.items, row, self.dims)
        self._graphs.pop("items", None)
        return self.items.agg(F.max("id")).first()[0]

    def delete(self, item_id: int) -> bool:
        return self._remove("items", item_id)

    def list_items(self) -> DataFrame:
        return store.listed(self.items)

    def items_3d(self) -> DataFrame:
        return manifold.pca_3d(self.items)

    def categories(self) -> DataFrame:
        return knn.categories(self.items)

    def benchmark(self, v: str | Sequence[float], k: int = 5, metric: str = "cosine") -> DataFrame:
        return knn.benchmark(self.items, self._vector(v), k, metric, graph_index=self.graph())

    def graph_info(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Layers with their entry points, nodes and edges."""
        index = self.graph()
        return graph.topology(index), graph.node_levels(index), graph.edges(index)

    def graph_topology(self) -> DataFrame:
        return graph.with_coordinates(graph.node_levels(self.graph()), self.items_3d())

    def graph_trace(self, v: str | Sequence[float], k: int = 5, ef: int = 50, metric: str = "cosine") -> DataFrame:
        query = self.spark.createDataFrame([(0, self._vector(v))], "qid long, emb array<double>")
        return graph.trace(self.graph(), query, k, ef, metric)

    def cluster_analytics(self) -> DataFrame:
        return manifold.clusters(self.items_3d())

    def metric_compare(self, v: str | Sequence[float], k: int = 5) -> DataFrame:
        return knn.compare_metrics(self.items, self._vector(v), k)

    def stats(self) -> dict:
        sq8, docs = quantize.stats(self.items).first(), quantize.stats(self.documents).first()
        words = self.token_stats().first()
        return {
            "count": sq8["count"],
            "dims": self.dims,
            "algorithms": list(knn.ALGORITHMS),
            "metrics": ["euclidean", "cosine", "manhattan"],
            "sq8": sq8.asDict(),
            "doc_index": {"chunk_count": docs["count"], "bm25_doc_count": words["doc_count"], "bm25_token_count": words["token_count"], "sq8_saved_bytes": docs["saved_bytes"]},
        }

    def save(self, path: str) -> dict:
        return {"saved_vectors": store.save(self.items, f"{path}/vectors"), "saved_docs": store.save(self.documents, f"{path}/documents")}

    def load(self, path: str) -> None:
        """Documents as saved; of the items those that the seed does not have are added to it."""
        self.items = store.restore(store.seed_items(self.spark), store.load(self.spark, f"{path}/vectors"))
        self.documents = store.load(self.spark, f"{path}/documents", store.CHUNK)
        self._graphs.clear()

    def persist_status(self, path: str) -> dict:
        return {k: store.snapshot_info(self.spark, f"{path}/{k}") for k in ("vectors", "documents")}

    # ---- documents

    def doc_insert(self, title: str, text: str, strategy: str = "fixed", percentile: float = semantic.PERCENTILE) -> int:
        doc = self.spark.createDataFrame([(0, title, text)], "id long, title string, text string")
        cut = chunks(doc, self.embed, strategy, percentile).coalesce(1).sortWithinPartitions("place")
        before = self.documents.count()
        self.documents = store.insert(self.documents, cut.select(F.lit(0).cast("long").alias("id"), "title", "text", "emb"))
        self._graphs.pop("documents", None)
        return self.documents.count() - before

    def semantic_preview(self, text: str, percentile: float = semantic.PERCENTILE) -> DataFrame:
        doc = self.spark.createDataFrame([(0, text)], "id long, text string")
        return semantic.semantic_preview(doc, self.embed, percentile)

    def doc_list(self) -> DataFrame:
        return self.documents.select("id", "title", tx.preview(F.col("text"), 120).alias("preview"), tx.word_count(F.col("text")).alias("words")).orderBy("id")

    def doc_delete(self, doc_id: int) -> bool:
        return self._remove("documents", doc_id)

    def token_stats(self) -> DataFrame:
        return lexical.corpus(self.documents.select("id", lexical.indexed_text().alias("content")))

    def doc_search(self, question: str, k: int = 3, max_dist: float = 0.9) -> DataFrame:
        asked = self._asked(question)
        return self._with_chunks(fusion.vector_hits(asked, self.documents, k, max_dist, self._near(asked, 2 * k)))

    def hybrid_search(self, question: str, k: int = 3, rrf_k: int = fusion.RRF_K) -> DataFrame:
        hits = self._with_chunks(self._hybrid(question, k, rrf_k))
        return hits.withColumn("text", tx.preview(F.col("text"), 200))

    def doc_rerank(self, question: str, k: int = 5, strategy: str = "cross") -> DataFrame:
        return rerank(self._candidates(question, 3 * k), strategy, self.generate, k).withColumn("text", tx.preview(F.col("text"), 150)).orderBy("new_rank")

    def advanced_search(self, question: str, k: int = 3, pipeline: str = "vector", strategy: str = "cross") -> DataFrame:
        """id, title, text, score, rank; score is a distance for vector and hyde."""
        if pipeline == "hybrid":
            return self._with_chunks(self._hybrid(question, k))
        if pipeline == "rerank":
            best = rerank(self._candidates(question, max(10, 3 * k)), strategy, self.generate, k)
            return best.select("id", "title", "text", F.col("rerank_score").alias("score"), F.col("new_rank").alias("rank"), "original_rank", "reasoning").orderBy("rank")
        if pipeline == "hyde" and self.generate is not None:
            row = self.spark.createDataFrame([(question,)], "q string")
            reply = generate_column(tx.passage_prompt(F.col("q")), self.generate)
            question = row.select(tx.passage(F.col("q"), reply).alias("p")).first()[0]
        return self.doc_search(question, k)

    def ask(self, question: str, k: int = 3, pipeline: str = "vector", strategy: str = "cross", ground: bool = True) -> dict:
        """The answer, what it was given, and how far it is grounded. Needs a generating model."""
        if self.generate is None or not self.available():
            raise RuntimeError("no generating model is available")
        times = [time.perf_counter()]
        found = [r.asDict() for r in self.advanced_search(question, k, pipeline, strategy).collect()]
        times.append(time.perf_counter())
        row = self.spark.createDataFrame([(question, [(f["title"], f["text"]) for f in found])], "q string, c array<struct<title:string,text:string>>")
        answer = self.generate([row.select(tx.answer_prompt(F.col("q"), F.col("c"))).first()[0]])[0]
        times.append(time.perf_counter())
        report, marked = None, answer
        if ground and found and not answer.startswith("ERROR"):
            contexts = self.spark.createDataFrame([(0, i, f["id"], f["title"], f["text"]) for i, f in enumerate(found)], "aid long, place long, doc_id long, title string, text string")
            matches = staged(grounding.match(self.spark.createDataFrame([(0, answer)], "aid long, answer string"), contexts, self.embed), "grounding")
            summary = grounding.report(matches).first()
            if summary:
                report = summary.asDict() | {"rows": [r.asDict() for r in matches.orderBy("sentence_no").collect()], "cited": [r.asDict() for r in grounding.cited(matches).orderBy("sentence_no").collect()]}
                marked = summary["annotated_answer"]
        times.append(time.perf_counter())
        names = ("retrieval_ms", "generation_ms", "grounding_ms")
        return {"answer": answer, "annotated_answer": marked, "pipeline": pipeline, "contexts": found, "grounding": report, "latencies": {n: round((b - a) * 1000, 1) for n, a, b in zip(names, times, times[1:], strict=False)}}

    def status(self) -> dict:
        return {"model_available": self.available(), "items": self.items.count(), "documents": self.documents.count(), "dims": self.dims}

    # ---- inside

    def _vector(self, v: str | Sequence[float]) -> list[float]:
        if isinstance(v, str):
            v = self.spark.createDataFrame([(v,)], "v string").select(knn.parse_vector(F.col("v"))).first()[0]
        if len(v) != self.dims:
            raise ValueError(f"the vector must have {self.dims} dimensions")
        return list(map(float, v))

    def _asked(self, question: str) -> DataFrame:
        return self.spark.createDataFrame([(0, question, list(map(float, self.embed([question])[0])))], "qid long, text string, emb array<double>")

    def _near(self, asked: DataFrame, k: int) -> DataFrame:
        rows = self.documents.where(F.size("emb") > 0)
        return fusion.routed(asked, rows, k, self.graph("documents") if rows.count() >= fusion.FEW else None)

    def _hybrid(self, question: str, k: int, rrf_k: int = fusion.RRF_K) -> DataFrame:
        asked = self._asked(question)
        return fusion.hybrid(asked, self.documents, k, rrf_k, self._near(asked, 4 * k))

    def _with_chunks(self, hits: DataFrame) -> DataFrame:
        score = "dist" if "dist" in hits.columns else "score"
        joined = self.documents.join(F.broadcast(hits), "id")  # k rows
        return joined.select("id", "title", "text", F.round(score, 6).alias("score"), "rank").orderBy("rank")

    def _candidates(self, question: str, n: int) -> DataFrame:
        hits = self._hybrid(question, n).withColumnRenamed("rank", "original_rank")
        joined = self.documents.join(F.broadcast(hits), "id")
        return joined.select(F.lit(0).cast("long").alias("qid"), F.lit(question).alias("query"), "id", "title", "text", "original_rank")
