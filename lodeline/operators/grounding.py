"""Grounding: each sentence of an answer is held against the sentences of its context documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.functions.models import Embed, hashing_embedder, vectors

GROUNDED, PARTIAL = 0.68, 0.50
#: Places of the similarities that sources are ranked by.
PLACES = 12
#: Sentences of a document that meet an answer at a time, and rows of them that a model gets at once.
PART, ROWS = 32, 256
#: Answers that a document's sentences are dealt to together.
ANSWERS = 256


def similarities(a: Sequence[Sequence[float]], d: Sequence[Sequence[float]]) -> np.ndarray:
    """Clamped cosine similarities of vectors a (down) to d (across): 0 for unlike or zero ones, not a
    number for empty ones."""
    sizes = {len(x) for x in a} | {len(x) for x in d}
    if len(sizes) > 1 or 0 in sizes:
        one = lambda x, y: similarities([x], [y])[0, 0] if len(x) == len(y) else 0.0
        return np.array([[one(x, y) if len(x) and len(y) else np.nan for y in d] for x in a]).reshape(len(a), len(d))
    a, d = (np.asarray(x, float).reshape(len(x), -1 if len(x) else 0) for x in (a, d))
    if not len(a) or not len(d):
        return np.zeros((len(a), len(d)))
    scale = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((d * d).sum(1))[None, :]
    return np.where(scale == 0, 0.0, np.clip(a @ d.T / np.where(scale == 0, 1.0, scale), -1.0, 1.0))


def rounded(sims: np.ndarray) -> np.ndarray:
    """To PLACES places, halves away from zero as SQL rounds them (NumPy takes the even neighbour)."""
    return np.copysign(np.floor(np.abs(sims) * 10.0**PLACES + 0.5) / 10.0**PLACES, sims)


def embedded(embed: Embed, texts: pa.Array) -> Sequence[Sequence[float]]:
    """Vectors of texts, of which the model gets equal ones once."""
    texts = texts.dictionary_encode()
    found, of = vectors(embed, texts.dictionary.to_pylist()), texts.indices.to_numpy()
    return found[of] if isinstance(found, np.ndarray) else [found[i] for i in of]


def match(answers: DataFrame, contexts: DataFrame, embed: Embed = hashing_embedder, grounded: float = GROUNDED, partial: float = PARTIAL, sources: DataFrame | None = None) -> DataFrame:
    """answers (aid, answer), contexts (aid, place, doc_id, title, text) -> aid, sentence_no,
    sentence, citation_id, source_doc_id, source_title, source_sentence, confidence, status.
    With sources (doc_id, title, text) contexts need aid, place and doc_id only: each document is then
    cut into sentences once, and its answers come to it, up to ANSWERS at a place.

    The source is the most similar context sentence, of those equal to PLACES places the first by
    place and sentence; citations count the distinct documents by their first place, and are null for
    ungrounded sentences. Answers without context documents give nothing."""
    asked = tx.claims(answers.select("aid", F.col("answer").alias("text")), out="asked").select("aid", "asked")
    cited = contexts.groupBy("aid", "doc_id").agg(F.min("place").alias("first"))
    cited = cited.withColumn("citation", F.row_number().over(Window.partitionBy("aid").orderBy("first")).cast("long")).drop("first")
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "citation"))
    asked = asked.join(cited.groupBy("aid").agg(F.map_from_entries(F.collect_list(known)).alias("cites")), "aid")
    if sources is None:
        both = tx.claims(contexts.select("aid", "place", "doc_id", "title", "text"), out="told").drop("text").join(asked, "aid")  # texts are dealt once
    else:
        many = contexts.groupBy("doc_id").agg(F.ceil(F.count("*") / ANSWERS).cast("int").alias("salts"))
        told = tx.claims(sources.select("doc_id", "title", "text").join(many, "doc_id"), out="told").drop("text")
        told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        asks = contexts.select("aid", "place", "doc_id").join(many, "doc_id").withColumn("salt", F.pmod(F.xxhash64("aid"), "salts").cast("int")).drop("salts")
        both = asks.join(asked, "aid").join(told, ["doc_id", "salt"])
    both = both.withColumn("citation", F.try_element_at("cites", "doc_id"))
    both = both.withColumn("told", F.when(F.col("citation").isNull(), F.array().cast("array<string>")).otherwise(F.col("told")))
    # long documents in parts; one without sentences has one empty part
    parts = F.sequence(F.lit(0), F.greatest(F.size("told") - 1, F.lit(0)), F.lit(PART))
    both = both.withColumn("from", F.explode(parts)).withColumn("told", F.slice("told", F.col("from") + 1, PART))
    kept = ["aid", "place", "doc_id", "title", "citation", "from"]
    types = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", sentence_no int, sentence string, no int, source string, sim double, ranked double"

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pc.sort_indices(b, [("doc_id", "ascending"), ("from", "ascending")]))  # a document's sentences meet all its answers
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                a_text, d_text = (part.column(c).flatten() for c in ("asked", "told"))
                a, d = (embedded(embed, x) for x in (a_text, d_text))
                a_end, d_end = (np.concatenate([[0], np.cumsum(part.column(c).value_lengths().to_numpy())]) for c in ("asked", "told"))
                at, sims = [], []
                for r in range(part.num_rows):
                    sim = similarities(a[a_end[r] : a_end[r + 1]], d[d_end[r] : d_end[r + 1]])
                    ranked = rounded(np.where(np.isnan(sim), -2.0, sim))
                    best = ranked.argmax(1) if sim.shape[1] else np.full(len(sim), -1)  # the first of equals
                    sims.append(np.take_along_axis(sim, best[:, None], 1)[:, 0] if sim.shape[1] else np.full(len(sim), np.nan))
                    at.append(best)
                row, no, sim = np.repeat(np.arange(part.num_rows), np.diff(a_end)), np.concatenate(at), np.concatenate(sims)
                none = np.isnan(sim)
                spot = pa.array(d_end[row] + no, mask=none)
                columns = [part.column(c).take(pa.array(row)) for c in kept]
                columns += [pa.array(np.arange(len(row)) - a_end[row], pa.int32()), a_text, pa.array(no, pa.int32(), mask=none), d_text.take(spot), pa.array(sim, mask=none), pa.array(rounded(sim), mask=none)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "sentence_no", "sentence", "no", "source", "sim", "ranked"])

    found = both.select(*kept, "asked", "told").mapInArrow(nearest_of, schema)
    source = F.when(F.col("sim").isNotNull(), F.struct("doc_id", "title", "source", "citation", "sim"))
    # similarities that are equal differ in the last places by their norms' roots; places decide then
    nearest = F.when(F.col("sim").isNotNull(), F.struct("ranked", (-F.col("place")).alias("p"), (-F.col("from") - F.col("no")).alias("n")))
    top = found.groupBy("aid", "sentence_no", "sentence").agg(F.max_by(source, nearest).alias("top"))
    confidence = F.round(F.greatest(F.coalesce("top.sim", F.lit(0.0)), F.lit(0.0)), 4)
    rows = top.withColumn("confidence", confidence)
    rows = rows.withColumn("status", F.when(F.col("confidence") >= grounded, "grounded").when(F.col("confidence") >= partial, "partial").otherwise("ungrounded"))
    return rows.select(
        "aid",
        F.col("sentence_no").cast("long").alias("sentence_no"),
        "sentence",
        F.when(F.col("status") != "ungrounded", F.col("top.citation")).alias("citation_id"),
        F.col("top.doc_id").alias("source_doc_id"),
        F.col("top.title").alias("source_title"),
        F.col("top.source").alias("source_sentence"),
        "confidence",
        "status",
    )


def report(matches: DataFrame) -> DataFrame:
    """matches -> aid, sentences, overall_confidence, grounding_rate, annotated_answer."""
    marked = F.concat("sentence", F.when(F.col("citation_id").isNotNull(), F.concat(F.lit(" ["), F.col("citation_id").cast("string"), F.lit("]"))).otherwise(""))
    rows = F.sort_array(F.collect_list(F.struct("sentence_no", marked.alias("marked"))))
    # in whole ten-thousandths, so that the mean and its rounding are exact in any order
    units, n = F.sum(F.round(F.col("confidence") * 10000).cast("long")), F.count("*")
    return matches.groupBy("aid").agg(
        n.alias("sentences"),
        (F.floor((2 * units + n) / (2 * n)) / 10000).alias("overall_confidence"),
        F.round(F.count_if(F.col("status") == "grounded") / F.count("*") * 100, 1).alias("grounding_rate"),
        F.array_join(F.transform(rows, lambda x: x["marked"]), " ").alias("annotated_answer"),
    )


def cited(matches: DataFrame) -> DataFrame:
    """aid, citation_id, doc_id, title, confidence: each cited document with its first sentence.
    A document of id 0 is never listed."""
    w = Window.partitionBy("aid", "source_doc_id").orderBy("sentence_no")
    rows = matches.where((F.col("status") != "ungrounded") & (F.col("source_doc_id") != 0))
    rows = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select("aid", "citation_id", F.col("source_doc_id").alias("doc_id"), F.col("source_title").alias("title"), "confidence", "sentence_no")
