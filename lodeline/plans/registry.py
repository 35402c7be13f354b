"""The queries over the test tables, each with the same query in SQL (DuckDB's dialect).

Searches take every row whose id is divisible by 20 as a query, against all rows; a search for one
vector takes vec_id 0. Items are the embeddings, chunks the documents, questions the benchmark's
passages, answers the assistant's turns. Vectors of texts come from the offline hashing embedder.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as tx
from lodeline.functions.models import embed_column, generate_column, hashing_embedder
from lodeline.operators import distance, fusion, graph, grounding, kdtree, knn, lexical, manifold, quantize, semantic
from lodeline.operators.rerank import rerank
from lodeline.plans.engine import Engine
from lodeline.scratch import spread, stage_path, staged
from lodeline.sources import store
from lodeline.streaming.ingest import chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("vec_"), "vec_id").alias("metadata"), F.col("label").cast("string").alias("category"), F.col("embedding").alias("emb"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return items(spark, sf_dir).where("id = 0").first()["emb"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return spread(d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"))


def embedded(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("emb", embed_column(F.col(text), hashing_embedder))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def plain(c: Column) -> Column:
    """Zero without sign."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), "emb")


# ---- pieces of SQL --------------------------------------------------------------------------

ITEMS = "items as (select vec_id as id, 'vec_' || vec_id as metadata, label::varchar as category, embedding::double[] as emb from embeddings)"
Q0 = "q as (select emb as v from items where id = 0)"
COS = "(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
EUC = "list_distance({a}, {b})"
MAN = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


def _near(dist: str, where: str = "true", k: int = 5) -> str:
    return f"with {ITEMS}, {Q0}, d as (select id, metadata, category, {dist.format(a='emb', b='v')} as dist from items, q where {where}) select id, metadata, category, round(dist, 6) as dist from (select * from d order by dist, id limit {k})"


STOP = "[" + ", ".join(f"'{w}'" for w in lexical.STOP_WORDS) + "]"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: length(w) > 1 and not list_contains({STOP}, w))"


def _embed(table: str, key: str, text: str, name: str) -> str:
    """CTE name(key, emb) of hashing vectors."""
    return f"""
    {name}_t as (select {key}, unnest({_tokens(text)}) as w from {table}),
    {name}_b as (select {key}, ('0x' || substr(md5(w), 1, 8))::bigint % 64 as b, count(*)::double as n from {name}_t group by all),
    {name}_g as (select {key}, map_from_entries(list((b, n))) as m from {name}_b group by {key}),
    {name} as (select t.{key}, list_transform(range(64), lambda i: coalesce(g.m[i], 0.0)) as emb from {table} t left join {name}_g g using ({key}))"""


DOCS = "docs as (select doc_id as id, source as title, text, source || ' ' || text as content from documents)"
QUESTIONS = "qs as (select item_id as qid, text from benchmark)"


def _bm25(k: int) -> str:
    return f"""
    tk as (select id, {_tokens('content')} as w from docs),
    st as (select count(*) as n, avg(len(w)) as avgdl from tk),
    tf as (select id, token, dl, count(*) as tf from (select id, len(w) as dl, unnest(w) as token from tk) group by all),
    idf as (select token, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from tf, st group by token, n),
    qt as (select qid, token, count(*) as times from (select qid, unnest({_tokens('text')}) as token from qs) group by all),
    bs as (select qid, id, sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1))))) as score
           from tf join idf using (token) join qt using (token), st group by all),
    bm as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from bs qualify rank <= {k})"""


def _hybrid(k: int, legs: int, rrf_k: int = 60) -> str:
    dist = COS.format(a="d.emb", b="q.emb")
    zero = "(sqrt(list_dot_product(d.emb, d.emb)) < 1e-9 or sqrt(list_dot_product(q.emb, q.emb)) < 1e-9)"
    return f"""{DOCS}, {QUESTIONS}, {_embed('docs', 'id', 'text', 'de')}, {_embed('qs', 'qid', 'text', 'qe')}, {_bm25(legs)},
    vd as (select q.qid, d.id, case when {zero} then 1.0 else {dist} end as dist from de d, qe q),
    vr as (select *, row_number() over (partition by qid order by round(dist, 12), id) as rank from vd qualify rank <= {legs}),
    rrf as (select coalesce(v.qid, b.qid) as qid, coalesce(v.id, b.id) as id, coalesce(1.0::double / ({rrf_k} + v.rank), 0) + coalesce(1.0::double / ({rrf_k} + b.rank), 0) as score, v.rank as vr, b.rank as br
            from vr v full join bm b on v.qid = b.qid and v.id = b.id),
    hy as (select qid, id, score, row_number() over (partition by qid order by score desc, vr nulls last, br nulls last) as rank from rrf qualify rank <= {k})"""


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _glue(pieces: str, least: int) -> str:
    """CTEs from pieces(id, p list) to sentences(id, sentences list)."""
    return f"""
    px as (select id, unnest(p) as s, generate_subscripts(p, 1) as i from {pieces}),
    ph as (select *, sum(case when i = 1 or len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '')) >= {least} then 1 else 0 end) over (partition by id order by i) as g from px),
    sj as (select id, g, string_agg(s, ' ' order by i) as sentence from ph group by id, g)"""


#: Stands for dots that end no sentence, in the SQL only.
_DOT = chr(2)


def _chunk_sentences(table: str) -> str:
    t = _strip("coalesce(text, '')")
    t = rf"regexp_replace({t}, '\r\n|\r', chr(10), 'g')"
    for a in tx.ABBREVIATIONS:
        parts = a.rstrip(".").split(".")
        found, put = r"\.".join(f"({p})" for p in parts) + r"\.", "".join(f"\\{i + 1}{_DOT}" for i in range(len(parts)))
        t = f"regexp_replace({t}, '{found}', '{put}', 'gi')"
    t = rf"regexp_replace({t}, '(\d+)\.(\d+)', '\1{_DOT}\2', 'g')"
    cut = rf"string_split(regexp_replace({t}, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1))"
    whole = _strip(f"replace(x, '{_DOT}', '.')")
    piece = f"list_filter(list_transform({cut}, lambda x: {whole}), lambda x: x <> '')"
    return f"pc as (select id, {piece} as p from {table}), {_glue('pc', 2)}"


def _claim_sentences(table: str, name: str = "") -> str:
    t = _strip("coalesce(text, '')")
    cut = rf"""string_split(regexp_replace({t}, '([.!?])\s+([A-Z0-9"''(\[])|([.!?])\n+', '\1\3' || chr(1) || '\2', 'g'), chr(1))"""
    piece = f"list_filter(list_transform({cut}, lambda x: {_strip('x')}), lambda x: x <> '')"
    body = f"pc as (select id, {piece} as p from {table}), {_glue('pc', 3)}"
    for c in ("pc", "px", "ph", "sj"):
        body = body.replace(f"{c} as", f"{name}{c} as").replace(f"from {c}", f"from {name}{c}")
    return body


# ---- nearest neighbours ---------------------------------------------------------------------


@query(_near(COS))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.hits(knn.search(items(spark, sf_dir), first_vector(spark, sf_dir), 5, "cosine", "bruteforce"))


def _batched(dist: str, k: int = 5, where: str = "true") -> str:
    """Every asked vector against all items."""
    return f"""with {ITEMS}, d as (select q.id as qid, i.id, i.category, round({dist.format(a='i.emb', b='q.emb')}, 12) as dist from items i, items q where q.id % 20 = 0 and ({where})),
    r as (select *, row_number() over (partition by qid order by dist, id) as rank from d)
    select qid, id, case when round(dist, 6) = 0 then 0.0 else round(dist, 6) end as dist, rank from r where rank <= {k}"""


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", plain(F.round("dist", 6)).alias("dist"), "rank")


@query(_batched(COS))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.search_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5))


@query(_batched(EUC))
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.search_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5, "euclidean"))


@query(_batched(MAN))
def knn_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.search_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5, "manhattan"))


@query(_batched(EUC))
def kdtree_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees, by a metric that has no such name and so is Euclidean."""
    return shown(knn.by_index(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5, "no such metric", "kdtree"))


@query(_batched(COS))
def kdtree_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of half of the items, to which the other half is added."""
    rows = items(spark, sf_dir)
    cuts, leaves = kdtree.build(rows.where("id % 2 = 0"))
    cuts = staged(cuts, "kd-cuts")
    leaves = staged(kdtree.insert(cuts, leaves, rows.where("id % 2 = 1")), "kd-leaves")
    return shown(kdtree.search(cuts, leaves, asked_vectors(spark, sf_dir), 5))


@query(_near(COS, k=10))
def hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector by graph search, with the breadth of 50 that finds all of the nearest here."""
    return knn.hits(knn.search(items(spark, sf_dir), first_vector(spark, sf_dir), 10, None, "hnsw"))


@query(
    f"""with {ITEMS}, d as (select q.id as qid, i.id, i.category, round({COS.format(a='i.emb', b='q.emb')}, 12) as dist from items i, items q where q.id % 20 = 0),
    r as (select *, row_number() over (partition by qid order by dist, id) as near from d),
    f as (select *, row_number() over (partition by qid order by dist, id) as rank from r where near <= 25 and category = '3')
    select qid, id, case when round(dist, 6) = 0 then 0.0 else round(dist, 6) end as dist, rank from f where rank <= 5"""
)
def knn_filter_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.search_filtered_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5, category=" 3 "))


@query(f"with f as ({_near(COS, k=25)}) select * from f where category = '3' order by dist, id limit 5")
def knn_filter_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.hits(knn.search_filtered(items(spark, sf_dir), first_vector(spark, sf_dir), 5, category=" 3 "))


@query(_batched(COS, where="i.category = '3'"))
def knn_filter_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(knn.search_filtered_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5, category="3", push_down=True))


@query(
    f"""with {ITEMS}, q as (select id as qid, emb as v from items where id % 20 = 0), d as (
      select qid, 'cosine' as metric, id, metadata, round({COS.format(a='emb', b='v')}, 5) as dist from items, q
      union all select qid, 'euclidean', id, metadata, round({EUC.format(a='emb', b='v')}, 5) from items, q
      union all select qid, 'manhattan', id, metadata, round({MAN.format(a='emb', b='v')}, 5) from items, q)
    select * replace (case when dist = 0 then 0.0 else dist end as dist) from (select *, row_number() over (partition by qid, metric order by dist, id) as rank from d) where rank <= 5"""
)
def metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.compare_metrics_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5)


@query("select position as place, value from (select unnest([1.5, -2.0, 3.0]) as value, unnest([0, 1, 2]) as position)")
def parse_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One literal with blanks in it; one with a bad token gives no rows."""
    rows = spark.createDataFrame([(" 1.5, -2 ,,3e0 ",), ("1,x",), ("",)], "v string")
    return rows.select(F.posexplode(knn.parse_vector(F.col("v"))).alias("place", "value"))


@query("select distinct label::varchar as category from embeddings order by 1")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.categories(items(spark, sf_dir))


@query("select vec_id as id, 'vec_' || vec_id as metadata, label::varchar as category, len(embedding)::bigint as dims from embeddings order by vec_id")
def items_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listed(items(spark, sf_dir)).select("id", "metadata", "category", F.size("emb").cast("long").alias("dims"))


@query("select unnest(['bruteforce', 'kdtree', 'hnsw']) as algo, true as timed, (select count(*) from embeddings) as item_count")
def benchmark_algos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search by each index; the times themselves differ from run to run."""
    row = knn.benchmark(items(spark, sf_dir), first_vector(spark, sf_dir))
    each = F.array(*[F.struct(F.lit(a).alias("algo"), (F.col(f"{a}_us") > 0).alias("timed")) for a in knn.ALGORITHMS])
    return row.select("item_count", F.inline(each))


@query(
    "select min(id)::bigint as first_id, max(id)::bigint as last_id, count(*) as n, count(distinct id) as ids from "
    "(select vec_id as id from embeddings where vec_id % 7 <> 0 union all select (select max(vec_id) from embeddings where vec_id % 7 <> 0) + row_number() over () from embeddings)"
)
def insert_delete_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = items(spark, sf_dir)
    left = store.delete(every, every.where("id % 7 = 0"))
    return store.insert(left, every, 64).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


# ---- quantisation ---------------------------------------------------------------------------

SQ8 = "p as (select min(list_min(embedding))::float as lowest, ((max(list_max(embedding))::float - min(list_min(embedding))::float)::float::double / 255)::float as scale from embeddings)"
CODE = "list_transform(embedding, lambda x: greatest(least(round_even(((x - lowest)::float::double / scale)::float::double, 0) - 128, 127), -128)::bigint)"


@query(f"with {SQ8} select lowest::double as lowest, scale::double as scale from p")
def sq8_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.parameters(items(spark, sf_dir)).select(F.col("lowest").cast("double").alias("lowest"), F.col("scale").cast("double").alias("scale"))


@query(f"with {SQ8} select vec_id as id, generate_subscripts({CODE}, 1)::bigint - 1 as pos, unnest({CODE}) as code from embeddings, p")
def sq8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantize.encode(items(spark, sf_dir)).select("id", F.posexplode("code").alias("pos", "code"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.col("code").cast("long").alias("code"))


@query(f"with {SQ8}, c as (select vec_id as id, {CODE} as code, lowest, scale from embeddings, p) select id, generate_subscripts(code, 1)::bigint - 1 as pos, round(unnest(list_transform(code, lambda c: (c + 128)::double * scale::double + lowest::double)), 6) as value from c")
def sq8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantize.encode(items(spark, sf_dir))
    rows = rows.select("id", F.posexplode(quantize.decode(F.col("code"), F.col("scale"), F.col("lowest"))).alias("pos", "value"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


_SQ8_NEAR = f"""{SQ8}, c as (select vec_id as id, embedding::double[] as emb, list_transform({CODE}, lambda c: (c + 128)::double * scale::double + lowest::double) as r from embeddings, p),
    d as (select q.id as qid, c.id, round(1 - list_dot_product(c.r, q.emb) / ((sqrt(list_dot_product(c.r, c.r)) + 1e-9) * (sqrt(list_dot_product(q.emb, q.emb)) + 1e-9)), 12) as dist from c, c q where q.id % 20 = 0),
    r as (select *, row_number() over (partition by qid order by dist, id) as rank from d)"""


@query(f"with {_SQ8_NEAR} select qid, id, round(dist, 6) as dist, rank from r where rank <= 5")
def sq8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(quantize.search_batch(asked_vectors(spark, sf_dir), items(spark, sf_dir), 5))


@query(f"with {_SQ8_NEAR} select id, round(dist, 6) as dist from r where qid = 0 and rank <= 5")
def sq8_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.search(items(spark, sf_dir), first_vector(spark, sf_dir), 5).select("id", F.round("dist", 6).alias("dist"))


@query(f"with e as (select * from embeddings where vec_id % 3 <> 0), {SQ8.replace('from embeddings', 'from e')} select lowest::double as lowest, scale::double as scale, (select count(*) from e) as count from p")
def sq8_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters after a third of the items has been deleted."""
    every = items(spark, sf_dir)
    left = store.delete(every, every.where("id % 3 = 0"))
    p = quantize.parameters(left).select(F.col("lowest").cast("double").alias("lowest"), F.col("scale").cast("double").alias("scale"))
    return p.crossJoin(left.agg(F.count("*").alias("count")))  # one row each


@query(
    f"""with {SQ8} select count(*) as count, max(len(embedding))::bigint as dims, (count(*) * max(len(embedding)) * 4)::bigint as float32_bytes, (count(*) * max(len(embedding)))::bigint as int8_bytes,
    (count(*) * max(len(embedding)) * 3)::bigint as saved_bytes, 4.0::double as compression_ratio, round(any_value(scale)::double, 8) as scale, round(any_value(lowest)::double, 8) as zero_point from embeddings, p"""
)
def sq8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.stats(items(spark, sf_dir))


# ---- lexical and hybrid search --------------------------------------------------------------


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", lexical.indexed_text().alias("content"))


@query(f"with {DOCS}, t as materialized (select id, {_tokens('content')} as w from docs) select id, token, count(*) as tf, dl from (select id, len(w)::bigint as dl, unnest(w) as token from t) group by id, token, dl")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_counts(contents(spark, sf_dir)).select("id", "token", "tf", "dl")


@query(f"with {DOCS}, t as (select len({_tokens('content')}) as n from docs) select count(*) as doc_count, sum(n)::bigint as token_count, round(avg(n), 6) as avgdl from t")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus(contents(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {DOCS}, t as (select distinct id, unnest({_tokens('content')}) as token from docs), n as (select count(*) as n from docs) select token, count(*) as df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) as idf from t, n group by token")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contents(spark, sf_dir)
    return lexical.idf(lexical.term_counts(docs), lexical.corpus(docs)).withColumn("idf", F.round("idf", 6))


@query(f"with {DOCS}, {QUESTIONS}, {_bm25(10)} select qid, id, round(score, 6) as score, rank from bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.score(questions(spark, sf_dir), contents(spark, sf_dir), 10)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_hybrid(3, 12)} select qid, id, round(score, 6) as score, rank from hy")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.hybrid(embedded(questions(spark, sf_dir)), embedded(documents(spark, sf_dir)), 3)
    return found.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {DOCS}, {QUESTIONS}, {_embed('docs', 'id', 'text', 'de')}, {_embed('qs', 'qid', 'text', 'qe')},
    d as (select q.qid, d.id, {COS.format(a='d.emb', b='q.emb')} as dist from de d, qe q where list_sum(d.emb) > 0 and list_sum(q.emb) > 0),
    r as (select *, row_number() over (partition by qid order by round(dist, 12), id) as rank from d)
    select qid, id, case when round(dist, 6) = 0 then 0.0 else round(dist, 6) end as dist, rank from r where rank <= 3 and dist <= 0.9"""
)
def doc_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fusion.vector_hits(embedded(questions(spark, sf_dir)), embedded(documents(spark, sf_dir)), 3)
    return found.select("qid", "id", plain(F.round("dist", 6)).alias("dist"), "rank")


# ---- texts ----------------------------------------------------------------------------------

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"


@query(
    f"""with w as (select doc_id as id, text, {WORDS} as w from documents),
    c as (select id, case when len(w) = 0 then [] when len(w) <= 250 then [text]
      else list_transform(range(0, (ceil((len(w) - 250) / 220.0) + 1)::bigint), lambda i: array_to_string(w[i * 220 + 1 : i * 220 + 250], ' ')) end as c from w)
    select id, generate_subscripts(c, 1)::bigint - 1 as place, unnest(c) as chunk from c"""
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.fixed_chunks(documents(spark, sf_dir)).select("id", F.posexplode("chunks").alias("place", "chunk"))
    return rows.withColumn("place", F.col("place").cast("long"))


@query(f"select doc_id as id, source as title, text[:120] || case when length(text) > 120 then '…' else '' end as preview, len({WORDS})::bigint as words from documents")
def doc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", "title", tx.preview(F.col("text"), 120).alias("preview"), tx.word_count(F.col("text")).cast("long").alias("words"))


@query(f"with {DOCS}, {_chunk_sentences('docs')} select id, (g - 1)::bigint as place, sentence from sj")
def sentences_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.sentences(documents(spark, sf_dir)).select("id", F.posexplode("sentences").alias("place", "sentence"))
    return rows.withColumn("place", F.col("place").cast("long"))


@query(f"with {DOCS}, {_claim_sentences('docs')} select id, (g - 1)::bigint as place, sentence from sj")
def sentences_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.claims(documents(spark, sf_dir)).select("id", F.posexplode("sentences").alias("place", "sentence"))
    return rows.withColumn("place", F.col("place").cast("long"))


_CURVE = f"""{DOCS}, {_chunk_sentences('docs')}, sk as (select id * 100000 + g as key, id, g, sentence from sj), {_embed('sk', 'key', 'sentence', 'se')},
    sv as (select sk.id, sk.g, se.emb, lead(se.emb) over (partition by sk.id order by sk.g) as nxt from sk join se using (key)),
    cv as (select id, (g - 1)::bigint as place, round(case when list_sum(emb) = 0 or list_sum(nxt) = 0 then 1.0 else 1 - greatest(least(list_dot_product(emb, nxt) / (sqrt(list_dot_product(emb, emb)) * sqrt(list_dot_product(nxt, nxt))), 1), -1) end, 4) as dist
           from sv where nxt is not null)"""


@query(f"with {_CURVE} select * from cv")
def distance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.semantic_preview(documents(spark, sf_dir)).select("id", F.posexplode("distances").alias("place", "dist"))
    return rows.withColumn("place", F.col("place").cast("long"))


@query(f"with {_CURVE}, o as (select id, list_sort(list(dist)) as d from cv group by id) select id, d[least(len(d) * 75 // 100, len(d) - 1) + 1] as threshold, len(d)::bigint as n from o")
def split_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.semantic_preview(documents(spark, sf_dir))
    return rows.where(F.size("distances") > 0).select("id", "threshold", F.size("distances").cast("long").alias("n"))


def _folded(rounded: bool) -> str:
    """CTEs to fd(id, g, chunk): each sentence's chunk, by going through a document's sentences."""
    d = "1 - greatest(least(list_dot_product(emb, nxt) / (sqrt(list_dot_product(emb, emb)) * sqrt(list_dot_product(nxt, nxt))), 1), -1)"
    d = f"case when list_sum(emb) = 0 or list_sum(nxt) = 0 then 1.0 else {d} end"
    return f"""{DOCS}, {_chunk_sentences('docs')}, sk as (select id * 100000 + g as key, id, g, sentence from sj), {_embed('sk', 'key', 'sentence', 'se')},
    sv as (select sk.id, sk.g, len(list_filter(string_split_regex(sk.sentence, '\\s+'), lambda w: w <> '')) as n, sk.sentence, se.emb, lead(se.emb) over (partition by sk.id order by sk.g) as nxt from sk join se using (key)),
    dv as (select id, g, {'round(' + d + ', 4)' if rounded else d} as dist from sv where nxt is not null),
    th as (select id, d[least(len(d) * 75 // 100, len(d) - 1) + 1] as t from (select id, list_sort(list(dist)) as d from dv group by id)),
    nx as materialized (select sv.id, sv.g::bigint as g, sv.n, dv.dist >= th.t as far from sv left join dv on dv.id = sv.id and dv.g = sv.g - 1 left join th on th.id = sv.id),
    fd as (select id, g, n as size, 0 as chunk from nx where g = 1
           union all select nx.id, nx.g, case when (nx.far and fd.size >= 25) or fd.size + nx.n > 350 then nx.n else fd.size + nx.n end,
                            fd.chunk + case when (nx.far and fd.size >= 25) or fd.size + nx.n > 350 then 1 else 0 end
           from fd join nx on nx.id = fd.id and nx.g = fd.g + 1)"""


@query(
    f"""with recursive {_folded(False)}, ct as (select id, count(*) as n from sj group by id)
    select fd.id, fd.chunk::bigint as place, case when any_value(ct.n) = 1 then {_strip('any_value(docs.text)')} else string_agg(sv.sentence, ' ' order by fd.g) end as chunk
    from fd join sv on sv.id = fd.id and sv.g = fd.g join ct on ct.id = fd.id join docs on docs.id = fd.id group by fd.id, fd.chunk"""
)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_chunks(documents(spark, sf_dir))


@query(
    f"""with recursive {_folded(True)},
    ch as (select fd.id, fd.chunk, string_agg(sv.sentence, ' ' order by fd.g) as text, sum(sv.n)::bigint as words, (min(fd.g) - 1)::bigint as first, (max(fd.g) - 1)::bigint as last
           from fd join sv on sv.id = fd.id and sv.g = fd.g group by fd.id, fd.chunk)
    select ch.id, coalesce(th.t, 0.0)::double as threshold, sum(last - first + 1) over (partition by ch.id)::bigint as sentence_count, count(*) over (partition by ch.id) as chunk_count, text, words, first, last
    from ch left join th using (id)"""
)
def semantic_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.semantic_preview(documents(spark, sf_dir))
    return rows.select("id", "threshold", "sentence_count", "chunk_count", F.inline("chunks"))


# ---- re-ranking and generation --------------------------------------------------------------

_CROSS = r"""
    cd as (select hy.qid, qs.text as query, docs.id, docs.title, docs.text, hy.rank as original_rank from hy join qs using (qid) join docs using (id)),
    ck as (select *, list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1) as q, lower(title || ' ' || text) as doc, lower(title) as lt from cd),
    cm as (select *, list_filter(q, lambda w: list_contains(regexp_extract_all(doc, '[\p{L}\p{N}_]+'), w)) as hit from ck),
    cs as (select *, case when len(q) = 0 then 0.0 else round(least(1.0, len(hit) / len(q) * 0.4
      + case when contains(doc, lower(query)) then 0.25 else 0.0 end
      + case when len(q) >= 2 then len(list_filter(range(1, len(q)), lambda i: contains(doc, q[i] || ' ' || q[i + 1]))) / (len(q) - 1) * 0.2 else 0.0 end
      + case when len(list_filter(q, lambda w: contains(lt, w))) > 0 then 0.15 else 0.0 end
      + least(coalesce(list_sum(list_transform(hit, lambda w: least((length(doc) - length("replace"(doc, w, ''))) / length(w), 5))), 0) / (len(q) * 3 + 1), 0.2)), 4) end as rerank_score from cm)"""


def candidates(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    asked, docs = questions(spark, sf_dir), documents(spark, sf_dir)
    found = fusion.hybrid(embedded(asked), embedded(docs), n).withColumnRenamed("rank", "original_rank")
    return found.join(asked.withColumnRenamed("text", "query"), "qid").join(docs, "id").select("qid", "query", "id", "title", "text", "original_rank")


@query(f"with {_hybrid(10, 40)}, {_CROSS} select qid, id, original_rank, rerank_score from cs")
def cross_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.cross_score(candidates(spark, sf_dir, 10), "rerank_score").select("qid", "id", "original_rank", "rerank_score")


@query(f"with {_hybrid(10, 40)}, {_CROSS} select qid, id, original_rank, rerank_score, row_number() over (partition by qid order by rerank_score desc, original_rank) as new_rank from cs qualify new_rank <= 3")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank(candidates(spark, sf_dir, 10), k=3).select("qid", "id", "original_rank", "rerank_score", "new_rank")


@query(f"with {_hybrid(3, 12, 10)} select hy.qid, hy.id, docs.title, docs.text[:200] || case when length(docs.text) > 200 then '…' else '' end as preview, round(hy.score, 6) as score, hy.rank from hy join docs using (id)")
def hybrid_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid route with a caller's constant, and previews of 200 characters."""
    docs = documents(spark, sf_dir)
    found = fusion.hybrid(embedded(questions(spark, sf_dir)), embedded(docs), 3, rrf_k=10)
    return found.join(docs, "id").select("qid", "id", "title", tx.preview(F.col("text"), 200).alias("preview"), F.round("score", 6).alias("score"), "rank")


@query(
    f"""with {_hybrid(15, 60)}, {_CROSS}
    select qid, id, text[:150] || case when length(text) > 150 then '…' else '' end as preview, rerank_score, 'The document shares ' || (trunc(rerank_score * 100))::int || '% of the query''s words and phrases.' as reasoning,
           row_number() over (partition by qid order by rerank_score desc, original_rank) as new_rank from cs qualify new_rank <= 5"""
)
def rerank_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The re-ranking route: three times as many candidates, reasons, previews of 150 characters."""
    return rerank(candidates(spark, sf_dir, 15), k=5).select("qid", "id", tx.preview(F.col("text"), 150).alias("preview"), "rerank_score", "reasoning", "new_rank")


def handbook(prompts: list[str]) -> list[str]:
    """Stands in for a model that writes passages: the question itself, behind a lead-in."""
    return ["Sure!: " + p.split(": ", 1)[1].rsplit("\n", 1)[0] for p in prompts]


@query(
    f"""with {_hybrid(10, 40)}, {_CROSS},
    rr as (select qid, id, row_number() over (partition by qid order by rerank_score desc, original_rank) as rank from cs qualify rank <= 3),
    ve as (select qid, id, rank from vr where rank <= 3 and dist <= 0.9)
    select 'vector' as pipeline, qid, id, rank from ve union all select 'hyde', qid, id, rank from ve
    union all select 'hybrid', qid, id, rank from (select qid, id, row_number() over (partition by qid order by score desc, vr nulls last, br nulls last) as rank from (
      select coalesce(v.qid, b.qid) as qid, coalesce(v.id, b.id) as id, coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as score, v.rank as vr, b.rank as br
      from (select * from vr where rank <= 12) v full join (select * from bm where rank <= 12) b on v.qid = b.qid and v.id = b.id)) where rank <= 3
    union all select 'rerank', qid, id, rank from rr"""
)
def advanced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four pipelines over all questions; the passages of hyde come from handbook."""
    asked, docs = questions(spark, sf_dir), staged(embedded(documents(spark, sf_dir)), "embedded")
    own = embedded(asked)
    passages = asked.select("qid", tx.passage(F.col("text"), generate_column(tx.passage_prompt(F.col("text")), handbook)).alias("text"))
    found = {
        "vector": fusion.vector_hits(own, docs, 3),
        "hyde": fusion.vector_hits(embedded(passages), docs, 3),
        "hybrid": fusion.hybrid(own, docs, 3),
        "rerank": rerank(candidates(spark, sf_dir, 10), k=3).withColumnRenamed("new_rank", "rank"),
    }
    return functools.reduce(DataFrame.unionByName, (f.select(F.lit(name).alias("pipeline"), "qid", "id", "rank") for name, f in found.items()))


#: Turns as a model's replies: graded by their length where it is even, without grade otherwise.
_REPLY = "case when length(text) % 2 = 0 then 'Reasoning: ' || text || chr(10) || 'score: ' || (length(text) % 130) / 10 else text end"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    graded = F.concat(F.lit("Reasoning: "), "text", F.lit("\nscore: "), ((F.length("text") % 130) / 10).cast("string"))
    return turns.select("conv_id", "turn", "text", F.when(F.length("text") % 2 == 0, graded).otherwise(F.col("text")).alias("reply"))


@query(
    rf"""with r as (select conv_id, turn, {_REPLY} as reply from conversations)
    select conv_id, turn, round(least(greatest(coalesce(try_cast(nullif(regexp_extract(reply, '(?i)Score:\s*([0-9]+(?:\.[0-9]+)?)', 1), '') as double), 5.0), 0), 10) / 10, 4) as grade,
    case when regexp_extract(reply, '(?i)Reasoning:\s*([^\n\r]+)', 1) <> '' then {_strip(r"regexp_extract(reply, '(?i)Reasoning:\s*([^\n\r]+)', 1)")}
         when {_strip("split_part(reply, chr(10), 1)")} <> '' and not starts_with({_strip("split_part(reply, chr(10), 1)")}, 'Score') then {_strip("split_part(reply, chr(10), 1)")}
         else '{tx.NO_REASON}' end as reason from r"""
)
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies(spark, sf_dir).select("conv_id", "turn", tx.grade(F.col("reply")).alias("grade"), tx.grade_reason(F.col("reply")).alias("reason"))


_LEAD_INS = "|".join(tx.LEAD_INS).replace("'", "''")


@query(
    rf"""with r as (select conv_id, turn, text, case turn % 4 when 0 then 'Sure!: ' || text when 1 then 'ERROR: ' || text when 2 then '  here is a paragraph: ' || text else '' end as reply from conversations)
    select conv_id, turn, case when reply = '' or starts_with(reply, 'ERROR') or c = '' then text else c end as passage
    from (select *, regexp_replace({_strip('reply')}, '^({_LEAD_INS}):\s*', '', 'i') as c from r)"""
)
def hyde_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, n = read(spark, sf_dir, "conversations"), F.col("turn") % 4
    reply = F.when(n == 0, F.concat(F.lit("Sure!: "), "text")).when(n == 1, F.concat(F.lit("ERROR: "), "text")).when(n == 2, F.concat(F.lit("  here is a paragraph: "), "text")).otherwise("")
    return turns.select("conv_id", "turn", tx.passage(F.col("text"), reply).alias("passage"))


@query(
    f"""with {DOCS}, {QUESTIONS}, {_bm25(3)},
    c as (select bm.qid, string_agg('[' || rank || '] ' || title || ':' || chr(10) || docs.text, chr(10) || chr(10) order by rank) as c from bm join docs using (id) group by qid)
    select qs.qid, md5(case when c is null then '{tx.ANSWER_FREELY}' || chr(10) || qs.text || chr(10) || chr(10) || 'Answer:'
      else '{tx.ANSWER_RULES}' || chr(10) || chr(10) || 'Sources:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || qs.text || chr(10) || chr(10) || 'Answer:' end) as prompt_md5 from qs left join c using (qid)"""
)
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, docs = questions(spark, sf_dir), documents(spark, sf_dir)
    hits = lexical.score(asked, contents(spark, sf_dir), 3).join(docs, "id")
    found = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "text"))).alias("c"))
    rows = asked.join(found, "qid", "left")
    return rows.select("qid", F.md5(tx.answer_prompt(F.col("text"), F.col("c"))).alias("prompt_md5"))


# ---- grounding ------------------------------------------------------------------------------


def matches(spark: SparkSession, sf_dir: str, sources: DataFrame) -> DataFrame:
    """Every assistant's turn against the sources (id, title, text, content) that its words find best."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    answers = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("aid"), F.col("text").alias("answer"))
    hits = lexical.score(answers.select(F.col("aid").alias("qid"), F.col("answer").alias("text")), sources.select("id", "content"), 2)
    contexts = staged(hits.select(F.col("qid").alias("aid"), F.col("rank").alias("place"), F.col("id").alias("doc_id")), "hits")
    return grounding.match(answers, contexts, sources=sources.withColumnRenamed("id", "doc_id"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("passage").alias("title"), "text", F.col("text").alias("content"))


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("content", lexical.indexed_text())


_GROUND = f"""
    an as (select conv_id * 1000 + turn as id, text from conversations where role = 'assistant'),
    ps as (select item_id as id, text from benchmark),
    docs as (select id, '' as title, text, text as content from ps),
    qs as (select id as qid, text from an), {_bm25(2)},
    {_claim_sentences('an', 'a')}, {_claim_sentences('ps', 'p')},
    ak as (select id * 1000 + g as key, id as aid, g, sentence from asj), {_embed('ak', 'key', 'sentence', 'ae')},
    pk as (select id * 1000 + g as key, id, g, sentence from psj), {_embed('pk', 'key', 'sentence', 'pe')},
    pr as (select ak.aid, ak.g as no, ak.sentence, pk.id as doc_id, pk.sentence as source, bm.rank as place, pk.g as pg,
             case when list_sum(ae.emb) = 0 or list_sum(pe.emb) = 0 then 0.0 else greatest(least(list_dot_product(ae.emb, pe.emb) / (sqrt(list_dot_product(ae.emb, ae.emb)) * sqrt(list_dot_product(pe.emb, pe.emb))), 1), -1) end as sim
           from ak join ae using (key) join bm on bm.qid = ak.aid join pk on pk.id = bm.id join pe on pe.key = pk.key),
    tp as (select *, row_number() over (partition by aid, no order by round(sim, 12) desc, place, pg) as r, round(greatest(sim, 0), 4) as confidence from pr),
    mt as (select aid, (no - 1)::bigint as sentence_no, sentence, doc_id as source_doc_id, source as source_sentence, place, confidence,
             case when confidence >= 0.68 then 'grounded' when confidence >= 0.5 then 'partial' else 'ungrounded' end as status from tp where r = 1)"""


@query(f"with {_GROUND} select aid, sentence_no, sentence, confidence, status from mt")
def grounding_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir, passages(spark, sf_dir)).select("aid", "sentence_no", "sentence", "confidence", "status")


@query(
    f"""with {_GROUND} select aid, count(*) as sentences, ((2 * sum(round(confidence * 10000)::bigint) + count(*)) // (2 * count(*)))::double / 10000 as overall_confidence,
    round(count(*) filter (where status = 'grounded') / count(*) * 100, 1) as grounding_rate,
    string_agg(sentence || case when status <> 'ungrounded' then ' [' || place || ']' else '' end, ' ' order by sentence_no) as annotated_answer from mt group by aid"""
)
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.report(matches(spark, sf_dir, passages(spark, sf_dir)))


@query(
    f"""with {_GROUND}, fi as (select *, row_number() over (partition by aid, source_doc_id order by sentence_no) as n from mt where status <> 'ungrounded' and source_doc_id <> 0)
    select aid, source_doc_id as doc_id, place as citation_id, 'passage' as title, confidence, sentence_no from fi where n = 1"""
)
def grounding_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.cited(matches(spark, sf_dir, passages(spark, sf_dir)))


@query()
def grounding_match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark, sf_dir, document_sources(spark, sf_dir))
    return found.select("aid", "sentence_no", "sentence", "citation_id", "source_doc_id", "source_sentence", "confidence", "status")


@query()
def grounding_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.report(matches(spark, sf_dir, document_sources(spark, sf_dir)))


# ---- space and graph ------------------------------------------------------------------------


def _pca_sql() -> str:
    """The same power iteration over the centred rows' scatter matrix, step by step in SQL."""
    draw = random.Random(manifold.SEED)
    starts = [[draw.uniform(-1.0, 1.0) for _ in range(64)] for _ in range(3)]
    unit = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
    axes, kept = [], []
    for i, start in enumerate(starts):
        off = lambda v, kept=tuple(kept): functools.reduce(lambda e, a: f"(select list_transform(list_zip(o.v, {a}.v), lambda z: z[1] - list_dot_product(o.v, {a}.v) * z[2]) as v from {e} as o, {a})", kept, v)
        first = off(f"(select {start}::double[] as v)")
        step = off(f"(select list_transform((select rows from sc), lambda r: list_dot_product(r, w{i}.v)) as v)")
        axes.append(
            f"w{i} as (select 0 as k, {unit.format(v='o.v')} as v, false as still from {first} as o union all "
            f"select k, v, list_sum(list_transform(list_zip(v, was), lambda z: (z[1] - z[2]) ** 2)) < {manifold.STILL} as still "
            f"from (select w{i}.k + 1 as k, w{i}.v as was, (select {unit.format(v='o.v')} from {step} as o) as v from w{i} where w{i}.k < {manifold.ROUNDS} and not w{i}.still)),"
            f" a{i} as (select v from w{i} order by k desc limit 1)"
        )
        kept.append(f"a{i}")
    return f"""with recursive x as (select vec_id as id, label::varchar as category, embedding::double[] as e from embeddings),
    mu as (select list(m order by i) as v from (select i, avg(e[i]) as m from x, range(1, 65) t(i) group by i)),
    c as materialized (select id, category, list_transform(list_zip(e, (select v from mu)), lambda z: z[1] - z[2]) as e from x),
    sc as materialized (select list(r order by i) as rows from (select i, list(s order by j) as r from (select i, j, sum(e[i] * e[j]) as s from c, range(1, 65) a(i), range(1, 65) b(j) group by i, j) group by i)),
    {', '.join(axes)}
    select id, category, {', '.join(f"case when round(list_dot_product(e, (select v from a{i})), 4) = 0 then 0.0 else round(list_dot_product(e, (select v from a{i})), 4) end as {c}" for i, c in enumerate('xyz'))} from c"""


@query(_pca_sql())
def pca_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifold.pca_3d(items(spark, sf_dir)).select("id", "category", *[plain(F.col(c)).alias(c) for c in "xyz"])


@query(
    """with p as (select label::varchar as category, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
    m as (select category, avg(x) as mx, avg(y) as my, avg(z) as mz from p group by category),
    d as (select p.category, mx, my, mz, (x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2 as s from p join m using (category))
    select category, round(any_value(mx), 4) as cx, round(any_value(my), 4) as cy, round(any_value(mz), 4) as cz, round(sqrt(max(s)), 4) as radius, round(avg(s), 4) as variance, count(*) as count from d group by category"""
)
def cluster_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda i: F.get("emb", F.lit(i)).cast("double")
    return manifold.clusters(items(spark, sf_dir).select("category", own(0).alias("x"), own(1).alias("y"), own(2).alias("z")))


def graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(graph.build(items(spark, sf_dir)), "graph")


#: Draws of the levels, for as many nodes as a shard has at most, worked out apart from the builder.
_DRAWS = "[" + ", ".join(repr(x) for x in map((lambda r: lambda _: r.random())(random.Random(graph.SEED)), range(graph.SHARD_ROWS))) + "]"
_LEVELS = f"""sh as (select greatest(1, ((count(*) + {graph.SHARD_ROWS} - 1) // {graph.SHARD_ROWS})) as n from embeddings),
    nd as (select vec_id as id, vec_id % sh.n as shard, row_number() over (partition by vec_id % sh.n order by vec_id) as no from embeddings, sh),
    lv as (select id, shard, no, floor(-ln(({_DRAWS})[no]) / ln(16))::bigint as max_layer from nd)"""


@query(f"with {_LEVELS} select id, max_layer from lv")
def hnsw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_levels(graph_index(spark, sf_dir)).select("id", "max_layer")


@query(
    f"""with {_LEVELS}, tp as (select shard, max(max_layer) as height from lv group by shard), en as (select tp.height as layer, min(lv.no) as no, lv.shard from lv join tp on tp.shard = lv.shard and lv.max_layer = tp.height group by all)
    select layer, count(*) as nodes, (select list(lv.id order by lv.id) from en join lv using (shard, no) where en.layer = x.layer) is not null as has_entry, 0::bigint as too_many_links, 0::bigint as links_off_layer, 0::bigint as loops, 0::bigint as lonely
    from (select unnest(range(0, max_layer + 1)) as layer, shard from lv) x group by layer"""
)
def hnsw_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers, with what no layer may have: nodes with too many links, links between nodes that are
    not in the layer, links to oneself, and nodes that neither link nor are linked among several."""
    index = graph_index(spark, sf_dir)
    e, nodes = staged(graph.edges(index), "graph-edges"), index.select("id", "max_layer")
    layers = graph.topology(index)
    most = F.when(F.col("layer") > 0, graph.LINKS).otherwise(graph.GROUND_LINKS)
    wide = e.groupBy("layer", "src").agg(F.count("*").alias("n")).where(F.col("n") > most).groupBy("layer").agg(F.count("*").alias("too_many_links"))
    ends = e.join(nodes.select(F.col("id").alias("src"), F.col("max_layer").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("max_layer").alias("b")), "dst")
    off = ends.groupBy("layer").agg(F.count_if((F.col("a") < F.col("layer")) | (F.col("b") < F.col("layer"))).alias("links_off_layer"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    there = index.select("shard", "id", F.explode(F.sequence(F.lit(0).cast("long"), "max_layer")).alias("layer"))
    several = there.groupBy("shard", "layer").agg(F.count("*").alias("n")).where("n > 1")
    linked = e.select("layer", F.explode(F.array("src", "dst")).alias("id")).distinct()
    lonely = there.join(several, ["shard", "layer"]).join(linked, ["layer", "id"], "left_anti").groupBy("layer").agg(F.count("*").alias("lonely"))
    rows = layers.join(wide, "layer", "left").join(off, "layer", "left").join(lonely, "layer", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("layer", "nodes", (F.size("entry_points") > 0).alias("has_entry"), *map(zero, ("too_many_links", "links_off_layer", "loops", "lonely")))


@query("select count(distinct vec_id) as nodes, count(distinct vec_id) as with_coordinates, 0::bigint as strangers from embeddings")
def hnsw_topology_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph with their places in space; strangers have another place than pca_3d gives."""
    rows = items(spark, sf_dir)
    points = manifold.pca_3d(rows).select("id", "x", "y", "z")
    nodes = graph.with_coordinates(graph.node_levels(graph_index(spark, sf_dir)), points)
    both = nodes.join(points.select("id", F.struct("x", "y", "z").alias("p")), "id", "left")
    placed = (F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)
    return both.agg(F.count_distinct("id").alias("nodes"), F.count_if(placed).alias("with_coordinates"), F.count_if(~F.struct("x", "y", "z").eqNullSafe(F.col("p"))).alias("strangers"))


_EXACT = f"""{ITEMS}, ex as (select q.id as qid, i.id, {COS.format(a='i.emb', b='q.emb')} as dist from items i, items q where q.id % 20 = 0)"""


@query(f"with {_EXACT} select count(distinct qid) * 5 as answers, 0::bigint as wrong_distances, 0::bigint as out_of_order, true as recall_of_095 from ex")
def hnsw_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph search for every asked vector, held against the exact scan."""
    asked, rows = asked_vectors(spark, sf_dir), items(spark, sf_dir)
    found = staged(graph.search(graph_index(spark, sf_dir), asked, 5, 50), "graph-found")
    exact = knn.search_batch(asked, rows, 5).select("qid", "id", F.lit(True).alias("right"))
    at = found.join(rows.select("id", "emb"), "id").join(asked.select("qid", F.col("emb").alias("v")), "qid")
    at = at.withColumn("wrong", F.abs(distance.cosine(F.col("emb"), F.col("v")) - F.col("dist")) > 1e-9).join(exact, ["qid", "id"], "left")
    at = at.withColumn("before", F.lag("dist").over(Window.partitionBy("qid").orderBy("rank")))
    recall = F.count_if("right") >= 0.95 * F.count("*")
    return at.agg(F.count("*").alias("answers"), F.count_if("wrong").alias("wrong_distances"), F.count_if(F.col("before") > F.col("dist")).alias("out_of_order"), recall.alias("recall_of_095"))


@query("select count(distinct vec_id) as left_over, 0::bigint as dangling, true as every_shard_has_its_entry, 0::bigint as found_gone from embeddings where vec_id % 4 <> 0")
def hnsw_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph without every fourth item: no link leads to one, and no search finds one."""
    rows = items(spark, sf_dir)
    gone = rows.where("id % 4 = 0").select("id")
    index = staged(graph.delete(graph_index(spark, sf_dir), gone), "graph-left")
    dangling = graph.edges(index).join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").agg(F.count("*").alias("dangling"))
    shards = index.groupBy("shard").agg(F.count_if("entry").alias("n")).agg((F.min("n") == 1).alias("every_shard_has_its_entry"))
    found = graph.search(index, asked_vectors(spark, sf_dir), 5).agg(F.count_if(F.col("id") % 4 == 0).alias("found_gone"))
    # one row each
    return index.agg(F.count("*").alias("left_over")).crossJoin(dangling).crossJoin(shards).crossJoin(found)


@query(
    f"with {_LEVELS} select qid, 1::bigint as entries, 5::bigint as results, 0::bigint as gaps, 0::bigint as wrong_distances, 0::bigint as upward, true as begins_at_top from (select vec_id as qid from embeddings where vec_id % 20 = 0), (select max(max_layer) as h from lv)"
)
def hnsw_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of every asked vector: events without gaps that begin at the top, never go up again,
    and name the right distances. Summed up over shards: one of them each has its entry and results."""
    asked, rows = asked_vectors(spark, sf_dir), items(spark, sf_dir)
    index = graph_index(spark, sf_dir)
    t = graph.trace(index, asked, 5, 50).join(index.where("entry").select("shard", "height"), "shard")
    t = t.join(rows.select(F.col("id").alias("node"), "emb"), "node").join(asked.select("qid", F.col("emb").alias("v")), "qid")
    # vectors go before the events are sorted
    t = t.withColumn("wrong", F.abs(F.round(distance.cosine(F.col("emb"), F.col("v")), 5) - F.col("dist")) > 2e-5).drop("emb", "v")
    order = Window.partitionBy("qid", "shard").orderBy("step")
    t = t.withColumns({"before": F.lag("layer").over(order), "last": F.lag("step").over(order)})
    own = t.groupBy("qid", "shard").agg(
        F.count_if(F.col("type") == "entry").alias("entries"), F.count_if(F.col("type") == "result").alias("results"), F.count_if(F.col("step") != F.coalesce(F.col("last") + 1, F.lit(0))).alias("gaps"),
        F.count_if("wrong").alias("wrong_distances"), F.count_if(F.col("layer") > F.col("before")).alias("upward"), F.min_by(F.col("layer") == F.col("height"), "step").alias("begins_at_top"),
    )
    return own.groupBy("qid").agg(*[F.max(c).alias(c) for c in ("entries", "results", "gaps", "wrong_distances", "upward")], F.bool_and("begins_at_top").alias("begins_at_top"))


@query("select vec_id as id, 'vec_' || vec_id as metadata, label::varchar as category, round(list_sum(embedding::double[]), 4) as total from embeddings")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "snapshot")
    store.save(items(spark, sf_dir).withColumn("emb", F.col("emb").cast("array<double>")), path)
    total = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x)
    return store.load(spark, path).select("id", "metadata", "category", F.round(total, 4).alias("total"))


@query("select count(*) as n, max(id)::bigint as last_id from (select i as id from range(1, 21) t(i) union all select 20 + row_number() over () from embeddings)")
def restore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = store.seed_items(spark)
    snapshot = items(spark, sf_dir).withColumn("emb", F.col("emb").cast("array<double>")).unionByName(seed)
    return store.restore(seed, snapshot).agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("select (select count(*) from embeddings) as count, (select count(*) from documents) as chunks, (select count(distinct label) from embeddings) as categories")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = items(spark, sf_dir).agg(F.count("*").alias("count"), F.count_distinct("category").alias("categories"))
    return counted.crossJoin(documents(spark, sf_dir).agg(F.count("*").alias("chunks"))).select("count", "chunks", "categories")  # one row each


@query(
    f"""with w as (select doc_id as id, source as title, text, {WORDS} as w from documents),
    c as (select id, title, case when len(w) = 0 then [] when len(w) <= 250 then [text]
      else list_transform(range(0, (ceil((len(w) - 250) / 220.0) + 1)::bigint), lambda i: array_to_string(w[i * 220 + 1 : i * 220 + 250], ' ')) end as c from w)
    select id as doc_id, generate_subscripts(c, 1)::bigint - 1 as place, title || case when len(c) > 1 then ' [' || generate_subscripts(c, 1) || '/' || len(c) || ']' else '' end || ' (fixed)' as title, md5(unnest(c)) as text_md5, 64::bigint as dims from c"""
)
def doc_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(documents(spark, sf_dir))
    return rows.select("doc_id", "place", "title", F.md5("text").alias("text_md5"), F.size("emb").cast("long").alias("dims"))


@query("select count(*) as documents, sum(length(text))::bigint as characters, (select count(*) + 20 from embeddings) as items, true as saved_over_itself, true as told, 0::bigint as missing from documents")
def service_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service saves, another loads, adds nothing and saves to the same place, a third one loads."""
    path = stage_path(spark, "service")
    docs, own = embedded(documents(spark, sf_dir)), items(spark, sf_dir).withColumn("emb", F.col("emb").cast("array<double>"))
    first = Engine(spark, own.unionByName(store.seed_items(spark)), docs, 64)
    first.save(path)
    second = Engine(spark, dims=64)
    second.load(path)
    counts = second.save(path)
    third = Engine(spark, dims=64)
    third.load(path)
    told = all(x["exists"] and x["size_bytes"] > 0 for x in third.persist_status(path).values())
    lost = documents(spark, sf_dir).join(third.documents.select("id", "text"), ["id", "text"], "left_anti")
    sums = third.documents.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
    row = sums.crossJoin(third.items.agg(F.count("*").alias("items"))).crossJoin(lost.agg(F.count("*").alias("missing")))  # one row each
    return row.withColumns({"saved_over_itself": F.col("documents") == counts["saved_docs"], "told": F.lit(told)})


@query("select vec_id as id, 'vec_' || vec_id as metadata, label::varchar as category, round(list_sum(embedding::double[]), 4) as total from embeddings")
def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "json")
    store.save_json(items(spark, sf_dir).withColumn("emb", F.col("emb").cast("array<double>")), path, 64)
    total = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x)
    return store.load_json(spark, path).select("id", "metadata", "category", F.round(total, 4).alias("total"))


@query("select false as model_available, (select count(*) from embeddings) as items, (select count(*) from documents) as documents, 64::bigint as dims")
def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = Engine(spark, items(spark, sf_dir), documents(spark, sf_dir), 64).status()
    return spark.createDataFrame([status], "model_available boolean, items long, documents long, dims long")


@query(f"with docs as (select doc_id as id, source || ' ' || text as content from documents where doc_id % 5 <> 0), t as materialized (select {_tokens('content')} as w from docs) select count(*) as doc_count, sum(len(w))::bigint as token_count, round(avg(len(w)), 6) as avgdl from t")
def bm25_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics after every fifth document has been deleted."""
    docs = documents(spark, sf_dir)
    left = store.delete(docs, docs.where("id % 5 = 0"))
    return lexical.corpus(left.select("id", lexical.indexed_text().alias("content"))).withColumn("avgdl", F.round("avgdl", 6))


@query("select count(*) * 6 as answers, 0::bigint as wrong_distances, 0::bigint as out_of_order from benchmark")
def vector_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by the index that their number calls for, here the graph, for all questions."""
    asked, docs = embedded(questions(spark, sf_dir)), staged(embedded(documents(spark, sf_dir)), "embedded")
    found = fusion.routed(asked, docs, 6).join(docs.select("id", "emb"), "id").join(asked.select("qid", F.col("emb").alias("v")), "qid")
    found = found.withColumn("before", F.lag("dist").over(Window.partitionBy("qid").orderBy("rank")))
    wrong = F.abs(distance.cosine(F.col("emb"), F.col("v")) - F.col("dist")) > 1e-9
    return found.agg(F.count("*").alias("answers"), F.count_if(wrong).alias("wrong_distances"), F.count_if(F.col("before") > F.col("dist")).alias("out_of_order"))
