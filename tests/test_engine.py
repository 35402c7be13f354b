import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline import scratch
from lodeline.functions import text as tx
from lodeline.functions.models import hashing_embedder
from lodeline.operators import distance, fusion, graph, grounding, kdtree, knn, lexical, manifold, quantize, semantic
from lodeline.operators.rerank import rerank
from lodeline.plans import registry
from lodeline.plans.engine import Engine
from lodeline.sources import store
from lodeline.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


# ---- queries against SQL --------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


# ---- distances ------------------------------------------------------------------------------


def test_zero_vector_has_cosine_distance_one(spark):
    assert value(spark, distance.cosine(distance.vector([0, 0]), distance.vector([1, 2]))) == 1.0


def test_metric_names():
    assert [distance.metric_name(x) for x in (None, "", "COSINE", "Manhattan", "typo")] == ["cosine", "cosine", "cosine", "manhattan", "euclidean"]


def test_clamped_guards(spark):
    a, none = distance.vector([1, 0]), distance.vector([])
    assert value(spark, distance.clamped_distance(a, none)) == 1.0
    assert value(spark, distance.clamped_similarity(a, distance.vector([1, 0, 0]))) == 0.0
    assert value(spark, distance.clamped_similarity(a, a)) == 1.0


@pytest.mark.parametrize("name", distance.METRICS)
def test_matrix_and_column_agree(spark, name):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 8))
    assert value(spark, distance.metric(name)(distance.vector(a), distance.vector(b))) == pytest.approx(distance.table(a[None], b[None], name)[0, 0])


# ---- search ---------------------------------------------------------------------------------


def test_neighbours_share_the_category(spark):
    e = Engine(spark)
    found = e.search([0.9, 0.85, 0.72, 0.68] + [0.1] * 12, 5).collect()
    assert {r["category"] for r in found} == {"cs"} and found[0]["id"] == 1


def test_filter_after_the_search_may_give_fewer(spark):
    q = list(store.SEED_ROWS[0][2])
    items = store.seed_items(spark)
    assert knn.search_filtered(items, q, 1, category="sports").count() == 0
    assert knn.search_filtered(items, q, 1, category="sports", push_down=True).count() == 1
    assert knn.search_filtered(items, q, 2, category="   ").count() == 2
    assert [r["category"] for r in knn.search_filtered(items, q, 2, category=" CS ").collect()] == ["cs", "cs"]


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        knn.search(store.seed_items(spark), [0.0] * 16, 0)


def test_blocks_of_queries_give_the_same(spark):
    items = registry.items(spark, SF)
    asked = registry.asked_vectors(spark, SF)
    one = knn.search_batch(asked, items, 3).collect()
    many = knn.search_batch(asked, items, 3, query_bytes=100, query_block=4).collect()
    assert sorted(one) == sorted(many) and len(one) == 75
    short = spark.createDataFrame([(900, [1.0, 0.0]), (901, []), (902, None)], "qid long, emb array<double>")
    pair = spark.createDataFrame([(7, [0.0, 2.0]), (8, [3.0, 0.0])], "id long, emb array<double>")
    both, rows = asked.unionByName(short), items.select("id", F.col("emb").cast("array<double>")).unionByName(pair)
    assert sorted(knn.search_batch(both, rows, 3).collect()) == sorted([*one, (900, 8, 0.0, 1), (900, 7, 1.0, 2)])
    assert knn.search_batch(asked.limit(0), items).count() == 0


@pytest.mark.parametrize("s, want", [("1, 2,,3", [1.0, 2.0, 3.0]), ("1,x", []), ("", []), (" 4 ", [4.0])])
def test_parse_vector(spark, s, want):
    assert value(spark, knn.parse_vector(F.lit(s))) == want


# ---- quantisation ---------------------------------------------------------------------------


def test_flat_collection_comes_back_too_high(spark):
    rows = quantize.encode(spark.createDataFrame([(1, [2.0, 2.0])], "id long, emb array<float>"))
    r = rows.select("code", quantize.decode(F.col("code"), F.col("scale"), F.col("lowest")).alias("v")).first()
    assert list(r["code"]) == [0, 0] and r["v"] == [130.0, 130.0]


def test_decoding_is_near(spark):
    rows = quantize.encode(registry.items(spark, SF)).select("emb", "scale", quantize.decode(F.col("code"), F.col("scale"), F.col("lowest")).alias("v")).toPandas()
    worst = max(np.abs(np.array(a) - np.array(b)).max() for a, b in zip(rows["emb"], rows["v"], strict=True))
    assert worst <= rows["scale"][0] / 2 * 1.001


def test_empty_stats(spark):
    r = quantize.stats(spark.createDataFrame([], store.ITEM)).first()
    assert (r["count"], r["float32_bytes"], r["scale"], r["compression_ratio"]) == (0, 0, None, 4.0)


# ---- lexical and hybrid ---------------------------------------------------------------------


def test_repeated_query_tokens_count_twice(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "")], "id long, content string")
    asked = spark.createDataFrame([(0, "apple"), (1, "apple apple"), (2, "the of")], "qid long, text string")
    got = {r["qid"]: r["score"] for r in lexical.score(asked, docs).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert set(got) == {0, 1}
    assert got[0] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (4 / 3))))
    assert got[1] == pytest.approx(2 * got[0])


def test_fusion_ties_prefer_vector_hits(spark):
    v = spark.createDataFrame([(0, 7, 1)], "qid long, id long, rank long")
    b = spark.createDataFrame([(0, 3, 1)], "qid long, id long, rank long")
    assert [r["id"] for r in fusion.merge(v, b, 2).orderBy("rank").collect()] == [7, 3]


# ---- texts ----------------------------------------------------------------------------------


def test_fixed_chunks(spark):
    rows = tx.fixed_chunks(texts(spark, " ".join(["w"] * 250) + " ", " ".join(f"w{i}" for i in range(251)), " \t", None)).orderBy("id").collect()
    assert rows[0]["chunks"] == [" ".join(["w"] * 250) + " "]
    assert [len(c.split()) for c in rows[1]["chunks"]] == [250, 31]
    assert rows[2]["chunks"] == [] and rows[3]["chunks"] == []


def test_sentences(spark):
    odd = "See e.g. this, i.e. that @@DOT@@ etc. and so on.\r\n  Then more here.   \n\n\tLast one, vs. the rest? Yes it is."
    rows = tx.sentences(texts(spark, odd)).first()["sentences"]
    assert rows == ["See e.g. this, i.e. that @@DOT@@ etc. and so on.", "Then more here.", "Last one, vs. the rest?", "Yes it is."]
    rows = tx.sentences(texts(spark, "Dr. Who has 3.14 pies. Yes. Two items. Here we go!\nNew line", "", None)).orderBy("id").collect()
    assert rows[0]["sentences"] == ["Dr. Who has 3.14 pies. Yes.", "Two items. Here we go!", "New line"]
    assert rows[1]["sentences"] == [] and rows[2]["sentences"] == []


def test_claims(spark):
    rows = tx.claims(texts(spark, "First one is here. no capital. Short. Last one is there.", "   ", "")).orderBy("id").collect()
    assert rows[0]["sentences"] == ["First one is here. no capital. Short.", "Last one is there."]
    assert rows[1]["sentences"] == [""] and rows[2]["sentences"] == []


def test_semantic_chunks_fall_back_without_vectors(spark):
    text = ". ".join(["One two three four five six seven"] * 50) + "."
    got = semantic.semantic_chunks(texts(spark, text, "Just one.", " "), lambda ts: [[] for _ in ts]).orderBy("id", "place").collect()
    words = text.split()
    assert [r["chunk"] for r in got] == [" ".join(words[:250]), " ".join(words[220:]), "Just one."]


def test_semantic_cuts():
    assert semantic.cuts([30, 10, 30, 400], [0.9, 0.1, 0.1], 0.9, 25, 350) == [0, 2]
    assert semantic.threshold([0.4, 0.1, 0.3, 0.2], 75) == 0.4
    with pytest.raises(ValueError):
        semantic.threshold([0.1], 101)


def test_preview_covers_all_sentences(spark):
    r = semantic.semantic_preview(registry.documents(spark, SF).limit(20)).collect()
    for x in r:
        assert [c["first"] for c in x["chunks"]] == [0, *(i + 1 for i in x["split_indices"])][: x["chunk_count"]]
        assert sum(c["last"] - c["first"] + 1 for c in x["chunks"]) == x["sentence_count"]


@pytest.mark.parametrize("reply, score, reason", [("Reasoning: good\nScore: 7.5", 0.75, "good"), ("score: 99", 1.0, "score: 99"), ("Score: -3", 0.5, tx.NO_REASON), ("fine", 0.5, "fine")])
def test_grades(spark, reply, score, reason):
    assert value(spark, tx.grade(F.lit(reply))) == score
    assert value(spark, tx.grade_reason(F.lit(reply))) == reason


@pytest.mark.parametrize("reply, want", [("ERROR: x", "q"), ("", "q"), (" Sure!: so it is", "so it is"), ("Sure!:", "q"), ("Sure! it is", "Sure! it is")])
def test_passages(spark, reply, want):
    assert value(spark, tx.passage(F.lit("q"), F.lit(reply))) == want


def test_rerank_by_grades(spark):
    rows = [(0, "q", 1, "t", "alpha", 1), (0, "q", 2, "t", "beta", 2), (0, "q", 3, "t", "gamma", 3)]
    c = spark.createDataFrame(rows, "qid long, query string, id long, title string, text string, original_rank long")
    got = rerank(c, "llm", lambda ps: ["Score: 9" if "beta" in p else "Score: 2" for p in ps], 2).orderBy("new_rank").collect()
    assert [(r["id"], r["rerank_score"]) for r in got] == [(2, 0.9), (1, 0.2)]
    assert [r["id"] for r in rerank(c, "llm", None, 3).orderBy("new_rank").collect()] == [1, 2, 3]


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "Red apples grow here. Nothing like that anywhere.")], "aid long, answer string")
    contexts = spark.createDataFrame([(1, 0, 0, "zero", "Red apples grow here."), (1, 1, 5, "five", "Blue pears rot there.")], "aid long, place long, doc_id long, title string, text string")
    m = grounding.match(answers, contexts).orderBy("sentence_no").collect()
    assert [(r["status"], r["citation_id"], r["source_doc_id"]) for r in m][0] == ("grounded", 1, 0)
    assert m[1]["status"] == "ungrounded" and m[1]["citation_id"] is None
    r = grounding.report(grounding.match(answers, contexts)).first()
    assert r["grounding_rate"] == 50.0 and r["annotated_answer"].startswith("Red apples grow here. [1] Nothing")
    assert grounding.cited(grounding.match(answers, contexts)).count() == 0


def test_scores_without_rows_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice([f"w{i}" for i in range(30)], n))
    docs = spark.createDataFrame([(i, text(1 + i % 20)) for i in range(200)] + [(200, ""), (201, "the")], "id long, content string").repartition(3)
    asked = spark.createDataFrame([(q, text(6)) for q in range(9)] + [(9, "the"), (10, "unheard")], "qid long, text string")
    own = lambda found: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in found.collect())
    got = lexical.score(asked, docs, 4)
    assert "Join" not in got._jdf.queryExecution().toString()
    tokens = asked.select("qid", F.explode(lexical.tokens(F.col("text"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("times"))
    want = own(lexical._ranked(lexical._joined(tokens, docs), 4))
    assert own(got) == want and len(want) == 36
    null = spark.createDataFrame([(0, "w1 w2"), (1, None)], "id long, content string")  # counts as a document
    assert own(lexical.score(spark.createDataFrame([(0, "w1")], "qid long, text string"), null)) == [(0, 1, 0, round(math.log(2), 9))]
    monkeypatch.setattr(lexical, "MOST_SENT", 10)
    assert own(lexical.score(asked, docs, 4)) == want


def test_sentences_meet_without_rows_of_pairs(spark):
    answers = spark.createDataFrame([(1, "Zebras eat green grass here.")], "aid long, answer string")
    long = " ".join(f"Sentence number {i} tells nothing." for i in range(70)) + " Zebras eat green grass. Zebras eat green grass."
    contexts = spark.createDataFrame([(1, 1, 5, "five", long), (1, 2, 6, "six", ""), (1, 3, None, "none", "Zebras eat green grass here.")], "aid long, place long, doc_id long, title string, text string")
    found = grounding.match(answers, contexts)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    assert [(r["source_doc_id"], r["source_sentence"], r["confidence"]) for r in found.collect()] == [(5, "Zebras eat green grass.", 0.8944)]
    odd = grounding.similarities([[1.0, 0.0], []], [[2.0, 0.0], [0.0, 0.0], [1.0], []])
    assert odd[0, :3].tolist() == [1.0, 0.0, 0.0] and np.isnan(odd[0, 3]) and np.isnan(odd[1]).all()


def test_grounding_takes_the_first_of_sources_alike_but_for_rounding(spark):
    answers = spark.createDataFrame([(1, "zebra")], "aid long, answer string")
    rows = [(1, 1, 5, "five", "alpha zebra"), (1, 2, 6, "six", "alpha zebra alpha zebra alpha zebra")]  # the second seems nearer by 1e-16
    contexts = spark.createDataFrame(rows, "aid long, place long, doc_id long, title string, text string")
    m = grounding.match(answers, contexts)
    assert [(r["source_doc_id"], r["citation_id"], r["confidence"]) for r in m.collect()] == [(5, 1, 0.7071)]
    assert grounding.report(m).first()["annotated_answer"] == "zebra [1]"
    assert [r["doc_id"] for r in grounding.cited(m).collect()] == [5]


def test_grounding_embeds_a_document_once_for_many_answers(spark, tmp_path):
    told = " ".join(f"Sentence w{i}0 tells of zebras." for i in range(20))
    rows = [(a, p, d, "t", told if d == 5 else f"Other words {a}.") for a in range(40) for p, d in ((1, 5), (2, 100 + a))]
    contexts = spark.createDataFrame(rows, "aid long, place long, doc_id long, title string, text string").coalesce(1)
    answers = spark.createDataFrame([(a, "Sentence w70 tells of zebras.") for a in range(40)], "aid long, answer string")

    def embed(texts):
        with open(f"{tmp_path}/log", "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return hashing_embedder(texts)

    found = grounding.match(answers, contexts, embed).collect()
    assert len(found) == 40 and {(r["source_doc_id"], r["source_sentence"], r["confidence"]) for r in found} == {(5, "Sentence w70 tells of zebras.", 1.0)}
    assert (tmp_path / "log").read_text().count("Sentence w80 tells") <= 8  # tasks


def test_grounding_cuts_a_cited_document_once_and_posts_words_once(spark, tmp_path, monkeypatch):
    told = " ".join(f"Sentence w{i}0 tells of zebras." for i in range(20))
    sources = spark.createDataFrame([(5, "t", told)] + [(100 + a, "t", f"Other words {a}.") for a in range(40)], "doc_id long, title string, text string")
    contexts = spark.createDataFrame([(a, p, d) for a in range(40) for p, d in ((1, 5), (2, 100 + a))], "aid long, place long, doc_id long").repartition(16)
    answers = spark.createDataFrame([(a, "Sentence w70 tells of zebras.") for a in range(40)], "aid long, answer string").repartition(16)

    def embed(texts):
        with open(f"{tmp_path}/log", "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return hashing_embedder(texts)

    row = lambda found: sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(grounding, "ANSWERS", 30)  # the forty answers in two parts
    got = row(grounding.match(answers, contexts, embed, sources=sources))
    assert got == row(grounding.match(answers, contexts.join(sources, "doc_id"))) and len(got) == 40
    assert (tmp_path / "log").read_text().count("Sentence w80 tells") <= 2
    # in turns: postings are made once for all of them
    asked = answers.select(F.col("aid").alias("qid"), F.concat("answer", F.lit(" "), F.col("aid").cast("string")).alias("text"))
    docs, names = sources.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), []
    want = row(lexical.score(asked, docs, 2).select("qid", "rank", "id"))
    monkeypatch.setattr(lexical, "MOST_SENT", 20)
    monkeypatch.setattr(lexical, "staged", lambda df, name: names.append(name) or scratch.staged(df, name))
    assert row(lexical.score(asked, docs, 2).select("qid", "rank", "id")) == want and names == ["postings"]


def test_grounding_cited_rounds_halves_as_its_sql(spark, tmp_path):
    answer = " ".join(["zebra"] * 22 + ["apple"] * 10 + ["pear"] * 3)  # 22 of the root of 593: a half in the 13th place
    rows = [(1, "zebra"), (2, " ".join(["zebra"] * 7) + ". " + " ".join(["Stone river"] * 40) + "."), *((i, "river") for i in range(3, 9))]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, "assistant", answer)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"select aid, citation_id, doc_id, title, confidence, sentence_no from ({registry.ORACLE_SQL['grounding_cited']})").fetchall()
    assert [(r[1], r[2]) for r in want] == [(2, 2)]
    got = registry.QUERIES["grounding_cited"](spark, str(tmp_path))
    assert [tuple(r) for r in got.select("aid", "citation_id", "doc_id", "title", "confidence", "sentence_no").collect()] == want


def test_grounding_in_documents_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    pool = [f"word{i}" for i in range(40)]
    sentence = lambda: "The " + " ".join(rng.choice(pool, 6)) + "."
    docs = {i: [sentence() for _ in range(int(rng.integers(1, 9)))] for i in range(30)}
    docs[29] = [sentence() for _ in range(400)]
    turns = {(c, 1): [docs[int(rng.integers(29))][0], sentence(), docs[29][399]] for c in range(8)}
    rows = [(i, " ".join(d), "en", f"site{i % 3}", 0) for i, d in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(c, t, "assistant", " ".join(x)) for (c, t), x in turns.items()] + [(0, 0, "user", "The question word1 word2?")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    cut = lambda s: [w for w in s.lower().replace(".", " ").split() if w not in lexical.STOP_WORDS]
    words = {i: cut(f"site{i % 3} " + " ".join(d)) for i, d in docs.items()}
    mean = sum(map(len, words.values())) / len(words)

    def weight(w, i):
        df, tf = sum(w in x for x in words.values()), words[i].count(w)
        return math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[i]) / mean))

    def cosine(a, b):
        x, y = map(np.array, hashing_embedder([a, b]))
        return float(x @ y / math.sqrt((x @ x) * (y @ y)))

    want = {}
    for (c, t), x in turns.items():
        asked = cut(" ".join(x))
        best = sorted(docs, key=lambda i: (-round(sum(weight(w, i) for w in asked), 9), i))[:2]
        for no, s in enumerate(x):
            want[c * 1000 + t, no] = s, round(max(cosine(s, o) for i in best for o in docs[i]), 4), best
    got = registry.QUERIES["grounding_match_documents"](spark, str(tmp_path)).collect()
    assert {(r["aid"], r["sentence_no"]) for r in got} == {*want}
    for r in got:
        s, confidence, best = want[r["aid"], r["sentence_no"]]
        assert r["sentence"] == s and r["confidence"] == pytest.approx(confidence, abs=1e-4) and r["source_doc_id"] in best
        assert r["source_sentence"] in docs[r["source_doc_id"]]
    assert any(r["source_doc_id"] == 29 for r in got)
    assert registry.QUERIES["grounding_report_documents"](spark, str(tmp_path)).count() == len(turns)


# ---- space and graph ------------------------------------------------------------------------


def test_axes_against_row_iteration(spark):
    items = store.seed_items(spark)
    x = np.array([v for _, _, v in store.SEED_ROWS])
    to = manifold.axes(len(x), x.sum(0), x.T @ x)
    assert np.allclose(to @ to.T, np.eye(3), atol=1e-6)
    got = manifold.pca_3d(items).orderBy("id").select("x", "y", "z").toPandas().to_numpy()
    assert np.allclose(got, (x - x.mean(0)) @ to.T, atol=6e-5)


def test_few_items_keep_their_first_components(spark):
    rows = spark.createDataFrame([(4, [0.5, 1.5]), (9, [2.0, 3.0])], "id long, emb array<double>")
    assert [tuple(r) for r in manifold.pca_3d(rows).orderBy("id").select("x", "y", "z").collect()] == [(0.5, 1.5, 0.0), (2.0, 3.0, 1.0)]


def test_seed_graph_is_complete(spark):
    e = Engine(spark)
    layers, nodes, _ = e.graph_info()
    assert [tuple(r) for r in layers.orderBy("layer").collect()] == [(0, 20, 190, []), (1, 4, 6, [2])]
    assert sorted(r["id"] for r in nodes.where("max_layer = 1").collect()) == [2, 10, 13, 20]


def test_graph_search_finds_the_neighbours():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    g = graph.Graph(list(range(300)), v)
    hit = 0
    for i in range(0, 300, 10):
        exact = np.argsort(distance.table(v[i][None], v, "cosine")[0])[:5]
        hit += len({x for _, x in g.search(v[i], 5)} & set(exact.tolist()))
    assert hit >= 0.95 * 150
    assert g.remove(g.entry) and not g.remove(-1) and len(g.search(v[0], 5)) == 5


def test_trace_gives_breadth_results_at_most():
    v = np.array([x for _, _, x in store.SEED_ROWS])
    events = graph.Graph(list(range(1, 21)), v).trace(v[0], 10, 3)
    assert sum(e["type"] == "result" for e in events) == 3 and events[0]["type"] == "entry"
    assert [e["step"] for e in events] == list(range(len(events)))


def test_benchmark_times_the_graph(spark, monkeypatch):
    asked, own = [], graph.search
    monkeypatch.setattr(graph, "search", lambda *a, **k: asked.append(1) or own(*a, **k))
    items = registry.items(spark, SF)
    r = knn.benchmark(items, registry.first_vector(spark, SF)).first()
    assert len(asked) == 1 and r["hnsw_us"] > 0 and r["item_count"] == items.count()


def test_shards_are_merged(spark):
    items, asked = registry.items(spark, SF), registry.asked_vectors(spark, SF)
    exact = {(r["qid"], r["id"]) for r in knn.search_batch(asked, items, 5).collect()}
    got = {(r["qid"], r["id"]) for r in graph.search(graph.build(items, 3), asked, 5).collect()}
    assert len(exact & got) >= 0.95 * len(exact)


def test_stored_graphs_answer_like_built_ones(spark):
    v = np.array([x for _, _, x in store.SEED_ROWS])
    own = graph.Graph(list(range(1, 21)), v)
    index = graph.build(store.seed_items(spark), 1)
    again = graph.Graph.restored(index.toPandas())
    assert (again.ids, again.top, again.entry, again.height) == (own.ids, own.top, own.entry, own.height)
    assert again.links == own.links and again.trace(v[7], 4, 6) == own.trace(v[7], 4, 6)
    gone = spark.createDataFrame([(own.ids[own.entry],), (5,), (99,)], "id long")
    left = graph.delete(index, gone)
    rows = {r["id"]: r for r in left.collect()}
    assert set(rows) == set(range(1, 21)) - {2, 5} and [i for i, r in rows.items() if r["entry"]] == [1]
    assert {r["height"] for r in rows.values()} == {1} and not {2, 5} & {x for r in rows.values() for layer in r["links"] for x in layer}
    asked = spark.createDataFrame([(0, [float(x) for x in v[1]]), (1, [1.0])], "qid long, emb array<double>")
    assert {r["qid"] for r in graph.search(left, asked, 3).collect()} == {0}
    more = graph.add(left, spark.createDataFrame([(21, [float(x) for x in v[1]])], "id long, emb array<double>"))
    assert graph.search(more, asked, 1).first()["id"] == 21


def test_levels_and_links_worked_out_by_hand():
    draws = [0.6394267984578837, 0.025010755222666936, 0.27502931836911926]  # of the seed
    assert graph.levels(3) == [int(-math.log(u) / math.log(16)) for u in draws] == [0, 1, 0]
    g = graph.Graph([10, 20, 30], np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.1]]))
    # the second node links with the first, the third with the nearer first, then the second
    assert [sorted(g.links[0][x]) for x in range(3)] == [[1, 2], [0, 2], [0, 1]] and g.links[0][2] == [0, 1]
    assert g.links[1] == {1: []} and g.entry == 1 and g.height == 1


@pytest.mark.parametrize("metric", distance.METRICS)
def test_trees_are_exact(metric):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(400, 3)), 1)
    v[:40], v[40:60] = 0.0, v[60]  # zero vectors and repeated ones
    ids = rng.permutation(400)
    cuts, leaves = kdtree.grow(kdtree._unit(v, metric), np.arange(400), 16)
    at, paths = zip(*leaves, strict=True)
    tree = kdtree.Tree(ids[list(at)], v[list(at)], list(paths), {p: (a, c) for p, a, c in cuts}, metric)
    measured = 0
    for q in [*v[::17], np.zeros(3), np.array([5.0, 5.0, 5.0])]:
        got, d, n = tree.search(q, 7)
        exact = np.round(distance.table(q[None], v, metric)[0], knn.PLACES)
        order = np.lexsort((ids, exact))[:7]
        assert tree.ids[got].tolist() == ids[order].tolist() and d.tolist() == exact[order].tolist()
        measured += n
    assert measured < 0.8 * 400 * 26  # sides are left out


def test_trees_over_tables(spark):
    items, asked = registry.items(spark, SF), registry.asked_vectors(spark, SF)
    exact = knn.search_batch(asked, items, 4, "manhattan").collect()
    for shards in (1, 3):
        assert sorted(kdtree.search(*kdtree.build(items, "manhattan", shards), asked, 4, "manhattan").collect()) == sorted(exact)
    empty = kdtree.build(items.limit(0))
    assert kdtree.search(*empty, asked).count() == 0


def test_names_of_indexes_select_them(spark, monkeypatch):
    asked = []
    for module in (graph, kdtree):
        monkeypatch.setattr(module, "search", lambda *a, own=module.search, name=module.__name__, **k: asked.append(name) or own(*a, **k))
    items, q = store.seed_items(spark), list(store.SEED_ROWS[3][2])
    found = [[r["id"] for r in knn.search(items, q, 3, "cosine", algo).collect()] for algo in ("bruteforce", "kdtree", "hnsw", "typo")]
    assert found[0] == found[1] == found[2] == found[3] and [x.rsplit(".")[-1] for x in asked] == ["kdtree", "graph", "graph"]


def test_few_chunks_are_searched_by_their_codes(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(quantize, "search_batch", lambda *a, own=quantize.search_batch: asked.append("codes") or own(*a))
    monkeypatch.setattr(graph, "search", lambda *a, own=graph.search, **k: asked.append("graph") or own(*a, **k))
    rows = store.seed_items(spark).select("id", "emb")
    q = rows.where("id = 3").select(F.lit(0).cast("long").alias("qid"), "emb")
    assert fusion.routed(q, rows.where("id < 10"), 2).first()["id"] == 3 and asked == ["codes"]
    assert fusion.routed(q, rows.where("id <= 10"), 2).first()["id"] == 3 and asked == ["codes", "graph"]


# ---- stores and the whole -------------------------------------------------------------------


def test_json_snapshots(spark, tmp_path):
    items = store.seed_items(spark)
    path = f"file://{tmp_path}/s"
    assert store.save_json(items, path, 16) == 20
    assert sorted(store.load_json(spark, path).collect()) == sorted(items.collect())
    again = store.load_json(spark, path, reassign=True)
    assert [r["id"] for r in again.orderBy("id").collect()] == list(range(1, 21))
    assert store.load_json(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{no json")
    assert store.load_json(spark, f"file://{tmp_path}/bad").count() == 0
    assert store.snapshot_info(spark, f"file://{tmp_path}/none")["exists"] is False


def test_a_snapshot_is_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    items = store.seed_items(spark)
    assert store.load(spark, path).count() == 0 and store.save(items, path) == 20
    now = store.load(spark, path)
    for n in (21, 22, 23):  # load, insert, save to the same place, load
        now = store.insert(now, spark.createDataFrame([(0, f"new{n}", "", [0.5] * 16)], store.ITEM))
        assert store.save(now, path) == n
        now = store.load(spark, path)
        assert now.count() == n and now.agg(F.max("id")).first()[0] == n
    folders = [x.name for x in (tmp_path / "s").iterdir() if x.name.startswith("snapshot-") and x.is_dir()]
    assert len(folders) == 2  # the current one and the one before
    with pytest.raises(Exception, match="boom"):
        store.save(now.withColumn("metadata", F.raise_error(F.lit("boom")).cast("string")), path)
    assert store.load(spark, path).count() == 23 and store.snapshot_info(spark, path)["size_bytes"] > 0


def test_model_server(monkeypatch):
    """The connectors against a server of their own."""
    import http.server
    import json
    import threading

    from lodeline.functions.models import http_models

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.reply({"models": []})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["prompt"] == "bad":
                self.send_error(500)
            elif self.path == "/api/embeddings":
                self.reply({"embedding": [float(len(asked["prompt"])), 1.0]})
            else:
                self.reply({"response": f"{asked['model']}: {asked['prompt']}"})

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    embed, generate, available = http_models(f"http://127.0.0.1:{server.server_port}", "e", "g")
    try:
        assert available() and embed(["abc", "bad"]) == [[3.0, 1.0], []]
        assert generate(["hello"]) == ["g: hello"] and generate(["bad"])[0].startswith("ERROR")
    finally:
        server.shutdown()
        server.server_close()
    assert not available()


def test_traces_work_out_distances_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    g = graph.Graph(list(range(120)), rng.normal(size=(120, 8)))
    asked = rng.normal(size=(5, 8))
    want = [g.trace(v, 5, 20) for v in asked]
    monkeypatch.setattr(graph, "VECTORS", 2)
    calls, table = [], distance.table
    monkeypatch.setattr(distance, "table", lambda *a: calls.append(1) or table(*a))
    assert list(g.traces(asked, 5, 20)) == want and len(calls) == 3 and g.known is None


def test_insert_delete_restore(spark):
    e = Engine(spark)
    assert e.insert("new", "cs", [0.1] * 16) == 21
    assert e.delete(21) and not e.delete(21)
    with pytest.raises(ValueError):
        e.insert("short", "cs", [0.1])
    seed = store.seed_items(spark)
    changed = store.delete(seed, spark.createDataFrame([(1,)], "id long"))
    more = store.insert(changed, spark.createDataFrame([(0, "own", "", [0.5] * 16)], store.ITEM))
    assert sorted(r["metadata"] for r in store.restore(seed, more).where("id > 20").collect()) == ["own"]


def test_restored_rows_are_numbered_as_they_are_dealt(spark):
    now = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in now}
    rows = spark.range(4000).select((F.col("id") + 100).alias("id"), F.concat(F.lit("own"), "id").alias("metadata"), F.lit("").alias("category"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.xxhash64("id", i) / 1e19).alias("emb"))
    try:  # the rows come in several partitions, their numbers alone in one
        for k, v in now.items():
            spark.conf.set(k, v)
        got = store.restore(store.seed_items(spark), rows).agg(F.count("*"), F.count_distinct("id"), F.max("id"), F.count_distinct("metadata"), F.count_if(F.size("emb") == 64)).first()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tuple(got) == (4020, 4020, 4020, 4020, 4000)


def test_the_whole_service(spark, tmp_path):
    e = Engine(spark, generate=lambda ps: ["Distributed engines shuffle rows between tasks." for _ in ps])
    assert e.doc_insert("Spark", "Distributed engines shuffle rows between tasks. Shuffles cost time and disk.") == 1
    assert e.doc_insert("Food", " ".join(f"bread{i} butter{i}" for i in range(200))) == 2
    assert [r["title"] for r in e.doc_list().collect()] == ["Spark (fixed)", "Food [1/2] (fixed)", "Food [2/2] (fixed)"]
    for pipeline in ("vector", "hybrid", "rerank", "hyde", "other"):
        assert e.advanced_search("How do engines shuffle rows?", 1, pipeline).first()["id"] == 1, pipeline
    answer = e.ask("How do engines shuffle rows?", 2, "rerank")
    assert answer["grounding"]["grounding_rate"] == 100.0 and answer["annotated_answer"].endswith("[1]")
    assert e.stats()["doc_index"]["chunk_count"] == 3
    assert e.doc_rerank("shuffle rows", 1).first()["id"] == 1
    saved = f"file://{tmp_path}/all"
    assert e.save(saved) == {"saved_vectors": 20, "saved_docs": 3}
    other = Engine(spark)
    other.load(saved)
    assert other.documents.count() == 3 and other.items.count() == 20
    assert e.doc_delete(1) and not e.doc_delete(1)


def test_empty_store(spark):
    e = Engine(spark)
    assert e.doc_search("anything").count() == 0 and e.hybrid_search("anything").count() == 0
    with pytest.raises(RuntimeError):
        e.ask("anything")


def test_stream_appends_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "one two"), (2, "b", "three four")], "id long, title string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.stream(stream, f"{tmp_path}/out", f"{tmp_path}/marks", once=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_hashing_embedder_is_stable():
    v = hashing_embedder(["Apple apple the"])[0]
    assert sum(v) == 2.0 and max(v) == 2.0 and hashing_embedder([""])[0] == [0.0] * 64
