import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeline.llm import ann, components, licenses, mixing, neardup, pieces, quality, queries, shingles, suffixes, tokencounts, topk, urls
from lodeline.llm.shared import lean, stage_path, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, h string, node long, size long"
#: Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use inside.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog " * 4, "en", "a", 1, 0, "x", 0, 0),
    (2, "THE quick brown fox jumps over the lazy dog " * 4, "en", "a", 1, 0, "x", 0, 0),
    (2, "The quick brown fox jumps over the lazy dog " * 4, None, None, None, None, None, None, None),
    (3, None, "en", "b", 0, 0, "x", 0, 0),
    (4, "", None, "b", 0, 0, "x", 0, 0),
    (5, " \t\n", "en", None, 3, 0, "x", 0, 0),
    (None, "released under the MIT license " * 5, "en", "c", 1, 0, "x", 0, 0),
    (6, "ab " * 20_000, "en", "c", 1, 0, "x", 0, 0),
    (7, "é▁🎉 word", "fr", "c", 1, 0, "x", 0, 0),
    (7, "é▁🎉 word", "fr", "c", 1, 0, "x", 0, 0),
    (8, "z" * 30_000, "fr", "c", 1, 0, "x", 0, 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# ---- 1: pieces ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_the_library_s(docs, library):
    p = pieces.load()
    for t in docs.select("text").toPandas()["text"]:
        assert list(p.encode(t)) == library.encode(t)
        assert p.decode(p.encode(t)) == t


@pytest.mark.parametrize("t", ["", " ", "  two  spaces ", "▁marks ▁▁ stay", "\x00\n\t", "日本語 🎉", "q" * 5000, "á"])
def test_round_trip(t):
    p = pieces.load()
    assert p.decode(p.encode(t)) == t
    assert p.encode(None).tolist() == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(200):
        vocabulary = {c: float(-rng.integers(1, 9)) for c in "ab"} | {"".join(rng.choice(list("abc"), rng.integers(2, 5))): float(-rng.integers(1, 9)) for _ in range(6)}
        p = pieces.Pieces([(t, i, s) for i, (t, s) in enumerate(vocabulary.items())], list(range(1000, 1256)))
        s = "".join(rng.choice(list("abc"), 7))
        worth = {i: v for i, v in enumerate(vocabulary.values())}

        def best(k, vocabulary=vocabulary, p=p, s=s):
            if k == len(s):
                return 0.0
            ways = [v + best(k + len(t)) for t, v in vocabulary.items() if s.startswith(t, k)]
            if s[k] not in vocabulary:
                ways.append(p.unknown + best(k + 1))
            return max(ways)

        ids = list(p.viterbi(s))
        assert sum(worth.get(i, p.unknown) for i in ids) == pytest.approx(best(0))
        assert b"".join(p.bytes_of[i] for i in ids).decode() == s


def test_encoding_tables(spark, odd, no_docs):
    got = pieces.decode(pieces.encode(odd)).select("text", "decoded").collect()
    assert len(got) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in got)
    assert pieces.encode(no_docs).count() == 0


# ---- 2: URLs --------------------------------------------------------------------------------

URLS = [
    ("https://Blog.Example.COM/en/7?x", "blog.example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://a.com/en/9#f", "a.com", "/en/9", "com/en/", "block"),
    ("http://com/en/", "com", "/en/", "com/en/", "block"),
    ("http://acom/en/", "acom", "/en/", None, "allow"),
    ("http://x.example.net/de/81", "x.example.net", "/de/81", "example.net/de/8", "block"),
    ("ftp://y.net/de/", "y.net", "/de/", "net/de/", "allow"),
    ("http://b.org?es/", "b.org", "", None, "allow"),
    ("a.com/en/9", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://É.org/es/ü", "É.org", "/es/ü", "org/es/", "block"),
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u[0], 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, host long, token string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, labels).collect()}
    assert got == {i: tuple(u[1:]) for i, u in enumerate(URLS)}
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_against_brute_force(spark):
    rng = np.random.default_rng(2)
    hosts, kinds = ["pills.x.info", "news.x.info", "shop.y.info"], ["buy", "read"]
    rows = []
    for i in range(300):
        h, k = hosts[rng.integers(3)], kinds[rng.integers(2)]
        bad = rng.random() < (0.95 if (h, k) == ("pills.x.info", "buy") else 0.1)
        rows.append((i, f"http://{h}/{k}/{i}", bool(bad)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(1, None)], "page_id long, blocked boolean")
    got = urls.judge(pages, labels, min_support=0.02).toPandas().set_index("page_id")
    seen = {i: frozenset([f"host:{x}" for x in u.split("/")[2].split(".")] + [f"path:{x}" for x in u.split("/")[3:]] + ["scheme:http"]) for i, u, _ in rows}
    bad = {r[0]: r[2] for r in rows}
    known = [i for i in bad if i % 3]

    def confidence(rule, blocks):
        has = [i for i in known if rule <= seen[i]]
        n, base = sum(bad[i] == blocks for i in has), sum(bad[i] == blocks for i in known) / len(known)
        if n < 0.02 * len(known) or 2 * n < len(has):
            return 0.0
        shrunk = (n + urls.PRIOR * base) / (len(has) + urls.PRIOR)
        return shrunk if shrunk >= max(0.5, urls.MIN_LIFT * base) else 0.0

    for i in bad:
        tokens = [t for t in seen[i]]
        sets = [frozenset(t for k, t in enumerate(tokens) if m >> k & 1) for m in range(1, 1 << len(tokens))]
        block, allow = (max(confidence(s, x) for s in sets) for x in (True, False))
        assert got.verdict[i] == ("block" if block else "allow")
        assert got.mined_verdict[i] == ("block" if block else "allow" if allow else None)
        if block or allow:
            assert got.confidence[i] == pytest.approx(block or allow)
    assert (got.verdict == "block").sum() > 30 and (got.mined_verdict == "allow").sum() > 30


def test_rules_judge_real_pages(spark):
    got = queries.op2_url_filter(spark, "/root/testdata/sf0.1").toPandas()
    assert len(got) == 2500 and got.mined_rule.notna().sum() >= 500
    free = got[got.rule.isna()]
    assert (free.verdict == free.mined_verdict.fillna("allow")).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_urls_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    want = con.sql(urls.SQL)
    got = queries.op2_url_filter(spark, f"/root/testdata/{sf}").select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_urls_of_odd_rows(spark):
    rows = [(1, "http://a.example/" + "x/" * 20_000, "r", 1), (1, "http://a.example/" + "x/" * 20_000, "r", 1), (None, "http://a.com/en/1", None, None), (2, None, "r", 2), (3, "", "r", 3), (4, " \n", "r", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, row long")
    labels = spark.createDataFrame([(1, True), (1, True), (None, True), (2, None)], "page_id long, blocked boolean")
    got = urls.judge(pages, labels, min_support=1.0).collect()
    assert len(got) == 6 and Counter(r["page_id"] for r in got)[1] == 2
    assert {r["verdict"] for r in got if r["page_id"] in (2, 3, 4)} == {"allow"} and [r["rule"] for r in got if r["page_id"] is None] == ["com/en/"]


def test_repeated_and_contrary_labels(spark):
    good = [(100 + i, f"http://good.example/g{i}") for i in range(60)]
    pages = spark.createDataFrame([(i % 50, f"http://bad.example/{i % 50}") for i in range(100)] + good, "page_id long, url string")
    labels = spark.createDataFrame([(i, True) for i in range(30)] * 2 + [(i, False) for i in range(5)] + [(i, False) for i, _ in good], "page_id long, blocked boolean")
    got = urls.judge(pages, labels)
    assert got.count() == 160 and got.where("verdict = 'block'").count() == 100
    assert got.where("page_id < 5 and mined_rule like '%host:bad%'").count() == 10  # contrary labels make no rule


# ---- 3: near-duplicates ---------------------------------------------------------------------


def shingled(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def linked(sets, percent=80):
    """Smallest id that each one's links lead to."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(docs, width):
    got = neardup.near_duplicates(docs, width).toPandas()
    sets = {r.doc_id: shingled(r.text, width) for r in docs.toPandas().itertuples()}
    want = linked(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(120):
        w = list(base)
        for j in rng.choice(300, int(rng.integers(0, 22)), replace=False):
            w[j] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"v{i}y{j}" for j in range(i + 1))) for i in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).toPandas()
    want = linked({i: shingled(t, 2) for i, t in rows})
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == want


def against(sql, frame, name="documents"):
    con = duckdb.connect()
    con.register(name, frame)
    found = con.sql(sql)
    return found.columns, sorted(found.fetchall(), key=repr)


def test_near_duplicates_against_sql(spark):
    columns, want = against(neardup.SQL, table(spark, "/root/testdata/sf0.01", "documents").toPandas())
    got = queries.op3_near_duplicates(spark, "/root/testdata/sf0.01").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Lists of many parts: copies of one text, each with changes of its own, and a chain of them."""
    monkeypatch.setattr(neardup, "PART", 16)
    rng = np.random.default_rng(21)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(300):
        w = list(base)
        for j in rng.choice(200, int(rng.integers(0, 7)), replace=False):
            w[j] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    w = [f"c{i}" for i in range(120)]
    for i in range(60):  # each like the one before, the first and last unlike
        w[2 * i : 2 * i + 2] = [f"d{i}", f"e{i}"]
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, "the same few words") for i in range(100)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got = neardup.near_duplicates(d, 2).toPandas()
    want = linked({int(i): shingled(t, 2) for i, t in rows})
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == want


def test_near_duplicates_of_odd_rows(odd, no_docs):
    got = neardup.near_duplicates(odd, 2).toPandas()
    assert len(got) == len(ODD)
    by = got.groupby("doc_id", dropna=False)["component_id"].agg(list)
    assert by[1] == [1] and by[2] == [1, 1] and by[3] == [3] and by[4] == [4] and by[5] == [5] and by[7] == [7, 7]
    assert got[got.doc_id.isin([3, 4, 5])].n_shingles.tolist() == [0, 0, 0] and got[got.doc_id.isna()].kept.all()
    assert neardup.near_duplicates(no_docs, 2).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_shingle_hashes_tell_words_apart():
    import pyarrow as pa

    (_, _, values, starts), *_ = shingles.sets(pa.array(["a b c", "A  b\nc", "ab c", "a bc", None, "b a c", "a"]), 2)
    own = [tuple(values[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    assert own[0] == own[1] and len({*own}) == 6 and [len(x) for x in own] == [2, 2, 1, 1, 0, 2, 1]


# ---- 4 and 9: vector searches ---------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_and_scores(spark, sf):
    e = table(spark, f"/root/testdata/{sf}", "embeddings")
    got = ann.nearest(e, F.col("vec_id") % 100 == 0).toPandas()
    p = e.toPandas()
    v, ids = np.stack(p["embedding"]).astype(float), p["vec_id"].to_numpy()
    hit, asks = 0, ids[ids % 100 == 0]
    for q in asks:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], [d[ids == i][0] for i in own["vec_id"]], rtol=1e-12)
        hit += len({*ids[order]} & {*own["vec_id"]})
    assert hit >= 0.92 * 10 * len(asks)


def test_ann_misses_nothing_wherever_queries_lie(spark):
    """Queries apart from the clusters that all other rows are of; clusters of many scales; copies."""
    rng = np.random.default_rng(1)
    n, places = 6000, rng.normal(size=(600, 32))
    apart = places[rng.integers(0, 600, n)] + 0.01 * rng.normal(size=(n, 32))
    apart[::100] = rng.normal(size=(n // 100, 32))
    of = rng.integers(0, 8, n)
    scales = 1e7 + places[of] + (10.0**-of)[:, None] * 0.1 * rng.normal(size=(n, 32))
    scales[:500] = scales[0]
    for x in (apart, scales):
        e = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
        got = ann.nearest(e, F.col("vec_id") % 100 == 0, row_block=700).toPandas().sort_values(["query_id", "rank"])
        want = []
        for i in range(0, n, 100):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            want += [(i, int(j), d[j]) for j in [j for j in np.lexsort((np.arange(n), d))[:11] if j != i][:10]]
        assert list(zip(got["query_id"], got["vec_id"], got["score"], strict=True)) == want


def test_ann_of_several_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=(8, 5, 3)[i % 3]).tolist()) for i in range(300)] + [(900, [1.0] * 9), (901, [2.0] * 9)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sample in (10_000, 40):
        got = ann.nearest(e, F.lit(True), k=4, fit_sample=sample, query_block=20, row_block=15).toPandas()
        hit = 0
        for i, x in rows:
            d = sorted((float(np.linalg.norm(np.subtract(x, y))), j) for j, y in rows if j != i and len(y) == len(x))[:4]
            own = got[got.query_id == i].sort_values("rank")
            assert len(own) == len(d)
            hit += len({j for _, j in d} & {*own["vec_id"]})
        assert hit >= 0.9 * (300 * 4 + 2)


def test_ann_fit_is_small():
    """The fit on the largest sample, with the most cells, stays far below a driver's memory."""
    import tracemalloc

    x = np.random.default_rng(0).normal(size=(8192, 16))
    tracemalloc.start()
    ann.fit(x, 10**9, 10)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


VECTORS = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.0, 1.0]), (7, None), (8, [0.0, 0.0]), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [1.0]), (12, [float("inf"), 0.0]), (None, [1.0, 1.0])]


def test_ann_of_odd_vectors(spark):
    e = spark.createDataFrame([(*r, 1) for r in VECTORS], "vec_id long, embedding array<float>, row long")
    got = ann.nearest(e, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").toPandas()
    assert got["vec_id"].tolist() == [0, 3, 5] * 2 or sorted(got["vec_id"]) == [0, 0, 3, 3, 5, 5]
    assert got[got["rank"] == 2]["vec_id"].tolist() == [3, 3]
    assert ann.nearest(e.limit(0), F.lit(True)).count() == 0 and ann.nearest(e, F.lit(False)).count() == 0


def test_topk_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    got = topk.top_k(topk.quantised(table(spark, SF, "embeddings")), F.col("vec_id") % 50 == 0, query_block=4, row_block=100)
    want = con.sql(topk.SQL)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_topk_of_odd_vectors(spark):
    e = spark.createDataFrame([(*r, 1) for r in VECTORS], "vec_id long, embedding array<float>, row long")
    got = topk.top_k(topk.quantised(e), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").toPandas()
    assert Counter(got["vec_id"]) == Counter([0, 3, 5, 8] * 2)
    assert got[got["rank"] == 1]["score"].tolist() == [65536, 65536] and got[got["rank"] == 2]["vec_id"].tolist() == [3, 3]


@pytest.mark.parametrize("kind", ["clusters", "everywhere"])
def test_pivots_leave_some_out(kind):
    rng = np.random.default_rng(4)
    centre = rng.integers(-200, 200, (20, 16))
    v = np.concatenate([c + rng.integers(-5, 5, (100, 16)) for c in centre]) if kind == "clusters" else np.floor(256 * (x := rng.normal(size=(2000, 64))) / np.linalg.norm(x, axis=1)[:, None]).astype(int)
    pivots = topk.Pivots(topk.choose_pivots(v.astype(float), round(topk.PIVOT_SHARE * v.shape[1])))
    far = pivots.distances(v.astype(float))
    assert np.allclose(far, np.sqrt(((v[:, None] - pivots.points[None]) ** 2).sum(2)))
    images = pivots.places(far)
    a, b = images[::7], images[3::11]
    low, true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), np.sqrt(((v[::7][:, None] - v[3::11][None]) ** 2).sum(2))
    assert (low <= true + 1e-6).all() and (low >= np.abs(far[::7][:, None] - far[3::11][None]).max(2) - 1e-3).all()
    side = {"row": np.arange(len(v)), "id": np.arange(len(v)), "v": v, "far": far}
    q = {k: x[::40] for k, x in side.items()} | {"least": np.full(50, topk.NOTHING)}
    at, score, evaluated = topk.search_block(pivots, q, side, 5)
    exact = q["v"] @ v.T
    for i, (a, s) in enumerate(zip(at, score, strict=True)):
        order = [j for j in np.lexsort((np.arange(len(v)), -exact[i])) if j != q["row"][i]][:5]
        assert a.tolist() == order and s.tolist() == exact[i][order].tolist()
    assert evaluated < 0.25 * len(q["row"]) * len(v)


def test_share_of_products_on_real_vectors(spark):
    v = np.array([r[0] for r in topk.quantised(table(spark, "/root/testdata/sf0.1", "embeddings")).orderBy("vec_id").select("vector").collect()])
    pivots = topk.Pivots(topk.choose_pivots(v.astype(float), round(topk.PIVOT_SHARE * v.shape[1])))
    side = {"row": np.arange(len(v)), "id": np.arange(len(v)), "v": v, "far": pivots.distances(v.astype(float))}
    q = {k: x[::50] for k, x in side.items()} | {"least": np.full(40, topk.NOTHING)}
    assert topk.search_block(pivots, q, side, 5)[2] < 0.25 * 40 * len(v)


def test_topk_of_degenerate_vectors(spark):
    """All alike, on a line, zero, of a length of their own, and more queries than a block takes."""
    rows = [(i, [3.0, 3.0, 3.0]) for i in range(30)] + [(100 + i, [float(i), 0.0, 0.0]) for i in range(30)] + [(200, [0.0] * 3), (201, [1.0, 2.0]), (202, [2.0, 1.0]), (203, []), (204, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(topk.quantised(e), F.lit(True), k=3, query_block=7, row_block=5).collect()
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows}
    want = []
    for i in v:
        best = sorted((-int(v[i] @ v[j]), j) for j in v if j != i and len(v[j]) == len(v[i]))[:3]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


# ---- 5: token counts ------------------------------------------------------------------------


def test_rollup_against_counts(docs, spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokencounts.TOKENIZERS}/{tokencounts.RANKS}", "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    p = docs.toPandas()
    p["n"] = [len(enc.encode_ordinary(t)) for t in p["text"]]
    want = {k: (len(g), g["n"].sum()) for k, g in p.groupby(["source", "lang"])}
    read = lambda rows: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rows.collect()}
    assert read(tokencounts.rollup(docs, "v")) == want
    labels = table(spark, SF, "labels").where("toxic = 1").toPandas()
    want = {k: (len(g), g["n"].sum()) for k, g in p[~p["doc_id"].isin(labels["doc_id"])].groupby(["source", "lang"])}
    assert 0 < len(labels) and read(queries.op5_token_counts(spark, SF)) == want


def test_ledger(spark, tmp_path):
    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/l")
    rows = spark.createDataFrame([("a", "en", "1", 10), ("a", "en", "1", 5), (None, "de", "1", 7)], "source string, lang string, version string, tokens long")
    totals = lambda: {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in ledger.totals().collect()}
    assert totals() == {}
    assert ledger.apply("b/1", tokencounts.signed(rows, 1)) and not ledger.apply("b/1", tokencounts.signed(rows, 1))
    assert totals() == {("a", "en"): (2, 15), (None, "de"): (1, 7)}
    ledger.apply("b/2", tokencounts.signed(rows.where("tokens = 5"), -1))
    ledger.apply("b/3", tokencounts.revised(rows.where("tokens = 7").withColumn("new", F.lit(9)), "tokens", "new"))
    ledger.apply("b/4", tokencounts.signed(rows.limit(0), 1))
    assert totals() == {("a", "en"): (1, 10), (None, "de"): (1, 9)}
    (tmp_path / "l" / "batch=broken").mkdir()
    (tmp_path / "l" / "batch=broken" / "part-0.parquet").write_text("half")
    assert totals() == {("a", "en"): (1, 10), (None, "de"): (1, 9)}
    ledger = ledger.compact(f"file://{tmp_path}/m")
    assert totals() == {("a", "en"): (1, 10), (None, "de"): (1, 9)} and ledger.committed() == {"b/1", "b/2", "b/3", "b/4"}
    assert not ledger.apply("b/1", tokencounts.signed(rows, 1)) and ledger.apply("b/5", tokencounts.signed(rows.where("tokens = 10"), -1))
    assert totals() == {(None, "de"): (1, 9)} == {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in ledger.compact(f"file://{tmp_path}/n").totals().collect()}


def test_rollup_of_odd_rows(odd, no_docs):
    got = tokencounts.rollup(odd, "v").agg(F.sum("docs"), F.count_if(F.col("source").isNull())).first()
    assert got[0] == len(ODD) and got[1] == 2
    gone = odd.select("doc_id").where("doc_id in (2, 6) or doc_id is null")
    assert tokencounts.rollup(odd, "v", gone.unionByName(gone)).agg(F.sum("docs")).first()[0] == len(ODD) - 3
    assert tokencounts.rollup(no_docs, "v", gone).count() == 0


# ---- 6: mixing ------------------------------------------------------------------------------


def test_mix_against_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(mixing.SQL)
    assert sorted(tuple(r[c] for c in want.columns) for r in mixing.mix(docs).collect()) == sorted(want.fetchall())


def test_mix_of_odd_rows(odd, no_docs):
    a, b = (mixing.mix(odd).toPandas() for _ in range(2))
    key = ["doc_id", "size", "source_size", "target", "taken"]
    pd.testing.assert_frame_equal(a.sort_values(key, ignore_index=True), b.sort_values(key, ignore_index=True))
    assert len(a) == len(ODD) and (a["taken"] <= 2 * a["size"]).all() and a[a["size"] == 0]["taken"].eq(0).all()
    assert mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5], [7], [0, 3], [500, 1, 1, 400, 2]])
def test_targets_against_filling_up(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.source_targets(rows).orderBy("source").collect()]
    weight, left = {i: (3, 1, 2)[i % 3] for i in range(len(sizes))}, 1.5 * sum(sizes)
    want, free = {}, set(range(len(sizes)))
    while free:
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= 2 * sizes[i]}
        if not over:
            want |= share
            break
        want |= {i: 2.0 * sizes[i] for i in over}
        left -= sum(2 * sizes[i] for i in over)
        free -= over
    assert got == pytest.approx([want[i] for i in range(len(sizes))])


# ---- 7: repeats -----------------------------------------------------------------------------


def cut(rows, window=100):
    """(doc_id, bytes) in order -> removed runs and what is left."""
    seen, out = set(), []
    for _, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int)))
        out.append((edge.reshape(-1, 2).tolist(), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


@pytest.mark.parametrize("limit", [4096, 1])
def test_repeats_against_brute_force(docs, limit):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.toPandas().itertuples())
    got = suffixes.repeats(docs, cut=limit, block=50_000).orderBy("doc_id").collect()
    assert [([[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in got] == cut(rows)


def test_repeats_against_sql(spark, docs):
    columns, want = against(suffixes.SQL, docs.toPandas())
    assert sorted(map(tuple, queries.op7_suffix_dedup(spark, SF).select(*columns).collect()), key=repr) == want


def test_repeats_of_odd_texts(spark):
    a = "".join(chr(97 + i * i % 26) for i in range(333))
    texts = ["x" * 500, "xy" * 300, a, a, "ü" * 120 + a, a[:99], None, "", "\x00" * 150, a[50:250] + "ü" + a[:120]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h long")
    got = suffixes.repeats(df).orderBy("doc_id").collect()
    assert [([[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in got] == cut([(i, (t or "").encode()) for i, t in enumerate(texts)])


@pytest.mark.parametrize("limit", [4096, 1])
def test_repeats_of_rows_alike(spark, limit):
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    line = letters(130)
    texts = [(1, letters(3000) + line), (2, letters(2000) + line + letters(700) + line), (3, letters(100)), (None, line + letters(4000))]
    want = dict(zip((i for i, _ in texts), cut([(i, t.encode()) for i, t in texts]), strict=True))
    df = spark.createDataFrame(texts + [texts[0], texts[0], *texts[1:]], "doc_id long, text string").repartition(3)
    got = suffixes.repeats(df, cut=limit, block=2_000).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({1: 3, 2: 2, 3: 2, None: 2})
    assert all(([[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) == want[r["doc_id"]] for r in got)


def test_repeats_without_ids(spark):
    """Texts whose 32-bit hashes are alike, and many rows without doc_id."""
    import random

    draw, by = random.Random(1), {}
    texts = ["".join(draw.choices("abcdefgh", k=110 + i % 60)) for i in range(90_000)]
    for h, t in zip(spark.createDataFrame([(t,) for t in texts], "t string").select(F.hash("t")).toPandas().iloc[:, 0], texts, strict=True):
        by.setdefault(h, []).append(t)
    alike = [x for x in by.values() if len(x) > 1]
    assert alike  # as likely as not for each 77,000 texts
    rows = [(1, texts[0] + alike[0][1])] + [(None, t) for x in alike for t in x] + [(None, t) for t in texts[:2000]]
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and sum(r["n_bytes"] - len(r["kept"]) for r in got if r["doc_id"] == 1) == 0
    first, second = (t.encode() for t in alike[0])
    left = {r["n_bytes"]: bytes(r["kept"]) for r in got if r["doc_id"] is None and r["n_bytes"] in (len(first), len(second)) and bytes(r["kept"]) in (b"", first)}
    assert left.get(len(first)) in (b"", first)


def test_repeats_of_odd_rows(odd, no_docs):
    got = suffixes.repeats(odd).collect()
    assert len(got) == len(ODD)
    assert suffixes.repeats(no_docs).count() == 0


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(6)
    for _ in range(50):
        s = rng.integers(1, 4, 60).astype(np.int16)
        text = np.concatenate([s, np.zeros(80, np.int16)])
        ranked = np.zeros(len(text), np.int64)
        for j in range(suffixes.SYMBOLS):
            ranked[: len(text) - j] |= text[j:].astype(np.int64) << (9 * (suffixes.SYMBOLS - 1 - j))
        wanted = np.arange(len(text)) < 60
        order = suffixes.two_stage(text, ranked, wanted, 70)
        order = order[wanted[order]]
        assert order.tolist() == sorted(range(60), key=lambda i: s[i:].tolist())


# ---- 8: licences ----------------------------------------------------------------------------


def test_license_base_against_brute_force(docs, spark):
    extra = spark.createDataFrame([(900, "MIT License, mit-license; the GNU General\nPublic LICENSE. apache  license mit licenses é"), (901, "licensed under CC BY-NC 4.0"), (902, "permit license")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r for r in licenses.scan(every).collect()}
    for r in every.toPandas().itertuples():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER))
        at = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        g = got[r.doc_id]
        assert (g["n_words"], g["n_base"]) == (len(w), len(at))
        assert (g["first_word"], g["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert g["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(g["base_labels"].split(",")) - {""} <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert got[901]["labels"] == "cc-by-nc" and got[901]["score"] == 1.0 and got[902]["labels"] == ""


def test_licenses_against_sql(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    notes = [" ".join(text.split()[k:]) + "." for k in (0, 3, 9) for _, _, text in licenses.TEMPLATES]
    mixed = [t.replace(" the ", " the said ", 1) for t in notes] + [t.replace(" ", " (c)\n", 7) for t in notes]
    more = spark.createDataFrame([(10**6 + i, "Some words. " + t.capitalize()) for i, t in enumerate(notes + mixed)], "doc_id long, text string")
    every = d.unionByName(more)
    con = duckdb.connect()
    con.register("documents", every.toPandas())
    want = con.sql(licenses.SQL)
    got = licenses.scan(every).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    assert len({r["labels"] for r in got}) > 10


def test_every_template_finds_itself(spark):
    rows = [(i, f"Some words before. {text}. And after.", label) for i, (label, _, text) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    for i, _, label in rows:
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0


def test_key_phrases_stand_once_in_their_templates():
    for _, phrase, text in licenses.TEMPLATES:
        assert f" {text} ".count(f" {phrase} ") >= 1 and len(set(phrase.split())) >= 2
        assert text == " ".join(re.findall("[a-z0-9]+", text))


def test_many_notices_and_stray_words_in_one_text(spark):
    filler, stray = " lorem ipsum dolor" * 50, " mozilla eclipse affero unencumbered "
    short = {label: text for label, _, text in licenses.TEMPLATES}  # the last of each label
    rows = [(0, (stray + filler + " ").join(t[2] for t in licenses.TEMPLATES)), (1, stray + filler + " licensed under cc by nc 4 0" + filler + stray)]
    five = [short[x] for x in ("mpl", "epl", "isc", "unlicense", "cc0")]
    rows += [(2, filler.join(five)), (3, stray + filler + " version subject terms 2 0 mozilla public license"), (4, "permission is hereby granted free of charge to stay")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == ",".join(sorted(short)) and got[1]["labels"] == "cc-by-nc"
    assert got[2]["labels"] == "cc0,epl,isc,mpl,unlicense" and all(got[i]["score"] == 1.0 for i in range(3))
    assert got[3]["labels"] == "mpl" and got[3]["score"] == pytest.approx(4 / 12)  # "terms" is in its place
    assert got[4]["labels"] == "" and got[4]["score"] == 0.0


def test_licenses_of_long_and_repeated_texts(spark):
    long = "mit license " * 60_000 + "licensed under the apache license version 2 0"
    rows = [(1, long, "x", 1), (1, long, "x", 1), (2, "mit", "x", 1), (2, "mit license mit", "x", 1)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, word string, t long")).orderBy("doc_id", "n_words").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in got[:2]] == [(120_008, 60_001, 0, 120_003, "apache,mit")] * 2
    assert [(r["n_base"], r["labels"]) for r in got[2:]] == [(0, ""), (1, "mit")]


def test_licenses_of_odd_rows(odd, no_docs):
    got = licenses.scan(odd).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id.isna()].labels.tolist() == ["mit"]
    assert licenses.scan(no_docs).count() == 0


# ---- 10: quality ----------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    d, labels = table(spark, "/root/testdata/sf0.01", "documents"), quality.table_labels(table(spark, "/root/testdata/sf0.01", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    got = quality.assess(quality.sites(d), labels.where(~held)).join(labels.where(held), "doc_id")
    p = got.select("good", "keep", "p_good").toPandas()
    assert (p["good"] == p["keep"]).mean() >= 0.95
    assert p[p["good"]]["keep"].mean() >= 0.98


def test_sites_shrink_toward_the_corpus(spark):
    rows = [(i, "plain words here and there.", "big", "x") for i in range(200)] + [(i, "plain words here and there.", "small", "y") for i in (500, 501)]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(200)] + [(500, False), (501, False)], "doc_id long, good boolean")
    p = quality.assess(d, labels).groupBy("host").agg(F.avg("p_path").alias("p")).toPandas().set_index("host")["p"]
    assert p["big"] == pytest.approx(0.5, abs=0.02) and 0.2 < p["small"] < p["big"]


def python_features(text):
    n, words, lines = max(len(text), 1), re.split(r"\s+", text), text.split("\n")
    share = lambda chars: sum(c in chars for c in text) / n
    return [
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), 8 / (8 + len(words)), share(quality.SYMBOLS), share("|"), share(quality.MARKS), share(quality.STOPS),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("abcdefghijklmnopqrstuvwxyz"), share("0123456789"), share(" "), 1 - len(set(lines)) / len(lines), math.log(n),
    ]


@pytest.mark.parametrize("spread", [quality.SPREAD, 3])
def test_posteriors_against_brute_force(spark, docs, spread):
    """All probabilities, for given weights, by another way: document by document."""
    own = docs.toPandas()
    rows = [(int(r.doc_id), r.text, r.source, r.lang) for r in own.itertuples()] + [(10**6, None, "nowhere", None), (10**6 + 1, " ", own.source[0], own.lang[0]), (None, "A text of its own.", None, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    known = {int(r.doc_id): bool(r.quality) for r in table(spark, SF, "labels").toPandas().itertuples()}
    labels = spark.createDataFrame(list(known.items()), "doc_id long, good boolean")
    weights, intercept = [-3.0, -1.0, -6.0, -5.0, -4.0, 3.0, -2.0, 1.0, -1.5, 2.0, -2.5, 0.1], 0.4
    got = quality.assess(d, labels, model=(weights, intercept), spread=spread).collect()

    sure = lambda p: min(max(p, 1 - quality.CERTAIN), quality.CERTAIN)
    logit = lambda p: math.log(sure(p) / (1 - sure(p)))
    p_doc, y = [], []
    for i, text, _, _ in rows:
        speaks = bool(WORD.search(text or ""))
        p = sure(1 / (1 + math.exp(-intercept - sum(w * x for w, x in zip(weights, python_features(text), strict=True))))) if speaks else None
        p_doc.append(p)
        y.append(float(known[i]) if i in known else p)
    site, host = [(r[2], r[3]) for r in rows], [r[2] for r in rows]

    def sums(keys):
        out = {k: [0.0, 0] for k in keys}
        for k, v in zip(keys, y, strict=True):
            if v is not None:
                out[k][0] += v
                out[k][1] += 1
        return out

    paths, hosts = sums(site), sums(host)
    p0 = (sum(s for s, _ in hosts.values()) + 1) / (sum(n for _, n in hosts.values()) + 2)

    def strength(groups):  # (sum, n, toward)
        some = [(s / n, n, t) for s, n, t in groups if n > 1]
        if not some:
            return quality.MOST_STRENGTH
        spread = np.mean([(m - t) ** 2 - m * (1 - m) / n for m, n, t in some])
        inner = np.mean([t * (1 - t) for _, _, t in some])
        return min(max(inner / spread - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH) if spread > 0 else quality.MOST_STRENGTH

    m_host = strength([(s, n, p0) for s, n in hosts.values()])
    of_host = lambda h, mine=0.0, one=0: (hosts[h][0] - mine + m_host * p0) / (hosts[h][1] - one + m_host)
    m_path = strength([(s, n, of_host(k[0])) for k, (s, n) in paths.items()])
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert len(by) == len(got) == len(rows)
    for (i, *_), k, p, v in zip(rows, site, p_doc, y, strict=True):
        mine, one = (0.0, 0) if v is None else (v, 1)
        h = of_host(k[0], mine, one)
        q = (paths[k][0] - mine + m_path * h) / (paths[k][1] - one + m_path)
        p = p0 if p is None else p
        good = 1 / (1 + math.exp(-(logit(p) - logit(p0) + logit(q))))
        r = by[i]
        assert (r["p_doc"], r["p_host"], r["p_path"], r["p_good"]) == pytest.approx((p, h, q, good), abs=1e-9) and r["keep"] == (round(good, 9) >= 0.5)


def test_regression_against_gradient():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [0, 5, 2]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -0.2, 3.0] - 5)))).astype(float)
    w, b = quality.regression(x, y, ridge=0.0)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(x.T @ (p - y), 0, atol=1e-5) and abs((p - y).sum()) < 1e-6
    w, b = quality.regression(np.column_stack([y, np.ones(400)]), y)  # classes that part
    assert np.isfinite(w).all() and w[0] > 3 and w[1] == 0


def test_quality_of_odd_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(1, True), (1, False), (2, None), (6, False), (None, True)], "doc_id long, good boolean")
    assert quality.assess(quality.sites(odd), labels).count() == len(ODD)
    none = labels.limit(0)
    assert quality.assess(quality.sites(odd), none).where("not keep").count() == 0
    assert quality.assess(quality.sites(no_docs), labels).count() == 0


# ---- the pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    now = docs
    columns = docs.columns
    judged = {r["doc_id"]: r["keep"] for r in quality.assess(quality.sites(docs), quality.table_labels(table(spark, SF, "labels"))).collect()}
    now = corpus_pipeline.classify(spark, now, SF)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == {i for i, k in judged.items() if k}

    before = now.toPandas()
    groups = linked({r.doc_id: shingled(r.text, 5) for r in before.itertuples()})
    now = corpus_pipeline.near_dedup(spark, now, SF)
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == {i for i, g in groups.items() if i == g}

    before = sorted((r.doc_id, (r.text or "").encode()) for r in now.toPandas().itertuples())
    now = corpus_pipeline.cut_repeats(spark, now, SF)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()}
    left = {i: x[1].decode("utf-8", "ignore") for (i, _), x in zip(before, cut(before), strict=True)}
    assert now.columns == columns and {i: t for i, (t, _) in got.items()} == left and all(len(t) == n for t, n in got.values())

    # the stage shuffles by doc_id and text, so that rows that repeat a doc_id are apart
    both = now.withColumn("own", F.col("doc_id")).withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("t")))
    taken = {r["own"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(both, row="own").collect()}
    now = corpus_pipeline.mix(spark, now, SF)
    assert now.columns == columns and Counter(r["doc_id"] for r in now.collect()) == Counter({i: n for i, n in taken.items() if n})

    p = pieces.load()
    done = corpus_pipeline.encode(spark, now, SF).collect()
    assert all(p.decode(r["token_ids"]) == r["text"] and r["n_tokens"] == len(r["token_ids"]) for r in done)


#: Names that the pipeline and its operators use inside.
INSIDE = ["t", "copy", "worded", "left", "mark_id", "mark_t", "number", "component", "first", "token_ids", "n_tokens", "times", "row", "size", "h", "node"]


def test_pipeline_of_odd_rows(spark, odd, no_docs):
    kept = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd, SF).collect())
    assert kept == Counter({1: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 1})
    mine = odd.withColumns({c: F.lit("mine") for c in INSIDE})
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, mine, SF), stage(spark, no_docs, SF)
        added = ["n_tokens", "token_ids"] if name == corpus_pipeline.STAGES[-1][0] else []
        assert sorted(got.columns) == sorted({*mine.columns, *added}) and none.count() == 0, name
        rows = got.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in INSIDE if c not in added), name
        if name in ("suffix-array dedup", corpus_pipeline.STAGES[-1][0]):
            assert len(rows) == len(ODD)


def test_mix_stage_deals_rows_alike(spark):
    alike = [(1, "one two three", "en", "a", 13)] * 41
    rows = alike + [(10 + i, f"some words {i} " * (i + 1), "en", "b", 1) for i in range(12)] + [(None, "no id here", None, None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    numbered = d.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("t"))).withColumn("n", F.monotonically_increasing_id())
    taken = mixing.mix(numbered, row="n").join(numbered.select("n", "source"), "n").groupBy("source").agg(F.sum("taken").alias("words")).collect()
    got = corpus_pipeline.mix(spark, d, SF).toPandas()
    by = Counter()
    for r in got.itertuples():
        by[r.source] += len(words(r.text))
    assert by == {r["source"]: r["words"] for r in taken if r["words"]}


# ---- the queries ----------------------------------------------------------------------------

#: The columns that the contracts fix.
COLUMNS = {
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op3_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_ann_search": ["query_id", "rank", "vec_id", "score"],
    "op6_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9_exact_topk": ["query_id", "rank", "vec_id", "score"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_columns(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]


def test_suffix_digests(spark, docs):
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.toPandas().itertuples())
    want = {i: (len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest()) for (i, b), (spans, left) in zip(rows, cut(rows), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op7_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_probability_of_a_lost_link():
    """Two sketches of a similarity of 0.8 share fewer values than needed so seldom."""
    k, need = neardup.K, neardup._surely(80, 0.8, neardup.K)
    lost = lambda p, n: sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(n))
    assert lost(0.8, need) < neardup.LOST <= lost(0.8, need + 1)
    assert need < neardup._surely(80, 0.95, k) < k
    assert lost(0.8 / 1.8 * 1.95, neardup._surely(80, 0.95, k)) < neardup.LOST


@pytest.mark.parametrize("size", [5, 300, 1000, 1023, 1100, 5000])
def test_parity_bits_bound_the_symmetric_difference(size):
    rng = np.random.default_rng(size)
    a = rng.integers(-(2**62), 2**62, size)
    for changed in (0, 1, size // 10, size // 2):
        b = np.concatenate([a[changed:], rng.integers(-(2**62), 2**62, changed + size // 50)])
        (i, j), bits = neardup.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        x, y = bits.reshape(2, neardup.PARITY)
        half = neardup.PARITY // 2
        if i < j:
            x, y = x[:half], y[:half] ^ y[half:]
        seen = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        shift = int(max(i, j))
        apart = 2 * changed + size // 50
        assert i == (size > neardup.WHOLE) + (size > 2 * neardup.WHOLE + 1) + (size > 4 * neardup.WHOLE + 3)
        assert seen <= apart if shift == 0 else seen <= apart / 2**shift + 6 * (apart / 2**shift) ** 0.5 + 6
        assert (seen - apart) % 2 == 0 or shift


def test_repeats_leave_only_the_tables_that_are_read_again(spark):
    before = set(Path(stage_path(spark, "x").removeprefix("file:")).parent.glob("*"))
    line = "the same passage of some length stands in each of these documents, and so it goes but for one of them. " * 2
    found = suffixes.repeats(spark.createDataFrame([(i, f"{i} " + line) for i in range(4)], "doc_id long, text string"))
    left = {p.name.rpartition("-")[0] for p in set(Path(stage_path(spark, "x").removeprefix("file:")).parent.glob("*")) - before}
    assert left == {"places", "first-windows"}
    assert [len(r["spans"]) for r in found.orderBy("doc_id").collect()] == [1, 1, 1, 1]


def test_a_worker_keeps_nothing_of_other_operators():
    pieces.load()
    assert list(lean(iter([1, 2]), "pieces")) == [1, 2] and pieces.load.cache_info().currsize == 1
    shingles.powers(5)
    assert list(lean(iter([3]), "shingles")) == [3] and pieces.load.cache_info().currsize == 0 and len(shingles.powers(0)[0]) > 1
    assert list(lean(iter([]), "pieces")) == [] and len(shingles.powers(0)[0]) == 1


def test_repeats_are_cut_in_one_pass_of_python(spark):
    line = "die gleiche Stelle über einige Länge steht in jedem dieser Texte, und so geht es überall weiter. " * 2
    rows = [(i, "é" * i + line, "de", "a", 0) for i in range(4)] + [(9, None, "de", "a", 0), (10, "kurz", "de", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.cut_repeats(spark, docs, SF)
    # each step in Python has idle workers of its own
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = {r["doc_id"]: r["kept"].decode("utf-8", "ignore") for r in suffixes.repeats(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == want | {9: None} and len(got[3]) < len(line)
