"""License scan: a positional index over rare words, in DataFrame functions only.

Templates are licence texts and notices, each with a mandatory key phrase; their words, with
positions, are the postings. Of a template's words that a file has, the rarest by document frequency
are looked up, and so are the two rarest of the key phrase. Each place where such a word stands in
the file, less the word's place in the template, is a shift: where the template would begin. Words
that agree on a shift propose it, the key phrase has to stand at its aligned place, and the score is
the share of the template's words that stand at theirs. The phrases whose places are counted go
through the same index, as templates that are nothing but their key phrase.

Each template has votes of its own, so no other notice and no other word of a file takes them; and
as two words of a key phrase always vote, every place of it is proposed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.license_texts import TEMPLATES
from lodeline.llm.shared import ascii_lower, staged

#: What parts words: ASCII that is neither a digit nor a lower-case letter (after lower-casing).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places count, with their labels. Fixed values.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: A template's rarest words that are looked up, how many distinct ones must agree on a shift, and the
#: share of a template's words that must stand at their places.
RARE_WORDS, VOTES, MIN_SHARE = 4, 2, 0.3

Template = tuple[str, str, str]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null or empty one."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _literal(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def _offset(template: Template) -> int:
    """Where the key phrase starts in the template, in words."""
    phrase, text = template[1].split(), template[2].split()
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE_PHRASES, rare_words: int = RARE_WORDS, votes: int = VOTES, min_share: float = MIN_SHARE
) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score: one row a document.

    base maps phrases to labels: n_base counts their places, first_word and last_word are the
    smallest and largest start (null without any). templates are (label, key phrase, text), the
    phrase of two different words at least and a part of the text. A template is found where its key
    phrase stands and at least min_share of its words stand at their places with it, whatever stands
    between; labels has the base labels and those of the templates found. Both are sorted and
    comma-joined, '' without any. score is the largest share of a template found, 0 without any.

    Null and empty texts have no words, no labels and score 0. Texts of any length are scanned
    whole, and all places count. Of words as frequent as each other the first by its letters is the
    rarer one; which it is changes no result. Rows that repeat a doc_id are scanned each for itself.
    An empty table gives an empty result. Other columns are not looked at, whatever their names."""
    every = [(label, phrase, phrase) for phrase, label in base.items()] + list(templates)
    vocabulary = sorted({w for _, _, text in every for w in text.split()})
    phrases = sorted({t[1] for t in every})
    has = lambda phrase: F.size(F.array_except(_literal(sorted(set(phrase.split()))), F.col("seen"))) == 0
    split = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    split = split.withColumn("seen", F.array_intersect("words", _literal(vocabulary)))
    # a file without all words of any key phrase has nothing to align
    may = (F.size("seen") > 1) & reduce(lambda a, b: a | b, (has(p) for p in phrases))
    files = staged(split.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "seen", F.when(may, F.col("words")).alias("words")), "license-words")

    # document frequencies of the licence words: one row a word of the vocabulary
    df = {r["word"]: r["df"] for r in files.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    rarest = lambda text: sorted(set(text.split()), key=lambda w: (df.get(w, 0), w))
    asked = []
    for i, (_, phrase, text) in enumerate(every):
        here = lambda words: F.array_intersect(_literal(words), F.col("seen"))  # noqa: E731  in the order of the first
        look = F.array_union(F.slice(here(rarest(text)), 1, rare_words), _literal(rarest(phrase)[:2]))
        asked.append(F.when(has(phrase), F.struct(F.lit(i).alias("t"), look.alias("look"))))
    some = files.where("words is not null").select("row", "words", F.array_compact(F.array(*asked)).alias("asked"))
    some = some.withColumn("all", F.array_distinct(F.flatten(F.col("asked.look"))))

    postings = files.sparkSession.createDataFrame([(w, i, at) for i, (_, _, text) in enumerate(every) for at, w in enumerate(text.split())], "word string, t int, place int")
    found = some.select("row", "asked", "all", F.posexplode("words").alias("at", "word")).where(F.array_contains("all", F.col("word")))
    found = found.select("row", "word", "at", F.explode("asked").alias("a")).where(F.array_contains("a.look", F.col("word"))).select("row", "word", "at", "a.t")
    shifts = found.join(F.broadcast(postings), ["word", "t"]).groupBy("row", "t", (F.col("at") - F.col("place")).alias("shift")).agg(F.count_distinct("word").alias("votes"))
    proposed = shifts.where(F.col("votes") >= votes).groupBy("row").agg(F.collect_list(F.struct("t", "shift")).alias("proposed"))  # a file's own

    texts, keys = (F.array(*[_literal(t[k].split()) for t in every]) for k in (2, 1))
    offsets, labels = F.array(*[F.lit(_offset(t)) for t in every]), _literal([t[0] for t in every])
    rows = some.select("row", "words").join(proposed, "row")
    rows = rows.withColumns({"texts": texts, "keys": keys, "offsets": offsets, "names": labels})
    stands = lambda words, start: F.forall(F.transform(words, lambda w, i: F.coalesce(F.get(F.col("words"), start + i) == w, F.lit(False))), lambda x: x)
    share = lambda words, start: F.size(F.filter(F.transform(words, lambda w, i: F.get(F.col("words"), start + i) == w), lambda x: x)) / F.size(words)
    of = lambda column, s: F.get(F.col(column), s["t"])
    rows = rows.withColumn("verified", F.filter("proposed", lambda s: stands(of("keys", s), s["shift"] + of("offsets", s))))
    is_base = lambda s: s["t"] < len(base)
    rows = rows.withColumns(
        {
            "starts": F.transform(F.filter("verified", is_base), lambda s: s["shift"]),
            "base": F.transform(F.filter("verified", is_base), lambda s: of("names", s)),
            "own": F.filter(F.transform(F.filter("verified", lambda s: ~is_base(s)), lambda s: F.struct(of("names", s).alias("label"), share(of("texts", s), s["shift"]).alias("share"))), lambda x: x["share"] >= min_share),
        }
    )
    hits = rows.select("row", "starts", F.array_distinct("base").alias("base"), F.array_distinct("own.label").alias("own"), F.array_max("own.share").alias("score"))
    none, joined = F.array().cast("array<string>"), lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return (
        files.select("row", "doc_id", "n_words")
        .join(hits, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.size(F.coalesce("starts", F.array().cast("array<int>"))).cast("long").alias("n_base"),
            F.array_min("starts").cast("long").alias("first_word"),
            F.array_max("starts").cast("long").alias("last_word"),
            joined(F.coalesce("base", none)).alias("base_labels"),
            joined(F.concat(F.coalesce("base", none), F.coalesce("own", none))).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )


def _sql(templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE_PHRASES, min_share: float = MIN_SHARE) -> str:
    """The same rows in DuckDB, by looking for each key phrase at each place."""
    listed = lambda s: "[" + ", ".join(f"'{w}'" for w in s.split()) + "]"
    rows = [f"('{label}', {listed(phrase)}, {listed(phrase)}, 0, true)" for phrase, label in base.items()]
    rows += [f"('{t[0]}', {listed(t[1])}, {listed(t[2])}, {_offset(t)}, false)" for t in templates]
    return rf"""
    with t(label, phrase, words, place, is_base) as (values {', '.join(rows)}),
    d as (
      select row_number() over () as row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
      from documents),
    p as (
      select row, label, words, is_base, spot, spot - place as shift
      from (select d.row, t.label, t.phrase, t.words, t.place, t.is_base, d.w, unnest(range(1, len(d.w) - len(t.phrase) + 2)) as spot from d join t on list_has_all(d.w, t.phrase)) x
      where w[spot : spot + len(phrase) - 1] = phrase),
    s as (
      select p.*, len(list_filter(range(1, len(words) + 1), lambda i: shift + i - 1 >= 1 and d.w[shift + i - 1] = words[i]))::double / len(words) as share from p join d using (row)),
    h as (
      select row, count(*) filter (where is_base) as n_base, min(spot - 1) filter (where is_base) as first_word, max(spot - 1) filter (where is_base) as last_word,
             string_agg(distinct label, ',' order by label) filter (where is_base) as base_labels,
             string_agg(distinct label, ',' order by label) filter (where is_base or share >= {min_share}) as labels, max(share) filter (where not is_base and share >= {min_share}) as score
      from s group by row)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
           coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
    from d left join h using (row)"""


SQL = _sql()
