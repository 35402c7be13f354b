"""Text functions as columns: chunks, sentences, previews, scores and prompts.

Arrays that a lambda refers to are columns of their own first: inside a lambda their expression
would be computed again for each element.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a fixed chunk, and words that it has in common with the next.
CHUNK_WORDS, OVERLAP_WORDS = 250, 30
#: Abbreviations whose dots end no sentence, wherever they stand. Fixed values.
ABBREVIATIONS = (
    "e.g.", "i.e.", "etc.", "vs.", "dr.", "mr.", "mrs.", "ms.", "prof.", "fig.",
    "vol.", "no.", "p.", "pp.", "al.", "approx.", "est.", "inc.", "corp.",
)


#: White space, Unicode's included: for trimming, and as a class.
_BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, _SPACE + "+"), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def preview(c: Column, n: int) -> Column:
    """The first n characters, and an ellipsis if there are more."""
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "…").otherwise(""))


def fixed_chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, text: str = "text") -> DataFrame:
    """docs with chunks: texts of up to size words stay as they are, longer ones become windows of
    size words that share overlap with the next; without words there are none. An overlap of size
    or more counts as none."""
    step = size - overlap if overlap < size else size
    rows = docs.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    n = F.size("_words")
    last = F.ceil((n - size) / step).cast("int")
    window = lambda i: F.array_join(F.slice("_words", i * step + 1, size), " ")
    long = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)
    none = F.array().cast("array<string>")
    return rows.withColumn("chunks", F.when(n == 0, none).when(n <= size, F.array(text)).otherwise(long)).drop("_words")


#: Parts sentences while they are one string. It holds no letter, so no pattern here sees it.
_CUT = "\x01\x02\x01"
#: Where sentences part, for chunking: white space after a mark, unless the mark is the dot of an
#: abbreviation, and white space with a line break in it. A dot inside a number has no space after it.
_ENDS = r"(?U)(?=\s)(?:(?<=[!?])|(?<=\.)(?<!(?i:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + r"))|(?<!\s)(?=[^\S\n\r]*+[\n\r]))\s++"
#: For grounding: white space after a mark and before a capital, digit, quote or bracket, or with a
#: line break right after the mark.
_CLAIM_ENDS = r"""(?U)(?=\s)(?<=[.!?])(?:\s++(?=[A-Z0-9"'(\[])|\n++\s*+)"""
#: What a stripped piece of two or three words at least holds.
_TWO, _THREE = r"(?U)\s", r"(?U)\s\S+\s"


def _glue(docs: DataFrame, enough: str, out: str) -> DataFrame:
    """docs with pieces _pieces -> out: pieces without what enough asks for go to the one before.
    Each piece brings what stands before it, so one pass over the array does."""
    led = F.transform("_pieces", lambda x, i: F.concat(F.when(i == 0, "").when(x.rlike(enough), _CUT).otherwise(" "), x))
    whole = F.split(F.array_join(led, ""), _CUT, -1)
    none = F.array().cast("array<string>")
    return docs.withColumn(out, F.when(F.size("_pieces") == 0, none).otherwise(whole)).drop("_pieces")


def sentences(docs: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """docs with sentences for chunking: ends are . ! ? before white space, and line breaks.
    Abbreviations and decimal points are no ends; a piece of one word goes to the one before."""
    pieces = F.array_remove(F.split(strip(F.coalesce(F.col(text), F.lit(""))), _ENDS), "")
    return _glue(docs.withColumn("_pieces", pieces), _TWO, out)


def claims(docs: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """docs with sentences for grounding: ends are . ! ? before white space and a capital, digit,
    quote or bracket, or before line breaks; a piece of fewer than three words goes to the one
    before. An empty or null text has none, a blank one has one empty sentence."""
    pieces = F.array_remove(F.split(strip(F.coalesce(F.col(text), F.lit(""))), _CLAIM_ENDS), "")
    rows = _glue(docs.withColumn("_pieces", pieces), _THREE, out)
    blank = (F.length(text) > 0) & (F.size(out) == 0)
    return rows.withColumn(out, F.when(blank, F.array(F.lit(""))).otherwise(F.col(out)))


# ---- relevance ------------------------------------------------------------------------------


def cross_score(pairs: DataFrame, out: str = "score") -> DataFrame:
    """pairs (query, title, text) with a score from 0 to 1: 0.40 of the query's words that the
    document has, 0.25 if it holds the query, 0.20 of its word pairs that it holds, 0.15 if the
    title holds a word, and up to 0.20 by how often words occur. Pairs, title and occurrences are
    matched as substrings."""
    word = r"(?U)\b\w+\b"
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = pairs.withColumns(
        {
            "_asked": F.lower(text("query")),
            "_title": F.lower(text("title")),
            "_doc": F.lower(F.concat(text("title"), F.lit(" "), text("text"))),
        }
    )
    rows = rows.withColumns(
        {
            "_q": F.filter(F.regexp_extract_all("_asked", F.lit(word), 0), lambda w: F.length(w) > 1),
            "_d": F.array_distinct(F.regexp_extract_all("_doc", F.lit(word), 0)),
        }
    )
    rows = rows.withColumns({"_hit": F.filter("_q", lambda w: F.array_contains("_d", w)), "_next": F.slice("_q", 2, F.greatest(F.size("_q"), F.lit(1)))})
    n = F.size("_q")
    pairs_of = F.filter(F.zip_with("_q", "_next", lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    rows = rows.withColumn("_pairs", pairs_of)
    held = F.size(F.filter("_pairs", lambda x: F.contains(F.col("_doc"), x)))
    times = lambda w: F.least((F.length("_doc") - F.length(F.replace(F.col("_doc"), w, F.lit("")))) / F.length(w), F.lit(5.0))
    often = F.aggregate("_hit", F.lit(0.0), lambda acc, w: acc + times(w)) / (n * 3 + 1)
    total = (
        F.size("_hit") / n * 0.40
        + F.when(F.contains(F.col("_doc"), F.col("_asked")), 0.25).otherwise(0.0)
        + F.when(n >= 2, held / (n - 1) * 0.20).otherwise(0.0)
        + F.when(F.exists("_q", lambda w: F.contains(F.col("_title"), w)), 0.15).otherwise(0.0)
        + F.least(often, F.lit(0.20))
    )
    some = (n > 0) & (F.size("_d") > 0)
    scored = rows.withColumn(out, F.when(some, F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(0.0))
    return scored.drop("_asked", "_title", "_doc", "_q", "_d", "_hit", "_next", "_pairs")


def cross_reason(score: Column) -> Column:
    return F.concat(F.lit("The document shares "), (score * 100).cast("int").cast("string"), F.lit("% of the query's words and phrases."))


def grade_prompt(query: Column, title: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Judge how well a document serves a search.\nSearch: "),
        query,
        F.lit("\n\nTitle: "),
        title,
        F.lit("\nText: "),
        F.substring(text, 1, 600),
        F.lit("\n\nGive a number from 0.0, of no use, to 10.0, a full answer. Reply with these two lines and nothing else:\nReasoning: <why, in one sentence>\nScore: <the number>"),
    )


def grade(reply: Column) -> Column:
    """The grade in a reply, from 0 to 1: 0.5 if it names none."""
    found = F.regexp_extract(reply, r"(?i)Score:\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.round(F.least(F.greatest(F.coalesce(found.try_cast("double"), F.lit(5.0)), F.lit(0.0)), F.lit(10.0)) / 10, 4)


#: The reason of a grade that comes without one.
NO_REASON = "Graded by a model."


def grade_reason(reply: Column) -> Column:
    """The line after "Reasoning:", else the first line unless it starts with "Score"."""
    named = F.regexp_extract(reply, r"(?i)Reasoning:\s*([^\n\r]+)", 1)
    first = strip(F.substring_index(reply, "\n", 1))
    fallback = F.when((first != "") & ~first.startswith("Score"), first).otherwise(F.lit(NO_REASON))
    return F.when(named != "", strip(named)).otherwise(fallback)


# ---- prompts --------------------------------------------------------------------------------


def passage_prompt(query: Column) -> Column:
    return F.concat(
        F.lit("Write the paragraph of a handbook that would answer this: "),
        query,
        F.lit("\nKeep to facts, and give the paragraph only, without greeting or comment."),
    )


#: Lead-ins that a generated passage may begin with, and that go. Fixed values.
LEAD_INS = ("Here is a paragraph", "Sure!", "Here's an explanation")


def passage(query: Column, reply: Column) -> Column:
    """A generated passage without lead-in; the query where nothing, or an error, came back."""
    bad = reply.isNull() | (reply == "") | reply.startswith("ERROR")
    clean = F.regexp_replace(strip(reply), rf"(?i)^({'|'.join(LEAD_INS)}):\s*", "")
    return F.when(bad | (clean == ""), query).otherwise(clean)


#: What an answering model is told, with context and without.
ANSWER_RULES = (
    "Answer the question below in plain and exact words. Where the numbered sources tell, follow them and nothing else; where they do not, say what is generally known. "
    "Speak of the matter itself and not of the sources."
)
ANSWER_FREELY = "Give a direct answer to this question:"


def answer_prompt(question: Column, contexts: Column) -> Column:
    """contexts: array of (title, text), by rank."""
    block = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["title"], F.lit(":\n"), c["text"]))
    with_context = F.concat(F.lit(ANSWER_RULES + "\n\nSources:\n"), F.array_join(block, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    without = F.concat(F.lit(ANSWER_FREELY + "\n"), question, F.lit("\n\nAnswer:"))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, with_context).otherwise(without)


def chunk_title(title: Column, place: Column, n: Column, strategy: str) -> Column:
    """place from 1; the place is named only if there are several."""
    tag = F.when(n > 1, F.concat(F.lit(" ["), place.cast("string"), F.lit("/"), n.cast("string"), F.lit("]"))).otherwise("")
    return F.concat(title, tag, F.lit(f" ({strategy})"))
