"""Quality classifier: a document's own evidence combined with its site's, by hierarchical
empirical Bayes.

A logistic regression over cheap text statistics gives each document's probability of being good.
Sites (host, and path below it) have posteriors of their own: the mean evidence of their documents,
shrunk toward the level above - path toward host, host toward the whole corpus - with a strength
estimated from how much the sites differ. A document's odds are the product of its likelihood
ratio and its site's posterior odds; its own evidence is left out of that posterior, as it would
count twice. Everything but the regression's bounded training sample is a grouped aggregation over
all documents.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import LOWER, UPPER, staged, word_count

#: Labelled rows that the regression is fitted on: about so many, picked by a hash of doc_id.
FIT_ROWS = 50_000
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 4.0, 10_000.0
#: No single probability is taken for more certain than this.
CERTAIN = 0.999
THRESHOLD = 0.5
#: The regression's penalty for each row, and most rounds of Newton's method.
RIDGE, ROUNDS = 1e-4, 60
#: Documents of a site that one task holds against it: larger sites are spread over several tasks.
SPREAD = 1_000_000
#: So many large sites are sent along to all tasks at most.
MOST_LARGE = 10_000
SYMBOLS, MARKS, STOPS = "$%&*#@^~<>{}[]\\=+_|/", "!?", ".,;:"


def features(text: Column) -> dict[str, Column]:
    """Numbers that grow with neither the text's length nor its language; 0 for empty and null."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    lines = F.split(text, "\n")
    words = F.split(text, r"\s+")
    # the second array is the first one's own rest: a lambda that held the split would redo it for each word
    stutter = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: a == b), lambda x: x))
    return {
        "stutter": stutter / F.size(words),
        "brevity": 8 / (8 + F.size(words)),
        "symbols": share(SYMBOLS),
        "bars": share("|"),
        "marks": share(MARKS),
        "stops": share(STOPS),
        "upper": share(UPPER),
        "lower": share(LOWER),
        "digits": share("0123456789"),
        "spaces": share(" "),
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "log_length": F.log(n.cast("double")),
    }


def regression(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on standardised features, by Newton's method;
    the penalty keeps it finite where the classes part completely."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 0.0
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def fit(labelled: DataFrame, names: list[str], fit_rows: int = FIT_ROWS) -> tuple[list[float], float]:
    """labelled (doc_id, good, features) -> weights and intercept. About fit_rows rows, picked by a
    hash of doc_id, come to the driver. Without one of the classes the weights are 0 and the
    intercept is the smoothed log odds of the labels."""
    n, good = labelled.agg(F.count("*"), F.count_if("good")).first()
    if good == 0 or good == n:
        return [0.0] * len(names), math.log((good + 1) / (n - good + 1))
    some = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // fit_rows))) == 0)
    rows = some.select(F.col("good").cast("double").alias("y"), *names).toArrow().to_pandas().sort_values(["y", *names])  # bounded
    y = rows["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return [0.0] * len(names), math.log((good + 1) / (n - good + 1))
    weights, intercept = regression(rows[names].to_numpy(float), y)
    return weights.tolist(), intercept


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1 - CERTAIN)), F.lit(CERTAIN))
    return F.log(p / (1 - p))


def _strength(mean: str, n: str, toward: str) -> Column:
    """Strength of the prior of groups whose means vary around toward: by the method of moments,
    from groups of two documents at least; the most where they differ no more than by chance."""
    spread = F.avg(F.when(F.col(n) > 1, (F.col(mean) - F.col(toward)) ** 2 - F.col(mean) * (1 - F.col(mean)) / F.col(n)))
    inner = F.avg(F.when(F.col(n) > 1, F.col(toward) * (1 - F.col(toward))))
    return F.least(F.greatest(F.when(spread > 0, inner / spread - 1).otherwise(F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def assess(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, model: tuple[list[float], float] | None = None, spread: int = SPREAD
) -> DataFrame:
    """docs (doc_id, text, host, path, ...), labels (doc_id, good) -> doc_id, t (a hash of the
    text), host, path, p_doc, p_host, p_path, p_good, keep: one row a document.

    p_host and p_path are the posteriors of the document's site by all other documents' evidence: a
    label's, else the regression's. model is a regression's weights, by the order of features(),
    and intercept, if there is one already. Null hosts and paths are sites of their own. Null and
    empty texts, and those without words, say nothing: their p_doc is the corpus mean, so their
    site decides. Very long texts are read whole and count as one document like any other. Labels
    that disagree about a doc_id count as the majority's, ties as bad; null ones are left out. Rows
    that repeat a doc_id are judged each for itself. Without labels every document is as likely
    good as bad and is kept; p_good equal to threshold keeps. An empty table gives an empty result.
    Other columns are not looked at, whatever their names."""
    agreed = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg((F.avg(F.col("good").cast("int")) > 0.5).alias("good"))
    names = list(features(F.lit("")))
    keyed = docs.select("doc_id", "host", "path", F.xxhash64("text").alias("t"), (word_count(F.col("text")) > 0).alias("speaks"), *[c.alias(k) for k, c in features(F.col("text")).items()])
    rows = staged(keyed, "quality-features")
    weights, intercept = model or fit(rows.join(agreed, "doc_id").where("speaks"), names, fit_rows)
    raw = reduce(lambda a, b: a + b, (F.col(k) * F.lit(w) for k, w in zip(names, weights, strict=True)), F.lit(intercept))
    sure = lambda p: F.least(F.greatest(p, F.lit(1 - CERTAIN)), F.lit(CERTAIN))
    # null-safe keys: a site is a string, and null is one of its own
    site = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    scored = rows.select("t", "doc_id", "host", "path", site("host").alias("h"), site("path").alias("p"), F.when(F.col("speaks"), sure(1 / (1 + F.exp(-raw)))).alias("p_doc"))
    scored = scored.join(agreed, "doc_id", "left").withColumn("y", F.coalesce(F.col("good").cast("double"), "p_doc")).drop("good")
    scored = staged(scored, "quality-scores")

    paths = scored.groupBy("h", "p").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("sum"), F.count("y").alias("n"), F.count("*").alias("docs"))
    paths = staged(paths, "quality-paths")
    hosts = paths.groupBy("h").agg(F.sum("sum").alias("host_sum"), F.sum("n").alias("host_n"))
    corpus = hosts.agg((F.coalesce(F.sum("host_sum"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("host_n"), F.lit(0)) + 2))
    p0 = float(corpus.first()[0])
    own = hosts.select((F.col("host_sum") / F.greatest("host_n", F.lit(1))).alias("mean"), "host_n", F.lit(p0).alias("p0"))
    m_host = own.agg(_strength("mean", "host_n", "p0")).first()[0] or MOST_STRENGTH
    p_host = lambda total, n: (total + m_host * p0) / (n + m_host)
    paths = paths.join(hosts, "h").withColumns({"mean": F.col("sum") / F.greatest("n", F.lit(1)), "p_host": p_host(F.col("host_sum"), F.col("host_n"))})
    m_path = paths.agg(_strength("mean", "n", "p_host")).first()[0] or MOST_STRENGTH

    # a site of very many documents is there once for each of its tasks
    parts = F.ceil(F.col("docs") / spread).cast("int")
    sites = paths.select("h", "p", "sum", "n", "host_sum", "host_n", parts.alias("parts"))
    large = sites.where("parts > 1").select("h", "p", "parts")  # at most documents / spread rows
    n_large, dealt = large.count(), scored.withColumn("part", F.lit(0))
    if n_large:
        dealt = scored.join(F.broadcast(large) if n_large <= MOST_LARGE else large, ["h", "p"], "left")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "t"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    judged = dealt.join(sites.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["h", "p", "part"])
    # without the document's own evidence
    one, mine = F.col("y").isNotNull().cast("int"), F.coalesce("y", F.lit(0.0))
    judged = judged.withColumns({"p_doc": F.coalesce("p_doc", F.lit(p0)), "p_host": p_host(F.col("host_sum") - mine, F.col("host_n") - one)})
    judged = judged.withColumn("p_path", (F.col("sum") - mine + m_path * F.col("p_host")) / (F.col("n") - one + m_path))
    odds = _logit(F.col("p_doc")) - _logit(F.lit(p0)) + _logit(F.col("p_path"))
    return judged.withColumn("p_good", 1 / (1 + F.exp(-odds))).select("doc_id", "t", "host", "path", "p_doc", "p_host", "p_path", "p_good", (F.round("p_good", 9) >= threshold).alias("keep"))


def table_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 1).alias("good"))


def sites(docs: DataFrame) -> DataFrame:
    """documents with host and path: a source is a host, its languages are the paths below it."""
    return docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
