"""URL filter: fixed rules first, then association rules mined from labelled pages.

DataFrame functions and the JVM's own FP-growth only. A URL's tokens are its scheme, its host's
labels and its path's segments. Labelled pages are transactions of tokens and a verdict; FP-growth
finds the frequent token sets, and those that imply a verdict with enough confidence, and clearly
more often than it is given anyway, are the rules. An inverted index from token to rule finds the
rules all of whose tokens a URL has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.shared import ascii_lower, staged

#: (action, host and path): the fixed rules of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A rule's tokens and verdict are in this share of the labelled pages at least, at every size; a rule
#: holds for this share of the pages that have its tokens, and for so many times the verdict's own share.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.5, 1.1
#: Confidence is that of a rule's pages and of so many more with the verdict's own share, so that a
#: few pages make no rule.
PRIOR = 10
#: Index rows that are sent along to all tasks at most; a larger index is dealt by token.
MOST_SENT = 500_000
VERDICTS = {"verdict:block": "block", "verdict:allow": "allow"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, #
    or the end. Both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none does. A rule fits its host and
    the host's subdomains, if the path starts with the rule's. rules is a list of the caller's, in
    the driver and in the plan: some hundreds at most."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(action)
    return rule, action


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; ASCII-only patterns, so any URL gives some or none."""
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    scheme = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(""))
    return F.array_distinct(F.concat(tag("scheme:", F.array(F.coalesce(ascii_lower(scheme), F.lit("")))), tag("host:", F.split(host, r"[.]")), tag("path:", F.split(path, r"[/._-]"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, prior: float = PRIOR) -> DataFrame:
    """labelled (tokens, blocked) -> rule, tokens, verdict, confidence, support of the rules.

    A rule that has one token more than another of the same verdict stays only if it is more
    confident. Empty without labelled rows. Every labelled row counts."""
    block, allow = VERDICTS
    baskets = labelled.select(F.concat("tokens", F.array(F.when(F.col("blocked"), block).otherwise(allow))).alias("items"))
    baskets = staged(baskets, "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].isin(*VERDICTS))
    share, pages = F.col("confidence") / F.col("lift"), F.lit(baskets.count())
    shrunk = (F.col("support") * pages + prior * share) / (F.col("support") * pages / F.col("confidence") + prior)
    # rounded, so that equal ones are equal whatever the order of their arithmetic
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.when(F.col("consequent")[0] == block, "block").otherwise("allow").alias("verdict"), F.round(shrunk, 9).alias("confidence"), "support", F.round(share, 9).alias("share"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("share"))).drop("share")
    rules = staged(rules.withColumn("rule", F.array_join("tokens", " ")), "url-rules")
    shorter = rules.select("rule", "verdict", "confidence", F.explode("tokens").alias("without"), "tokens")
    shorter = shorter.select(F.col("rule").alias("longer"), "verdict", F.col("confidence").alias("c"), F.array_join(F.array_remove("tokens", F.col("without")), " ").alias("rule"))
    beaten = shorter.join(rules.select("rule", "verdict", "confidence"), ["rule", "verdict"]).where("confidence >= c")
    return rules.join(beaten.select(F.col("longer").alias("rule"), "verdict").distinct(), ["rule", "verdict"], "left_anti")


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, prior: float = PRIOR
) -> DataFrame:
    """pages (page_id, url, ...), labels (page_id, blocked) -> page_id, host, path, rule, verdict,
    mined_rule, mined_verdict, confidence: one row a page.

    verdict is the fixed rule's, else "block" where a mined rule for it matches, else "allow".
    mined_rule is the matching rule that decides, or would where a fixed one does: the most
    confident one for a block, else the most confident one to allow; of equal ones the last by its
    text. Labels that disagree about a page, or are null, are left out; repeated ones count once.
    Null URLs and those without :// have empty host and path; null and empty ones, of which no rule
    can match any, get "allow". URLs of any length are read whole. Rows that repeat a page_id or a
    url are judged each for itself. Empty tables give empty results, no labels no mined rules.
    Other columns are not looked at, whatever their names."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), tokens_of(F.col("url"), host, path).alias("tokens"))
    urls = staged(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    agreed = labels.where("page_id is not null and blocked is not null").groupBy("page_id").agg(F.min("blocked").alias("blocked"), F.max("blocked").alias("most")).where("blocked = most").drop("most")
    mined = mine(urls.join(agreed, "page_id").select("tokens", "blocked"), min_support, min_confidence, min_lift, prior)

    index = staged(mined.select("rule", "verdict", "confidence", F.size("tokens").alias("needs"), F.explode("tokens").alias("token")), "url-index")
    if index.count() <= MOST_SENT:
        index = F.broadcast(index)
    asked = urls.select("row", F.explode("tokens").alias("token"))
    matched = asked.join(index, "token").groupBy("row", "rule", "verdict", "confidence", "needs").agg(F.count("*").alias("has")).where("has = needs")
    top = F.max(F.struct((F.col("verdict") == "block").alias("blocks"), "confidence", "rule", "verdict")).alias("top")
    best = matched.groupBy("row").agg(top).select("row", F.col("top.rule").alias("mined_rule"), F.col("top.verdict").alias("mined_verdict"), F.col("top.confidence").alias("confidence"))

    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return (
        urls.join(best, "row", "left")
        .withColumns({"rule": rule, "action": action})
        .select("page_id", "host", "path", "rule", F.coalesce("action", "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule", "mined_verdict", "confidence")
    )


def _sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The query's rows in DuckDB: every set of a page's tokens is looked up, so for short URLs only."""
    fits = lambda t: f"(host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}')"
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    case = lambda put: "case " + " ".join(f"when {fits(t)} then '{put(v, t)}'" for v, t in longest) + " end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tagged = lambda kind, parts: f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{kind}:' || x)"
    return rf"""
    with r as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, case when instr(url, '://') > 0 then {lower.format("split_part(url, '://', 1)")} else '' end as scheme, {lower.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} as host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r),
    t as (select row_number() over () as row, *, list_sort(list_distinct(list_concat({tagged('scheme', '[scheme]')}, {tagged('host', "string_split(host, '.')")}, {tagged('path', "string_split_regex(path, '[/._-]')")}))) as tokens from p),
    a as (select doc_id as page_id, min(b) as blocked from (select doc_id, quality = 0 or toxic = 1 as b from labels) where doc_id is not null and b is not null group by doc_id having min(b) = max(b)),
    n as (select count(*)::double as n, ceil({MIN_SUPPORT} * count(*)) as least, count(*) filter (where blocked)::double as bad from t join a using (page_id)),
    s as (select row, page_id, len(q) as needs, array_to_string(q, ' ') as rule, q from (select row, page_id, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) as q from (select *, unnest(range(1, 1 << len(tokens))) as mask from t))),
    c as (select rule, any_value(q) as q, count(*)::double as has, count(*) filter (where blocked)::double as bad from s join a using (page_id) group by rule),
    v as (select rule, q, 'block' as verdict, c.bad as both_, has, n.bad / n.n as share, least from c, n union all select rule, q, 'allow', has - c.bad, has, (n.n - n.bad) / n.n, least from c, n),
    k as (select rule, q, verdict, round((both_ + {PRIOR} * share) / (has + {PRIOR}), 9) as confidence from v
          where both_ >= least and both_ > 0 and both_ / has >= {MIN_CONFIDENCE} and round((both_ + {PRIOR} * share) / (has + {PRIOR}), 9) >= {MIN_CONFIDENCE}
            and round((both_ + {PRIOR} * share) / (has + {PRIOR}), 9) >= {MIN_LIFT}::double * round(share, 9)),
    b as (select distinct l.rule, l.verdict from (select *, unnest(q) as without from k) l join k z on z.verdict = l.verdict and z.rule = array_to_string(list_filter(l.q, lambda x: x <> l.without), ' ') where z.confidence >= l.confidence),
    m as (select s.row, k.rule as mined_rule, k.verdict as mined_verdict, k.confidence from s join k using (rule) anti join b on b.rule = k.rule and b.verdict = k.verdict
          qualify row_number() over (partition by s.row order by k.verdict desc, k.confidence desc, k.rule desc) = 1)
    select page_id, host, path, {case(lambda v, t: t)} as rule, coalesce({case(lambda v, t: v)}, mined_verdict, 'allow') as verdict, mined_rule, mined_verdict, confidence
    from t left join m using (row)"""


SQL = _sql()
