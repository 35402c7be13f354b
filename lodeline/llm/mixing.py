"""Mixing sources to target weights by weighted fair queueing.

Each source owns a queue of its documents in shuffled order, twice over (a document may be taken
two times at most). A copy's virtual finish time is the source's words up to and with it, divided
by the source's target; the mix takes copies by virtual finish time until the budget is used up.

Both running sums are two-level. Sums over (source, slice of the shuffle key), respectively over
slots of virtual time, are small tables that are accumulated first; the rows then only need a sum
within their own slice. So a source that holds a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.llm.shared import staged, word_count

#: Hex digits of the shuffle key that make a slice: 16 ** 3 slices of each source.
SLICE_DIGITS = 3
#: Slots of virtual time up to 1; all after OVERFLOW share the last one.
SLOTS, OVERFLOW = 4096, 5120


def _running(order: Sequence[Column], *by: Column) -> Window:
    w = Window.partitionBy(*by) if by else Window
    return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def source_targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """sources (source, source_size) -> with rank, weight and target.

    Sources in code point order, null last, have the weights in turn. They share percent % of all
    sizes by weight; no target is above most times its source's size, and the excess goes to the
    others by weight until none is above. In closed form: ordered by cap over weight, the first
    sources are capped, as many as have a cap of at most their share of what is left.
    Sources of size 0 have target 0. One row a source, so the sums run over this small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ratio = F.col("source_size").cast("double") / F.col("weight")
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(percent) * F.col("total") - 100 * most * F.col("before")  # in hundredths of a word
    return (
        sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", w)
        .withColumn("ratio", ratio)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(after))
        .withColumn("capped", (100 * most * F.col("source_size") * F.col("rest") <= left * F.col("weight")))
        .withColumn("level_left", F.max(F.when(~F.col("capped"), left)).over(everything))
        .withColumn("level_rest", F.max(F.when(~F.col("capped"), F.col("rest"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(
                (F.col("weight") * F.col("level_left")).cast("double") / (100 * F.col("level_rest")).cast("double")
            ),
        )
        .select("source", "source_size", "rank", "weight", "target", "total")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, row: str = "doc_id") -> DataFrame:
    """docs (doc_id, text, source, ...) -> row, size, source_size, target, taken: one row a document.

    The shuffle key is the MD5 of doc_id, so reruns agree. Null texts and texts without words have
    size 0 and take nothing; very long ones count whole. A null source is a source of its own, a
    null doc_id shuffles as the empty string. Rows that repeat a doc_id are documents of their own;
    rows alike in doc_id, source and size are interchangeable, unless the column row numbers them.
    An empty table gives an empty result. Other columns are not looked at."""
    docs = docs.select("doc_id", F.col(row).alias("row"), "source", word_count(F.col("text")).alias("size"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = staged(docs.withColumn("h", key).withColumn("slice", F.substring("h", 1, SLICE_DIGITS)), "sizes")

    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = staged(source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, percent, most), "targets")
    offsets = slices.withColumn("offset", F.sum("slice_size").over(_running([F.col("slice")], F.col("source"))) - F.col("slice_size"))
    offsets = offsets.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "slice_size")

    order = [F.col("h"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row")]
    # source as a join key that is never null
    named = lambda df: df.withColumn("sk", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))))
    queued = (
        named(rows)
        .withColumn("within", F.sum("size").over(_running(order, F.col("sk"), F.col("slice"))))
        .join(named(offsets).drop("source"), ["sk", "slice"])
        .withColumn("cum", F.col("offset") + F.col("within"))
        .drop("within", "offset", "sk", "slice", "source")
    )
    queued = staged(queued, "queued")
    copies = queued.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("cum")).cast("double") / F.col("target"))
    copies = copies.withColumn("slot", F.least(F.floor(F.col("finish") * SLOTS), F.lit(OVERFLOW)).cast("int"))

    # the slots are a bounded table: at most OVERFLOW + 1 rows
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("slot_end", F.sum("slot_size").over(_running([F.col("slot")])))
    budget = F.floor(F.lit(percent) * F.col("total") / 100)
    marked = copies.join(F.broadcast(slots), "slot")
    whole = marked.where(F.col("slot_end") <= budget)
    first_cut = marked.where((F.col("slot_end") > budget) & (F.col("slot_end") - F.col("slot_size") <= budget))
    by_finish = [F.col("finish"), F.col("rank"), F.col("copy"), *order]
    cut = first_cut.withColumn("upto", F.col("slot_end") - F.col("slot_size") + F.sum("size").over(_running(by_finish, F.col("slot"))))
    kept = whole.select("doc_id", "h", "size", "rank", "cum").unionByName(cut.where(F.col("upto") <= budget).select("doc_id", "h", "size", "rank", "cum"))
    times = kept.groupBy("rank", "cum", "h").agg(F.count("*").alias("times"))
    # (rank, cum) names one document with words: the source's running sum grows with each
    return queued.join(times, ["rank", "cum", "h"], "left").select(
        F.col("row").alias(row),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, F.col("size") * F.coalesce("times", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


#: The same rows in DuckDB.
SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rank from s),
w as (select *, ([3, 1, 2])[(rank - 1) % 3 + 1]::bigint as weight, (sum(source_size) over ())::bigint as total from r),
o as (select *, source_size::double / weight as ratio from w),
c as (
  select *, coalesce(sum(source_size) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)::bigint as before,
         (sum(weight) over (order by ratio, rank rows between current row and unbounded following))::bigint as rest
  from o),
k as (select *, 200 * source_size * rest <= (150 * total - 200 * before) * weight as capped from c),
l as (select max(150 * total - 200 * before)::bigint as level_left, max(rest)::bigint as level_rest from k where not capped),
t as (
  select source, source_size, rank, total,
         case when capped then (2 * source_size)::double else (weight * level_left)::double / (100 * level_rest)::double end as target
  from k cross join (select max(level_left) as level_left, max(level_rest) as level_rest from l) l),
q as (
  select d.doc_id, d.size, d.h, t.source_size, t.rank, t.total, t.target,
         (sum(d.size) over (partition by t.rank order by d.h, d.doc_id nulls last, d.size rows between unbounded preceding and current row))::bigint as cum
  from d join t on d.source is not distinct from t.source),
n as (select q.*, copy, (copy * source_size + cum)::double / target as finish from q cross join (select unnest([0, 1]) as copy) where size > 0),
u as (
  select *, (sum(size) over (order by finish, rank, copy, h, doc_id nulls last, size rows between unbounded preceding and current row))::bigint as upto
  from n),
x as (select rank, cum, h, count(*) as times from u where upto <= 150 * total // 100 group by all)
select q.doc_id, q.size, q.source_size, q.target, (case when q.size > 0 then q.size * coalesce(x.times, 0) else 0 end)::bigint as taken
from q left join x on q.rank = x.rank and q.cum = x.cum and q.h = x.h
"""
