"""Near-duplicates by bottom-k sketches of one hash function.

Documents with equal shingle sets are one class. A class's sketch is the k smallest hashes of its
set. Inverted lists of the values that sketches retain generate overlaps: two sets of the wanted
similarity share many values, so each class only enters its rarest values into the lists, as many
as are needed for two such sets to meet (values of one class alone need no list). What meets has
to pass a bound from parity bits of the full sets, then the estimate from the sketch of the union,
then the exact similarity of the full sets.

No list is expanded into all its pairs: in each of a few rounds every list has one leader that the
others are held against. Classes found linked hook onto the one among them that most are linked
with, and drop out where all of a list hang together. What is still apart at the end meets
pairwise, list by list, so no link between different components is left out: links inside one need
not be found twice. Lists are cut into parts of bounded length, and each part is a task's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm import shingles
from lodeline.llm.components import components
from lodeline.llm.shared import lean, staged

#: Values that a sketch retains.
K = 64
#: Rounds with leaders before what is left meets pairwise.
ROUNDS = 3
#: Classes of a part of a list, about.
PART = 1024
#: Longs of a set's parity bits, in two halves.
PARITY = 16
#: Sets of up to this size have all their shingles in their parity bits; larger ones a half, a
#: quarter and so on, by their hashes.
WHOLE = 1023
#: A link is lost with less than this probability by what sketches of its sets have to share.
LOST = 1e-8


def parity(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set its level, and its parity bits: how often, modulo 2, shingles hit each bit.

    Bits that differ between two sets are shingles that only one of them has, so they bound the
    symmetric difference from below. At level x only shingles count whose hash ends in x zero bits;
    the first half holds those with one more zero bit, the second half the others, at the same
    places, so that both halves together are comparable to the first half one level below."""
    n = np.diff(starts)
    level = np.zeros(len(n), np.int32)
    while (more := n >> level > WHOLE).any():
        level[more] += 1
    of = np.repeat(np.arange(len(n)), n)
    h = shingles.mix(values.view(np.uint64), 7)
    spot, mark = h & np.uint64(32 * PARITY - 1), h >> np.uint64(16)
    step = np.uint64(1) << level[of].astype(np.uint64)
    counts = mark & (step - np.uint64(1)) == 0
    of, spot = of[counts], spot[counts].astype(np.int64) + 32 * PARITY * ((mark[counts] & step[counts]) != 0)
    bits = np.zeros(len(n) * PARITY, np.uint64)
    np.bitwise_xor.at(bits, of * PARITY + spot // 64, np.uint64(1) << (spot % 64).astype(np.uint64))
    return level, bits.view(np.int64)


def sketched(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """docs (doc_id, text) -> doc_id, t (a hash of the text), n, d1, d2 (the set's size and digest),
    sketch, level and bits."""
    schema = "doc_id long, t long, n long, d1 long, d2 long, sketch array<long>, level int, bits array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, values, starts in shingles.sets(b.column("text"), width):
                n = np.diff(starts)
                d = shingles.digests(values, starts)
                kept = np.minimum(n, k)
                at = np.concatenate([[0], np.cumsum(kept)])
                low = values[np.arange(at[-1]) - np.repeat(at[:-1], kept) + np.repeat(starts[:-1], kept)]
                level, bits = parity(values, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        b.column("t").slice(i, j - i),
                        pa.array(n),
                        pa.array(d[0]),
                        pa.array(d[1]),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(low)),
                        pa.array(level),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * PARITY, PARITY), pa.int32()), pa.array(bits)),
                    ],
                    ["doc_id", "t", "n", "d1", "d2", "sketch", "level", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("t")).mapInArrow(lambda batches: lean(run(batches), "shingles"), schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) -> d1, d2, n, items: whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, values, starts in shingles.sets(b.column("text"), width):
                d = shingles.digests(values, starts)
                yield pa.RecordBatch.from_arrays([pa.array(d[0]), pa.array(d[1]), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))], ["d1", "d2", "n", "items"])

    return docs.select("text").mapInArrow(lambda batches: lean(run(batches), "shingles"), "d1 long, d2 long, n long, items array<long>")


def _surely(percent: int, ratio: float, k: int) -> int:
    """How many values two full sketches of similar sets share, but for LOST, if the smaller set is
    at least ratio of the larger: the larger one's share in the intersection is then p at least."""
    p = percent / (100 + percent) * (1 + ratio)
    below, m = 0.0, 0
    while (below := below + math.comb(k, m) * p**m * (1 - p) ** (k - m)) < LOST:
        m += 1
    return m


def least_shared(n: Column, percent: int, k: int = K) -> Column:
    """How many values the sketch of a set of n shares with a similar set's, at least. Sets small
    enough that a similar one's sketch is its whole set share percent % of theirs for certain."""
    return F.when(n * 100 <= k * percent, F.ceil(n * percent / 100)).otherwise(F.lit(_surely(percent, percent / 100, k)))


def _retained(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """node, common, v, parts, part: the values by which each class enters the inverted lists, how
    many of its sketch's values other classes have too, and of how many parts of a list it is in
    which."""
    postings = classes.select("node", F.explode("sketch").alias("v"))
    lengths = postings.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    listed = postings.join(lengths, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("length", "v"))).alias("some"))  # k at most
    size = F.least("n", F.lit(k))
    enough = size - least_shared(F.col("n"), percent, k) + 1 - (size - F.size("some"))  # alone in its list: met by none
    rows = listed.join(classes.select("node", "n"), "node").withColumn("common", F.size("some")).withColumn("some", F.slice("some", 1, F.greatest(enough, F.lit(0)).cast("int")))
    rows = rows.select("node", "common", F.explode("some").alias("x")).select("node", "common", "x.v", F.ceil(F.col("x.length") / PART).cast("int").alias("parts"))
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _to_parts(lists: DataFrame) -> DataFrame:
    """One row a list -> one for each of its parts."""
    return lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _bounds(classes: DataFrame, end: str) -> DataFrame:
    """classes as end: what _may_match needs, with a column for each long of bits, since code for
    arrays gets too long to be compiled."""
    names = {f"p{w}_{end}": F.get("bits", F.lit(w)) for w in range(PARITY)} | {f"n_{end}": F.col("n"), f"level_{end}": F.col("level").cast("long")}
    return classes.select(F.col("node").alias(end), *(c.alias(name) for name, c in names.items())).where(" and ".join(f"{name} is not null" for name in names))


def _may_match(a: str, b: str, percent: int) -> Column:
    """Sizes, and a bound from the parity bits. Sets of level 0 that are similar always pass; of
    larger ones a link is lost with less than the probability LOST (Bernstein's inequality)."""
    n, m, i, j = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"level_{a}"), F.col(f"level_{b}")
    # masks: of the set that is a level above the other both halves count as one, at equal levels each for itself
    above, below, same = F.shiftright(j - i, 63), F.shiftright(i - j, 63), (i == j).cast("long") * -1
    differ = F.lit(0)
    for w in range(PARITY // 2):
        (x, xx), (y, yy) = ((F.col(f"p{w}_{end}"), F.col(f"p{w + PARITY // 2}_{end}")) for end in (a, b))
        one = x.bitwiseXOR(y).bitwiseXOR(xx.bitwiseAND(above)).bitwiseXOR(yy.bitwiseAND(below))
        differ = differ + F.bit_count(one) + F.bit_count(xx.bitwiseXOR(yy).bitwiseAND(same))
    level, ln = F.greatest(i, j), -math.log(LOST)
    most = (n + m) * ((100 - percent) / (100 + percent)) + 0.001
    some = most / F.pow(F.lit(2.0), level)
    most = F.when(level == 0, most).otherwise(some + ln / 3 + F.sqrt(ln * ln / 9 + 2 * ln * some))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((F.abs(i - j) > 1) | (differ <= most))


def _side(df: DataFrame, end: str, column: str, name: str) -> DataFrame:
    return df.select(F.col("node").alias(end), F.col(column).alias(name))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """pairs (a, b) that the sketch of the union lets pass."""
    both = pairs.join(_side(classes, "a", "sketch", "sa"), "a").join(_side(classes, "b", "sketch", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumns({"union": union, "both": F.array_intersect("sa", "sb")})
    shared = _surely(percent, percent / 100, k)
    return both.where(F.size(F.array_intersect("union", "both")) * k >= F.size("union") * shared).select("a", "b")


def _links(likely: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar."""
    full = likely.join(_side(items, "a", "items", "ia"), "a").join(_side(items, "b", "items", "ib"), "b")
    full = full.withColumn("both", F.size(F.array_intersect("ia", "ib")))
    return full.where(100 * F.col("both") >= percent * (F.size("ia") + F.size("ib") - F.col("both"))).select("a", "b")


def _whole_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """node, items of the nodes: from the document of the smallest doc_id of each."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", "first_doc", "d1", "d2", "n")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_doc"), F.col("text").cast("string"))
    named = texts.join(wanted.where("first_doc is not null").select("first_doc"), "first_doc", "left_semi")
    return full_sets(named.unionByName(texts.where("first_doc is null")), width).join(wanted.drop("first_doc"), ["d1", "d2", "n"]).select("node", "items")


def _hooked(member: DataFrame, links: DataFrame) -> DataFrame:
    """member (node, component) with the components of linked nodes (a, b) hooked together: each
    points to the neighbour of the most links, if that has more than itself, and two such steps are
    taken at once. So components that get one number are connected, and mostly all that are."""
    ends = links.join(member.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(member.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    edges = ends.where("ca <> cb").select(F.explode(F.array(F.struct("ca", "cb"), F.struct(F.col("cb").alias("ca"), F.col("ca").alias("cb")))).alias("e")).select("e.*").distinct()
    edges = staged(edges, "edges")
    degree = edges.groupBy("ca").agg(F.count("*").alias("links"))
    near = edges.join(degree.select(F.col("ca").alias("cb"), "links"), "cb")
    hub = F.greatest(F.struct(F.count("*").alias("links"), F.col("ca").alias("c")), F.max(F.struct("links", F.col("cb").alias("c"))))
    step = staged(near.groupBy("ca").agg(hub.alias("hub")).select("ca", F.col("hub.c").alias("to")), "hooks")
    step = step.join(step.select(F.col("ca").alias("to"), F.col("to").alias("next")), "to").select("ca", F.col("next").alias("to"))
    return member.join(step.withColumnRenamed("ca", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, and t (a hash of the
    text) and component (a number of the component, in this result): one row a document.

    Two documents are linked if 100 times the size of the intersection of their shingle sets is at
    least percent times the size of the union. component_id is the smallest doc_id that links lead
    to, kept says whether it is the document's own. Texts of fewer words than width have one
    shingle of all of them; null and empty texts and those without words have none, are linked
    with nothing and kept, and have no component. Very long texts are taken whole. A null doc_id is
    larger than all others; a component of such documents only has a null component_id. Rows that
    repeat a doc_id are documents of their own, and all kept if their doc_id is the component's. An
    empty table gives an empty result. Other columns are not looked at.

    Sets are compared as sets of 64-bit hashes."""
    keys = ["d1", "d2", "n"]
    # the sketches are not kept for each document, only for each class: what is hashed twice is not stored
    rows = staged(sketched(docs, width, k).select("doc_id", "t", *keys), "digests")
    grouped = sketched(docs, width, k).where("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.first("sketch").alias("sketch"), F.first("level").alias("level"), F.first("bits").alias("bits"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "classes", tidy=True)

    lists = staged(_retained(classes, percent, k), "lists", tidy=True)
    member = lists.select("node").distinct().withColumn("component", F.col("node"))
    items, links = None, []
    for turn in range(rounds + 1):
        # what copies are made from shares most: it leads first, then others do
        rank = -F.col("common") if turn < rounds - 1 else F.lit(0)
        now = lists.join(member, "node") if turn else lists.withColumn("component", F.col("node"))
        one = F.min(F.struct(rank.alias("r"), F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("lead"), F.col("component").alias("lead_component")))
        apart = now.groupBy("v").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.first("parts").alias("parts"), one.alias("one")).where("least <> most")
        now = staged(now.join(_to_parts(apart.select("v", "parts", "one.lead", "one.lead_component")), ["v", "part"]), "apart", tidy=True)
        if now.isEmpty():
            break
        if turn < rounds:
            held = now.where("component <> lead_component").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
            pairs = held.join(_bounds(classes, "a"), "a").join(_bounds(classes, "b"), "b").where(_may_match("a", "b", percent)).select("a", "b")
            # a leader has met all of its list
            lists = now.where("node <> lead").select("node", "common", "v", "parts", "part")
        else:
            pairs = _left(now, classes, percent)
        likely = staged(_likely(pairs, classes, percent, k), "likely", tidy=True)
        if likely.isEmpty():
            continue
        ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        more = staged(_whole_sets(docs, ends if items is None else ends.join(items, "node", "left_anti"), classes, width), "sets")
        items = more if items is None else items.unionByName(more)
        found = staged(_links(likely, items, percent), "links", tidy=True)
        links.append(found)
        member = staged(_hooked(member, found), "members", tidy=True)

    whole = classes.select("node", "first_doc", *keys).withColumn("component", F.col("node"))
    if links:
        # what hooks have left apart; linked nodes all are members
        label = lambda end: member.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = reduce(DataFrame.unionByName, links).join(label("a"), "a").join(label("b"), "b").where("ca <> cb")
        merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        member = member.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("own"))
        whole = whole.join(member, "node", "left").withColumn("component", F.coalesce("own", "component")).drop("own")
    whole = staged(whole, "components", tidy=True)
    least = whole.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = whole.join(least, "component").select(*keys, "component_id", "component")
    alone = rows.where("n = 0").select("doc_id", "t", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    done = rows.where("n > 0").select("doc_id", "t", *keys).join(named, keys).select(*alone.columns).unionByName(alone)
    return done.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "t", "component")


def _left(now: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that are in one list of now: each part of a list meets
    the whole list, and a pair is made in the first of its lists only."""
    ours = now.groupBy("node").agg(F.sort_array(F.collect_list("v")).alias("all"))  # k at most

    def side(end: str) -> DataFrame:
        rows = now.select(F.col("node").alias(end), "v", "parts", "part", F.col("component").alias(f"component_{end}"))
        return rows.join(_bounds(classes, end), end).join(ours.select(F.col("node").alias(end), F.col("all").alias(f"all_{end}")), end)

    first = ~F.exists("all_a", lambda v: (v < F.col("v")) & F.array_contains("all_b", v))
    pairs = side("a").drop("parts").join(_to_parts(side("b").drop("part")), ["v", "part"])
    pairs = pairs.where((F.col("component_a") < F.col("component_b")) & _may_match("a", "b", percent) & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: The rows of two-word shingles and 80 % in DuckDB, by all pairs that share a shingle.
SQL = r"""
with recursive w as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct row, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as x from w),
n as (select row, count(*)::bigint as n from s group by row),
p as (select a.row as a, b.row as b, count(*) as shared from s a join s b on a.x = b.x and a.row < b.row group by all),
e as (select a, b from p join n x on x.row = a join n y on y.row = b where 100 * shared >= 80 * (x.n + y.n - shared)),
l as (select a, b from e union all select b, a from e),
c as (select row as a, row as b from n union select c.a, l.b from c join l on c.b = l.a),
m as (select c.a as row, min(w.doc_id) as component_id from c join w on w.row = c.b group by c.a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, case when n.n is null then w.doc_id else m.component_id end as component_id,
       w.doc_id is not distinct from (case when n.n is null then w.doc_id else m.component_id end) as kept
from w left join n using (row) left join m using (row)"""
