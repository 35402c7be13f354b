"""Repeats of a fixed length by suffix arrays, over whole texts of all documents.

A repeat is a window of WINDOW bytes that also starts earlier. Windows are dealt so that equal ones
meet: each window is represented by its anchor, the GRAM-byte string inside it with the smallest
hash, which depends on the window's bytes alone. Consecutive windows of one anchor are a segment.
Anchors that occur once are done. Of the others equal segments are merged into one with its first
place, and the distinct segments of an anchor meet in one block, where a suffix array tells which
of their windows are equal: suffixes smaller than their successors are sorted directly, all others
are induced from them by a scan over the buckets, and windows whose common prefixes with their
neighbours reach WINDOW form a run. A run's first place stays, all others go.

An anchor with very many distinct segments is cut up: its windows are dealt one by one, by their
hash, so that no block grows with the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm import shingles
from lodeline.llm.shared import drop, give_back, lean, staged

WINDOW, GRAM = 100, 24
#: Bytes of text that are hashed at a time, few enough for a core's cache; longer documents are cut, with
#: WINDOW - 1 bytes in common.
PIECE = 1 << 17
#: Bytes of segments in a block, about, and distinct segments from which an anchor is cut up.
BLOCK, CUT = 1 << 21, 4096
#: Symbols of a word: 7 of 9 bits, so that the end of a segment is smaller than every byte.
SYMBOLS = 7


def pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents, and where each starts and ends, in pieces of about PIECE bytes; long ones are cut
    so that each window lies in one piece."""
    step = max(PIECE, 2 * window)
    for i, j in shingles.chunks(offsets, step):
        if j - i == 1 and offsets[j] - offsets[i] > step:
            for a in range(int(offsets[i]), int(offsets[j]) - window + 1, step - window + 1):
                yield np.array([i]), np.array([a, min(a + step, int(offsets[j]))])
        else:
            yield np.arange(i, j), offsets[i : j + 1]


def segments(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts data[bounds[i]:bounds[i + 1]] the segments: anchor hash, segment hash, text number,
    first window's start within data, number of windows."""
    base, n = int(bounds[0]), int(bounds[-1] - bounds[0])
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < window:
        return none
    data = data[base : base + n]
    up, down = shingles.powers(n + 1)
    with np.errstate(over="ignore"):
        # bytes, not letters: hashes tell A from a
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n])])
        grams = shingles.mix((total[gram:] - total[:-gram]) * down[: n - gram + 1], 3)
    # the smallest hash, the first of equals: 40 bits of the hash, 24 of the place
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    start = np.flatnonzero(np.arange(window, window + len(anchor)) <= (bounds[1:] - base)[of])
    if not len(start):
        return none
    anchor, of = anchor[start], of[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    a, z = start[first], start[first] + count - 1 + window
    with np.errstate(over="ignore"):
        whole = shingles.mix((total[z] - total[a]) * down[a] + (z - a).astype(np.uint64), 4)
    return grams[anchor[first]], whole, of[first], a + base, count


_BYTES = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ANCHORS = "h long, g long, doc_id long, t long, start long, windows int"


def anchors(docs: DataFrame, window: int, gram: int, hashes: bool = False) -> DataFrame:
    """docs (doc_id, text, t) -> one row a segment: hashes of anchor and segment, and its place. With
    hashes the anchor's alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = shingles.text_buffer(b.column("text"))
            for numbers, bounds in pieces(offsets, window):
                h, g, of, start, count = segments(data, bounds, window, gram)
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])
                elif len(h):
                    doc = pa.array(numbers[of])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), b.column("doc_id").take(doc), b.column("t").take(doc), pa.array(start - offsets[numbers[of]]), pa.array(count, pa.int32())],
                        ["h", "g", "doc_id", "t", "start", "windows"],
                    )

    return docs.mapInArrow(lambda batches: lean(run(batches), "shingles"), ANCHORS.split(",")[0] if hashes else ANCHORS)


# ---- the suffix array of a block ------------------------------------------------------------


def direct_sort(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places at in the order of their next depth symbols, word by word; only ties go on, and of them
    only groups that a word parts are sorted again."""
    key = words[at]
    order = np.argsort(key)
    out, key = at[order], key[order]
    new = np.ones(len(out), bool)
    new[1:] = key[1:] != key[:-1]
    spot = np.arange(len(out))
    for j in range(SYMBOLS, depth, SYMBOLS):
        alone = new.copy()  # groups of one are done
        alone[:-1] &= new[1:]
        spot, new = spot[~alone], new[~alone]
        if not len(spot):
            break
        key, group = words[out[spot] + j], np.cumsum(new) - 1
        parted = np.zeros(group[-1] + 1, bool)
        parted[group[1:][(key[1:] != key[:-1]) & ~new[1:]]] = True
        some = np.flatnonzero(parted[group])
        order = some[np.lexsort((key[some], group[some]))]
        out[spot[some]], key[some] = out[spot[order]], key[order]
        new[1:] |= key[1:] != key[:-1]
    return out


def two_stage(text: np.ndarray, words: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places where wanted holds, and those that they are induced from, in the order of their next
    depth symbols. text: 0 ends a segment and fills the end, other symbols are bytes plus 1."""
    step = np.diff(text.astype(np.int32), append=0)
    change = np.flatnonzero(step)
    larger = np.zeros(len(text), bool)  # than its successor: first different symbol falls
    if len(change):
        larger[: change[-1] + 1] = np.repeat(step[change] < 0, np.diff(change, prepend=-1))
    # a larger suffix is induced from its successor, so that has to be there; down to a smaller one
    needed, more = wanted.copy(), np.flatnonzero(wanted & larger)
    while len(more):
        more = more[more + 1 < len(text)] + 1
        more = more[~needed[more]]
        needed[more] = True
        more = more[larger[more]]
    seeds = direct_sort(words, np.flatnonzero(needed & ~larger), depth)
    edges = np.searchsorted(text[seeds], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def scan(part: np.ndarray) -> None:
        out.append(part)
        before = part[part > 0] - 1
        before = before[needed[before] & larger[before]]
        if not len(before):
            return
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before = before[order]
        symbol = symbol[order]
        cuts = [0, *(np.flatnonzero(symbol[1:] != symbol[:-1]) + 1).tolist(), len(symbol)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            waiting[symbol[i]].append(before[i:j])

    for c in range(257):
        while waiting[c]:  # again while runs of one symbol are induced
            part, waiting[c] = np.concatenate(waiting[c]), []
            scan(part)
        if edges[c] < edges[c + 1]:
            scan(seeds[edges[c] : edges[c + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def equal_to_neighbour(words: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """Whether each place has a common prefix of window symbols at least with the one before."""
    same = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for j in [*range(0, window - SYMBOLS, SYMBOLS), window - SYMBOLS]:
        left = left[words[order[left] + j] == words[order[left - 1] + j]]
    same[left] = True
    return same


def first_windows(parts: list[bytes], count: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of segments with count windows each, owned by documents of a rank and starting there: which
    windows are the first of their run, as (segment, window number)."""
    # a 0 after each segment: what follows a window decides nothing, as windows with the same bytes stand
    # together in any order that goes by their bytes first; room for words at the end
    length = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    text = np.zeros(begin[-1] + window + 2 * SYMBOLS, np.int16)
    flat = np.frombuffer(b"\0".join(parts), np.uint8)
    text[: len(flat)] = flat
    text[: len(flat)] += 1
    text[begin[1:] - 1] = 0
    # SYMBOLS of them in a word, by words of two and of four
    words = text.astype(np.int64)
    two = words << 9
    two[:-1] |= words[1:]
    four = two << 18
    four[:-2] |= two[2:]
    three = two << 9
    three[:-2] |= words[2:]
    words = four << 27
    words[:-4] |= three[4:]
    segment = np.repeat(np.arange(len(parts)), count)
    number = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[segment] + number
    wanted = np.zeros(len(text), bool)
    wanted[place] = True
    owner = np.zeros(len(text), np.int64)
    owner[place] = (rank[segment] << 40) + start[segment] + number
    order = two_stage(text, words, wanted, window + 5)
    order = order[wanted[order]]
    run = np.flatnonzero(~equal_to_neighbour(words, order, window))
    least = np.repeat(np.minimum.reduceat(owner[order], run), np.diff(np.append(run, len(order))))
    first = np.zeros(len(text), bool)
    first[order] = owner[order] == least
    kept = first[place]
    return segment[kept], number[kept]


# ---- the operator ---------------------------------------------------------------------------

_PLACE = ["doc_id", "t"]


def text_key(text: Column) -> Column:
    """What tells documents of one doc_id, or of none, apart: 64 bits of the text; null is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _same_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({"doc_id": "right_id", "t": "right_t"})
    return left.join(renamed, F.col("doc_id").eqNullSafe(F.col("right_id")) & (F.col("t") == F.col("right_t")), how).drop("right_id", "right_t")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, cut: int = CUT, decoded: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, t, n_bytes, spans (start and end of the maximal removed
    runs, in bytes), kept (the remaining bytes): one row a document. With decoded instead doc_id, t,
    left (the remaining whole characters), of the documents that lose anything.

    Texts are UTF-8 bytes; matches never cross documents. Removed is each byte covered by a string
    of window bytes that also starts earlier: in a document of smaller doc_id, or earlier in the
    same one. Overlaps count, and strings are judged on the input. Null texts are empty; texts
    shorter than window stay whole. A null doc_id is larger than all others. Rows that repeat a
    doc_id stand in the order of t, a hash of their texts, and rows alike in both are the same
    document and get the same result. An empty table gives an empty result. Other columns are not
    looked at. Strings are compared by their bytes, segments that are merged by 64-bit hashes of
    segment and anchor."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), text_key(F.col("text")).alias("t"))
    found = lambda hashes: anchors(docs.where(F.octet_length("text") >= window), window, gram, hashes)
    often = found(True).groupBy("h").agg(F.count("*").alias("places")).where("places > 1").select("h")
    often = staged(often, "frequent-anchors", tidy=True)
    places = staged(found(False).join(often, "h"), "places", tidy=True)
    drop(often)

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "start")
    distinct = places.groupBy("h", "g").agg(F.min(place).alias("p"), F.first("windows").alias("windows"))
    distinct = staged(distinct.select("h", "g", "p.doc_id", "p.t", "p.start", "windows"), "segments", tidy=True)
    crowded = distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > cut).select("h")
    total = distinct.agg(F.sum(F.col("windows") + window)).first()[0] or 0
    blocks = max(1, -(-total // block))

    def take(batches: Iterator[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = shingles.text_buffer(b.column("text"))
            asks = b.column("asked")
            h, start, count = (x.to_numpy(zero_copy_only=False) for x in asks.flatten().flatten())
            times = count if single else np.ones(len(h), np.int64)
            doc = np.repeat(np.repeat(np.arange(b.num_rows), asks.value_lengths().to_numpy()), times)
            start = np.repeat(start, times) + np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
            count, block_of = np.ones(len(doc), np.int32) if single else count, np.repeat(h % blocks, times)
            size = count.astype(np.int64) + window - 1
            for i, j in shingles.chunks(np.concatenate([[0], np.cumsum(size)])):
                edge = np.concatenate([[0], np.cumsum(size[i:j])])
                flat = data[np.arange(edge[-1]) + np.repeat(offsets[doc[i:j]] + start[i:j] - edge[:-1], size[i:j])]
                for k in range(j - i) if single else ():  # windows with equal bytes meet
                    block_of[i + k] = hash_of(flat[edge[k] : edge[k + 1]].tobytes()) % blocks
                of = pa.array(doc[i:j])
                own = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(block_of[i:j]), b.column("doc_id").take(of), b.column("t").take(of), pa.array(start[i:j]), pa.array(count[i:j], pa.int32()), own], ["block", "doc_id", "t", "start", "windows", "bytes"])

    def bytes_of(segments: DataFrame, single: bool) -> DataFrame:
        asked = segments.groupBy(*_PLACE).agg(F.collect_list(F.struct("h", "start", "windows")).alias("asked"))
        with_text = _same_document(docs, asked, "inner")
        return with_text.mapInArrow(lambda batches: lean(take(batches, single), "shingles"), "block long, doc_id long, t long, start long, windows int, bytes binary")

    if crowded.isEmpty():
        taken = bytes_of(distinct, False)
    else:  # their windows one by one; equal ones, of which there may be very many, are merged before they meet
        single = bytes_of(distinct.join(crowded, "h", "left_semi"), True).groupBy("block", "bytes").agg(F.min(place).alias("p"))
        taken = bytes_of(distinct.join(crowded, "h", "left_anti"), False).unionByName(single.select("block", "p.doc_id", "p.t", "p.start", F.lit(1).alias("windows"), "bytes"))

    def keep(t: pa.Table) -> pa.Table:
        start = t["start"].to_numpy()
        document = [t["t"].to_numpy(), t["doc_id"].fill_null(0).to_numpy(), t["doc_id"].is_null().to_numpy()]
        order, new = np.lexsort(document), np.zeros(len(start), bool)
        for c in document:
            new[1:] |= c[order][1:] != c[order][:-1]
        rank = np.zeros(len(start), np.int64)
        rank[order] = np.cumsum(new)
        segment, window_number = first_windows(t["bytes"].to_pylist(), t["windows"].to_numpy(), rank, start, window)
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (window_number[1:] != window_number[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(segment)))
        rows = pa.array(segment[first])
        give_back()  # arrays many times as large as the block
        return pa.table({"doc_id": t["doc_id"].take(rows), "t": t["t"].take(rows), "start": start[segment[first]] + window_number[first], "windows": pa.array(-count, pa.int32())})

    kept = staged(taken.groupBy("block").applyInArrow(keep, "doc_id long, t long, start long, windows int"), "first-windows", tidy=True)
    drop(distinct)
    # a set: rows alike bring each of their marks once a row, or merged, and have to count once
    marks = places.select(*_PLACE, "start", "windows").unionByName(kept).groupBy(*_PLACE).agg(F.collect_set(F.struct("start", "windows")).alias("marks"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = shingles.text_buffer(b.column("text"))
            marked = b.column("marks")
            start, count = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in marked.flatten().flatten())
            ends = np.concatenate([[0], np.cumsum(marked.value_lengths().fill_null(0).to_numpy())])
            for i, j in shingles.chunks(offsets):
                edge = offsets[i : j + 1] - offsets[i]
                stays, each = np.ones(edge[-1], bool), [np.zeros((0, 2), np.int64)] * (j - i)
                for k in np.flatnonzero(np.diff(ends[i : j + 1])):
                    own, of = slice(edge[k], edge[k + 1]), slice(ends[i + k], ends[i + k + 1])
                    gone, each[k] = removed(edge[k + 1] - edge[k], start[of], count[of], window)
                    stays[own] = ~gone
                every, size = np.concatenate(each), np.diff(edge)
                left = size - [int((x[:, 1] - x[:, 0]).sum()) for x in each]
                span = pa.ListArray.from_arrays(_edges(np.array([len(x) for x in each])), pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["start", "end"]))
                kept = pa.Array.from_buffers(pa.binary(), j - i, [None, _edges(left).buffers()[1], pa.py_buffer(data[offsets[i] : offsets[j]][stays])])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("t").slice(i, j - i), pa.array(size), span, kept], ["doc_id", "t", "n_bytes", "spans", "kept"])

    def left_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_out(batches):
            b = b.take(pa.array(np.flatnonzero(b.column("spans").value_lengths().to_numpy())))
            left = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(left, pa.string())], ["doc_id", "t", "left"])

    # one pass: each step in Python has workers of its own
    joined = _same_document(docs, marks, "left").select(*_PLACE, "text", "marks")
    if decoded:
        return joined.mapInArrow(lambda batches: lean(left_of(batches), "shingles"), "doc_id long, t long, left string")
    return joined.mapInArrow(lambda batches: lean(cut_out(batches), "shingles"), "doc_id long, t long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _edges(lengths: np.ndarray) -> pa.Array:
    """Offsets of an Arrow list or binary column."""
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())


def hash_of(window: bytes) -> int:
    """A window's hash, the same on every machine."""
    import xxhash

    return xxhash.xxh64_intdigest(window) >> 1


def removed(n: int, start: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n bytes go, and their maximal runs. Positive counts are windows that occur more
    than once or may do so, negative ones those that stay."""
    steps = np.zeros(n + 2, np.int64)
    sign = np.sign(count)
    np.add.at(steps, start, sign)
    np.add.at(steps, start + np.abs(count), -sign)
    at = np.flatnonzero(np.cumsum(steps)[:n] > 0)
    cover = np.zeros(n + 1, np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    gone = np.cumsum(cover)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return gone, edge.reshape(-1, 2)


#: The digests of windows of 100 bytes in DuckDB, window by window.
SQL = r"""
with d as (
  select row_number() over (order by doc_id nulls last, md5(coalesce(text, ''))) as place, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select place, doc_id, h, (length(h) // 2)::bigint as n from d),
w as (select place, unnest(range(0, n - 99)) as spot, h from b where n >= 100),
g as (select place, spot, md5(substr(h, 2 * spot + 1, 200)) as s from w),
r as (select place, spot, row_number() over (partition by s order by place, spot) > 1 as again from g),
o as (select place, spot, spot + 100 as upto, max(spot + 100) over (partition by place order by spot rows between unbounded preceding and 1 preceding) as before from r where again),
q as (select place, spot, upto, sum(case when before is null or spot > before then 1 else 0 end) over (partition by place order by spot) as run from o),
x as (select place, run, min(spot) as a, max(upto) as z from q group by all),
y as (select place, a, z, lag(z, 1, 0) over (partition by place order by a) as since from x),
k as (select y.place, count(*)::bigint as n_spans, sum(z - a)::bigint as n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as head, max(z) as last from y join b using (place) group by y.place)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when k.place is null then h else head || substr(h, 2 * last + 1) end)) as kept_sha256
from b left join k using (place)"""
