"""Semantic chunking: cuts where neighbouring sentences are far apart.

Sentences are split by column functions; embedding, distances and the greedy fold then happen for
whole documents inside one scan, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeline.functions import text as tx
from lodeline.functions.models import Embed, hashing_embedder, vectors

PERCENTILE, MIN_WORDS, MAX_WORDS = 75.0, 25, 350


def distances(own: Sequence[Sequence[float]]) -> np.ndarray:
    """Clamped cosine distances of neighbours; 1 for empty, unlike long or zero vectors."""
    if len(own) < 2:
        return np.zeros(0)
    size = np.array([len(v) for v in own])
    m = np.zeros((len(own), max(1, size.max())))
    for n in np.unique(size):
        m[size == n, :n] = own if len(np.unique(size)) == 1 else [v for v in own if len(v) == n]
    scale = np.sqrt((m * m).sum(1))
    scale = scale[1:] * scale[:-1]
    fits = (size[1:] == size[:-1]) & (scale > 0)
    dot = (m[1:] * m[:-1]).sum(1)
    return np.where(fits, 1.0 - np.clip(dot / np.where(fits, scale, 1.0), -1.0, 1.0), 1.0)


def threshold(d: Sequence[float], percentile: float) -> float:
    """The value at the percentile's rank, without interpolation; 0 of none."""
    if not 0 <= percentile <= 100:
        raise ValueError("the percentile must be from 0 to 100")
    return float(np.sort(d)[min(int(len(d) * percentile / 100.0), len(d) - 1)]) if len(d) else 0.0


def cuts(counts: list[int], d: list[float], at: float, least: int, most: int) -> list[int]:
    """After which sentences a chunk ends, but for the last: where the next one is far and the
    chunk is long enough, or where it would get too long."""
    out, size = [], counts[0] if counts else 0
    for i, (far, n) in enumerate(zip(d, counts[1:], strict=True)):
        if (far >= at and size >= least) or size + n > most:
            out.append(i)
            size = n
        else:
            size += n
    return out


def _fold(docs: DataFrame, schema: str, handle, embed: Embed, text: str) -> DataFrame:
    """handle: id, text, sentences, distances or None if any sentence has no vector -> rows. The
    distances of a whole batch are one computation."""
    fields = T._parse_datatype_string(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["sentences"].map(len).to_numpy()
            flat = [s for x in frame["sentences"] for s in x]
            own_vectors = vectors(embed, flat) if flat else []
            d, given = distances(own_vectors), np.array([len(v) > 0 for v in own_vectors], bool)
            ends, rows = np.cumsum(size), []
            for i, whole, own, z in zip(frame["id"], frame[text], frame["sentences"], ends, strict=True):
                a = z - len(own)
                rows += handle(i, whole, list(own), d[a : max(a, z - 1)], bool(given[a:z].all()))
            yield pd.DataFrame(rows, columns=fields.names)

    rows = tx.sentences(docs.select("id", F.coalesce(F.col(text), F.lit("")).alias(text)), text)
    return rows.mapInPandas(run, fields)


def semantic_chunks(docs: DataFrame, embed: Embed = hashing_embedder, percentile: float = PERCENTILE, least: int = MIN_WORDS, most: int = MAX_WORDS, text: str = "text") -> DataFrame:
    """docs (id, text) -> id, place, chunk. One sentence, and texts of few words, are one chunk;
    if any sentence has no vector, the document gets fixed chunks; blank texts get none."""
    threshold([], percentile)

    def handle(i: int, whole: str, own: list[str], d: np.ndarray, given: bool) -> list[tuple]:
        counts = [len(s.split()) for s in own]
        if len(own) <= 1:
            chunks = [whole.strip()] if whole.strip() else []
        elif sum(counts) <= least:
            chunks = [" ".join(own)]
        elif not given:
            chunks = _windows(whole)
        else:
            ends = [*cuts(counts, d, threshold(d, percentile), least, most), len(own) - 1]
            starts = [0, *(e + 1 for e in ends)]
            chunks = [" ".join(own[a : e + 1]) for a, e in zip(starts, ends, strict=False)]
        return [(i, k, c) for k, c in enumerate(chunks)]

    return _fold(docs, "id long, place long, chunk string", handle, embed, text)


def _windows(whole: str, size: int = tx.CHUNK_WORDS, overlap: int = tx.OVERLAP_WORDS) -> list[str]:
    w = whole.split()
    if len(w) <= size:
        return [whole] if w else []
    last = -(-(len(w) - size) // (size - overlap))
    return [" ".join(w[k * (size - overlap) :][:size]) for k in range(last + 1)]


_PREVIEW = (
    "id long, sentences array<string>, distances array<double>, threshold double, split_indices array<long>, "
    "chunks array<struct<text:string,words:long,first:long,last:long>>, sentence_count long, chunk_count long"
)


def semantic_preview(docs: DataFrame, embed: Embed = hashing_embedder, percentile: float = PERCENTILE, least: int = MIN_WORDS, most: int = MAX_WORDS, text: str = "text") -> DataFrame:
    """docs (id, text) -> one row each: sentences, distances rounded to 4 places, threshold, the
    sentences after which it cuts, and the chunks. There are no fixed chunks here: sentences
    without vector are at distance 1."""
    threshold([], percentile)

    def handle(i: int, whole: str, own: list[str], d: np.ndarray, given: bool) -> list[tuple]:
        counts = [len(s.split()) for s in own]
        d = [round(x, 4) for x in d.tolist()]
        at = round(threshold(d, percentile), 4)
        inner = cuts(counts, d, at, least, most)
        ends = [*inner, len(own) - 1] if own else []
        starts = [0, *(e + 1 for e in ends)]
        chunks = [{"text": " ".join(own[a : e + 1]), "words": sum(counts[a : e + 1]), "first": a, "last": e} for a, e in zip(starts, ends, strict=False)]
        return [(i, own, d, at, inner, chunks, len(own), len(chunks))]

    return _fold(docs, _PREVIEW, handle, embed, text)
