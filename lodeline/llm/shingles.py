"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers at once.

A word is a run of bytes that are no ASCII white space, A-Z lower-cased. Its hash is a polynomial
over random byte values modulo 2^64, taken from prefix sums; a shingle's hash mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodeline.llm.shared import kept

#: Bytes of text that are hashed at a time; a longer text goes alone.
CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _forget() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


kept["shingles"] = _forget


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that leaves no bit alone."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n at least; kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(p)
    return _powers


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets; null is empty."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents data[offsets[i]:offsets[i + 1]], from offsets[0] on: each word's hash and document."""
    data = data[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[len(data)] = True
    begin = np.flatnonzero(ink & (np.concatenate([[True], ~ink[:-1]]) | edge[:-1]))
    end = np.flatnonzero(ink & (np.concatenate([~ink[1:], [True]]) | edge[1:])) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
        h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(starts, begin, "right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, as signed numbers, sorted within each: hashes, and where
    each document's start. A document of fewer words has one, of all of them."""
    n = np.bincount(doc, minlength=n_docs)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for i in range(width):
            rolled = mix(rolled + h[i : i + len(rolled)], width)
        whole = doc[: len(rolled)] == doc[width - 1 :][: len(rolled)] if len(rolled) else np.zeros(0, bool)
        rolled, of = rolled[whole], doc[: len(whole)][whole]
        short = (n > 0) & (n < width)
        if short.any():
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            some = np.flatnonzero(short)
            one = np.full(len(some), 0, np.uint64)
            for i in range(width - 1):
                more = i < n[some]
                one[more] = mix(one[more] + h[first[some[more]] + i], width + 1)
            rolled, of = np.concatenate([rolled, one]), np.concatenate([of, some])
    rolled = rolled.view(np.int64)
    order = np.lexsort((rolled, of))
    rolled, of = rolled[order], of[order]
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (of[1:] != of[:-1])
    rolled, of = rolled[new], of[new]
    return rolled, np.searchsorted(of, np.arange(n_docs + 1))


def sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges i:j of texts their documents' sorted distinct shingles, and where each one's start."""
    data, offsets = text_buffer(texts)
    for i, j in chunks(offsets):
        h, doc = words(data, offsets[i : j + 1])
        yield i, j, *shingles(h, doc, j - i, width)


def digests(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each document's set; equal sets, and by chance no others, agree."""
    out = np.zeros((2, len(starts) - 1), np.int64)
    for k in range(2):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.view(np.uint64), 101 + k))])
            out[k] = (total[starts[1:]] - total[starts[:-1]]).view(np.int64)
    return out
