"""Models are callables over batches: texts to vectors, prompts to replies.

embed(texts) gives one list of floats for each text, empty where it failed; generate(prompts) one
string each, starting with ERROR where it failed. hashing_embedder works offline and is the same
everywhere, so tests and SQL can repeat it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeline.operators.lexical import STOP_WORDS

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]
DIMS = 64


@lru_cache(maxsize=200_000)
def _bucket(token: str, dims: int) -> int:
    """-1 for what is not indexed."""
    if len(token) < 2 or token in STOP_WORDS:
        return -1
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dims


def hashing_matrix(texts: Sequence[str], dims: int = DIMS) -> np.ndarray:
    """Counts of indexed tokens, dealt to dims buckets by the first 32 bits of their MD5: one row a text."""
    place, find = [], re.compile("[a-z0-9]+").findall
    for i, t in enumerate(texts):
        place += [i * dims + b for w in find((t or "").lower()) if (b := _bucket(w, dims)) >= 0]
    return np.bincount(np.array(place, np.int64), minlength=len(texts) * dims).astype(float).reshape(len(texts), dims)


def hashing_embedder(texts: list[str], dims: int = DIMS) -> list[list[float]]:
    return hashing_matrix(texts, dims).tolist()


#: An embedder may bring a function of the same result as a matrix, which saves making lists of it.
hashing_embedder.matrix = hashing_matrix


def vectors(embed: Embed, texts: list[str]) -> Sequence[Sequence[float]]:
    return getattr(embed, "matrix", embed)(texts)


def embed_column(text: Column, embed: Embed = hashing_embedder) -> Column:
    """An array of doubles; empty where the model gives nothing."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([np.asarray(v, float) for v in vectors(embed, s.fillna("").tolist())], index=s.index, dtype=object)

    return run(text)


def generate_column(prompt: Column, generate: Generate) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(generate(s.fillna("").tolist()), dtype=object)

    return run(prompt)


def http_models(url: str, embed_model: str, generate_model: str, timeout: float = 30.0, patience: float = 180.0) -> tuple[Embed, Generate, Callable[[], bool]]:
    """Callables for a model server with /api/embeddings, /api/generate and /api/tags, and a probe."""
    import json
    import urllib.request

    def post(path: str, body: dict, wait: float) -> dict:
        request = urllib.request.Request(f"{url}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=wait) as r:
            return json.load(r)

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            try:
                out.append(post("/api/embeddings", {"model": embed_model, "prompt": t}, timeout).get("embedding") or [])
            except (OSError, ValueError):
                out.append([])
        return out

    def generate(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            try:
                out.append(post("/api/generate", {"model": generate_model, "prompt": p, "stream": False}, patience).get("response", ""))
            except (OSError, ValueError) as e:
                out.append(f"ERROR: {e}")
        return out

    def available() -> bool:
        try:
            with urllib.request.urlopen(f"{url}/api/tags", timeout=2):
                return True
        except OSError:
            return False

    return embed, generate, available
