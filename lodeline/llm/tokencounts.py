"""Token counts as delta-maintained rollups.

A batch of changes - a document that comes adds itself and its tokens, one that goes takes both
away, one whose count is revised brings the difference - is pre-aggregated to (source, lang,
tokenizer version) and committed as one delta. Totals are sums of deltas, so they never need the
documents again. A batch has an id and its delta a folder of that name; the folder's _SUCCESS mark
is the commit. A committed batch is not applied again, and one that broke off is written anew, so
replays change nothing. A compaction sums many deltas up in one and remembers their batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.shared import stage_path, staged

#: Where the public tokenizers' files are, and the one that counts.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts text into words before merging. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "version")
#: Folders of a batch's delta, of a compaction's, and of the ids that a compaction has summed up.
BATCH, SUM, FOLDED = "batch=", "sum=", "folded="
DELTA = "source string, lang string, version string, docs long, tokens long"


class Ledger:
    """The rollup in a folder: one delta a committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _deltas(self) -> list[str]:
        """Folders of committed deltas."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(self._fs(s.getPath().getName(), "_SUCCESS")[1]))

    def committed(self) -> set[str]:
        """Ids of committed batches, those that a compaction has summed up too: one a batch."""
        deltas, done = self._deltas(), set()
        for d in deltas:
            if d.startswith(BATCH):
                done.add(base64.urlsafe_b64decode(d.removeprefix(BATCH)).decode())
        folded = [f"{self.path}/{d}" for d in deltas if d.startswith(FOLDED)]
        return done | {r[0] for r in self.spark.read.schema("id string").parquet(*folded).collect()} if folded else done

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: source, lang, version, docs (1 for a document that comes, -1 for one that goes,
        0 for one that stays) and tokens, signed alike. False, and nothing happens, if the batch is
        committed already. Rows whose docs or tokens are null count as nothing; null keys are keys of
        their own; repeated rows count as often as they stand there, in any order. An empty batch is
        committed as an empty delta."""
        if batch_id in self.committed():
            return False
        rows = changes.where("docs is not null and tokens is not null")
        delta = rows.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        delta.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/{BATCH}{base64.urlsafe_b64encode(batch_id.encode()).decode()}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: sums over the committed deltas. Keys whose docs and
        tokens have come to nothing are left out."""
        folders = [f"{self.path}/{f}" for f in self._deltas() if not f.startswith(FOLDED)]
        deltas = self.spark.read.schema(DELTA).parquet(*folders) if folders else self.spark.createDataFrame([], DELTA)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self, path: str) -> Ledger:
        """A new ledger at path with the same totals in one delta, that refuses the same batches. It
        counts from the moment its delta is committed, which is the last step."""
        other = Ledger(self.spark, path)
        self.spark.createDataFrame([(x,) for x in sorted(self.committed())], "id string").write.mode("overwrite").parquet(f"{other.path}/{FOLDED}0")
        self.totals().write.mode("overwrite").parquet(f"{other.path}/{SUM}0")
        return other


def signed(rows: DataFrame, sign: int, tokens: Column | str = "tokens") -> DataFrame:
    """rows (source, lang, version), each a document, as changes of one sign."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return rows.select(*KEYS, F.lit(sign).alias("docs"), (sign * tokens).cast("long").alias("tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows with an old and a new count: the documents stay, the difference comes or goes."""
    return rows.select(*KEYS, F.lit(0).alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


def count_tokens(docs: DataFrame, version: str, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """docs (doc_id, source, lang, text, ...) -> doc_id, source, lang, version, guess, tokens: one row a
    document.

    tokens is the byte-level BPE's count over the whole text, however long, 0 for null and empty
    ones; guess is the quick count of one token for each four bytes, rounded up. Null sources and
    languages stay null. Repeated rows are counted each for itself; an empty table gives an empty
    result. Other columns are not looked at."""
    path, kept = f"{folder}/{ranks}", ["doc_id", "source", "lang", "guess"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64())], [*kept, "tokens"])

    guess = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), guess.alias("guess"), F.col("text").cast("string"))
    counted = rows.mapInArrow(count, "doc_id long, source string, lang string, guess long, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), "guess", "tokens")


def rollup(docs: DataFrame, version: str, gone: DataFrame | None = None, path: str | None = None, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """docs (doc_id, source, lang, text, ...), gone (doc_id) -> source, lang, version, docs, tokens of
    the documents that are not gone, by four commits: the quick counts as documents come in, their
    revision by the tokenizer's, the documents that go, and a replay, which the ledger refuses.

    Null and empty texts have no tokens but are documents; long ones count whole. Null sources and
    languages are keys of their own. Repeated rows count as often as they stand there, and go as
    often; ids that repeat in gone go once, null ones take nothing. Keys that are left with nothing
    do not appear. An empty table gives an empty result; other columns are not looked at."""
    ledger = Ledger(docs.sparkSession, path or stage_path(docs.sparkSession, "token-ledger"))
    guess = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)
    ledger.apply(f"{version}/load", signed(docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.lit(version).alias("version"), guess.alias("tokens")), 1))
    # texts are counted once, and never shuffled: what goes is looked up among the counts
    counted = staged(count_tokens(docs, version, folder, ranks), "token-counts")
    changes = revised(counted, "guess", "tokens")
    ledger.apply(f"{version}/revise", changes)
    if gone is not None:
        ids = gone.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
        ledger.apply(f"{version}/delete", signed(counted.join(ids, "doc_id", "left_semi"), -1))
    ledger.apply(f"{version}/revise", changes)
    return ledger.totals()
