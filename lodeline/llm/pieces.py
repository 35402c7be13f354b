"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each place it follows its output
links to all pieces that end there, longest first, and each relaxes the best score of that place.
A character without a piece of its own is spelled in byte pieces.

The vocabulary's pieces have the space mark at their start only (this is checked), so the best path
goes through every start of a run of spaces, and the stretches between - mostly words - can be
encoded each for itself. Frequent ones are remembered, in a table of bounded size.

The result is the path of the highest total score. For a unigram model that is all. A model trained
by pair merging has scores by merge order, and their highest sum alone is not its encoding. There a
guard stands before the relaxation: a piece relaxes its end only if it goes together with the last
piece of the best path to its start, that is, if merging both pieces' text leaves these two. Merging
all of a text leaves such a pair everywhere, so the best path among those that pass the guard is
what merging gives. Pieces that merging never leaves are not in the automaton.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeline.llm.shared import kept, lean

#: A public vocabulary with byte pieces.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Remembered stretches of a worker, the longest that is remembered, and remembered pairs of pieces.
REMEMBERED, LONGEST, PAIRS = 600_000, 64, 1_000_000
#: Documents that a worker returns at a time.
ROWS = 256


class Pieces:
    """A vocabulary: pieces (text, id, score), and ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], merging: bool = False):
        import ahocorasick

        self.byte_ids, self.merging = byte_ids, merging
        self.score = {t: s for t, _, s in pieces}
        self.text_of = {i: t for t, i, _ in pieces}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i, score in pieces:
            if not merging or self.merge(text) == [text]:
                self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.singles = {t for t, _, _ in pieces if len(t) == 1}
        self.unknown = min((s for _, _, s in pieces), default=0.0) - 10.0
        self.bytes_of = {i: t.replace(MARK, " ").encode() for t, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        cut_at_mark = all(MARK not in t.lstrip(MARK) for t, _, _ in pieces)
        self.stretches = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut_at_mark else r"(?s).+").findall
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """What pair merging leaves of a short text: the pair of the highest score is merged, of
        equal ones the first, until none is a piece."""
        never = float("-inf")
        left, score = list(text), self.score.get
        pairs = [score(a + b, never) for a, b in zip(left, left[1:], strict=False)]
        while pairs and (top := max(pairs)) > never:
            k = pairs.index(top)
            left[k : k + 2] = [left[k] + left[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score(left[k - 1] + left[k], never)
            if k < len(pairs):
                pairs[k] = score(left[k] + left[k + 1], never)
        return left

    def together(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces leaves just these two."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            one, two = self.text_of[a], self.text_of[b]
            known = self.pairs[key] = self.merge(one + two) == [one, two]
        return known

    def viterbi(self, s: str) -> array:
        """Ids of the path of the highest score, of equal ones that whose last pieces are longer;
        for a merging model among the paths whose neighbours go together."""
        n, low, known = len(s), float("-inf"), self.pairs.get
        # a short text's places are lists, a long one's a few bytes each
        best, back, size = ([low] * (n + 1), [-1] * (n + 1), [1] * (n + 1)) if n <= LONGEST else (array("d", [low]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [1]) * (n + 1))
        best[0], done, merging = 0.0, 0, self.merging
        odd = not self.singles.issuperset(s)
        for end, (length, i, score) in self.automaton.iter(s):  # at each end the longest first
            if odd:
                while done < end:  # pieces that end later may start here
                    done += 1
                    self._spell(s, done, best, back)
            end += 1
            start = end - length
            if merging:
                before = back[start]
                if before >= 0:
                    fits = known(before << 32 | i)
                    if fits is None:
                        fits = self.together(before, i)
                    if not fits:
                        continue
            now = best[start] + score
            if now > best[end]:
                best[end], back[end], size[end] = now, i, length
        if odd:
            while done < n:
                done += 1
                self._spell(s, done, best, back)
        ids = array("i")
        while n:
            if back[n] >= 0:
                ids.append(back[n])
                n -= size[n]
            else:
                n -= 1
                ids.extend([self.byte_ids[b] for b in reversed(s[n].encode())])
        ids.reverse()
        return ids

    def _spell(self, s: str, end: int, best, back) -> None:
        """Relaxes an end by the bytes of the character before it, if that has no piece of its own;
        where pieces merge, only if none has come to this end."""
        if s[end - 1] not in self.singles:
            now = best[end - 1] + self.unknown
            if best[end] == float("-inf") or not self.merging and now > best[end]:
                best[end], back[end] = now, -1

    def encode(self, text: str | None) -> array:
        """A space is put before the text, as before every word. Marks that the text itself holds
        are spelled in bytes, so decoding is exact. Null and empty texts have no ids."""
        ids = array("i")
        if not text:
            return ids
        known = self.known
        for k, part in enumerate((" " + text).split(MARK)):
            if k:
                ids.extend(self.byte_ids[b] for b in MARK.encode())
            for s in self.stretches(part.replace(" ", MARK)):
                got = known.get(s)
                if got is None:
                    got = self.viterbi(s).tobytes()
                    if len(s) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[s] = got
                ids.frombytes(got)
        return ids

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file, once in each process."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    all_ids = range(m.get_piece_size())
    plain = [i for i in all_ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(not m.is_byte(i) for i in byte_ids):
        raise ValueError(f"{path} has no byte pieces, so not every text can be encoded")
    # a merging model's scores are minus its merges' numbers
    scores = [m.get_score(i) for i in plain]
    merging = all(s == int(s) for s in scores)
    return Pieces([(m.id_to_piece(i), i, s) for i, s in zip(plain, scores, strict=True)], byte_ids, merging)


kept["pieces"] = load.cache_clear


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with a column ids of piece ids; a column of that name is replaced. Null and empty texts
    have no ids; whole texts of any length are encoded. Other columns, repeated rows and nulls stay
    as they are; an empty table stays empty."""
    names = [c for c in docs.columns if c != ids]
    rows = docs.select(*[docs[f"`{c}`"] for c in names])
    fields = T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                offsets, flat = array("i", [0]), array("i")
                for t in part.column(place):
                    flat.extend(p.encode(t.as_py()))
                    offsets.append(len(flat))
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*names, ids])

    return rows.mapInArrow(lambda batches: lean(run(batches), "pieces"), fields)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """rows with a column text of what the ids spell; null ids give null. Ids that the vocabulary
    does not have are an error."""
    names = [c for c in rows.columns if c != text]
    rows = rows.select(*[rows[f"`{c}`"] for c in names])
    fields = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    place = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                spelled = [p.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spelled, pa.string())], [*names, text])

    return rows.mapInArrow(lambda batches: lean(run(batches), "pieces"), fields)
