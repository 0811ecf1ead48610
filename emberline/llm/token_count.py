"""Token counts of a unigram vocabulary, without building tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text; dynamic programming carries the best score and its
number of pieces. Ties go as in the tokenizers library's Unigram model: among paths of equal score to a place, the one
whose last piece starts first stays. A character that no piece of one character covers may stand for itself at the score of the worst
piece less 10; with byte pieces it counts as its UTF-8 bytes, without them a run of such characters counts as one.

The vocabulary is read from a sentencepiece model file. Its pieces and scores are taken as a unigram model whatever algorithm
they were made for: what is counted is the best unigram segmentation under those scores. White space is escaped as the file
states: spaces become U+2581 and one stands before the text. Files with a character map or that squeeze spaces raise ValueError.

Texts are cut before runs of U+2581 where no piece crosses the cut, and equal parts are counted once; that is exact if
scores are whole numbers. With others the text is taken in one.

Results in special cases: a null or empty text has no tokens and score 0; repeated rows each give a row; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Types of pieces in a sentencepiece file.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
#: Parts kept with their count by each Python worker.
CACHE_PARTS = 400_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


class Unigram:
    """count() gives the number of tokens of a text's best segmentation, and its score."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool, prefix: bool = True):
        self.pieces, self.byte_fallback, self.prefix = pieces, byte_fallback, prefix
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.cuts = not crossing and byte_fallback and all(float(s).is_integer() for s in pieces.values())
        alone = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
        self.parts = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, tuple[int, float]] = {}

    @classmethod
    def read(cls, path: str) -> Unigram:
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        pieces, byte_pieces = {}, 0
        for number, value in model:
            if number == 1:
                p = dict(fields(value))
                kind = p.get(3, NORMAL)
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    pieces[p[1].decode("utf-8")] = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                byte_pieces += kind == BYTE
        normal = dict(next((fields(v) for number, v in model if number == 3), ()))
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only files that neither map characters nor squeeze white space are supported")
        return cls(pieces, byte_pieces == 256, bool(normal.get(3, 1)))

    def part(self, text: str) -> tuple[int, float]:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count, loose = [0] * (n + 1), [False] * (n + 1)
        pieces, done = self.pieces, 0

        def unknown(upto: int) -> None:
            """Lets the character before each place up to `upto` stand for itself where no piece of one character does."""
            nonlocal done
            while done < upto:
                c = text[done]
                if c not in pieces:
                    s = best[done] + self.unknown
                    if best[done + 1] is None or s > best[done + 1]:
                        best[done + 1] = s
                        count[done + 1] = count[done] + (len(c.encode("utf-8")) if self.byte_fallback else not loose[done])
                        loose[done + 1] = True
                done += 1

        for end, (length, score) in self.automaton.iter(text):
            if end > done:
                unknown(end)
            start = end + 1 - length
            s = best[start] + score
            old = best[end + 1]
            if old is None or s > old:
                best[end + 1] = s
                count[end + 1] = count[start] + 1
                loose[end + 1] = False
        unknown(n)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.cuts:
            return self.part(text)
        total, score, cache = 0, 0.0, self.cache
        for p in self.parts.findall(text):
            if (got := cache.get(p)) is None:
                got = self.part(p)
                if len(p) < 64:
                    if len(cache) >= CACHE_PARTS:
                        cache.clear()
                    cache[p] = got
            total += got[0]
            score += got[1]
        return total, score


@lru_cache(maxsize=2)
def loaded(path: str) -> Unigram:
    return Unigram.read(path)


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, score double) of every row; path is the model file, present on every machine."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            got = [model.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, score double").withColumnRenamed("id", id_col)
