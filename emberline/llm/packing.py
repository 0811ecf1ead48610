"""Packing pieces into sequences: Martello-Toth dominance reduction, then best fit for the remainder.

Pieces of one length are interchangeable, so the plan is made on the counts of lengths alone (at most one per token of
capacity, however many pieces there are) on the driver. The reduction permanently fixes sets of up to three pieces
that provably dominate every other set with their largest piece; the remainder goes, longest first, into the fullest
sequence that it fits, all pieces of a length at once. The plan says for each length which ranks go to which sequences,
at which offset; pieces get their rank from counts by hash chunk, so no length's pieces ever meet in one task.

Results in special cases: a null text counts as empty and is one piece that holds the end token alone; a document
longer than the capacity is cut into full pieces after a first one that may be shorter; a text with a run of white space too long for
tiktoken is encoded by the tokenizers library; equal rows are interchangeable
and each is placed; an empty table gives an empty one; other columns of documents are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm.bpe import byte_alphabet
from emberline.llm.common import small_batches, written

CAPACITY = 2048
END = 0
#: Pieces that are ranked together in one hash chunk, about.
CHUNK_ROWS = 4_000
#: Rows of a plan that may be broadcast.
BROADCAST_ROWS = 200_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """A byte-level BPE file of the tokenizers library, whose ids are its merge order, as a tiktoken encoding."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ids = [spec["model"]["vocab"][a + b] for a, b in merges]
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"] or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        raise ValueError("only byte-level BPE files whose ids are in merge order are supported")
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


def encoded(enc: tiktoken.Encoding, path: str, text: str) -> bytes:
    """The ids of a text, little-endian unsigned 32-bit."""
    try:
        return enc.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
    except ValueError:
        # a run of some 500,000 white-space characters is more than tiktoken's expression engine can step back over
        return np.array(library(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def tokenized(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, with `end` after the text's own) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoding(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = [encoded(enc, path, t or "") + last for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def pieces(tokens: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """(id, piece int, start long, length long, ids binary): tokens cut where a document is longer than the capacity."""
    n = (F.length("ids") / 4).cast("long")
    count = F.ceil(F.col("n") / capacity)
    cut = tokens.select(F.col(id_col), "ids", n.alias("n")).select(id_col, "ids", (F.col("n") - capacity * (count - 1)).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.col("first") + capacity * (F.col("piece") - 1))
    length = F.when(F.col("piece") == 0, F.col("first")).otherwise(F.lit(capacity).cast("long"))
    out = cut.select(id_col, F.col("piece").cast("int").alias("piece"), start.alias("start"), length.alias("length"), "ids")
    return out.withColumn("ids", F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))


class Plan:
    """Where the pieces of each length go. rows: (length, from rank, to rank, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < x <= capacity for x in counts):
            raise ValueError("lengths must be from 1 to the capacity")
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 2, np.int64)
        for x, n in counts.items():
            self.left[x] = n
        self.ranks: dict[int, int] = defaultdict(int)
        self.reduced = 0
        self._reduce()
        self._best_fit()

    def _place(self, length: int, sequence: int, sequences: int, each: int, offset: int) -> None:
        n = sequences * each
        self.rows.append((length, self.ranks[length], self.ranks[length] + n, sequence, each, offset))
        self.ranks[length] += n
        self.left[length] -= n

    def _fix(self, *lengths: int) -> None:
        """As many sequences of these pieces as there are."""
        need = Counter(lengths)
        n = min(int(self.left[x]) // k for x, k in need.items())
        offset = 0
        for x, k in need.items():
            self._place(x, self.sequences, n, k, offset)
            offset += x * k
        self.sequences += n
        self.reduced += n

    def _dominating(self, x: int) -> tuple[int, ...] | None:
        """A set with x that dominates every feasible set with x, or None if none of up to three pieces is seen to."""
        room = self.capacity - x
        self.left[x] -= 1
        try:
            there = np.flatnonzero(self.left > 0)
            fits = there[there <= room]
            if not len(fits):
                return (x,)
            k = int(fits[-1])
            if k == room:
                return x, k
            low = np.repeat(fits[:3], np.minimum(self.left[fits[:3]], 3))[:3]
            if len(low) < 2 or low[0] + low[1] > room:
                return x, k
            if len(low) == 3 and low.sum() <= room:
                return None
            # two more pieces at most: the best partner of each first piece a >= b
            at = np.searchsorted(fits, np.minimum(fits, room - fits), side="right") - 1
            b = np.where(at >= 0, fits[np.maximum(at, 0)], 0)
            alone = (b == fits) & (self.left[fits] < 2)
            at = np.where(alone, at - 1, at)
            b = np.where(at >= 0, fits[np.maximum(at, 0)], 0)
            pairs = b > 0
            if (fits + b)[pairs].max(initial=0) <= k:
                return x, k
            if pairs[-1] and b[pairs].max() <= b[-1]:
                return x, k, int(b[-1])
            return None
        finally:
            self.left[x] += 1

    def _reduce(self) -> None:
        again = True
        while again:
            again = False
            for x in range(self.capacity, 0, -1):
                while self.left[x] > 0 and (found := self._dominating(x)):
                    self._fix(*found)
                    again = True

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, sequences)
        free = np.zeros(self.capacity + 1, bool)

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                open_[room].append((first, n))
                free[room] = True

        for x in range(self.capacity, 0, -1):
            while (count := int(self.left[x])) > 0:
                rooms = np.flatnonzero(free[x:])
                if len(rooms):
                    room = x + int(rooms[0])
                    first, n = open_[room].pop()
                    free[room] = bool(open_[room])
                else:
                    room, first = self.capacity, self.sequences
                    n = -(-count // (room // x))
                    self.sequences += n
                each = room // x
                whole = min(n, count // each)
                if whole:
                    self._place(x, first, whole, each, self.capacity - room)
                    keep(room - each * x, first, whole)
                    keep(room, first + whole, n - whole)
                else:
                    self._place(x, first, 1, count, self.capacity - room)
                    keep(room - count * x, first, 1)
                    keep(room, first + 1, n - 1)


def packed(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start"), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows with sequence_id long and offset long. rows has `length` and should be a written table, as it is read twice.

    order are columns that tell rows apart as far as they need be; rows equal in all of them may swap places.
    """
    spark = rows.sparkSession
    n = rows.count()
    chunks = max(1, n // CHUNK_ROWS)
    # the rows' own columns travel in one struct, so their names clash with none
    chunked = rows.select(F.struct(*rows.columns).alias("row"), F.col("length").alias("size"), F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int").alias("chunk"))
    counts = chunked.groupBy("chunk", "size").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = written(counts.select("chunk", "size", "n", before.alias("before")))
    plan = Plan({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = spark.createDataFrame(plan.rows, "size long, from long, to long, first long, each long, at long")
    ranked = chunked.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "size").orderBy(*(F.col("row")[c] for c in order))).cast("long"))
    # counts grow with the rows, so they are never broadcast
    ranked = ranked.join(counts.drop("n").hint("merge"), ["chunk", "size"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    inside = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    if len(plan.rows) <= broadcast_rows:
        placed = ranked.join(F.broadcast(table).withColumnRenamed("size", "of"), (F.col("size") == F.col("of")) & inside)
    else:
        # by length and a stretch of ranks, as one length may have most of the rows
        stretch = lambda x: F.floor(x / F.lit(CHUNK_ROWS)).cast("long")
        table = table.withColumnRenamed("size", "of").withColumn("stretch", F.explode(F.sequence(stretch(F.col("from")), stretch(F.col("to") - 1))))
        placed = ranked.withColumn("own", stretch(F.col("rank"))).join(table.hint("merge"), (F.col("size") == F.col("of")) & (F.col("own") == F.col("stretch")) & inside)
    at = F.col("rank") - F.col("from")
    return placed.select(
        "row.*",
        (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(at, F.col("each")) * F.col("size")).cast("long").alias("offset"),
    )
