"""Near copies by SimHash: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of WORDS words of 64 bits, over the distinct shingles, propose: fingerprints that agree under a probe of the generalised
pigeonhole (emberline/llm/simhash.py) and differ in at most RADIUS bits of the CARRIED words are candidates. Bits of two sets of similarity s
differ with probability acos(2s / (1 + s)) / pi; the probes are taken so that a pair of exactly 0.8 is missed with a probability of MISS,
and one above it with a smaller one. Whole shingle sets decide: within each component of candidates every pair is compared by its exact Jaccard
similarity, in blocks of bounded size, and only a spanning forest of the links found is emitted. So no row stands for a pair of copies, a pair
below 0.8 is never linked, and a pair above it is lost only where neither it nor any chain of candidates joins its texts.

Sets of few shingles are too short for the bits' law, so those of at most SHORT are compared exactly, by their class numbers: two of them that differ are similar only if one is the
other without a shingle, and each set of five to SHORT shingles lists the classes that it would be in without one of its own.

Results in special cases: null texts and texts without words are copies of each other; equal sets are one class from the start; rows that
share an id are told apart by their texts; a null id has a null component; an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, written
from emberline.llm.components import components
from emberline.llm.simhash import SEED, bits_of, likely_probes, links, mixed, shingles, word_columns

WIDTH, WORDS = 5, 16
SIMILARITY, MISS = 0.8, 0.01
#: Shingles of the larger set of a pair up to which one shingle is all that may differ: 7 of 9 are below SIMILARITY.
SHORT = 8
#: Words of a fingerprint that candidates are compared by, and the bits of them that may differ: 3 standard deviations above what is expected at SIMILARITY.
CARRIED = 4
#: Shingles of a block of texts that are compared in one task.
BLOCK_SHINGLES = 1 << 20
#: Bits of the map that tells which texts' sets are built for comparison: of one size however many texts there are.
MARKS = 1 << 23


def differing_rate(similarity: float) -> float:
    """The share of bits that differ between fingerprints of sets of this Jaccard similarity and equal sizes."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float, words: int) -> int:
    rate = differing_rate(similarity)
    return math.floor(64 * words * rate + 3 * math.sqrt(64 * words * rate * (1 - rate)))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, WIDTH)], dtype=np.uint64))


def class_of(found: np.ndarray) -> int:
    """A set's number, as a signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def without_one(found: np.ndarray) -> list[int]:
    """The classes of a short set without one of its shingles, where that is similar to it."""
    n = len(found)
    return [class_of(np.delete(found, i)) for i in range(n)] if n <= SHORT and n - 1 >= SIMILARITY * n - 1e-9 else []


def signatures(texts: DataFrame) -> DataFrame:
    """(id, c: class, n: shingles, less: see without_one, fp, fp1 ...) of every row of (id, text)."""
    names = word_columns(WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            fps = np.array([[bits_of(s if not k else mixed(s, k)) for k in range(WORDS)] for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            told = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([without_one(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told, *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(WORDS))], names=["id", "c", "n", "less", *names])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, c long, n int, less array<long>, " + ", ".join(f"{x} long" for x in names))


def marked_ids(ids: DataFrame) -> np.ndarray:
    """MARKS bits, with those of the ids set."""
    at = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    rows = ids.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, c, s binary: sorted hashes of the distinct shingles) of the texts of these ids, and of some more that share their marks."""
    marks = marked_ids(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            taken = np.flatnonzero(marks[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(taken):
                found = [shingle_set(t) for t in batch.column(2).take(pa.array(taken)).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(taken)), pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "c", "s"])

    return texts.select(F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("at"), "id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, c long, s binary")


class Inverted:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owner, self.n = owner[order], len(sets)

    def shared(self, one: np.ndarray) -> np.ndarray:
        """How many shingles of one each set has."""
        at = np.searchsorted(self.keys, one)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == one)]
        a, n = self.first[at], self.first[at + 1] - self.first[at]
        places = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[places], minlength=self.n)


def similar(sets: list[np.ndarray], nodes: list[int]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of a Jaccard similarity of SIMILARITY or more; sets are sorted and without repeats."""
    share = SIMILARITY / (1 + SIMILARITY)  # both / (|a| + |b|) of such a pair
    sizes = np.array([len(s) for s in sets])
    rest, index, held = np.arange(len(sets)), None, np.zeros(0, int)
    queue: list[int] = []
    a: list[int] = []
    b: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
            continue
        x = queue.pop()
        if index is None or 2 * len(rest) < len(held):
            held, index = rest, Inverted([sets[k] for k in rest])
        both = index.shared(sets[x])
        good = held[both >= np.ceil((sizes[held] + sizes[x]) * share - 1e-6)]
        good = good[(sizes[good] + sizes[x] > 0) & np.isin(good, rest, assume_unique=True)]
        if len(good):
            a += [nodes[x]] * len(good)
            b += [nodes[k] for k in good.tolist()]
            queue += good.tolist()
            rest = rest[~np.isin(rest, good, assume_unique=True)]
    return a, b


def verified(members: DataFrame, sets: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): a spanning forest of the similar pairs of each group; members is (node, id, comp, n), sets (id, c, s)."""
    blocks = members.groupBy("comp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1), lambda c: F.least(own, c) * F.col("blocks") + F.greatest(own, c))
    rows = members.join(blocks, "comp").select("node", "id", "comp", dealt.alias("pairs")).join(sets.withColumnRenamed("c", "node"), ["id", "node"]).select("comp", F.explode("pairs").alias("pair"), "node", "s")
    rows = rows.repartition("comp", "pair").sortWithinPartitions("comp", "pair", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, found, nodes = None, [], []

        def out() -> pa.RecordBatch:
            x, y = similar(found, nodes)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in batches:
            for comp, pair, node, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, pair) != group:
                    if len(found) > 1:
                        yield out()
                    group, found, nodes = (comp, pair), [], []
                if not nodes or nodes[-1] != node:
                    found.append(np.frombuffer(s, np.uint64))
                    nodes.append(node)
        if len(found) > 1:
            yield out()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of every row: components of texts that are similar by 0.8 or more, by the smallest id; a null id has none."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    signed = written(signatures(texts))
    names = word_columns(WORDS)
    # the rows of a class have all but the id in common
    classes = written(signed.groupBy(F.col("c").alias("node")).agg(F.min("id").alias("id"), *(F.first(x).alias(x) for x in ("n", "less", *names))))
    prints = classes.select(*names, "node")
    probes = likely_probes(prints, names, differing_rate(SIMILARITY), MISS)
    candidates = components(links(prints, radius(SIMILARITY, CARRIED), probes, CARRIED))
    members = written(candidates.withColumnRenamed("component", "comp").join(classes.select("node", "id", "n"), "node"))
    short = classes.where(F.size("less") > 0).select(F.col("node").alias("a"), F.explode("less").alias("b"))
    short = short.join(classes.where(F.col("n") < SHORT).select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    found = components(verified(members, sets_of(texts, members.select("id"))).unionByName(short))
    labelled = classes.select("node", "id").join(found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("id").alias("component"))
    of = labelled.join(least, "comp").select(F.col("node").alias("c"), "component")
    nulls = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(None).cast("long").alias("component"))
    return signed.select("id", "c").join(of, "c").select(F.col("id").alias(id_col), "component").unionByName(nulls)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates(): that of the smallest id. Rows with a null id all stay; of rows that share an id one stays."""
    found = written(near_duplicates(docs, id_col, text_col))
    # nothing bounds the number of copies, so their ids are shuffled at every size, never broadcast
    copies = found.where(F.col(id_col) != F.col("component")).select(id_col).distinct().hint("merge")
    kept = docs.join(copies, id_col, "left_anti").select(docs.columns)
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, id_col, "left_anti").unionByName(kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col])).select(docs.columns)
