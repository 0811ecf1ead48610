"""Divergence of sources within a language, by the terms that they use.

Each task counts the terms of its documents by language and source, in dictionaries of bounded size, and writes these partial counts once. A
count-min sketch over (language, term) adds up document frequencies: tasks fill sketches of one fixed size, whose cells saturate at the threshold, and these are
merged block by block. As a cell never holds less than the true frequency, a term with a cell below the threshold can't be kept, so its
partial counts are dropped before any of them is shuffled; the survivors are counted exactly, and those that only the sketch let through go then. Pairs
of sources are compared through a sparse join: only terms that both use meet, everything else follows from sums over each source's own
terms. All arithmetic is exact: whole numbers, as decimals of 38 digits where a product may pass 64 bits.

Results in special cases: null text, lang and source read as ''; a group whose documents have no kept term takes part with counts of zero; a
language without kept terms has pair values of 0 and no rows of terms; a language with a single source has no pairs; rows with a
null or repeated id count one by one; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, text_or_empty, written

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Entries of the dictionaries of a task before they are written out.
HELD_TERMS = 300_000
#: The sketch: rows, cells of a row, cells of a block that is merged at a time. Its size, and that of the bits broadcast, follow from these alone.
DEPTH, WIDTH, BLOCK = 4, 1 << 23, 1 << 16
#: Groups (language and source) whose totals may be broadcast; beyond, joins shuffle.
BROADCAST_GROUPS = 50_000
#: Bytes of a term stay, A to Z lower-cased; every other byte of ASCII becomes a space.
TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A written table (lang, source, term, count, documents long): counts by task, several rows for a term."""
    small_batches(docs.sparkSession)
    names = ["lang", "source", "term", "count", "documents"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        documents: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), of in counts.items():
                found = documents[lang, source]
                columns = [pa.array([x] * len(of), pa.string()) for x in (lang, source)]
                columns += [pa.array([*of], pa.binary()).cast(pa.string()), pa.array([*of.values()], pa.int64()), pa.array([found[t] for t in of], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            counts.clear()
            documents.clear()

        held = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                terms = text.as_py().translate(TERM_BYTES).split()
                own, key = set(terms), (lang, source)
                held -= len(documents[key])
                counts[key].update(terms)
                documents[key].update(own)
                held += len(documents[key])
                if held > HELD_TERMS:
                    yield from out()
                    held = 0
        yield from out()

    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInArrow(run, "lang string, source string, term string, count long, documents long"))


def cells(keys: np.ndarray, depth: int = DEPTH, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The cell of each 64-bit key in each row of the sketch, rows one after the other. width is a power of two."""
    keys = keys.astype(np.uint64)
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    for i in range(depth):
        yield ((low + np.uint64(i) * high) & np.uint64(width - 1)).astype(np.int64) + i * width


def sketched(counts: DataFrame, least: int = MIN_DOCUMENTS, depth: int = DEPTH, width: int = WIDTH, block: int = BLOCK) -> np.ndarray:
    """Which cells of the merged sketch reach `least`, as packed bits. counts has (key long, documents long)."""
    block = min(block, width)

    def merged(into: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
        spots, back = np.unique(at, return_inverse=True)
        into[spots] = np.minimum(into[spots] + np.bincount(back, np.minimum(more, least)), least)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(depth * width, np.uint8)
        for batch in batches:
            keys, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for at in cells(keys, depth, width):
                merged(held, at, more)
        for i in range(0, len(held), block):
            if (part := held[i : i + block]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(data.as_buffer(), np.uint8)
                held[i] = np.minimum(held[i] + more, least) if i in held else more.copy()
        for i, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(x >= least).tobytes()], pa.binary())], names=["block", "cells"])

    if least > 127:
        raise ValueError("cells are bytes whose sums of two must fit")
    spark = counts.sparkSession
    # a sketch for each core and not for each split, as all are of full size
    filled = counts.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(fill, "block int, cells binary")
    full = np.zeros(depth * width // 8, np.uint8)
    # of one size however many rows there are
    for r in filled.repartition("block").mapInArrow(merge, "block int, cells binary").toLocalIterator():
        full[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["cells"], np.uint8)
    return full


def possible(counts: DataFrame, least: int = MIN_DOCUMENTS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """Rows of partial counts without those whose (lang, term) the sketch rules out."""
    spark = counts.sparkSession
    key = F.xxhash64("lang", "term")
    sent = spark.sparkContext.broadcast(sketched(counts.select(key.alias("key"), "documents"), least, depth, width))

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        ok, full = np.ones(len(keys), bool), sent.value
        for at in cells(keys.to_numpy(), depth, width):
            ok &= (full[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return counts.where(may(key))


def kept_counts(docs: DataFrame, least: int = MIN_DOCUMENTS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A written table (lang, source, term, count, total long, first boolean) of the terms in at least so many documents of their language.

    total is the language's count; first marks one row of each (lang, term).
    """
    found = possible(partial_counts(docs, text_col, lang_col, source_col), least)
    exact = found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    term = Window.partitionBy("lang", "term")
    whole = exact.withColumns({"total": F.sum("count").over(term), "all": F.sum("documents").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return written(whole.where(F.col("all") >= least).drop("all", "documents"))


def per_billion(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (wide(count) + 2) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(v > 0, 1 + F.call_function("div", above, wide(n) + 2 * wide(v))).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of numbers up to SCALE + 1: their squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def weighted(kept: DataFrame, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two written tables: groups (lang, source, own, v long, zero) and terms (lang, source, term, p, q, zero).

    p is the group's figure of a term, q the language's, zero the group's of a term that it lacks; own counts its kept terms.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"), F.count_if("first").alias("firsts"))
    by_lang = Window.partitionBy("lang")
    none = F.lit(0).cast("long")
    groups = rows.join(own, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n", "own", "firsts")))
    groups = groups.withColumns({"v": F.sum("firsts").over(by_lang), "lang_n": F.sum("n").over(by_lang)})
    groups = written(groups.withColumn("zero", per_billion(none, F.col("n"), F.col("v"))))
    near = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups.hint("merge")
    terms = kept.join(near, ["lang", "source"])
    terms = terms.select("lang", "source", "term", per_billion(F.col("count"), F.col("n"), F.col("v")).alias("p"), per_billion(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), "zero")
    return groups.select("lang", "source", "own", "v", "zero"), written(terms)


def pair_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value long): every ordered pair of a language's sources, summed over all its kept terms.

    A term that neither has gives one constant. A term of one source alone gives what that source's figures have against the other's zero,
    which is summed by distinct figure. A term of both corrects for these two, and it alone is joined.
    """
    few = groups.count() <= BROADCAST_GROUPS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df.hint("merge")

    a, b = terms.alias("a"), terms.alias("b")
    p, q, zero_a, zero_b = F.col("a.p"), F.col("b.p"), F.col("a.zero"), F.col("b.zero")
    pair = [F.col("a.lang").alias("lang"), F.col("a.source").alias("one"), F.col("b.source").alias("two")]
    both = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source"))
    shared = a.join(b, both).select(*pair, (apart(p, q) - apart(p, zero_b) - apart(zero_a, q) + apart(zero_a, zero_b)).alias("value"))
    # a figure stands for as many terms as have it
    figures = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    other = side(groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero")))
    lone = figures.join(other, "lang").where("source <> other")
    lone = lone.select("lang", F.least("source", "other").alias("one"), F.greatest("source", "other").alias("two"), (F.col("n") * apart(F.col("p"), F.col("other_zero"))).alias("value"))
    c, d = groups.alias("a"), side(groups).alias("b")
    neither = (F.col("a.v") - F.col("a.own") - F.col("b.own")) * apart(zero_a, zero_b)
    base = c.join(d, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select(*pair, F.when(F.col("a.v") > 0, neither).otherwise(0).cast("long").alias("value"))
    summed = shared.unionByName(lone).unionByName(base).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    return summed.select("lang", ways, "value").select("lang", "source", "item", "value")


def audited(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value long, rank int): the part `pair` ranks the other sources, `term` the terms that a source has above its language."""
    kept = kept_counts(docs, least, text_col, lang_col, source_col)
    groups, terms = weighted(kept, docs, text_col, lang_col, source_col)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, terms).withColumn("rank", F.row_number().over(by_value))
    own = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
