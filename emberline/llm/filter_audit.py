"""Audit of interacting filters: what each filter removes in every order of application.

The flags of every document are computed once, by built-in functions, and written as a narrow table. A depth-first walk then
goes through the orders as through a trie: a step applies one filter to the persisted DataFrame of survivors and counts, per part,
what it removes. Orders that share a set of filters share its survivors, whatever their order was (memoised), so five
filters take 31 DataFrames, at most five of them persisted at a time, and 80 counted edges for 120 orders. The counts go to a
table in the shared folder, edge by edge; a lost executor's share of a persisted DataFrame is computed anew from the flags.

Results in special cases: a null text is empty, has no words, so fails only the filter of short texts (and that of copies, where a
smaller id is empty too); a null id is never a copy of another nor makes one, and has no label; rows that share an id and a text are
not copies of each other, as neither id is smaller; rows that share an id count one by one; of several labels of an id any 1 counts;
a null part is ''; an empty table gives no row; extra columns are ignored, whatever their names. Texts count as equal by SHA-256.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import shared_folder, text_or_empty, written

#: The filters by letter, in the order of their flags.
LETTERS = "ABCDE"
MIN_WORDS = 200
COUNTED = ("removed", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text, as conditions of failure."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def flagged(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, A to E boolean: the filter fails, good, toxic boolean) of every row of docs."""
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(part_col).alias("part"), text_or_empty(text_col).alias("text"))
    own = written(own.select("id", "part", *(f.alias(x) for x, f in failures(F.col("text")).items()), F.sha2("text", 256).alias("digest")))
    # only a text's smallest id is looked up, together with the text: a key of its own for each, however many copies there are
    first = own.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return (
        own.join(first, ["id", "digest"], "left")
        .join(known, "id", "left")
        .select("part", *"ABCD", (F.col("id").isNotNull() & F.col("first").isNull()).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    )


def edges(flags: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """(part, state, letter, before, removed, good_lost, toxic_lost) of every set of filters already applied and every other filter.

    state has the letters applied, sorted. flags should be a written table. One row for each part of the table, zeros included.
    """
    spark, path = flags.sparkSession, shared_folder(flags.sparkSession)
    visited: set[frozenset[str]] = set()

    def count(survivors: DataFrame, applied: frozenset[str]) -> None:
        """What each further filter removes from these survivors, by part."""
        left = [x for x in letters if x not in applied]
        lost = {"removed": F.lit(True), "good_lost": F.col("good"), "toxic_lost": F.col("toxic")}
        sums = [F.struct(F.lit(x).alias("letter"), *(F.count_if(F.col(x) & c).alias(n) for n, c in lost.items())) for x in left]
        by_part = survivors.groupBy("part").agg(F.count("*").alias("before"), F.array(*sums).alias("edges"))
        rows = by_part.select("part", F.lit("".join(sorted(applied))).alias("state"), "before", F.inline("edges"))
        rows.select("part", "state", "letter", "before", *COUNTED).write.mode("append").parquet(path)

    def visit(survivors: DataFrame, applied: frozenset[str]) -> None:
        visited.add(applied)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        count(survivors, applied)
        for x in letters:
            if x not in applied and len(applied) + 1 < len(letters) and (then := applied | {x}) not in visited:
                visit(survivors.where(~F.col(x)), then)
        survivors.unpersist()

    visit(flags, frozenset())
    return spark.read.schema("part string, state string, letter string, before long, removed long, good_lost long, toxic_lost long").parquet(path)


def report(found: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """A row for each part, order and step, from the counted edges.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    spark = found.sparkSession
    # parts without a survivor in a state have no row there: they lose nothing
    lost = {n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in COUNTED}
    steps = [("".join(order), k + 1, "".join(sorted(order[:k])), x) for order in permutations(letters) for k, x in enumerate(order)]
    plan = spark.createDataFrame(steps, "filter_order string, step int, state string, letter string")
    parts = found.where("state = ''").select("part", "letter", F.col("removed").alias("fails"), F.col("before").alias("rows"))
    everything = F.broadcast(plan).join(parts, "letter")
    rows = everything.join(found.drop("before"), ["part", "state", "letter"], "left").withColumns(lost)
    rest = F.length("state") == len(letters) - 1
    by_letter = rows.groupBy("part", "letter").agg(F.max(F.when(rest, F.col("removed"))).alias("unique_fails"), F.sum("removed").alias("shapley"))
    after = found.select("part", "state", "letter", F.col("before"), "removed").select("part", "state", "letter", (F.col("before") - F.col("removed")).alias("kept"))
    return (
        rows.join(by_letter, ["part", "letter"])
        .join(after, ["part", "state", "letter"], "left")
        .select("part", "filter_order", "step", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


def audited(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return report(edges(written(flagged(docs, labels, part_col, id_col, text_col))))
