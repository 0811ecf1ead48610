"""The corpus pipeline: documents that the quality rules keep and that aren't toxic, one of each group of near copies, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all but the
last return the columns of documents. The rules and the toxicity model are learned from the labels of the documents that a stage
gets.

Results in special cases: a null, empty or wordless text fails the base rules of the first stage, so it goes; rows with a null id are
judged and scored like others, are never copies of others and are packed; of rows that share an id near_dedup keeps one; equal rows
are copies; ties go to the smallest id; extra columns stay, whatever their names, up to the last stage; empty tables give empty ones;
without labels of both kinds only the base rules reject.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import near, packing, quality, toxicity
from emberline.llm.common import small_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality.learn(quality.labelled(docs, table(spark, sf_dir, "labels")))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return quality.judged(whole, rules, "doc").where("kept").select("doc.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    small_batches(spark)
    score = toxicity.score_of(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash proposes pairs, their whole shingle sets decide."""
    return near.without_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    tokens = packing.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pieces(tokens).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(written(rows), order=("doc_id", "piece", "start", "ids_crc32"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", not_toxic),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No stage of these can be expressed in SQL as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
