"""The clipped policy loss over token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_terms(lp: Column, old_lp: Column, ref_lp: Column, advantage: Column, low: float, high: float, beta: float) -> Column:
    """struct<ratio, clipped, k3, loss> of a token: the pessimistic of plain and clipped gain, and beta times the k3 distance from the reference (0 for a null ref_lp)."""
    ratio = F.exp(lp - old_lp)
    bounded = F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
    apart = ref_lp - lp
    k3 = F.coalesce(F.exp(apart) - apart - 1, F.lit(0.0)) if beta > 0 else F.lit(0.0)
    loss = -F.least(ratio * advantage, bounded * advantage) + beta * k3
    return F.struct(ratio.alias("ratio"), ((ratio < 1 - low) | (ratio > 1 + high)).alias("clipped"), k3.alias("k3"), loss.alias("loss"))


def policy_loss(tokens: DataFrame, low: float = 0.2, high: float = 0.28, beta: float = 0.01) -> DataFrame:
    """One row (token_mean, sequence_mean, clip_frac, approx_kl_old, kl_ref, ratio_mean double, tokens, sequences long) of tokens (seq, lp, old_lp, ref_lp, advantage, mask).

    Tokens outside the mask count nowhere, but a sequence of none counts among the sequences, with a loss of 0. A first aggregation by sequence makes a row for each, a second adds them up.
    """
    terms = tokens.select("seq", "mask", (F.col("old_lp") - F.col("lp")).alias("old"), token_terms(*(F.col(c) for c in ("lp", "old_lp", "ref_lp", "advantage")), low, high, beta).alias("t"))
    own = lambda c: F.coalesce(F.sum(F.when(F.col("mask"), c)), F.lit(0.0))
    by_seq = terms.groupBy("seq").agg(
        F.count_if("mask").alias("n"), own(F.col("t.loss")).alias("loss"), own(F.col("t.clipped").cast("double")).alias("clipped"), own(F.col("old")).alias("old"), own(F.col("t.k3")).alias("k3"), own(F.col("t.ratio")).alias("ratio")
    )
    n = F.greatest(F.sum("n"), F.lit(1))
    return by_seq.agg(
        (F.sum("loss") / n).alias("token_mean"),
        F.avg(F.col("loss") / F.greatest("n", F.lit(1))).alias("sequence_mean"),
        *((F.sum(c) / n).alias(name) for c, name in (("clipped", "clip_frac"), ("old", "approx_kl_old"), ("k3", "kl_ref"), ("ratio", "ratio_mean"))),
        F.sum("n").alias("tokens"),
        F.count("*").alias("sequences"),
    )
