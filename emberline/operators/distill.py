"""Training rows from a teacher's own episodes (sequence-level distillation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns

IMITABLE = ("ok", "stop")


def canonical_action(text: Column) -> Column:
    """The action in its protocol form; text that is no action stays as it is, null is empty."""
    whole = F.coalesce(text, F.lit(""))
    found = columns.action(whole)
    return F.when(found["kind"] == "stop", F.lit("<STOP>")).when(found["kind"] == "edit", F.concat(F.lit("<EDIT>\n"), found["code"], F.lit("\n</EDIT>"))).otherwise(whole)


def rows(episodes: DataFrame, horizon: int, min_speedup: float) -> DataFrame:
    """A row for each episode whose best speedup reaches min_speedup, its turns and steps zipped by place, the shorter list's length.

    episodes: (episode_id, task_id, best_ratio, n_edits, n_invalid, reward, turns of (obs, action_text, finished), steps of (status, ratio)). A null `finished` counts as finished.
    """
    n = F.least(F.size("turns"), F.size("steps"))

    def step(i: Column) -> Column:
        t, s = F.get("turns", i), F.get("steps", i)
        return F.struct(
            i.alias("step"),
            (F.lit(horizon) - i).alias("remaining"),
            t["obs"].alias("obs"),
            canonical_action(t["action_text"]).alias("action"),
            s["status"].alias("status"),
            s["ratio"].alias("ratio"),
            F.coalesce(t["finished"], F.lit(True)).alias("finished"),
            s["status"].isin(*IMITABLE).alias("learn"),
        )

    zipped = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), step))
    kept = episodes.where(columns.speedup(F.col("best_ratio")) >= min_speedup)
    return kept.select("episode_id", "task_id", zipped.alias("steps"), F.col("best_ratio").alias("final_ratio"), "n_edits", "n_invalid", F.lit("seqkd").alias("method"), F.col("reward").alias("teacher_reward"))


def stats(episodes: DataFrame, horizon: int, min_speedup: float) -> DataFrame:
    """One row of counts beside the training rows."""
    speedup = columns.speedup(F.col("best_ratio"))
    both = episodes.join(rows(episodes, horizon, min_speedup).select("episode_id", F.col("steps").alias("kept"), F.lit(True).alias("taken")), "episode_id", "left")
    return both.agg(
        F.count("*").alias("episodes"),
        F.count("taken").alias("kept"),
        F.sum(F.coalesce(F.size("kept"), F.lit(0))).alias("steps"),
        F.sum(F.coalesce(F.size(F.filter("kept", lambda s: s["learn"])), F.lit(0))).alias("imitable_steps"),
        F.sum(F.coalesce(F.size(F.filter("kept", lambda s: ~s["finished"])), F.lit(0))).alias("truncated_steps"),
        F.avg((speedup >= 1.05).cast("double")).alias("success_105"),
        F.avg((speedup >= 1.5).cast("double")).alias("success_15"),
        F.avg("n_edits").alias("mean_edits"),
    )
