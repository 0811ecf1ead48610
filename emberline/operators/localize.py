"""Where edits go in tasks of several functions: chance rates, first edits, places, and what edits of slow functions come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import columns

SUCCESS, COMPLETE = 1.5, 0.8
#: Edits with this number that must be there for a rate.
LEAST_EDITS = 20


def hottest(profile: Column) -> Column:
    """The name with the largest share of map<string, double>, the first in the map's order among equals; null for none."""
    ranked = F.transform(F.map_entries(profile), lambda e, i: F.struct(e["value"].alias("share"), (-i).alias("first"), e["key"].alias("name")))
    return F.array_max(ranked)["name"]


def edits(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each edit of a function of the task's file: run, episode_id, k (its number), hit (a slow one is among them), hot, place (of the first of them in the file), ok.

    records: (run, episode_id, task_id, steps of (action_kind, status, edited)); tasks: (task_id, functions, slow_functions, profile). Both are one row each.
    """
    known = tasks.select("task_id", "functions", "slow_functions", hottest(F.col("profile")).alias("hottest"))
    own = F.transform("steps", lambda s: F.struct(s["status"].alias("status"), F.when(s["action_kind"] == "edit", F.filter(s["edited"], lambda f: F.array_contains(F.col("functions"), f))).alias("e")))
    told = records.join(known, "task_id").select("run", "episode_id", "functions", "slow_functions", "hottest", F.posexplode(F.filter(own, lambda s: F.size(s["e"]) > 0)).alias("i", "s"))
    return told.select(
        "run",
        "episode_id",
        (F.col("i") + 1).alias("k"),
        F.arrays_overlap("slow_functions", "s.e").alias("hit"),
        F.when(F.col("hottest").isNotNull(), F.array_contains("s.e", F.col("hottest"))).alias("hot"),
        (F.array_position("functions", F.col("s.e")[0]) - 1).cast("int").alias("place"),
        (F.col("s.status") == "ok").alias("ok"),
    )


def report(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(run, figure, key, value double, n long). Figures of chance stand under the run 'chance'.

    slow_chance, hot_chance; success and complete by the number of slow functions; first_slow, first_hot; edit_slow by the edit's number, where there are LEAST_EDITS; place by the first
    edited function's place; correct by slow or fast. records have best_ratio and reference_speedup, too. All figures but the chances come from one pass over edits.
    """
    rate = lambda c: F.avg(c.cast("double"))
    row = lambda figure, key, value, n: F.struct(F.lit(figure).alias("figure"), key.cast("string").alias("key"), value.cast("double").alias("value"), n.cast("long").alias("n"))
    none, count = F.lit(""), F.count("*")
    n = F.size("functions")
    chance = tasks.agg(F.array(row("slow_chance", none, F.avg(F.size("slow_functions") / n), count), row("hot_chance", none, F.avg(1 / n), count)).alias("rows")).select(F.lit("chance").alias("run"), F.inline("rows"))
    speedup = columns.inverse(F.col("best_ratio"))
    by_d = records.join(tasks.select("task_id", F.size("slow_functions").alias("d")), "task_id").groupBy("run", "d")
    by_d = by_d.agg(F.array(row("success", F.col("d"), rate(speedup >= SUCCESS), count), row("complete", F.col("d"), rate(speedup >= COMPLETE * F.col("reference_speedup")), count)).alias("rows")).select("run", F.inline("rows"))
    found = edits(records, tasks)
    keys = F.array(
        *(F.struct(F.lit(x).alias("figure"), k.cast("string").alias("key"), v.cast("double").alias("v")) for x, k, v in (
            ("first_slow", F.when(F.col("k") == 1, ""), F.col("hit")),
            ("first_hot", F.when((F.col("k") == 1) & F.col("hot").isNotNull(), ""), F.col("hot")),
            ("edit_slow", F.col("k"), F.col("hit")),
            ("place", F.col("place"), F.lit(1)),
            ("correct", F.when(F.col("hit"), "slow").otherwise("fast"), F.col("ok")),
        ))
    )
    counted = found.select("run", F.inline(keys)).where("key is not null").groupBy("run", "figure", "key").agg(F.avg("v").alias("value"), count.alias("n"))
    counted = counted.where((F.col("figure") != "edit_slow") | (F.col("n") >= LEAST_EDITS)).withColumn("value", F.when(F.col("figure") == "place", F.col("n").cast("double")).otherwise(F.col("value")))
    return chance.unionByName(by_d).unionByName(counted)
