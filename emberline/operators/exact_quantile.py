"""Exact quantiles of groups of any size: no task holds a group's values.

Each pass counts, for each group, the rows below and inside a range of values that holds the wanted rank; the next pass narrows the range by quantiles of a mergeable sketch over the rows
inside. Once a group has at most `few` rows inside, or one value, these alone are gathered. A pass reads (group, value) of a kept table and shuffles one row for each group and task.

Results in special cases: null values are left out, so a group of nulls alone has null; NaN counts as the largest; ties are equal; a group may be null; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.tables import kept_table

#: Rows of a group that are gathered at last, and the sketch's accuracy.
FEW, ACCURACY = 10_000, 1_000


def upper_median(rows: DataFrame, group: str, value: str, few: int = FEW) -> DataFrame:
    """(group, n long, median double): of n values in ascending order the one at n // 2, from 0."""
    return ranked(rows, group, value, lambda n: F.floor(n / 2).cast("long"), few).withColumnRenamed("value", "median")


def ranked(rows: DataFrame, group: str, value: str, rank: Callable[[Column], Column], few: int = FEW) -> DataFrame:
    """(group, n, value) at the rank, from 0, that `rank` makes of n."""
    own = kept_table(rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")))
    v, none = F.col("v"), F.lit(None).cast("double")
    state = own.groupBy("g").agg(F.count("v").alias("n"))
    # ends of the range, which lie outside it, null for none; rows below it and inside; the value once it is found
    state = kept_table(state.select("g", "n", rank(F.col("n")).alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("found")))
    names, wide = state.columns, F.col("found").isNull() & (F.col("inside") > few)
    while state.where(wide).limit(1).count():
        open_ = state.where(wide)
        sketch = within(own, open_).groupBy("h").agg(F.percentile_approx("v", [k / 64 for k in range(65)], F.lit(ACCURACY)).alias("q"))
        at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * 64).cast("int")
        cut = open_.join(sketch, F.col("g").eqNullSafe(F.col("h"))).drop("h")
        cut = kept_table(cut.withColumns({"a": F.get("q", F.greatest(at - 1, F.lit(0))), "b": F.get("q", F.least(at + 2, F.lit(64)))}).drop("q"))
        a, b = F.col("a"), F.col("b")
        parts = {"under": v < a, "same_a": v == a, "between": (v > a) & (v < b), "same_b": (v == b) & (a < b), "over": v > b}
        counted = within(own, cut).groupBy("h").agg(*(F.count_if(c).alias(n) for n, c in parts.items()))
        told = cut.join(counted, F.col("g").eqNullSafe(F.col("h")))
        # the part that holds the rank, and the rows before it
        chosen, before = None, F.col("below")
        for name, low, high, found in (("under", F.col("low"), a, none), ("same_a", a, a, a), ("between", a, b, none), ("same_b", b, b, b), ("over", b, F.col("high"), none)):
            part = F.struct(low.alias("low"), high.alias("high"), before.alias("below"), F.col(name).alias("inside"), found.alias("found"))
            holds = F.col("rank") < before + F.col(name)
            chosen = F.when(holds, part) if chosen is None else chosen.when(holds, part)
            before = before + F.col(name)
        moved = told.withColumn("c", chosen).select("g", "n", "rank", "c.*").select(*names)
        state = kept_table(state.where(~wide).unionByName(moved))
    left = within(own, state.where("found is null")).groupBy("h").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    out = state.join(left, F.col("g").eqNullSafe(F.col("h")), "left")
    return out.select(F.col("g").alias(group), "n", F.coalesce("found", F.get("vs", (F.col("rank") - F.col("below")).cast("int"))).alias("value"))


def within(own: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of these groups, as h and v with the state's ends a and b, that lie in their range. AQE splits a group that has most of the rows."""
    met = own.withColumnRenamed("g", "h").join(state, F.col("h").eqNullSafe(F.col("g")))
    return met.where((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))
