"""Column functions of the episode and protocol semantics, for use in any DataFrame expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELTA = 0.03
LEAST_RATIO = 1e-9


def speedup(best_ratio: Column) -> Column:
    return 1 / F.greatest(best_ratio, F.lit(LEAST_RATIO))


def inverse(x: Column) -> Column:
    """1 / x as doubles have it, infinite for zero, where Spark's division raises."""
    return F.when(x == 0, F.lit(float("inf"))).otherwise(1 / x)


def ln(x: Column) -> Column:
    """The logarithm as doubles have it: minus infinity for zero and no number below, where Spark's is null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def reward(best_ratio: Column, n_edits: Column, n_invalid: Column, per_edit: float = 0.01, per_invalid: float = 0.05, regression: float = 0.0) -> Column:
    """Clipped log-speedup less the cost of edits, invalid edits and, above ratio 1, a regression."""
    gain = F.least(F.greatest(F.ln(speedup(best_ratio)), F.lit(-4.0)), F.lit(4.0))
    return gain - per_edit * n_edits - per_invalid * n_invalid - F.when(best_ratio > 1, F.lit(regression)).otherwise(0.0)


def unit_hash(*parts: Column, sep: str = "\n---\n") -> Column:
    """The first 16 hex digits of sha1 over the parts, as a number from 0 to 1."""
    key = F.concat_ws(sep, *parts)
    return F.conv(F.substring(F.sha1(key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def truncated_best(steps: Column, budget: Column | int, delta: float = DELTA) -> Column:
    """struct<best double, used int>: the fold over steps (struct with kind, status, ratio, in order) cut at a stop or the budget.

    An ok step replaces the best only below (1 - delta) of it, so this is no running minimum.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(1.0).alias("best"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        done = a["done"] | (x["kind"] == "stop") | (a["used"] >= budget)
        better = ~done & (x["status"] == "ok") & x["ratio"].isNotNull() & (x["ratio"] < (1 - delta) * a["best"])
        return F.struct(F.when(better, x["ratio"]).otherwise(a["best"]).alias("best"), F.when(done, a["used"]).otherwise(a["used"] + 1).alias("used"), done.alias("done"))

    return F.aggregate(steps, start, step, lambda a: F.struct(a["best"].alias("best"), a["used"].alias("used")))


def expected_best_of(values: Column, k: Column | int) -> Column:
    """The mean over all k-subsets of an ascending array of the subset's last value; NaN for k above the size."""
    k = F.lit(k) if isinstance(k, int) else k
    n = F.size(values)

    def weight(i: Column) -> Column:
        product = F.aggregate(F.sequence(F.lit(0), k - 2), F.lit(1.0), lambda w, j: w * F.greatest(i - j, F.lit(0)) / F.greatest(n - 1 - j, F.lit(1)))
        return k / n * F.when(k == 1, F.lit(1.0)).otherwise(F.when(i >= k - 1, product).otherwise(0.0))

    total = F.aggregate(F.transform(values, lambda v, i: v * weight(i)), F.lit(0.0), lambda a, x: a + x)
    return F.when((k > n) | (n == 0), F.lit(float("nan"))).otherwise(total)


def p_reach(n: Column, c: Column, k: int) -> Column:
    """The chance that a k-subset of n samples holds one of the c that reach a threshold; NaN for k above n."""
    missed = F.lit(1.0)
    for j in range(k):
        missed = missed * F.greatest(n - c - j, F.lit(0)) / F.greatest(n - j, F.lit(1))
    return F.when(n < k, F.lit(float("nan"))).otherwise(1 - missed)


def learning_rate(step: Column, rate: float, least: float, warm: int, last: int) -> Column:
    """Linear warm-up, then a cosine to the least rate."""
    share = (step - warm) / max(1, last - warm)
    return F.when(step < warm, rate * (step + 1) / max(1, warm)).when(step >= last, F.lit(least)).otherwise(least + 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)) * (rate - least))


def action(text: Column) -> Column:
    """struct<kind, code> of a reply: the first protocol token wins, an unclosed edit runs to the end, an edit without code is malformed."""
    stop, edit = F.instr(text, "<STOP>"), F.instr(text, "<EDIT>")
    code = F.regexp_replace(F.regexp_extract(text, r"(?s)<EDIT>\s*?\n?(.*?)(?:</EDIT>|\z)", 1), r"\s+\z", "")
    is_stop = (stop > 0) & ((edit == 0) | (stop < edit))
    is_edit = ~is_stop & (edit > 0) & (F.length(F.regexp_replace(code, r"\s", "")) > 0)
    return F.struct(F.when(is_stop, "stop").when(is_edit, "edit").otherwise("malformed").alias("kind"), F.when(is_edit, code).alias("code"))


def with_hint(observation: Column, hint: Column) -> Column:
    """The hint as the last line before the last </STATE>, or at the end; a null or empty hint changes nothing."""
    tag = "</STATE>"
    at = F.length(observation) - F.instr(F.reverse(observation), tag[::-1]) - len(tag) + 1
    inside = F.concat(F.substring(observation, F.lit(1), at), F.lit("hint="), hint, F.lit("\n"), F.substring(observation, at + 1, F.length(observation)))
    outside = F.concat(observation, F.lit("\nhint="), hint)
    return F.when(hint.isNull() | (hint == ""), observation).when(F.instr(observation, tag) > 0, inside).otherwise(outside)


def profile_shares(times: Column) -> Column:
    """map<string,double> of times as shares of their sum; a sum of 0 counts as 1."""
    total = F.aggregate(F.map_values(times), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(times, lambda _, v: v / F.when(total == 0, F.lit(1.0)).otherwise(total))


def hottest(profile: Column, names: Column) -> Column:
    """The name with the largest share, missing ones counting as 0; the first of equals."""
    ranked = F.transform(names, lambda n, i: F.struct(F.coalesce(F.try_element_at(profile, n), F.lit(0.0)).alias("share"), (-i).alias("first"), n.alias("name")))
    return F.array_max(ranked)["name"]
