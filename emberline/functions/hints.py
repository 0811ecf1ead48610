"""Hindsight hints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELTA = 0.03
# The sentences, with {f} for what was edited.
STOPPED, EARLY = "stopping here is right", "stopping here is premature"
MALFORMED = "the next action is malformed; answer with a complete <EDIT> or <STOP>"
BY_STATUS = {
    "incorrect": "the next edit to {f} changes its behaviour; it must preserve it exactly",
    "syntax_error": "the next edit to {f} is not valid; it must be plain valid Python",
    "static_error": "the next edit to {f} is not valid; it must be plain valid Python",
    "load_error": "the next edit to {f} is not valid; it must be plain valid Python",
    "runtime_error": "the next edit to {f} raises an error",
    "timeout": "the next edit to {f} is too slow or hangs",
    "resource": "the next edit to {f} is too slow or hangs",
}
GAIN, NO_GAIN, OTHER = "editing {f} speeds the code up", "editing {f} gives no speedup", "the next edit to {f} fails ({s})"


def outcome_hint(kind: Column, status: Column, improved: Column, names: Column, remaining: Column) -> Column:
    """What to say about an action; names: the functions that it edits, remaining: the slow ones that are left."""
    about = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("the code"))
    put = lambda text: F.replace(F.replace(F.lit(text), F.lit("{f}"), about), F.lit("{s}"), status)
    out = F.when(kind == "stop", F.when(F.size(remaining) > 0, F.lit(EARLY)).otherwise(F.lit(STOPPED))).when(status == "malformed", F.lit(MALFORMED))
    for s, text in BY_STATUS.items():
        out = out.when(status == s, put(text))
    return out.when(status == "ok", F.when(improved, put(GAIN)).otherwise(put(NO_GAIN))).otherwise(put(OTHER))


def told(steps: Column, slow: Column) -> Column:
    """array<struct<step, hint>> of an episode's steps (step, action_kind, status, ratio, edited): an improving edit of a slow function leaves it among those that are left no more."""
    start = F.struct(F.lit(1.0).alias("best"), slow.alias("left"), F.expr("cast(array() as array<struct<step: int, hint: string>>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        better = (s["action_kind"] == "edit") & (s["status"] == "ok") & F.coalesce(s["ratio"] < (1 - DELTA) * a["best"], F.lit(False))
        row = F.struct(s["step"].alias("step"), outcome_hint(s["action_kind"], s["status"], better, s["edited"], a["left"]).alias("hint"))
        return F.struct(F.when(better, s["ratio"]).otherwise(a["best"]).alias("best"), F.when(better, F.array_except(a["left"], s["edited"])).otherwise(a["left"]).alias("left"), F.concat(a["out"], F.array(row)).alias("out"))

    return F.aggregate(steps, start, step, lambda a: a["out"])
