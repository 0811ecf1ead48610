"""The episode state machine over an unbounded stream of steps.

Steps (episode_id, step, kind, status, ratio, ts) of an episode may come in any order and twice; a step waits in state until all before it have been taken. An episode ends with its stop, or when no step
came for `idle` by event time; then one record goes out and its state goes away. Later steps of an ended episode are dropped, as are rows behind the watermark.

A step improves on the best ratio only below (1 - DELTA) of it; stops count no edit, malformed actions do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELTA = 0.03
STATE = "next int, best double, n_edits int, n_invalid int, n_correct int, n_improved int, last_improved int, failed boolean, recovered boolean, ended boolean"
RECORD = "episode_id string, best_ratio double, n_edits int, n_invalid int, n_correct int, stopped int, recovered boolean, n_improved int, last_improved int"
START = (1, 1.0, 0, 0, 0, 0, 0, False, False, False)


def taken(state: tuple, kind: str, status: str, ratio: float | None) -> tuple:
    """The state after the step whose turn it is."""
    turn, best, edits, invalid, correct, improved, last, failed, recovered, _ = state
    if kind == "stop":
        return (turn + 1, best, edits, invalid, correct, improved, last, failed, recovered, True)
    ok = status == "ok"
    better = ok and ratio is not None and ratio == ratio and ratio < (1 - DELTA) * best
    return (turn + 1, ratio if better else best, edits + 1, invalid + (not ok), correct + ok, improved + better, turn if better else last, failed or not ok, recovered or (failed and better), False)


class Episodes(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getMapState("waiting", "step int", "kind string, status string, ratio double")

    def record(self, key: str, s: tuple, stopped: bool) -> pd.DataFrame:
        return pd.DataFrame([(key, s[1], s[2], s[3], s[4], int(stopped), s[8], s[5], s[6])], columns=[f.split()[0] for f in RECORD.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else START
        state = tuple(state)
        if state[-1]:
            return
        newest = 0
        for batch in rows:
            for step, kind, status, ratio, at in zip(batch["step"], batch["kind"], batch["status"], batch["ratio"], batch["at"], strict=True):
                newest = max(newest, int(at))
                if step >= state[0]:
                    self.waiting.updateValue((int(step),), (kind, status, None if ratio != ratio else float(ratio)))
        while not state[-1] and self.waiting.containsKey((state[0],)):
            turn = state[0]
            state = taken(state, *self.waiting.getValue((turn,)))
            self.waiting.removeKey((turn,))
        for t in list(self.handle.listTimers()):
            newest = max(newest, t - self.idle_ms)
            self.handle.deleteTimer(t)
        # an ended episode is remembered until its timer, so that what comes late opens no new one
        self.handle.registerTimer(newest + self.idle_ms)
        self.state.update(state)
        if state[-1]:
            self.waiting.clear()
            yield self.record(key[0], state, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        self.state.clear()
        self.waiting.clear()
        if state is not None and not state[-1]:
            yield self.record(key[0], state, False)

    def close(self) -> None:
        pass


def records(steps: DataFrame, idle: str = "7 days", late: str = "1 hour") -> DataFrame:
    """A stream of episode records; needs the RocksDB state store."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    keyed = steps.withWatermark("ts", late).selectExpr("episode_id", "step", "kind", "status", "ratio", "ts", "unix_millis(ts) as at")
    return keyed.groupBy("episode_id").transformWithStateInPandas(Episodes(idle_ms), outputStructType=RECORD, outputMode="Append", timeMode="EventTime")
