"""Attempts since the last pass, over a stream of runs: the streaming form of operators.worklist.attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def count_attempts(runs: DataFrame, most: int = 2, forget_after_ms: int | None = None) -> DataFrame:
    """runs (session, at, passed) -> (session, at, attempt, blocks) of each failed run, in the order of at in a batch.

    A session's state is one number, which only a pass ends, however long a pause is; with forget_after_ms it also ends
    after so long without runs, by processing time. Of a batch only times and outcomes are held. A null outcome is a failure.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(b["at"].to_numpy(np.int64), b["passed"].fillna(False).to_numpy(bool)) for b in batches]
        at, passed = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at, kind="stable")
        at, passed = at[order], passed[order]
        known, place = (state.get[0] if state.exists else 0), np.arange(1, len(at) + 1)
        last = np.maximum.accumulate(np.where(passed, place, 0))  # the last pass up to each run, 0 before the first
        attempt = place - last + np.where(last == 0, known, 0)
        state.update((int(attempt[-1]),))
        if forget_after_ms is not None:
            state.setTimeoutDuration(forget_after_ms)
        failed = ~passed
        yield pd.DataFrame({"session": key[0], "at": at[failed], "attempt": attempt[failed], "blocks": attempt[failed] <= most})

    kind = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return runs.groupBy("session").applyInPandasWithState(step, "session string, at long, attempt long, blocks boolean", "n long", "append", kind)
