"""Order-dependent operators on streams: rows wait in state until the watermark has passed them, then go by in order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def in_order(signal: DataFrame, columns: list[str], lateness: str, expiry_us: int, output: str, step: Callable, close: Callable) -> DataFrame:
    """Rows of each subject (subject_id, ts, columns) in the order of their times, whatever order they arrive in.

    A row is final once the watermark (the latest time seen less `lateness`) has passed it; until then it
    is held in its subject's state, with a timer that fires when it becomes final. Rows that arrive after that are dropped,
    as Spark does for its own windows. step(machine, time in microseconds, values) gives the next machine (None at first) and
    finished rows; close(machine) gives what is left where a subject had no rows for expiry_us, and its
    state goes. What a subject holds is bounded by the rows of its last `lateness` and `expiry_us`.
    """
    names = [c.split()[0] for c in output.split(", ")]

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, machine, last = pickle.loads(state.get[0]) if state.exists else ([], None, None)
        mark = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            waiting += list(zip(batch["_us"].tolist(), *(batch[c].tolist() for c in columns)))
        waiting.sort(key=lambda r: r[0])
        done, found = 0, []
        for time, *values in waiting:
            if time >= mark:
                break
            if last is not None and time - last > expiry_us:
                found, machine = found + close(machine), None
            machine, rows = step(machine, time, values)
            found, last, done = found + rows, time, done + 1
        waiting = waiting[done:]
        if not waiting and last is not None and last + expiry_us < mark:
            found += close(machine)
            state.remove()
        else:
            state.update((pickle.dumps((waiting, machine, last), 5),))
            due = waiting[0][0] if waiting else last + expiry_us
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        yield pd.DataFrame([(*key, *r) for r in found], columns=["subject_id", *names])

    marked = signal.withWatermark("ts", lateness).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    kind = signal.schema["subject_id"].dataType.simpleString()
    return marked.select("subject_id", "ts", "_us", *columns).groupBy("subject_id").applyInPandasWithState(work, f"subject_id {kind}, {output}", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def outside_episodes(signal: DataFrame, flag: str, step_us: int, lateness: str = "10 minutes", expiry_us: int = 86_400_000_000) -> DataFrame:
    """subject_id, start_us, end_us, n, duration_us of each maximal run of a true flag, as episodes.outside_episodes gives them.

    An episode is told when a row that isn't flagged follows, or when the subject had no rows for expiry_us; the
    next row after such a pause begins anew, so within the subject's pauses of up to expiry_us both agree.
    """

    def end(run: tuple) -> list[tuple]:
        return [(*run, run[1] - run[0])]

    def step(machine, time, values):
        before, run = machine or (None, None)
        if values[0] is True or values[0] == 1:
            run = (run[0], time, run[2] + 1) if run else (time - step_us if before is None else before, time, 1)
            return (time, run), []
        return (time, None), end(run) if run else []

    return in_order(signal, [flag], lateness, expiry_us, "start_us long, end_us long, n long, duration_us long", step, lambda machine: end(machine[1]) if machine and machine[1] else [])


def thin(signal: DataFrame, window_us: int, lateness: str = "10 minutes", expiry_us: int = 86_400_000_000) -> DataFrame:
    """subject_id, ts_us of the first time and each next one at least a window after the last kept, as windows.thin gives them.

    expiry_us is a window at least, so forgetting a subject changes nothing.
    """

    def step(machine, time, values):
        return (time, [(time,)]) if machine is None or time >= machine + window_us else (machine, [])

    return in_order(signal, [], lateness, max(expiry_us, window_us), "ts_us long", step, lambda machine: [])
