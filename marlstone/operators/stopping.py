"""Early stopping as a state machine, over tables and streams: constant state a key, whatever the number of events."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: steps taken, reference value, steps without improvement, best value, its order, whether it has stopped and where.
STATE = "steps long, reference double, stalled long, best double, best_at double, stopped boolean, stopped_at double"
START = (0, math.inf, 0, math.inf, math.nan, False, math.nan)


def step(state: tuple, at: float, value: float, patience: int, least: float) -> tuple:
    """The state after one event: the reference is reset by a relative improvement beyond least; patience steps without one stop."""
    steps, reference, stalled, best, best_at, stopped, stopped_at = state
    if stopped:
        return state
    if value < best:
        best, best_at = value, at
    if value < reference * (1.0 - least):
        reference, stalled = value, 0
    else:
        stalled += 1
    stopped = stalled >= patience
    return steps + 1, reference, stalled, best, best_at, stopped, at if stopped else stopped_at


def early_stopping(df: DataFrame, key: str, order: list[str], value: str, patience: int, least: float) -> DataFrame:
    """(key, steps, reference, stalled, best, best_at, stopped, stopped_at): one fold over each key's events in order.

    Rows are dealt by key and sorted; a task folds them as they stream by. best_at and stopped_at are the first order
    column as a number, stopped_at null without a stop. Null values are passed over; NaN is no improvement; without values a key has no row.
    """
    slim = df.where(f"{value} is not null").select(key, *order, value)
    dealt = slim.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            done = []
            for k, at, v in zip(pdf[key], pdf[order[0]], pdf[value]):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, *state))
                    now, state = k, START
                state = step(state, at.timestamp() if hasattr(at, "timestamp") else float(at), float(v), patience, least)
            yield pd.DataFrame(done, columns=[key, *(c.split()[0] for c in STATE.split(", "))])
        if state is not None:
            yield pd.DataFrame([(now, *state)], columns=[key, *(c.split()[0] for c in STATE.split(", "))])

    return dealt.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {STATE}")


def early_stopping_stream(stream: DataFrame, key: str, order: list[str], value: str, patience: int, least: float) -> DataFrame:
    """The same over a stream (update mode): each micro-batch moves the state of the keys that it holds, in order within the batch."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        rows = pd.concat(list(batches)).sort_values(order)
        for at, v in zip(rows[order[0]], rows[value]):
            now = step(tuple(now), at.timestamp() if hasattr(at, "timestamp") else float(at), float(v), patience, least)
        state.update(tuple(now))
        yield pd.DataFrame([(*k, *now)], columns=[key, *(c.split()[0] for c in STATE.split(", "))])

    out = f"{key} {stream.schema[key].dataType.simpleString()}, {STATE}"
    return stream.where(f"{value} is not null").groupBy(key).applyInPandasWithState(run, out, STATE, "update", GroupStateTimeout.NoTimeout)


def tail_report(df: DataFrame, key: str, order: list[str], value: str, last: int) -> DataFrame:
    """(key, n, best, best_step, tail_mean, best_is_recent): the first least value of each key's events in order, the mean of
    its last `last` values, and whether the best one is among them. Steps count from 1; null and NaN values are passed over.

    Rows are dealt by key and sorted; a task keeps `last` values a key while they stream by.
    """
    slim = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, *order, value)
    dealt = slim.repartition(key).sortWithinPartitions(key, *order)
    names = [key, "n", "best", "best_step", "tail_mean", "best_is_recent"]

    def row(k, n: int, best: float, at: int, tail: deque) -> tuple:
        return k, n, best, at, sum(tail) / len(tail), at > n - last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, best, at, tail = None, 0, math.inf, 0, deque(maxlen=last)
        for pdf in batches:
            done = []
            for k, v in zip(pdf[key], pdf[value].astype(float)):
                if n and k != now:
                    done.append(row(now, n, best, at, tail))
                    n, best, at, tail = 0, math.inf, 0, deque(maxlen=last)
                now, n = k, n + 1
                tail.append(v)
                if v < best:
                    best, at = v, n
            yield pd.DataFrame(done, columns=names)
        if n:
            yield pd.DataFrame([row(now, n, best, at, tail)], columns=names)

    return dealt.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, n long, best double, best_step long, tail_mean double, best_is_recent boolean")
