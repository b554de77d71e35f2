"""Firings as a stream: sessions and rotations are counted and late points dropped with a small state for each sensor.

The state of a sensor is the largest rearmost column of all its firings, which
tells the rotation and how far columns are finished, the stamp of the last one,
the number of the session, and whether the next firing has to begin a new one.
That is all that the next micro-batch needs, whatever the length of the stream.
A micro-batch's size is set at the source, so a group's rows have a bound. The
state of a sensor that sends nothing for `idle_ms` goes; it begins anew then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "stream_id long, pid long, firing_index long, row_index int, session long, rotation long, global_column long, late boolean"
STATE = "rearmost long, stamp_ns long, session long, again boolean"


@dataclass
class Sensor:
    """rearmost is -1 before a session's first firing; stamp_ns is null before the first of all."""

    rearmost: int = -1
    stamp_ns: int | None = None
    session: int = 0
    again: bool = False


def step(sensor: Sensor | int, frame: pd.DataFrame, num_columns: int, gap_ns: int | None = None) -> tuple[Sensor, pd.DataFrame]:
    """Takes the firings of a sensor (or of one of which nothing but its rearmost column is known) in their order. Expects firing_index, pid, row_index and column_in_rotation, and stamp_ns where gap_ns is given.

    Every point is placed by the shorter way round from the largest rearmost
    column so far. A firing whose stamp (its points' smallest) is more than
    gap_ns from the one before, in either direction, begins a new session and
    is dropped itself. A firing longer than half a turn is a bad start: its
    points come out, and the next firing begins a new session and is dropped.
    In a new session columns are counted anew. One pass over the firings finds
    what each is placed from; the points are placed all at once.
    """
    sensor = Sensor(sensor) if isinstance(sensor, int) else sensor
    half = num_columns / 2
    frame = frame.sort_values(["firing_index", "pid"])
    firing, column = frame["firing_index"].to_numpy(np.int64), frame["column_in_rotation"].to_numpy(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], firing[1:] != firing[:-1]]))
    stops = np.append(starts[1:], len(firing))
    stamps = np.minimum.reduceat(frame["stamp_ns"].to_numpy(np.int64), starts).tolist() if gap_ns is not None else [None] * len(starts)
    low, high = np.minimum.reduceat(column, starts).tolist(), np.maximum.reduceat(column, starts).tolist()
    base, mark, late_below, session = (np.empty(len(starts), np.int64) for _ in range(4))
    keep = np.ones(len(starts), bool)
    rearmost, last, now, again = sensor.rearmost, sensor.stamp_ns, sensor.session, sensor.again
    for k, (a, z, stamp) in enumerate(zip(starts.tolist(), stops.tolist(), stamps)):
        jump = gap_ns is not None and last is not None and abs(stamp - last) > gap_ns
        last = stamp if gap_ns is not None else last
        if jump or again:
            now, rearmost, again, keep[k] = now + 1, -1, False, False
            base[k], mark[k], late_below[k], session[k] = 0, -1, 0, now
            continue
        from_ = max(rearmost, 0)
        at = from_ % num_columns
        base[k], mark[k], session[k] = from_ - at, rearmost, now
        first, most = low[k] - at, high[k] - at
        if first < -half or (most > half and rearmost > 0):
            # Some points go round: what the firing's ends are depends on each point.
            way = column[a:z] - at
            placed = column[a:z] + num_columns * ((way < -half).astype(np.int64) - ((way > half) & (rearmost > 0)))
            first, most = int(placed.min()) - at, int(placed.max()) - at
        bad = most - first > half
        late_below[k] = -(1 << 62) if bad else rearmost
        again = bad
        rearmost = -1 if bad else max(rearmost, from_ + first)
    n = stops - starts
    spread = lambda x: np.repeat(x, n)
    from_, before = spread(base), spread(mark)
    way = column - np.maximum(before, 0) % num_columns
    turn = from_ // num_columns + (way < -half) - ((way > half) & (before > 0))
    placed = turn * num_columns + column
    out = frame[["stream_id", "pid", "firing_index", "row_index"]].assign(session=spread(session), rotation=turn, global_column=placed, late=placed < spread(late_below))
    return Sensor(rearmost, last, now, again), out[spread(keep)]


def unwrap_stream(points: DataFrame, num_columns: int, gap_ns: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Adds session, rotation, global_column and late to a stream of points with stream_id."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sensor = Sensor(*state.get) if state.exists else Sensor()
        sensor, out = step(sensor, pd.concat(frames), num_columns, gap_ns)
        state.update((sensor.rearmost, sensor.stamp_ns, sensor.session, sensor.again))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    wait = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return points.groupBy("stream_id").applyInPandasWithState(update, OUTPUT, STATE, "append", wait)
