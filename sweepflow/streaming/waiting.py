"""Messages of a stream that wait for a pose at or after their stamp.

Messages and poses are one stream of rows. The state of a sensor holds the
messages that no pose has reached yet, and the poses of the last `keep_ns`
with the one before them, so it has a bound as long as poses keep coming.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a row of the stream has: a message has an id, a pose has the numbers of `pose` (seven: place and quaternion).
INPUT = "stream_id long, stamp_ns long, id long, pose array<double>"
OUTPUT = "stream_id long, id long, stamp_ns long, before_ns long, after_ns long, before array<double>, after array<double>"
STATE = "stamps array<long>, poses array<double>, ids array<long>, waiting array<long>"
SIZE = 7
Held = tuple[list[int], list[float], list[int], list[int]]


def release(held: Held, frame: pd.DataFrame, keep_ns: int, wait: bool = True) -> tuple[Held, pd.DataFrame]:
    """Takes the rows of a sensor and gives its new state and the messages that can go.

    A message goes once a pose at or after its stamp is there, with that one and
    the last at or before it. One that no pose precedes is dropped then. Where
    `wait` is false it goes at once with the newest pose, and is dropped where
    there is none. Of poses with the same stamp the last one counts.
    """
    is_pose = frame["id"].isna()
    new = frame[is_pose]
    known = dict(zip(held[0], np.reshape(held[1], (-1, SIZE)).tolist()))
    known.update(zip(new["stamp_ns"].tolist(), (np.asarray(p, float).tolist() for p in new["pose"])))
    stamps = np.array(sorted(known), np.int64)
    messages = frame[~is_pose]
    ids = np.array([*held[2], *messages["id"]], np.int64)
    times = np.array([*held[3], *messages["stamp_ns"]], np.int64)
    order = np.lexsort((ids, times))
    ids, times = ids[order], times[order]
    latest = stamps[-1] if len(stamps) else None
    ready = np.full(len(ids), True) if not wait else np.full(len(ids), False) if latest is None else times <= latest
    if wait or latest is None:
        before, after = np.searchsorted(stamps, times, "right") - 1, np.searchsorted(stamps, times, "left")
    else:
        before = after = np.full(len(ids), len(stamps) - 1)
    go = np.flatnonzero(ready & (before >= 0))
    out = pd.DataFrame({
        "id": ids[go], "stamp_ns": times[go], "before_ns": stamps[before[go]], "after_ns": stamps[after[go]],
        "before": [known[s] for s in stamps[before[go]].tolist()], "after": [known[s] for s in stamps[after[go]].tolist()],
    })
    kept = stamps[max(0, np.searchsorted(stamps, latest - keep_ns, "right") - 1) :].tolist() if latest is not None else []
    return (kept, [x for s in kept for x in known[s]], ids[~ready].tolist(), times[~ready].tolist()), out


def await_poses(rows: DataFrame, keep_ns: int = 10_000_000_000, wait: bool = True) -> DataFrame:
    """Messages with the poses around them, to interpolate between. Expects INPUT."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(map(list, state.get)) if state.exists else ([], [], [], [])
        held, out = release(held, pd.concat(frames), keep_ns, wait)
        state.update(held)
        yield out.assign(stream_id=key[0])[["stream_id", "id", "stamp_ns", "before_ns", "after_ns", "before", "after"]]

    return rows.groupBy("stream_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
