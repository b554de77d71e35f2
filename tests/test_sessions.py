"""Sessions and rotations of a stream against plain loops, the batch operator, and in time."""

from __future__ import annotations

import random
import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sweepflow.operators import range_image
from sweepflow.streaming import firings

SCHEMA = "stream_id long, pid long, firing_index long, row_index int, column_in_rotation long, stamp_ns long"


def plain_step(rows, num_columns, gap_ns):
    """rows: (firing, pid, column, stamp). One firing and one point at a time."""
    half, out = num_columns / 2, []
    rearmost, last, session, again = -1, None, 0, False
    for f in sorted({r[0] for r in rows}):
        points = sorted(r for r in rows if r[0] == f)
        stamp = min(p[3] for p in points)
        jump = gap_ns is not None and last is not None and abs(stamp - last) > gap_ns
        last = stamp
        if jump or again:
            session, rearmost, again = session + 1, -1, False
            continue
        base, placed = max(rearmost, 0), []
        for _, pid, column, _ in points:
            way, turn = column - base % num_columns, base // num_columns
            turn += 1 if way < -half else -1 if way > half and rearmost > 0 else 0
            placed.append((pid, session, turn, turn * num_columns + column))
        columns = [p[3] for p in placed]
        again = max(columns) - min(columns) > half
        out += [(*p, not again and p[3] < rearmost) for p in placed]
        rearmost = -1 if again else max(rearmost, min(columns))
    return sorted(out)


def made(seed, n, num_columns=40):
    r = random.Random(seed)
    rows, at, now = [], 0, 0
    for f in range(n):
        at += r.choice([0, 1, 3, 3, 3, 30 if r.random() < 0.05 else 2])
        now += r.choice([1, 2, 3, 200 if r.random() < 0.04 else 1, -300 if r.random() < 0.03 else 1])
        wild = r.random() < 0.04
        rows += [(f, f * 8 + k, (at - r.randrange(6) if not wild else r.randrange(num_columns)) % num_columns, now + k) for k in range(r.choice([1, 4, 8]))]
    return rows


def test_step_equals_plain_loop():
    for seed in range(60):
        for gap in (None, 50):
            rows = made(seed, 80)
            frame = pd.DataFrame([(0, p, f, 0, c, s) for f, p, c, s in rows], columns=["stream_id", "pid", "firing_index", "row_index", "column_in_rotation", "stamp_ns"])
            sensor, parts = firings.Sensor(), []
            for a, z in ((0, 13), (13, 14), (14, 80)):
                sensor, out = firings.step(sensor, frame[(frame.firing_index >= a) & (frame.firing_index < z)], 40, gap)
                parts.append(out)
            got = pd.concat(parts)
            assert sorted(zip(got.pid, got.session, got.rotation, got.global_column, got.late)) == plain_step(rows, 40, gap), (seed, gap)


def test_sessions_of_a_stream_are_those_of_the_table(spark):
    rows = [(s, f * 4 + k + 10_000 * s, f, k, (f * 3) % 40, stamp) for s in (0, 1) for f, p, c, stamp in made(7 + s, 90) for k in [p % 8]]
    one = spark.createDataFrame(rows, SCHEMA).dropDuplicates(["stream_id", "firing_index"])
    path, name = tempfile.mkdtemp(prefix="in-"), f"sessions{id(rows)}"
    for a, z in ((0, 20), (20, 50), (50, 90)):
        one.where(F.col("firing_index").between(a, z - 1)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = firings.unwrap_stream(source, 40, gap_ns=50).writeStream.format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="state-")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    table = range_image.time_jump_sessions(spark.read.parquet(path), ["stream_id"], ["firing_index"], F.col("stamp_ns"), 50.0, F.floor(F.col("firing_index") / 16))
    assert sorted(map(tuple, spark.sql(f"select pid, session from {name}").collect())) == sorted(map(tuple, table.select("pid", "session").collect()))
    assert table.agg(F.max("session")).first()[0] > 1


def test_many_firings_a_second():
    n = 20_000
    rng = np.random.default_rng(1)
    firing = np.repeat(np.arange(n), 64)
    frame = pd.DataFrame({"stream_id": 0, "pid": np.arange(len(firing)), "firing_index": firing, "row_index": np.tile(np.arange(64), n), "column_in_rotation": (firing - rng.integers(0, 5, len(firing))) % 2200})
    start = time.perf_counter()
    firings.step(firings.Sensor(), frame, 2200)
    assert n / (time.perf_counter() - start) > 10_000  # 22,000 on a machine that does nothing else
