"""A small folder of sequences, and the stream against one batch."""

from __future__ import annotations

import os
import random
import struct
import tempfile

import numpy as np
import pandas as pd
import pytest

from sweepflow.jobs import ground_truth, storage
from sweepflow.operators import motion
from sweepflow.sources import kitti
from sweepflow.streaming import firings, waiting


@pytest.fixture(scope="module")
def root():
    root = tempfile.mkdtemp(prefix="kitti-")
    for kind in ("velodyne", "labels"):
        os.makedirs(f"{root}/03/{kind}")
    cloud = [(i * 0.2, 0.0, 0.0, 0.5) for i in range(12)] + [(50 + i * 0.2, 0.0, 0.0, 0.5) for i in range(12)] + [(float("nan"), 0, 0, 0)]
    with open(f"{root}/03/velodyne/000007.bin", "wb") as f:
        f.write(b"".join(struct.pack("<4f", *p) for p in cloud))
    with open(f"{root}/03/labels/000007.label", "wb") as f:
        f.write(b"".join(struct.pack("<2H", s, 1) for s in [40] * 12 + [10] * 12 + [0]))
    open(f"{root}/03/times.txt", "w").write("0.0\n0.103736\n")
    open(f"{root}/03/poses.txt", "w").write("1 0 0 5 0 1 0 6 0 0 1 7\n" * 2)
    open(f"{root}/03/calib.txt", "w").write("".join(f"{k}: 1 0 0 0 0 1 0 0 0 0 1 0\n" for k in ("P0", "P1", "P2", "P3", "Tr")))
    return root


def test_folder(spark, root):
    p = kitti.with_labels(kitti.points(spark, root), spark, root)
    rows = p.orderBy("point_idx").collect()
    assert len(rows) == 25 and rows[3].sequence == 3 and rows[3].frame == 7 and rows[24].x is None and rows[12].semantic_label == 10
    assert [(r.frame, r.stamp_ns) for r in kitti.times(spark, root).orderBy("frame").collect()] == [(0, 0), (1, 103736000)]
    assert kitti.poses(spark, root).first().m[3] == 5.0 and {r.key for r in kitti.calibration(spark, root).collect()} == {"P0", "P1", "P2", "P3", "Tr"}


def test_ground_truth_clusters(spark, root):
    p = kitti.with_labels(kitti.points(spark, root), spark, root)
    got = {r.point_idx: r.cluster_label for r in ground_truth.euclidean_clusters(p).collect()}
    assert {got[i] for i in range(12)} == {0} and {got[i] for i in range(12, 24)} == {2} and got[24] == 0


def test_broken_file_stops(spark, root):
    other = tempfile.mkdtemp(prefix="kitti-")
    os.makedirs(f"{other}/00/velodyne")
    open(f"{other}/00/velodyne/000000.bin", "wb").write(b"123")
    with pytest.raises(Exception, match="no multiple"):
        kitti.points(spark, other).collect()


def test_stream_equals_batch(spark):
    rows = [(s, f * 16 + r, f, r, (f * 3 + 5 - r % 3) % 40) for s in range(2) for f in range(60) for r in range(4)]
    frame = pd.DataFrame(rows, columns=["stream_id", "pid", "firing_index", "row_index", "column_in_rotation"])
    want = pd.concat([firings.step(-1, g, 40)[1] for _, g in frame.groupby("stream_id")])
    path, out = tempfile.mkdtemp(prefix="in-"), f"s{id(frame)}"
    schema = "stream_id long, pid long, firing_index long, row_index int, column_in_rotation long"
    for i in range(3):
        part = frame[(frame.firing_index >= i * 20) & (frame.firing_index < (i + 1) * 20)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = firings.unwrap_stream(stream, 40).writeStream.format("memory").queryName(out).option("checkpointLocation", tempfile.mkdtemp(prefix="state-")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    key = ["stream_id", "pid"]
    got = spark.sql(f"select * from {out}").toPandas().sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    assert (got[want.columns].astype(int) == want.astype(int)).all().all() and want.rotation.max() > 2


def test_sensor_poses(spark, root):
    swap = np.array([[0, 0, 1], [-1, 0, 0], [0, -1, 0]])
    other = tempfile.mkdtemp(prefix="kitti-")
    os.makedirs(f"{other}/05")
    camera, tr = np.random.default_rng(1).normal(size=(2, 3, 4))
    line = lambda m: " ".join(map(repr, m.ravel().tolist()))
    open(f"{other}/05/times.txt", "w").write("0.5\n")
    open(f"{other}/05/poses.txt", "w").write(f"{line(camera)}\n{line(tr)}\n")
    open(f"{other}/05/calib.txt", "w").write(f"P0: {line(camera)}\nTr: {line(tr)}\n")
    (row,) = kitti.sensor_poses(spark, other).collect()
    whole = lambda m: np.vstack([m, [0, 0, 0, 1]])
    want = swap @ (whole(camera) @ whole(tr))[:3]
    assert row.stamp_ns == 500_000_000 and np.allclose(row.m, want.ravel())
    open(f"{other}/05/times.txt", "a").write("0.6\n0.7\n")
    with pytest.raises(Exception, match="no pose"):
        kitti.sensor_poses(spark, other).collect()


def test_gps_folder_and_static_transform(spark):
    other = tempfile.mkdtemp(prefix="drive-")
    os.makedirs(f"{other}/d1/oxts/data")
    for frame, lat in enumerate((49.0, 49.001)):
        open(f"{other}/d1/oxts/data/{frame:010d}.txt", "w").write(f"{lat} 8.4 110.5 0.01 0.02 1.5 90 91 7 8 9 0 0\n")
    rows = kitti.oxts(spark, other)
    assert [(r.drive, r.frame, r.lat, r.yaw, r.forward, r.left, r.up) for r in rows.orderBy("frame").collect()] == [("d1", 0, 49.0, 1.5, 7.0, 8.0, 9.0), ("d1", 1, 49.001, 1.5, 7.0, 8.0, 9.0)]
    m = [r.m for r in motion.gps_poses(rows, ["drive"], "frame").orderBy("frame").collect()]
    scale = np.cos(np.radians(49.0))
    assert m[1][3] == pytest.approx(scale * 6378137.0 * np.radians(8.4)) and m[1][7] == pytest.approx(scale * 6378137.0 * np.arctanh(np.sin(np.radians(49.001)))) and m[1][11] == 110.5
    # Near the first row, the projection is true to scale.
    assert m[1][7] - m[0][7] == pytest.approx(6378137.0 * np.radians(0.001), rel=1e-4)
    open(f"{other}/calib.txt", "w").write("calib_time: 15-Mar-2012 11:37:16\nR: 1 2 3 4 5 6 7 8 9\nT: -1 -2 -3.5\n")
    assert kitti.static_transform(spark, f"{other}/calib.txt").first().m == [1, 2, 3, -1, 4, 5, 6, -2, 7, 8, 9, -3.5]
    open(f"{other}/calib.txt", "w").write("calib_time: x\nR: 1 2 3\nT: 1 2 3\n")
    with pytest.raises(Exception, match="nine"):
        kitti.static_transform(spark, f"{other}/calib.txt").collect()


def test_scratch_tables_go(spark):
    with storage.scratch(spark) as keep:
        path = storage.written(spark.range(5), "scratch-test").inputFiles()[0].removeprefix("file:")
        kept = keep(spark.range(5), "scratch-kept")
        assert os.path.exists(path.removeprefix("//"))
    assert not os.path.exists(path.removeprefix("//")) and kept.count() == 5


def test_messages_wait_for_poses(spark):
    r = random.Random(3)
    rows = []
    for s in range(2):
        poses = [(s, t, None, [float(t + k) for k in range(7)]) for t in range(100, 1000, 90)]
        messages = [(s, r.randrange(0, 1100), i, None) for i in range(60)]
        rows += [(b, row) for row in sorted(poses + messages, key=lambda x: x[1]) for b in [min(2, row[1] // 400)]]
    # A plain loop: what each message should meet once all poses are there.
    want = set()
    for _, (s, t, i, _pose) in rows:
        stamps = [x[1] for _, x in rows if x[0] == s and x[2] is None]
        before, after = [x for x in stamps if x <= t], [x for x in stamps if x >= t]
        if i is not None and before and after:
            want.add((s, i, t, max(before), min(after), float(max(before)), float(min(after))))
    path, out = tempfile.mkdtemp(prefix="in-"), f"w{id(rows)}"
    for b in range(3):
        spark.createDataFrame([row for n, row in rows if n == b], waiting.INPUT).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(waiting.INPUT).option("maxFilesPerTrigger", 1).parquet(path)
    query = waiting.await_poses(stream).writeStream.format("memory").queryName(out).option("checkpointLocation", tempfile.mkdtemp(prefix="state-")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql(f"select * from {out}").collect()
    assert sorted((g.stream_id, g.id, g.stamp_ns, g.before_ns, g.after_ns, g.before[0], g.after[0]) for g in got) == sorted(want)
    held, first = waiting.release(([], [], [], []), pd.DataFrame([x for _, x in rows if x[0] == 0], columns=["stream_id", "stamp_ns", "id", "pose"]), 10**9)
    assert {(0, *x) for x in zip(first["id"], first["stamp_ns"], first["before_ns"], first["after_ns"], [p[0] for p in first["before"]], [p[0] for p in first["after"]])} == {w for w in want if w[0] == 0}
    assert held[2] == [i for _, t, i in sorted((x[1], x[1], x[2]) for _, x in rows if x[0] == 0 and x[2] is not None and x[1] > 910)]
    _, now = waiting.release(held, pd.DataFrame([(0, 5000, 99, None)], columns=["stream_id", "stamp_ns", "id", "pose"]), 10**9, wait=False)
    assert set(now["before_ns"]) == {910} and 99 in set(now["id"])
