"""Frames as a stream, label files, nested firings, placement in blocks, transforms between named frames."""

from __future__ import annotations

import math
import os
import random
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepflow.config import Ground
from sweepflow.jobs import queries as jobs
from sweepflow.operators import evaluate, ground, motion, neighbors, range_image, sinks
from sweepflow.sources import frames, ingest, kitti


def write_frame(root, sequence, frame, n):
    os.makedirs(f"{root}/{sequence:02d}/velodyne", exist_ok=True)
    with open(f"{root}/{sequence:02d}/velodyne/{frame:06d}.bin", "wb") as f:
        f.write(b"".join(struct.pack("<4f", frame, i, float("nan") if i == 1 else 0.5, 1.0) for i in range(n)))


def test_frames_as_a_stream(spark):
    """Each point once, over a restart and with frames that come later; a trigger has a bound."""
    frames.register(spark)
    root, state, progress = (tempfile.mkdtemp(prefix=p) for p in ("seq-", "state-", "progress-"))
    for k in range(5):
        write_frame(root, 3, k, k)
    seen = []

    def take(df, k):
        seen.append(sorted((r.sequence, r.frame, r.point_idx, r.x, r.y, r.z) for r in df.collect()))

    def run():
        source = spark.readStream.format("lidar_frames").option("path", root).option("progress", progress).option("framesPerTrigger", "2").option("framesPerTask", "1").load()
        query = source.writeStream.foreachBatch(take).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert [len(b) for b in seen if b] == [1, 5, 4]
    write_frame(root, 3, 5, 3)
    write_frame(root, 4, 0, 2)
    write_frame(root, 4, 1, 2)
    run()
    assert [len(b) for b in seen if b][3:] == [5, 2]
    rows = [r for b in seen for r in b]
    want = [(3, k, i, float(k), float(i), None if i == 1 else 0.5) for k in range(5) for i in range(k)] + [(3, 5, i, 5.0, float(i), None if i == 1 else 0.5) for i in range(3)]
    want += [(4, k, i, float(k), float(i), None if i == 1 else 0.5) for k in range(2) for i in range(2)]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_label_files_round_trip(spark):
    root = tempfile.mkdtemp(prefix="labels-")
    rows = [(s, f, i, (s * 1000 + f * 10 + i) % 65536) for s in (0, 7) for f in range(3) for i in range(50 * f + 1)]
    df = spark.createDataFrame(rows, "sequence int, frame int, point_idx int, cluster_label int")
    frames.write_label_files(df.repartition(5), root)
    assert sorted(tuple(r) for r in kitti.clusters(spark, root).collect()) == sorted(rows)
    assert os.path.getsize(f"{root}/07/labels_euclidean_clustering/000002.label") == 2 * 101
    with pytest.raises(Exception, match="there already"):
        frames.write_label_files(df, root)
    frames.write_label_files(df.withColumn("cluster_label", F.lit(5)), root, overwrite=True)
    assert {r.cluster_label for r in kitti.clusters(spark, root).collect()} == {5}
    assert [x for x in os.listdir(root) if x.startswith("_")] == []


@pytest.mark.parametrize(("change", "message"), [("point_idx + 1", "gap"), ("0", "gap"), ("point_idx", "16 bits")])
def test_broken_labels_leave_nothing(spark, change, message):
    root = tempfile.mkdtemp(prefix="labels-")
    df = spark.range(40).selectExpr("0 AS sequence", "CAST(id % 4 AS INT) AS frame", "CAST(id DIV 4 AS INT) AS point_idx", "CAST(id AS INT) AS cluster_label")
    broken = df.withColumn("point_idx", F.expr(f"CASE WHEN frame = 2 THEN {change} ELSE point_idx END").cast("int")).withColumn("cluster_label", F.when((F.col("frame") == 2) & F.lit(message == "16 bits"), 70_000).otherwise(F.col("cluster_label")))
    with pytest.raises(Exception, match=message):
        frames.write_label_files(broken, root)
    assert os.listdir(root) == []


def test_nested_firings_must_not_change_their_length(spark):
    point = "array<struct<x: double, y: double, z: double, intensity: double>>"
    rows = [(0, 0, 5, [(1.0, 2.0, 3.0, 1.0), (math.nan, 0.0, 0.0, 0.5)]), (0, 1, 0, [(9.0, 9.0, 9.0, 0.0)]), (0, 2, None, None), (0, 3, 7, [(4.0, 5.0, 6.0, 0.0), None])]
    schema = f"sensor int, seq long, stamp_ns long, points {point}"
    got = ingest.firing_points(spark.createDataFrame(rows, schema), ["sensor"], "seq", F.floor(F.col("seq") / 2)).orderBy("seq", "row_index").collect()
    assert [(r.seq, r.firing_index, r.row_index, r.x, r.intensity) for r in got] == [(0, 0, 0, 1.0, 255), (0, 0, 1, None, 127), (3, 1, 0, 4.0, 0), (3, 1, 1, None, None)]
    for bad in ([(1.0, 1.0, 1.0, 0.0)], None, []):
        with pytest.raises(Exception, match="points, not 2"):
            ingest.firing_points(spark.createDataFrame([*rows, (0, 4, 8, bad)], schema), ["sensor"], "seq", F.col("seq")).collect()
    assert ingest.firing_points(spark.createDataFrame([], schema), ["sensor"], "seq", F.col("seq")).count() == 0


def plain_cells(rows):
    cells = {}
    for pid, row, column, distance in rows:
        if distance is None:
            continue
        taken = cells.setdefault(row, {})
        if column not in taken:
            taken[column] = (distance, pid)
        elif column + 1 not in taken:
            taken[column + 1] = (distance, pid)
        elif distance < taken[column][0]:
            taken[column] = (distance, pid)
    return sorted((r, c, p, d) for r, t in cells.items() for c, (d, p) in t.items())


@pytest.mark.parametrize(("density", "shuffled"), [(1.0, False), (0.7, True)])
def test_placement_over_many_blocks(spark, density, shuffled):
    """A row without a gap, whose carries go on over many borders."""
    r = random.Random(int(density * 10))
    rows = [(k, max(0, c - r.randrange(3)), r.choice([None, 1.0, 2.0, 3.0])) for c in range(48) for k in range(2) for _ in range(r.choice([1, 2, 3]) if r.random() < density else 0)]
    if shuffled:
        r.shuffle(rows)
    rows = [(i, *x) for i, x in enumerate(rows)]
    df = spark.createDataFrame([(0, *x) for x in rows], "stream_id long, pid long, row_index int, c long, d double")
    got = range_image.place_in_order(df, ["stream_id"], "row_index", "c", "pid", "d", 4).collect()
    assert sorted((x.row_index, x.cell_column, x.pid, x.d) for x in got) == plain_cells(rows)


def test_placement_of_a_table_equals_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    points = jobs.points(spark, sf).selectExpr("stream_id", "pid", "row_index", "floor(col / 2) AS c", "dist").orderBy("pid").collect()
    want = []
    for s in {p.stream_id for p in points}:
        want += [(s, *x) for x in plain_cells([(p.pid, p.row_index, p.c, p.dist) for p in points if p.stream_id == s])]
    assert sorted((x.stream_id, x.row_index, x.cell_column, x.pid, x.dist) for x in jobs.cell_placement(spark, sf).collect()) == sorted(want)


def test_transforms_between_frames(spark):
    r = np.random.default_rng(3)
    turn = lambda a: np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    made = {n: np.vstack([np.hstack([turn(r.uniform(0, 6)), r.normal(size=(3, 1))]), [0, 0, 0, 1]]) for n in "abcdefg"}
    parents = {"a": None, "b": "a", "c": "b", "d": "c", "e": "a", "f": "odom", "g": "f"}
    rows = [(1, n, p, made[n][:3].ravel().tolist()) for n, p in parents.items()]
    table = spark.createDataFrame(rows, "k int, frame string, parent string, m array<double>")
    pairs = [("d", "e"), ("e", "d"), ("d", "a"), ("a", "d"), ("b", "b"), ("g", "odom"), ("g", "f"), ("d", "g"), ("nowhere", "a")]
    got = {(x.source, x.target): x.m for x in motion.between_frames(spark.createDataFrame([(1, *p) for p in pairs], "k int, source string, target string"), table, ["k"]).collect()}

    def up(n):
        m = np.eye(4)
        while parents.get(n):
            m, n = made[n] @ m, parents[n]
        return m, n

    for s, t in pairs:
        (a, ra), (b, rb) = up(s), up(t)
        if ra != rb:
            assert got[s, t] is None
        else:
            assert np.allclose(got[s, t], (np.linalg.inv(b) @ a)[:3].ravel())
    circle = spark.createDataFrame([(1, "x", "y", rows[0][3]), (1, "y", "x", rows[0][3])], table.schema)
    with pytest.raises(ValueError, match="circle"):
        motion.root_transforms(circle, ["k"])


def test_view_join_looks_up_fewer_rows(spark):
    p = jobs.points(spark, "/root/testdata/sf0.001")
    looked = p.select(F.sum(neighbors.columns_of_view(F.col("dist"), 0.7, 128, 4) + 1).alias("n")).first()["n"]
    assert looked < 5 * p.count()
    wide = neighbors.column_pairs(p, 0.7, 4, 5, field_of_view=2 * math.pi / 128)
    narrow = neighbors.view_pairs(p, 0.7, 128, 4, 5)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))


def test_forced_clusters_query_covers_all_points(spark):
    got = jobs.forced_clusters(spark, "/root/testdata/sf0.001").collect()
    assert all(g.max_column - g.min_column + 1 <= 48 and g.forced == (g.max_column - g.min_column + 1 == 48) for g in got)


def test_small_helpers(spark):
    box = Ground(ego_box=((-1.0, 3.0), (-2.0, 2.0), (0.0, 1.5)))
    assert ground.ego_marker(box) == {"center": (1.0, 0.0, 0.75), "size": (4.0, 4.0, 1.5)}
    wide = spark.createDataFrame([(0, 1, 5), (0, 1, 9)], "k int, row_index int, c long")
    assert [tuple(r) for r in evaluate.row_statistics(wide, ["k"], "row_index", "c", 10).collect()] == [(0, 1, 2, 2, 9)]
    with pytest.raises(Exception, match="column 9"):
        evaluate.row_statistics(wide, ["k"], "row_index", "c", 9).collect()
    rows, stamp = sinks.columns_between(spark.createDataFrame([(1, 0), (2, 7), (3, 5), (4, 1)], "col long, stamp_ns long"), 1, 3)
    assert rows.agg(stamp.alias("s")).first()["s"] == 5 and rows.count() == 3
    summary = spark.createDataFrame([(None, 2, 0.5, None), (3, 2, 0.25, 0.125)], "sequence int, num_frames long, recall_mean double, recall_std double")
    assert evaluate.markdown(summary, "sequence", ["recall"]) == "| sequence | recall |\n|---|---|\n| all | 0.50 / - |\n| 3 | 0.25 / 0.12 |\n"


def test_raw_stamps(spark):
    path = tempfile.mkdtemp(prefix="stamps-")
    open(f"{path}/timestamps.txt", "w").write("2011-09-26 13:02:25.964389445\n2011-09-26 13:02:26.000000001\n")
    assert [(r.frame, r.stamp_ns) for r in kitti.raw_stamps(spark, f"{path}/timestamps.txt").orderBy("frame").collect()] == [(0, 1317042145964389445), (1, 1317042146000000001)]


def test_sequences_and_names(spark):
    names = {r.semantic_label: r.name for r in kitti.semantic_names(spark).collect()}
    assert len(names) == 34 and names[40] == "road" and names[259] == "moving-other-vehicle"
    rows = spark.createDataFrame([("2011_09_30_drive_0028_sync", f) for f in (1099, 1100, 5170, 5171)] + [("none", 5)], "drive string, frame int")
    got = kitti.in_sequences(rows, kitti.sequences(spark), bucket=7)
    assert sorted((r.drive_frame, r.sequence, r.frame) for r in got.collect()) == [(1100, 8, 0), (5170, 8, 4070)]
