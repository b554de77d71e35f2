"""Operators against rules worked out by hand and plain Python."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from sweepflow.config import Config, Ground
from sweepflow.functions import geometry as g
from sweepflow.functions import labels
from sweepflow.operators import components, evaluate, ground, motion, poses, range_image, scans

NAN = float("nan")


def column(*points):
    """A column from the top: (r, z) of each row."""
    r, z = (np.array([[p[k] for p in points]], float) for k in (0, 1))
    return r, z, np.zeros(r.shape, bool)


def scan(*points, **changes):
    label, rule = ground.scan_columns(*column(*points), replace(Ground(robot_height=1.5), **changes))
    return [ground.RULES[x] for x in rule[0]], list(label[0])


def test_first_point_is_ground_within_limits():
    assert scan((5, -1.5))[0] == ["first_ground"]
    assert scan((5, -1.0))[0] == ["first_obstacle"]


def test_flat_and_steep():
    rules, label = scan((8, 0.5), (7.5, -1.4), (6, -1.45), (5, -1.5))
    assert rules == ["steep", "flat", "flat", "first_ground"]
    assert label == [labels.OBSTACLE, labels.GROUND, labels.GROUND, labels.GROUND]


def test_missing_and_skipped_cells_keep_no_label():
    rules, label = scan((NAN, NAN), (5, -1.5))
    assert rules == ["none", "first_ground"] and label[0] == labels.UNKNOWN


def test_flat_again_needs_flat_to_the_last_ground_too():
    rules, _ = scan((12, -1.4), (11, -1.3), (6.5, 0.5), (5, -1.5))
    assert rules[2] == "steep" and rules[0] in ("flat_again", "steep")


def test_near_ground_behind_an_obstacle_is_demoted_by_the_next_obstacle():
    rules, label = scan((5.1, 1.5), (5.2, -1.2), (5, 1.0), (5, -1.5))
    assert rules[1] == "demoted" and label[1] == labels.OBSTACLE


def test_running_values_equal_plain_ones(spark):
    r = random.Random(3)
    data = [(r.randint(0, 2), i, r.choice([None, r.randint(0, 99)])) for i in range(500)]
    df = spark.createDataFrame(data, "k int, i long, v long")
    block = F.floor(F.col("i") / 37)
    for kind in ("max", "sum", "last"):
        for own in (True, False):
            got = {(x.k, x.i): x.out for x in scans.running(df, ["k"], ["i"], F.col("v"), kind, "out", block, own).collect()}
            for k, i, _ in data:
                past = [v for k2, i2, v in data if k2 == k and v is not None and (i2 < i or own and i2 == i)]
                want = (max(past) if kind == "max" else past[-1]) if past and kind != "sum" else sum(past) if kind == "sum" else None
                assert got[k, i] == want, (kind, own, k, i)


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pose_inverse_and_compose(spark):
    m = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 2, 1, 0, 0, -3, 0, 0, 1, 0.5)])
    row = spark.range(1).select(g.compose(m, g.inverse(m)).alias("unit"), g.transform(m, g.vec(1, 2, 3)).alias("p")).first()
    assert np.allclose(row.unit, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])
    assert (row.p.x, row.p.y, row.p.z) == (0.0, -2.0, 3.5)


def test_slerp_half_way(spark):
    a, b = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), F.array(*map(F.lit, (2**-0.5, 0.0, 0.0, 2**-0.5)))
    q = spark.range(1).select(poses.slerp(a, b, F.lit(0.5)).alias("q")).first().q
    assert np.allclose(q, [np.cos(np.pi / 8), 0, 0, np.sin(np.pi / 8)])


def test_nan_is_no_return(spark):
    df = spark.createDataFrame([(NAN,), (None,), (1.0,)], "x double")
    assert [r.m for r in df.select(g.is_missing(F.col("x")).alias("m")).collect()] == [True, True, False]
    assert [r.m for r in df.select(g.null_if_nan(F.col("x")).alias("m")).collect()] == [None, None, 1.0]


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(10, 4070, 120000), (1, 2, -1)], "s int, f int, i int").withColumn("p", g.pack_id(F.col("s"), F.col("f"), F.col("i")))
    s, f, i = g.unpack_id(F.col("p"))
    assert [tuple(r) for r in df.select(s, f, i).collect()] == [(10, 4070, 120000), (None, None, None)]


def test_placement_moves_a_taken_cell_on(spark):
    df = spark.createDataFrame([(0, 0, 0, 5.0, 3), (1, 0, 0, 4.0, 3), (2, 0, 0, 1.0, 3), (3, 0, 0, 9.0, 5)], "pid long, stream_id long, row_index int, d double, c long")
    got = {r.cell_column: r.pid for r in range_image.place_in_order(df, ["stream_id"], "row_index", "c", "pid", "d", 512).collect()}
    assert got == {3: 2, 4: 1, 5: 3}


def test_placement_moves_points_over_block_borders(spark):
    rows = [(0, 0, 0, 5.0, 511), (1, 0, 0, 4.0, 511), (2, 0, 0, 1.0, 512), (3, 0, 0, 9.0, 512), (4, 0, 0, 2.0, 1023), (5, 0, 0, 3.0, 1023), (6, 0, 0, 7.0, 1030)]
    df = spark.createDataFrame(rows, "pid long, stream_id long, row_index int, d double, c long")
    got = {r.cell_column: r.pid for r in range_image.place_in_order(df, ["stream_id"], "row_index", "c", "pid", "d", 512).collect()}
    assert got == {511: 0, 512: 1, 513: 2, 1023: 4, 1024: 5, 1030: 6}


def test_entropies_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (0, 2), (0, 3)], "truth long, detection long").withColumn("f", F.lit(0))
    over = evaluate.over_segmentation(df, ["f"], "truth", "detection").first()
    under = evaluate.under_segmentation(df, ["f"], "truth", "detection").first()
    assert np.isclose(over.over_segmentation_entropy, np.log(2)) and np.isclose(under.under_segmentation_entropy, np.log(2))


def test_metrics_without_denominator_are_null(spark):
    row = spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, c long, d long").select(*[v.alias(k) for k, v in evaluate.metrics(*map(F.col, "abcd")).items()]).first()
    assert list(row) == [None] * 4


def test_ignore_flags(spark):
    df = spark.createDataFrame([(0, 0, None, 119), (2, 0, 5.0, 119), (3, 0, 5.0, 119), (2, 2, 5.0, 64), (2, 4, 0.1, 119), (2, 6, 500.0, 119)], "col long, row_index int, dist double, ground_label int").withColumn("gap", F.lit(0.02))
    got = [r.is_ignored for r in ground.ignore_flags(df, Config.library_defaults().clustering, [], 16).collect()]
    assert got == [True, False, True, True, True, True]


def test_default_layers_differ():
    assert Config.library_defaults().ground.first_ring_max_dz == 0.4 and Config.node_defaults().ground.first_ring_max_dz == 0.5
    assert Config.kitti().image.num_columns == 2200 and Config.kitti().clustering.max_distance == 0.5


def test_poses_relative_to_the_first(spark):
    df = spark.createDataFrame([(0, t, [float(v) for v in m]) for t, m in ((1, (1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7)), (2, (0, -1, 0, 6, 1, 0, 0, 6, 0, 0, 1, 7)))], "s int, t int, m array<double>")
    got = {r.t: r.m for r in motion.relative_to_first(df, ["s"], "t").collect()}
    assert np.allclose(got[1], [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]) and np.allclose(got[2], [0, -1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0])


def test_pose_of_a_gps_row(spark):
    zero = F.lit(0.0)
    m = spark.range(1).select(motion.mercator_pose(zero, F.lit(1.0), F.lit(3.0), zero, zero, F.lit(np.pi / 2), F.lit(1.0)).alias("m")).first().m
    assert np.allclose(m[:3], [0, -1, 0], atol=1e-12) and np.isclose(m[3], motion.EARTH_RADIUS * np.pi / 180) and np.isclose(m[11], 3)


def plain_rotations(firings, n):
    """One firing after the other, as lists of columns; the largest rearmost column is carried on."""
    rear, out = -1, []
    for columns in firings:
        placed = []
        for c in columns:
            turn, way = max(rear, 0) // n, c - max(rear, 0) % n
            placed.append((turn + (way < -n / 2) - (rear > 0 and way > n / 2)) * n + c)
        out.append((placed, rear))
        rear = max(rear, min(placed))
    return out


def test_rotations_across_the_seam_equal_a_plain_loop(spark):
    """A firing at 99 and 0 of 100 columns after one at 97 and 98 stays at 99 and 100; small steps back are kept."""
    r, columns, at = random.Random(2), [[97, 98], [99, 0]], 102
    for _ in range(300):
        at += r.choice([-2, 0, 1, 5, 30])
        columns.append([(at - r.randint(0, 8)) % 100 for _ in range(4)])
    rows = [(0, f, i, c) for f, cs in enumerate(columns) for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "s int, f long, i int, c int")
    got = {(x.f, x.i): x for x in range_image.unwrap_points(df, 100, ["s"], "f", "i", "c", F.floor(F.col("f") / 37)).collect()}
    for f, (placed, rear) in enumerate(plain_rotations(columns, 100)):
        for i, g_ in enumerate(placed):
            assert (got[f, i].global_column, got[f, i].late) == (g_, f > 0 and g_ < rear) and not got[f, i].bad_start and not got[f, i].fell_back
    assert [got[1, i].global_column for i in (0, 1)] == [99, 100]
    import pandas as pd

    from sweepflow.streaming import firings

    frame = pd.DataFrame([(0, f * 16 + i, f, i, c) for _, f, i, c in rows], columns=["stream_id", "pid", "firing_index", "row_index", "column_in_rotation"])
    _, out = firings.step(-1, frame, 100)
    assert all(got[x.firing_index, x.row_index].global_column == x.global_column and got[x.firing_index, x.row_index].late == x.late for x in out.itertuples())


def test_a_first_firing_across_the_seam_is_a_bad_start(spark):
    df = spark.createDataFrame([(0, 0, 0, 99), (0, 0, 1, 1), (0, 1, 0, 2), (0, 1, 1, None)], "s int, f long, i int, c int")
    got = range_image.unwrap_points(df, 100, ["s"], "f", "i", "c", F.col("f")).collect()
    assert len(got) == 3 and {(x.f, x.bad_start) for x in got} == {(0, True), (1, False)}


def test_frame_images_equal_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(f, k, r.choice([None, *range(12)]), i) for i in range(500) for f, k in [(r.randint(0, 2), r.randint(0, 3))]]
    df = spark.createDataFrame(rows, "f int, k int, c long, i long")
    want = {}
    for f, k, c, i in rows:
        if c is not None:
            free = [x for x in (c, c + 1, c - 1) if 0 <= x < 12 and (f, k, x) not in want]
            at = free[0] if free else c
            want[f, k, at] = (i, at != c)
    assert {(x.f, x.k, x.c): (x.i, x.moved) for x in range_image.organize_frame(df, ["f"], "k", "c", "i", 12).collect()} == want


def test_terrain_bounds_flat_steps():
    far, near = ((11, -1.4), (5, -1.5)), ((9, -1.4), (5, -1.5))
    assert scan(*far)[0][0] == "flat" and scan(*far, use_terrain=True)[0][0] == "steep" and scan(*near, use_terrain=True)[0][0] == "flat"


def test_points_without_distance_take_no_cell(spark):
    df = spark.createDataFrame([(0, 0, 0, NAN, 3), (1, 0, 0, None, 3), (2, 0, 0, 4.0, 3)], "pid long, stream_id long, row_index int, d double, c long")
    assert [(r.cell_column, r.pid) for r in range_image.place_in_order(df, ["stream_id"], "row_index", "c", "pid", "d", 512).collect()] == [(3, 2)]
