"""Ground labels of a whole table against a loop over one cell after the other."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest

from sweepflow.functions import labels
from sweepflow.jobs import queries as jobs
from sweepflow.operators import ground

SF = "/root/testdata/sf0.001"
FLATS = (ground.FIRST_GROUND, ground.FLAT, ground.FLAT_AGAIN, ground.NEAR_GROUND)


def plain_column(cells, p):
    """cells: (row, r, z, skip_rule) of a column. Returns label and rule by row, from the lowest laser up."""
    out = {}
    last = certain_ground = (0.0, -p.robot_height)
    last_rule, started, obstacle = ground.NONE, False, False
    distance = {row: r for row, r, _, _ in cells}
    for row, r, z, skip in sorted(cells, reverse=True):
        if skip:
            out[row] = (labels.FOG if skip == ground.FOG else labels.EGO, skip)
            continue
        dr, dz, gr, gz = r - last[0], z - last[1], r - certain_ground[0], z - certain_ground[1]
        slope = dz / dr if dr else math.copysign(math.inf, dz) if dz else math.nan
        ground_slope = gz / gr if gr else math.copysign(math.inf, gz) if gz else math.nan
        flat = abs(slope) < p.max_slope and dr > 0 and (not p.use_terrain or dr < p.terrain_max_dr)
        if not started:
            rule = ground.FIRST_GROUND if p.first_ring_min_dz < gz < p.first_ring_max_dz else ground.FIRST_OBSTACLE
        elif not obstacle and flat:
            rule = ground.FLAT
        elif not p.use_terrain and obstacle and flat and abs(ground_slope) < p.max_slope and gr > 0:
            rule = ground.FLAT_AGAIN
        elif not p.use_terrain and abs(gr) < p.near_ground_max_dr and abs(gz) < p.near_ground_max_dz:
            rule = ground.NEAR_GROUND
        else:
            rule = ground.STEEP
        is_ground = rule in FLATS
        out[row] = (labels.GROUND if is_ground else labels.OBSTACLE, rule)
        if not is_ground:
            # It takes with it the uncertain ground right below, up to the first cell that is none.
            below = row + 1
            while out.get(below, (None, None))[0] == labels.GROUND and (out[below][1] == ground.NEAR_GROUND or abs(distance[below] - r) < p.demote_max_dr):
                out[below] = (labels.OBSTACLE, ground.DEMOTED)
                below += 1
            obstacle = True
        sure = rule in (ground.FLAT, ground.FLAT_AGAIN) and slope > p.ground_slope_over and abs(dr) < p.ground_distance_under and last_rule != ground.NEAR_GROUND
        if sure or rule == ground.FIRST_GROUND:
            certain_ground = (r, z)
        last, last_rule, started = (r, z), rule, True
    return out


@pytest.mark.parametrize("terrain", [False, True])
def test_ground_of_a_table_equals_plain_loop(spark, terrain):
    p = replace(jobs.GROUND, robot_height=1.7, use_terrain=terrain, demote_max_dr=1.2, max_slope=0.6)
    table = jobs.points(spark, SF)
    skip = jobs.F.when(ground.is_fog(jobs.F.col("intensity"), jobs.F.col("dist"), jobs.F.col("inc"), p), ground.FOG).when(ground.is_ego(jobs.F.col("x"), jobs.F.col("y"), jobs.F.col("z"), p), ground.EGO).otherwise(0)
    # Heights that make slopes of all kinds, and cells without a return.
    cells = table.where("event_type <> 'error'").withColumns({"skip_rule": skip, "sensor": jobs.F.lit(0).cast("long"), "z": (jobs.F.col("pid") % 7) * 0.35 - 1.7 + (15 - jobs.F.col("row_index")) * 0.1})
    columns = {}
    for c in cells.collect():
        columns.setdefault(c.col, []).append((c.row_index, math.hypot(c.x, c.y), c.z, c.skip_rule))
    want = {(col, row): x for col, own in columns.items() for row, x in plain_column(own, p).items()}
    got = {(r.col, r.row_index): (r.ground_label, r.ground_rule) for r in ground.segment_ground(cells, jobs.ROWS, p, ["sensor"], columns_per_task=16).collect()}
    assert got == want and len({x[1] for x in want.values()}) >= (5 if terrain else 7)


def test_registered_scan_equals_plain_loop(spark):
    p = replace(jobs.GROUND, robot_height=1.7)
    want = {}
    columns = {}
    for c in jobs.points(spark, SF).collect():
        fog = c.intensity < p.fog_intensity_below and c.dist < p.fog_distance_below and c.inc > p.fog_inclination_above
        ego = all(low < v < high for v, (low, high) in zip((c.x, c.y, c.z), p.ego_box))
        columns.setdefault(c.col, []).append((c.row_index, math.hypot(c.x, c.y), c.z, ground.FOG if fog else ground.EGO if ego else 0))
    for col, own in columns.items():
        want |= {(col, row): x for row, x in plain_column(own, p).items()}
    assert {(r.col, r.row_index): (r.ground_label, r.ground_rule) for r in jobs.ground_scan(spark, SF).collect()} == want
