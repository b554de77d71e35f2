"""Ground segmentation of range image columns, and the flags that keep cells out of clustering.

The rules follow a column from its lowest laser up. Columns do not touch each
other, so groups of whole columns are one task each: a matrix of columns by
rows, over whose rows a loop runs with masks. A group has a fixed number of
columns, whatever the length of the stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Clustering, Ground
from ..functions import labels

#: Names of the rules that gave a label, by code.
RULES = ["none", "fog", "ego", "first_ground", "first_obstacle", "flat", "flat_again", "near_ground", "steep", "demoted"]
NONE, FOG, EGO, FIRST_GROUND, FIRST_OBSTACLE, FLAT, FLAT_AGAIN, NEAR_GROUND, STEEP, DEMOTED = range(len(RULES))


def is_fog(intensity: Column, distance: Column, inclination: Column, p: Ground) -> Column:
    if not p.fog_enabled:
        return F.lit(False)
    return F.coalesce((intensity < p.fog_intensity_below) & (distance < p.fog_distance_below) & (inclination > p.fog_inclination_above), F.lit(False))


def is_ego(x: Column, y: Column, z: Column, p: Ground) -> Column:
    """Strictly inside the robot's box."""
    inside = [(c > low) & (c < high) for c, (low, high) in zip((x, y, z), p.ego_box)]
    return F.coalesce(inside[0] & inside[1] & inside[2], F.lit(False))


def ego_marker(p: Ground) -> dict[str, tuple[float, float, float]]:
    """Centre and size of the robot's box, as a viewer draws it."""
    return {"center": tuple((low + high) / 2 for low, high in p.ego_box), "size": tuple(high - low for low, high in p.ego_box)}


def scan_columns(r: np.ndarray, z: np.ndarray, skip: np.ndarray, p: Ground) -> tuple[np.ndarray, np.ndarray]:
    """Labels and rules of columns by rows, rows from the top; r is the distance from the sensor's axis, NaN where there is no return."""
    n, rows = r.shape
    label, rule = np.full((n, rows), labels.UNKNOWN), np.full((n, rows), NONE)
    ground_r, ground_z = np.zeros(n), np.full(n, -p.robot_height)
    last_r, last_z, last_rule = np.zeros(n), np.full(n, -p.robot_height), np.full(n, NONE)
    started, obstacle = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(rows - 1, -1, -1):
        here = ~np.isnan(r[:, i]) & ~skip[:, i]
        x, h = np.where(here, r[:, i], 0.0), np.where(here, z[:, i], 0.0)
        dr, dz, gr, gz = x - last_r, h - last_z, x - ground_r, h - ground_z
        with np.errstate(divide="ignore", invalid="ignore"):
            slope, ground_slope = dz / dr, gz / gr
        flat = (np.abs(slope) < p.max_slope) & (dr > 0)
        if p.use_terrain:
            flat &= dr < p.terrain_max_dr
        flat_ground = (np.abs(ground_slope) < p.max_slope) & (gr > 0)
        first = here & ~started
        ring = (gz > p.first_ring_min_dz) & (gz < p.first_ring_max_dz)
        new = np.full(n, STEEP)
        if not p.use_terrain:
            new[(np.abs(gr) < p.near_ground_max_dr) & (np.abs(gz) < p.near_ground_max_dz)] = NEAR_GROUND
            new[obstacle & flat & flat_ground] = FLAT_AGAIN
        new[~obstacle & flat] = FLAT
        new[first & ring], new[first & ~ring] = FIRST_GROUND, FIRST_OBSTACLE
        is_ground = np.isin(new, (FIRST_GROUND, FLAT, FLAT_AGAIN, NEAR_GROUND))
        label[:, i] = np.where(here, np.where(is_ground, labels.GROUND, labels.OBSTACLE), label[:, i])
        rule[:, i] = np.where(here, new, rule[:, i])
        # An obstacle takes with it the uncertain ground right below.
        falling = here & ~is_ground
        for j in range(i + 1, rows):
            if not falling.any():
                break
            close = np.abs(r[:, j] - x) < p.demote_max_dr
            falling &= (label[:, j] == labels.GROUND) & ((rule[:, j] == NEAR_GROUND) | close)
            label[falling, j], rule[falling, j] = labels.OBSTACLE, DEMOTED
        obstacle |= here & ~is_ground
        certain = here & np.isin(new, (FLAT, FLAT_AGAIN)) & (slope > p.ground_slope_over) & (np.abs(dr) < p.ground_distance_under) & (last_rule != NEAR_GROUND)
        certain |= here & (new == FIRST_GROUND)
        ground_r, ground_z = np.where(certain, x, ground_r), np.where(certain, h, ground_z)
        last_r, last_z, last_rule = np.where(here, x, last_r), np.where(here, h, last_z), np.where(here, new, last_rule)
        started |= here
    return label, rule


def segment_ground(cells: DataFrame, rows: int, p: Ground, keys: list[str], columns_per_task: int = 512) -> DataFrame:
    """Adds ground_label and ground_rule to cells (keys, col, row_index, x, y, z; `skip` marks fog and the robot itself)."""
    grouped = cells.select(*keys, "col", F.col("row_index").cast("int").alias("row_index"), "x", "y", "z", "skip_rule").withColumn("part", F.floor(F.col("col") / columns_per_task))
    schema = "".join(f"{k} {dict(cells.dtypes)[k]}, " for k in keys) + "col long, row_index int, ground_label int, ground_rule int"

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        columns, at = np.unique(frame["col"].to_numpy(), return_inverse=True)
        row = frame["row_index"].to_numpy()
        r, z, skip = (np.full((len(columns), rows), fill) for fill in (np.nan, np.nan, 0))
        r[at, row] = np.hypot(frame["x"].to_numpy(float), frame["y"].to_numpy(float))
        z[at, row] = frame["z"].to_numpy(float)
        skip[at, row] = frame["skip_rule"].to_numpy()
        label, rule = scan_columns(r, z, skip > 0, p)
        label = np.where(skip == FOG, labels.FOG, np.where(skip == EGO, labels.EGO, label))
        rule = np.where(skip > 0, skip, rule)
        out = frame[[*keys, "col", "row_index"]].copy()
        out["ground_label"], out["ground_rule"] = label[at, row], rule[at, row]
        return out

    return grouped.groupBy(*keys, "part").applyInPandas(scan, schema)


def ignore_flags(cells: DataFrame, p: Clustering, keys: list[str], rows: int) -> DataFrame:
    """Adds is_ignored to cells with dist, ground_label, gap (angle to the laser below, null for the lowest), col and row_index."""
    ignored = F.col("dist").isNull() | (F.col("ground_label") != labels.OBSTACLE) | (F.col("dist") < p.max_distance)
    if p.ignore_big_inclination_gap:
        ignored |= (F.col("row_index") < rows - 1) & (F.atan2(F.lit(p.max_distance), F.col("dist")) < F.col("gap"))
    if p.ignore_chessboard:
        ignored |= F.col("col") % 2 != F.col("row_index") % 2
    return cells.withColumn("is_ignored", F.coalesce(ignored, F.lit(True)))


def supplement_inclinations(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Inclinations of empty cells: that of the nearest known cell below plus the gaps between. Expects inc (null if empty) and gap."""
    up = W.partitionBy(*keys, "col").orderBy(F.desc("row_index")).rowsBetween(W.unboundedPreceding, W.currentRow)
    climbed = cells.withColumn("__climb", F.sum(F.coalesce("gap", F.lit(0.0))).over(up))
    base = F.last(F.when(F.col("inc").isNotNull(), F.col("inc") - F.col("__climb")), ignorenulls=True).over(up)
    return climbed.withColumn("inc", F.coalesce("inc", base + F.col("__climb"))).drop("__climb")
