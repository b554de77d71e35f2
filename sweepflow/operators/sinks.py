"""Columns of each stage's output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = ["stream_id", "pid", "firing_index", "row_index", "stamp_ns", "x", "y", "z"]
IMAGE = [*RAW, "intensity", "dist", "az", "inc", "col", "continuous_azimuth", "global_column"]
GROUND = [*IMAGE, "ground_label", "ground_rule", "height_over_ground", "is_ignored"]
CLUSTER = [*GROUND, "tree_id", "cluster_id", "finish_azimuth"]
STAGE_COLUMNS = {"raw": RAW, "image": IMAGE, "ground": GROUND, "cluster": CLUSTER}


def stage_output(rows: DataFrame, stage: str) -> DataFrame:
    """The stage's columns in order; what a table does not have yet is null."""
    have = set(rows.columns)
    return rows.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in STAGE_COLUMNS[stage]])


def outcome(truth: Column, predicted: Column) -> Column:
    return F.when(truth & predicted, "tp").when(truth, "fn").when(predicted, "fp").otherwise("tn")


def columns_between(rows: DataFrame, first: int, last: int) -> tuple[DataFrame, Column]:
    """Rows of a range of columns, and the stamp of the message that holds them: the smallest that isn't 0."""
    return rows.where(F.col("col").between(first, last)), F.min(F.when(F.col("stamp_ns") != 0, F.col("stamp_ns")))
