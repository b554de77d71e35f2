"""Scores of ground labels and clusters against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.geometry import unpack_id


def confusion(points: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fn, fp, tn for each group."""
    count = lambda c: F.count_if(c)
    return points.groupBy(*keys).agg(count(truth & predicted).alias("tp"), count(truth & ~predicted).alias("fn"), count(~truth & predicted).alias("fp"), count(~truth & ~predicted).alias("tn"))


def ground_confusion(points: DataFrame, keys: list[str], semantic: str, is_ground: Column) -> DataFrame:
    """Unlabelled points are left out."""
    truth = F.col(semantic).isin(*sorted(labels.GROUND_CLASSES.values()))
    return confusion(points.where(F.col(semantic) != labels.UNLABELED), keys, truth, is_ground)


def detections_on_truth(truth: DataFrame, detections: DataFrame, keys: list[str]) -> DataFrame:
    """Truth points with is_ground and detection_label of the detection that has their packed id, and `found`; points without one are no ground and have label 0.

    Expects packed_id, is_ground and detection_label in detections; detections
    without an id are left out. Of several with one id the largest label counts.
    """
    s, f, i = unpack_id(F.col("packed_id"))
    named = detections.where(F.col("packed_id").isNotNull()).select(*[c.alias(k) for c, k in zip((s, f, i), keys)], "is_ground", "detection_label")
    one = named.groupBy(*keys).agg(F.max(F.struct("detection_label", "is_ground")).alias("best"))
    joined = truth.join(one, keys, "left")
    return joined.withColumns({"found": F.col("best").isNotNull(), "is_ground": F.coalesce("best.is_ground", F.lit(False)), "detection_label": F.coalesce("best.detection_label", F.lit(0))}).drop("best")


def row_statistics(points: DataFrame, keys: list[str], row: str, column: str, width: int) -> DataFrame:
    """n_points, n_columns and max_column of each row of an image; a column beyond the width stops the job."""
    wide = F.raise_error(F.format_string("column %s in an image of %s", F.max(column).cast("string"), F.lit(str(width))))
    most = F.when(F.coalesce(F.max(column) < width, F.lit(True)), F.max(column)).otherwise(wide)
    return points.groupBy(*keys, row).agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct(column).alias("n_columns"), most.alias("max_column"))


def metrics(tp: Column, fn: Column, fp: Column, tn: Column) -> dict[str, Column]:
    """Null where a score has no denominator."""
    recall, precision = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp)
    return {"recall": recall, "precision": precision, "f1": F.try_divide(2 * recall * precision, recall + precision), "accuracy": F.try_divide(tp + tn, tp + fn + fp + tn)}


def split_entropy(points: DataFrame, keys: list[str], of: str, over: str, out: str, skip_without: bool) -> DataFrame:
    """Sum over the groups `of` (0 is no group) of the entropy of their points' labels `over`, 0 among them.

    With skip_without, groups whose points all have label 0 count nothing. The
    points are counted by both labels first, so that no group is gathered.
    """
    pairs = points.where(F.col(of) != 0).groupBy(*keys, of, over).agg(F.count(F.lit(1)).alias("n"))
    # Sum of -n/N ln(n/N) = ln N - (sum of n ln n) / N.
    groups = pairs.groupBy(*keys, of).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("n_ln_n"), F.max((F.col(over) != 0).cast("int")).alias("has_label"))
    entropy = F.ln("total") - F.col("n_ln_n") / F.col("total")
    if skip_without:
        entropy = F.when(F.col("has_label") == 1, entropy).otherwise(0.0)
    return groups.groupBy(*keys).agg(F.sum(entropy).alias(out))


def over_segmentation(points: DataFrame, keys: list[str], truth: str, detection: str) -> DataFrame:
    return split_entropy(points, keys, truth, detection, "over_segmentation_entropy", False)


def under_segmentation(points: DataFrame, keys: list[str], truth: str, detection: str) -> DataFrame:
    return split_entropy(points, keys, detection, truth, "under_segmentation_entropy", True)


def summarize(frames: DataFrame, sequence: str, values: list[str]) -> DataFrame:
    """Mean and population deviation over the frames of each sequence, and over all frames (sequence null)."""
    return frames.rollup(sequence).agg(F.count(F.lit(1)).alias("num_frames"), *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def markdown(summary: DataFrame, sequence: str, values: list[str]) -> str:
    """The table of a summary, which has a row for each sequence."""
    lines = [f"| {sequence} | " + " | ".join(values) + " |", "|" + "---|" * (len(values) + 1)]
    shown = lambda x: "-" if x is None else f"{x:.2f}"
    for r in summary.orderBy(F.col(sequence).asc_nulls_first()).collect():
        lines.append(f"| {'all' if r[sequence] is None else r[sequence]} | " + " | ".join(f"{shown(r[f'{v}_mean'])} / {shown(r[f'{v}_std'])}" for v in values) + " |")
    return "\n".join(lines) + "\n"
