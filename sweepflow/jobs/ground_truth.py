"""Ground-truth clusters: points of the same object that are near each other, frame by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import labels
from ..operators.components import connected_components
from ..operators.neighbors import grid_pairs


def euclidean_clusters(points: DataFrame, tolerance: float = 1.0, least: int = 10, most: int = 300_000) -> DataFrame:
    """Adds cluster_label, numbered within each frame by the first point; 0 for ground, unlabelled points and clusters of no allowed size.

    Expects sequence, frame, point_idx, x, y, z, semantic_label, instance_label.
    Ground clusters keep their number without showing it. Frames and objects are
    keys of the join, so nothing but neighbours within an object meets.
    """
    keys = ["sequence", "frame", "semantic_label", "instance_label"]
    whole = F.struct("sequence", "frame", "point_idx")
    rows = points.withColumn("id", whole)
    pairs = grid_pairs(rows.where("x is not null"), F.array(*[F.col(c).cast("double") for c in "xyz"]), 3, tolerance, keys, "id")
    component = connected_components(pairs).withColumnRenamed("node", "id")
    rows = rows.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = rows.where("x is not null").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.first("semantic_label").alias("kind")).where(F.col("n").between(least, most))
    number = F.row_number().over(W.partitionBy("component.sequence", "component.frame").orderBy("component.point_idx"))
    numbered = sizes.withColumn("number", number).select("component", "number", "kind")
    hidden = F.col("kind").isin(labels.UNLABELED, *sorted(labels.GROUND_CLASSES.values()))
    return rows.join(numbered, "component", "left").withColumn("cluster_label", F.when(F.col("number").isNull() | hidden, 0).otherwise(F.col("number"))).drop("id", "component", "number", "kind")
