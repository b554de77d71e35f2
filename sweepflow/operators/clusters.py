"""Clusters from links, and what is known of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Clustering
from ..functions.geometry import TWO_PI
from .components import connected_components
from .scans import running


def label_points(points: DataFrame, links: DataFrame, keep: list[str]) -> DataFrame:
    """Adds cluster_id, the smallest pid of the point's component; a point without links is a cluster of its own."""
    found = connected_components(links).withColumnRenamed("node", "pid")
    return points.select(*keep).join(found, "pid", "left").withColumn("cluster_id", F.coalesce("component", "pid")).drop("component")


def cluster_sizes(labelled: DataFrame, p: Clustering) -> DataFrame:
    """Size of each cluster and the gates it passes."""
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("num_points"))
    return sizes.withColumns({"has_id": F.col("num_points") > p.min_points_id, "published": F.col("num_points") > p.min_points_published})


def cluster_statistics(labelled: DataFrame, p: Clustering, num_columns: int) -> DataFrame:
    """Points, columns, stamps and the angle at which a cluster is closed: no later point can be nearer than max_distance to it.

    Expects cluster_id, col, dist, stamp_ns. A cluster as long as a whole
    rotation is closed by force.
    """
    reach = F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(p.max_distance), F.col("dist"))))
    found = labelled.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("num_points"),
        F.min("col").alias("min_column"),
        F.max("col").alias("max_column"),
        F.min("stamp_ns").alias("min_stamp"),
        F.max("stamp_ns").alias("max_stamp"),
        F.max(F.col("col") * F.lit(TWO_PI / num_columns) + reach).alias("finish_azimuth"),
    )
    stamp = F.col("max_stamp") if p.last_point_stamps else F.col("min_stamp") + F.shiftright(F.col("max_stamp") - F.col("min_stamp"), 1)
    return found.withColumns({"stamp_ns": stamp, "forced": F.col("max_column") - F.col("min_column") + 1 >= num_columns}).drop("min_stamp", "max_stamp")


def published(labelled: DataFrame, p: Clustering) -> DataFrame:
    """Points of published clusters."""
    wanted = cluster_sizes(labelled, p).where("published").select("cluster_id")
    return labelled.join(wanted, "cluster_id", "left_semi")


def column_azimuths(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest continuous azimuth of each column: the watermark by which clusters are closed."""
    return cells.groupBy(*keys, "col").agg(F.min("continuous_azimuth").alias("min_azimuth"))


def closing_columns(found: DataFrame, columns: DataFrame, keys: list[str], num_columns: int, look: int = 3, block_columns: int = 1024, every: int = 1) -> DataFrame:
    """Adds closing_column, the first column whose smallest azimuth is not below a cluster's finish_azimuth; null while it is open.

    A point lies in the column of its azimuth or in the one after it. So that
    column is among the few from the one on in which the angle lies, which an
    equi-join finds, or else, where these are absent or too early, the next one
    that there is, which a scan in blocks from the far end finds. With `every`,
    clusters are closed only in columns that it divides.
    """
    columns = columns if every == 1 else columns.where(F.col("col") % every == 0)
    at = F.floor(F.col("finish_azimuth") / F.lit(TWO_PI / num_columns)).cast("long")
    asked = found.select(*keys, "cluster_id", "finish_azimuth", F.explode(F.array(*[at + k for k in range(-1, look)])).alias("col"))
    closed = asked.join(columns, [*keys, "col"]).where(F.col("min_azimuth") >= F.col("finish_azimuth")).groupBy(*keys, "cluster_id").agg(F.min("col").alias("closing_column"))
    near = found.join(closed, [*keys, "cluster_id"], "left")
    beyond = near.where("closing_column IS NULL").select(*keys, "cluster_id", (at + look).alias("col"), F.lit(1).alias("__kind"))
    there = columns.select(*keys, "col", F.lit(0).alias("__kind")).withColumn("cluster_id", F.lit(None).cast(dict(found.dtypes)["cluster_id"]))
    both = there.unionByName(beyond).withColumns({"__back": -F.col("col"), "__value": F.when(F.col("__kind") == 0, F.col("col")), "__tie": F.coalesce(F.col("cluster_id"), F.lit(-1))})
    after = running(both, keys, ["__back", "__kind", "__tie"], F.col("__value"), "last", "__after", F.floor(-F.col("col") / block_columns)).where("__kind = 1")
    return near.join(after.select(*keys, "cluster_id", "__after"), [*keys, "cluster_id"], "left").withColumn("closing_column", F.coalesce("closing_column", "__after")).drop("__after")


def number_closed(closed: DataFrame, keys: list[str], p: Clustering, block: Column) -> DataFrame:
    """Adds id, counted from 1 in the order of closing for clusters with enough points; 0 for smaller ones. Expects closing_column; open clusters are left out."""
    done = closed.where(F.col("closing_column").isNotNull()).withColumn("__counts", (F.col("num_points") > p.min_points_id).cast("long"))
    counted = running(done, keys, ["closing_column", "cluster_id"], F.col("__counts"), "sum", "id", block)
    return counted.withColumn("id", F.when(F.col("__counts") == 1, F.col("id")).otherwise(0)).drop("__counts")


def released_columns(closed: DataFrame, columns: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """Adds first_unpublished to each column: the oldest column that a cluster still open there needs, else the next one. It never decreases.

    Open ones are those that close in a later column or not at all. Expects
    closed with min_column and closing_column, columns with col; block is one of
    `col`.
    """
    last = F.lit((1 << 62))
    needs = closed.select(*keys, F.coalesce("closing_column", last).alias("col"), F.col("min_column").alias("__need")).groupBy(*keys, "col").agg(F.min("__need").alias("__need"))
    # Those that never close are needed by all columns from their own on: one minimum for each key.
    never = needs.where(F.col("col") == last).select(*keys, F.col("__need").alias("__never"))
    rows = columns.select(*keys, "col").join(needs.where(F.col("col") < last), [*keys, "col"], "left").withColumns({"__back": -F.col("col"), "__block": -block})
    later = running(rows.withColumnRenamed("__block", "__from"), keys, ["__back"], -F.col("__need"), "max", "__later", F.col("__from"), own=False)
    joined = later.join(F.broadcast(never), keys, "left") if keys else later.crossJoin(F.broadcast(never.agg(F.min("__never").alias("__never"))))
    return joined.select(*keys, "col", F.least(F.col("col") + 1, -F.col("__later"), F.col("__never")).alias("first_unpublished"))
