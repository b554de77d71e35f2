"""Clusters and columns that come out of a stream of points.

Connected components are kept up from micro-batch to micro-batch. What is stored
between them: the points of columns that are not yet released (those of columns
that are not yet complete among them), the open clusters with their sums, and a
row for each sensor. A micro-batch links the points of the columns that it
completes with each other and with the last few columns before; the components
of these links, in which an open cluster is one node, merge clusters and give
new points to them. Clusters are closed against the smallest azimuths of the
completed columns, numbered in that order, and written once; columns that no
open cluster needs are written with the numbers of their points, and forgotten.

A column is complete when a later firing has left it behind: the largest
rearmost column of a sensor's firings is its watermark. Points that come behind
it are late: they are counted and dropped.

A cluster as long as a whole rotation is closed in the column in which it gets
that long, with the points that it has by then; links to it are ignored from
then on. Only components that would get so long in a micro-batch are followed
column by column, each in a group of its own, which holds no more than the
points of one micro-batch and a node for each open cluster. So open clusters,
and with them the stored points, never reach back more than a rotation.

All tables of micro-batch k are written under its number. The row of sensors is
written last and makes the state count: a micro-batch that is run again, after a
failure at any point, starts from the state before it and writes the same
folders anew. Null azimuths and columns must not occur; an empty micro-batch
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Clustering
from ..operators.clusters import closing_columns, column_azimuths
from ..operators.components import connected_components
from ..operators.neighbors import column_pairs

#: What a point of the stream has.
INPUT = "stream_id long, pid long, firing_index long, col long, row_index int, x double, y double, z double, dist double, continuous_azimuth double, stamp_ns long"
POINTS = f"{INPUT}, label long"
SUMS = "num_points long, min_column long, max_column long, min_stamp long, max_stamp long, finish_azimuth double"
CLUSTERS = f"stream_id long, cluster_id long, {SUMS}, closing_column long, forced boolean, id long"
SENSORS = "stream_id long, watermark long, released long, next_id long, n_late long"


@dataclass
class ClusterStream:
    """Clusters of a stream, stored in a folder that the driver and all executors share.

    `advance` takes a micro-batch and is what foreachBatch calls; with `last` it
    completes all columns. `columns_back` and `rows_apart` bound the search for
    neighbours; `force` closes clusters that are as long as `most_columns`, a
    rotation where it isn't given.
    """

    spark: SparkSession
    path: str
    clustering: Clustering
    num_columns: int
    columns_back: int
    rows_apart: int
    force: bool = True
    most_columns: int | None = None
    keep_states: int = 2

    @property
    def _most(self) -> int:
        return self.most_columns or self.num_columns

    # Folders

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _states(self) -> list[int]:
        """Numbers of the micro-batches whose state is whole."""
        system, folder = self._folder(f"{self.path}/state")
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n) for n in names if system.exists(self._folder(f"{self.path}/state/{n}/sensors/_SUCCESS")[1]))

    def _load(self, batch: int | None, name: str, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if batch is None else self.spark.read.schema(schema).parquet(f"{self.path}/state/{batch}/{name}")

    def _store(self, df: DataFrame, path: str) -> DataFrame:
        full = f"{self.path}/{path}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(full)
        return self.spark.read.schema(df.schema).parquet(full)

    def clusters(self) -> DataFrame:
        """All closed clusters: stream_id, cluster_id (the smallest pid), sums, closing_column, forced, id and stamp_ns."""
        stamp = F.col("max_stamp") if self.clustering.last_point_stamps else F.col("min_stamp") + F.shiftright(F.col("max_stamp") - F.col("min_stamp"), 1)
        return self._output("clusters", CLUSTERS).withColumn("stamp_ns", stamp)

    def columns(self) -> DataFrame:
        """Points of all released columns, in their columns, with the id of their cluster, 0 for none."""
        return self._output("columns", f"{INPUT}, id long")

    def cluster_points(self) -> DataFrame:
        """Points of all published clusters, with the cluster's id."""
        return self._output("points", f"{INPUT}, id long")

    def sensors(self) -> DataFrame:
        states = self._states()
        return self._load(states[-1] if states else None, "sensors", SENSORS)

    def _output(self, name: str, schema: str) -> DataFrame:
        system, folder = self._folder(f"{self.path}/out/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/out/{name}/batch=*") if system.exists(folder) else self.spark.createDataFrame([], schema)

    # A micro-batch

    def advance(self, batch: DataFrame, number: int, last: bool = False) -> None:
        states = self._states()
        if number in states:
            return
        before = max((s for s in states if s < number), default=None)
        held, known, sensors = self._load(before, "points", POINTS), self._load(before, "clusters", CLUSTERS), self._load(before, "sensors", SENSORS)
        work = lambda df, name: self._store(df, f"work/{number}/{name}")

        points = batch.select(*[c.split()[0] for c in INPUT.split(", ")]).withColumn("label", F.lit(None).cast("long"))
        sensors = work(self._watermarks(points, held, sensors, last), "sensors")
        arrived = points.unionByName(held.where("label IS NULL")).join(sensors.select("stream_id", "old_watermark", "watermark"), "stream_id")
        arrived = work(arrived.where("col >= old_watermark"), "arrived")
        ready = arrived.where("col < watermark").drop("watermark", "old_watermark")

        open_before = known.where("closing_column IS NULL")
        labelled = held.where("label IS NOT NULL")
        edge = labelled.join(sensors.select("stream_id", "old_watermark"), "stream_id").where(F.col("col") >= F.col("old_watermark") - self.columns_back).drop("old_watermark")
        edge = edge.join(open_before.select("stream_id", F.col("cluster_id").alias("label")), ["stream_id", "label"], "left_semi")
        nodes = self._components(ready, edge, open_before, work)

        # New points and open clusters, each under its new label.
        named = ready.drop("label").join(nodes.select("stream_id", F.col("node").alias("pid"), F.col("to").alias("label"), "forced_column"), ["stream_id", "pid"])
        named = work(named, "named")
        reach = F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(self.clustering.max_distance), F.col("dist"))))
        fresh = named.select("stream_id", "label", F.lit(1).cast("long").alias("num_points"), F.col("col").alias("min_column"), F.col("col").alias("max_column"), F.col("stamp_ns").alias("min_stamp"), F.col("stamp_ns").alias("max_stamp"), (F.col("continuous_azimuth") + reach).alias("finish_azimuth"), "forced_column")
        moved = nodes.withColumnRenamed("node", "cluster_id")
        kept = open_before.join(moved, ["stream_id", "cluster_id"]).select("stream_id", F.col("to").alias("label"), *[s.split()[0] for s in SUMS.split(", ")], "forced_column")
        sums = fresh.unionByName(kept).groupBy("stream_id", F.col("label").alias("cluster_id")).agg(
            F.sum("num_points").alias("num_points"), F.min("min_column").alias("min_column"), F.max("max_column").alias("max_column"), F.min("min_stamp").alias("min_stamp"),
            F.max("max_stamp").alias("max_stamp"), F.max("finish_azimuth").alias("finish_azimuth"), F.min("forced_column").alias("forced_column"),
        )
        sums = work(sums, "sums")
        columns = work(column_azimuths(named, ["stream_id"]), "columns")
        found = closing_columns(sums, columns, ["stream_id"], self.num_columns, every=self.clustering.every_nth_column)
        found = found.withColumns({"forced": F.col("forced_column").isNotNull(), "closing_column": F.least("closing_column", "forced_column")}).drop("forced_column")
        found = work(self._number(found, sensors), "closed")
        closed = found.where("closing_column IS NOT NULL")

        # The oldest column that an open cluster needs.
        needed = found.where("closing_column IS NULL").groupBy("stream_id").agg(F.min("min_column").alias("needed"))
        counts = closed.where("id > 0").groupBy("stream_id").agg(F.count(F.lit(1)).alias("counted"))
        after = sensors.join(needed, "stream_id", "left").join(counts, "stream_id", "left")
        after = after.withColumns({"old_released": F.col("released"), "released": F.greatest("released", F.least("watermark", F.coalesce("needed", "watermark"))), "next_id": F.col("next_id") + F.coalesce("counted", F.lit(0))})
        after = work(after, "after")

        # Points under their clusters' new labels, with ids where the cluster is closed.
        relabel = moved.where("cluster_id <> to").select("stream_id", F.col("cluster_id").alias("label"), "to")
        old = labelled.join(relabel, ["stream_id", "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        every = known.where("closing_column IS NOT NULL").unionByName(found.select(*known.columns))
        ids = every.select("stream_id", F.col("cluster_id").alias("label"), F.col("id"), F.col("closing_column").alias("closed_in"), F.col("num_points").alias("size"))
        points_now = old.unionByName(named.drop("forced_column").select(*old.columns)).join(ids, ["stream_id", "label"]).join(after.select("stream_id", "old_released", "released", "watermark"), "stream_id")
        points_now = work(points_now, "points")
        plain = [c.split()[0] for c in INPUT.split(", ")]
        out = points_now.where("col >= old_released AND col < released").select(*plain, "id")
        fresh_ids = closed.where(F.col("num_points") > self.clustering.min_points_published).select("stream_id", F.col("cluster_id").alias("label"))
        self._store(out, f"out/columns/batch={number}")
        self._store(points_now.join(fresh_ids, ["stream_id", "label"], "left_semi").select(*plain, "id"), f"out/points/batch={number}")
        self._store(closed.select(*known.columns), f"out/clusters/batch={number}")

        # What the next micro-batch needs.
        still = points_now.where((F.col("col") >= F.col("released")) | (F.col("col") >= F.col("watermark") - self.columns_back)).select(*plain, "label")
        waiting = arrived.where("col >= watermark").select(*plain, "label")
        self._store(still.unionByName(waiting), f"state/{number}/points")
        needs = still.select("stream_id", F.col("label").alias("cluster_id")).distinct()
        self._store(every.join(needs, ["stream_id", "cluster_id"], "left_semi"), f"state/{number}/clusters")
        self._store(after.select(*[c.split()[0] for c in SENSORS.split(", ")]), f"state/{number}/sensors")
        self._forget(f"{self.path}/work/{number}", *[f"{self.path}/state/{s}" for s in [*states, number][: -self.keep_states]])

    def _forget(self, *paths: str) -> None:
        for path in paths:
            system, folder = self._folder(path)
            system.delete(folder, True)

    def _watermarks(self, points: DataFrame, held: DataFrame, sensors: DataFrame, last: bool) -> DataFrame:
        """Sensors with old and new watermark, and late points counted. A sensor's first watermark is below all columns."""
        low = F.lit(-(1 << 62))
        ends = points.groupBy("stream_id", "firing_index").agg(F.min("col").alias("rear"), F.max("col").alias("front"))
        seen = ends.groupBy("stream_id").agg(F.max("front" if last else "rear").alias("seen"))
        if last:
            waiting = held.where("label IS NULL").groupBy("stream_id").agg(F.max("col").alias("seen"))
            seen = seen.unionByName(waiting).groupBy("stream_id").agg((F.max("seen") + 1).alias("seen"))
        both = sensors.join(seen, "stream_id", "full").withColumn("old_watermark", F.coalesce("watermark", low))
        late = points.join(both.select("stream_id", "old_watermark"), "stream_id").where("col < old_watermark").groupBy("stream_id").agg(F.count(F.lit(1)).alias("late"))
        both = both.join(late, "stream_id", "left")
        return both.select(
            "stream_id", "old_watermark", F.greatest("old_watermark", F.coalesce("seen", low)).alias("watermark"), F.coalesce("released", low).alias("released"),
            F.coalesce("next_id", F.lit(1).cast("long")).alias("next_id"), (F.coalesce("n_late", F.lit(0)) + F.coalesce("late", F.lit(0))).alias("n_late"),
        )

    def _components(self, ready: DataFrame, edge: DataFrame, clusters: DataFrame, work: Callable) -> DataFrame:
        """stream_id, node, to and forced_column: for each new point and open cluster the label of the cluster that it is in now."""
        among = ready.unionByName(edge.select(*ready.columns))
        pairs = column_pairs(ready, self.clustering.max_distance, self.columns_back, self.rows_apart, ["stream_id"], among=among)
        labels = edge.select("stream_id", F.col("pid").alias("b"), "label")
        links = pairs.join(labels, ["stream_id", "b"], "left").select("stream_id", "a", F.coalesce("label", "b").alias("b")).distinct()
        links = work(links, "links")
        found = connected_components(links)
        low, high = F.col("col").alias("low"), F.col("col").alias("high")
        nodes = ready.select("stream_id", F.col("pid").alias("node"), "col", low, high)
        nodes = nodes.unionByName(clusters.select("stream_id", F.col("cluster_id").alias("node"), F.lit(None).cast("long").alias("col"), F.col("min_column").alias("low"), F.col("max_column").alias("high")))
        nodes = work(nodes.join(found, "node", "left").withColumn("to", F.coalesce("component", "node")).drop("component"), "nodes")
        plain = nodes.select("stream_id", "node", "to", F.lit(None).cast("long").alias("forced_column"))
        if not self.force:
            return plain
        long = nodes.groupBy("stream_id", "to").agg(F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("high") - F.col("low") + 1 >= self._most).select("stream_id", "to")
        long = work(long, "long")
        if not long.head(1):
            return plain
        inside = work(nodes.join(long, ["stream_id", "to"]), "inside")
        ends = work(links.join(inside.select("stream_id", F.col("node").alias("a"), "to"), ["stream_id", "a"]), "ends")
        split = inside.groupBy("stream_id", "to").cogroup(ends.groupBy("stream_id", "to")).applyInPandas(follow(self._most), "stream_id long, node long, to long, forced_column long")
        return work(plain.join(long, ["stream_id", "to"], "left_anti").unionByName(split), "split")

    def _number(self, found: DataFrame, sensors: DataFrame) -> DataFrame:
        """Adds id to the clusters that are closed now, in the order of closing from the sensor's next one on; 0 where they are small or open."""
        counts = F.col("closing_column").isNotNull() & (F.col("num_points") > self.clustering.min_points_id)
        # As many rows as one micro-batch closes.
        order = W.partitionBy("stream_id").orderBy("closing_column", "cluster_id")
        some = found.where(counts).withColumn("place", F.row_number().over(order) - 1).join(sensors.select("stream_id", "next_id"), "stream_id")
        some = some.withColumn("id", (F.col("next_id") + F.col("place")).cast("long")).drop("place", "next_id")
        return some.unionByName(found.where(~F.coalesce(counts, F.lit(False))).withColumn("id", F.lit(0).cast("long")))


def follow(num_columns: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Follows one component column by column and closes parts of it as they get as long as a rotation."""

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        stream = nodes["stream_id"].iloc[0]
        low, high = dict(zip(nodes["node"], nodes["low"])), dict(zip(nodes["node"], nodes["high"]))
        parent = {n: n for n in nodes["node"]}
        closed: dict[int, int] = {}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        by_point = links.groupby("a")["b"].apply(list).to_dict() if len(links) else {}
        new = nodes[nodes["col"].notna()].sort_values(["col", "node"])
        for column, points in new.groupby("col")["node"]:
            for a in points:
                for b in by_point.get(a, ()):
                    r, t = root(a), root(b)
                    if r != t and r not in closed and t not in closed:
                        # The smaller id is the root, and so the label.
                        r, t = min(r, t), max(r, t)
                        parent[t], low[r], high[r] = r, min(low[r], low[t]), max(high[r], high[t])
            for r in {root(a) for a in points}:
                if r not in closed and high[r] - low[r] + 1 >= num_columns:
                    closed[r] = int(column)
        to = [root(n) for n in nodes["node"]]
        return pd.DataFrame({"stream_id": stream, "node": nodes["node"], "to": to, "forced_column": pd.array([closed.get(t) for t in to], "Int64")})

    return run
