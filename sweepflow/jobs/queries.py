"""The operators as queries over the whole tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as g
from ..operators import clusters, evaluate, ground, motion, neighbors, poses, range_image, scans, sinks, vectors
from ..sources.derived import COLUMNS, ROWS, events, points
from ..sources import kitti
from ..sources.ingest import firing_points
from ..sources.messages import slice_topics
from ..streaming.clusters import ClusterStream
from . import ground_truth, storage

#: Parameters of the derived stream's queries.
DISTANCE, BACK, APART = 0.3, 3, 5
CLUSTERING = replace(Config.kitti().clustering, max_distance=DISTANCE)
BLOCK = 1024
TOLERANCE = 1.2

POINTS = """
WITH base AS (
  SELECT event_id AS pid, user_id % 4 AS stream_id, CAST(event_id % 16 AS INTEGER) AS row_index, event_id // 16 AS col,
         CAST(5 + floor(value / 25) AS DOUBLE) AS dist, CAST(least(floor(value), 255) AS INTEGER) AS intensity,
         epoch_us(ts) * 1000 AS stamp_ns, event_type, user_id, value FROM events),
angled AS (SELECT *, 2 * pi() * col / 128 AS az, (7.5 - row_index) * 0.02 AS inc FROM base),
points AS (SELECT *, dist * cos(inc) * cos(-az) AS x, dist * cos(inc) * sin(-az) AS y, dist * sin(inc) AS z FROM angled)
"""

PAIRS = POINTS + """,
looks AS (SELECT *, unnest([col, col - 1, col - 2, col - 3]) AS look FROM points),
pairs AS (
  SELECT a.pid AS a, b.pid AS b FROM looks a JOIN points b ON a.look = b.col
  WHERE abs(a.row_index - b.row_index) <= 5 AND (b.col < a.col OR b.row_index < a.row_index)
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.3 * 0.3)
"""

COMPONENTS = PAIRS.replace("WITH base", "WITH RECURSIVE base") + """,
sym AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (SELECT u, u FROM sym UNION SELECT v, root FROM reach JOIN sym ON node = u WHERE v > root),
labels AS (SELECT node, min(root) AS cluster_id FROM reach GROUP BY node),
labelled AS (SELECT p.*, coalesce(l.cluster_id, p.pid) AS cluster_id FROM points p LEFT JOIN labels l ON p.pid = l.node)
"""


def rounded(*names: str) -> list:
    """Six digits, and no negative zero."""
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def points_cartesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    angle = g.increasing_azimuth(F.atan2("y", "x"))
    at = g.vec("x", "y", "z")
    return p.select("pid", "row_index", *rounded("x", "y", "z"), F.round(g.length(at), 6).alias("distance"), F.round(g.inclination(at), 6).alias("inclination"), (F.round(F.cos(angle), 6) + 0.0).alias("turn_cos"), F.round(g.azimuth_plane(at)["r"], 6).alias("plane_r"), F.round(g.max_angle(F.col("dist"), 0.5), 6).alias("max_angle"))


POINTS_CARTESIAN = POINTS + """
SELECT pid, row_index, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(sqrt(x * x + y * y + z * z), 6) AS distance,
       round(asin(z / sqrt(x * x + y * y + z * z)), 6) AS inclination, round(cos(pi() - atan2(y, x)), 6) + 0.0 AS turn_cos,
       round(sqrt(x * x + y * y), 6) AS plane_r, round(asin(0.5 / dist), 6) AS max_angle FROM points
"""


def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against the line through two fixed ones, and a rigid transform."""
    p = points(spark, sf_dir)
    at, a, b = g.vec("x", "y", "z"), g.vec(1, 0, 0), g.vec(1, 2, 2)
    turn = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 2, 1, 0, 0, -3, 0, 0, 1, 0.5)])
    moved = p.select("pid", g.line_distance(at, a, b).alias("line_distance"), g.length_squared(g.sub(at, a)).alias("squared"), g.transform(turn, at).alias("m"))
    return moved.select("pid", *rounded("line_distance", "squared"), F.round("m.x", 6).alias("moved_x"), F.round("m.y", 6).alias("moved_y"), F.round("m.z", 6).alias("moved_z"))


VECTOR_ALGEBRA = POINTS + """,
rest AS (SELECT *, (x - 1) * 0 + y * 2 / sqrt(8.0) + z * 2 / sqrt(8.0) AS t FROM points)
SELECT pid, round(sqrt((x - 1) ** 2 + (y - t * 2 / sqrt(8.0)) ** 2 + (z - t * 2 / sqrt(8.0)) ** 2), 6) AS line_distance,
       round((x - 1) ** 2 + y * y + z * z, 6) AS squared, round(-y + 2, 6) AS moved_x, round(x - 3, 6) AS moved_y, round(z + 0.5, 6) AS moved_z
FROM rest
"""


def pack_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    sequence, frame, index = (F.col("user_id") % 11).cast("int"), F.floor(F.col("event_id") / 2048).cast("int"), F.when(F.col("event_type") == "error", -1).otherwise((F.col("event_id") % 2048).cast("int"))
    packed = e.select("event_id", g.pack_id(sequence, frame, index).alias("packed"))
    s, f, i = g.unpack_id(F.col("packed"))
    return packed.select("event_id", "packed", s.alias("sequence"), f.alias("frame"), i.alias("point_idx"))


PACK_IDS = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN ((user_id % 11) << 48) | ((event_id // 2048) << 32) | (event_id % 2048) END AS packed,
       CASE WHEN event_type <> 'error' THEN CAST(user_id % 11 AS INTEGER) END AS sequence,
       CASE WHEN event_type <> 'error' THEN CAST(event_id // 2048 AS INTEGER) END AS frame,
       CASE WHEN event_type <> 'error' THEN CAST(event_id % 2048 AS INTEGER) END AS point_idx FROM events
"""


def moving_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose column lags behind their firing by up to four columns."""
    p = points(spark, sf_dir)
    return p.withColumn("firing_index", F.col("col")).withColumn("point_column", F.col("col") - F.floor(F.pmod(F.col("intensity"), F.lit(23)) / 5).cast("long"))


MOVING = POINTS + ", moving AS (SELECT *, col AS firing_index, col - CAST(floor((intensity % 23) / 5) AS BIGINT) AS point_column FROM points)"


def column_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = range_image.firing_bounds(moving_points(spark, sf_dir), ["stream_id"], "firing_index", "point_column")
    block = F.floor(F.col("firing_index") / BLOCK)
    return scans.running(bounds, ["stream_id"], ["firing_index"], F.col("rearmost"), "max", "finished_before", block)


COLUMN_MINMAX = MOVING + """
SELECT stream_id, firing_index, rearmost, foremost, max(rearmost) OVER (PARTITION BY stream_id ORDER BY firing_index ROWS UNBOUNDED PRECEDING) AS finished_before
FROM (SELECT stream_id, firing_index, min(point_column) AS rearmost, max(point_column) AS foremost FROM moving GROUP BY ALL)
"""


def late_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = range_image.late_points(moving_points(spark, sf_dir), ["stream_id"], "firing_index", "point_column", F.floor(F.col("firing_index") / BLOCK))
    return found.select("pid", "stream_id", "point_column", "first_unfinished", "late")


LATE_POINTS = MOVING + """,
bounds AS (SELECT stream_id, firing_index, min(point_column) AS rearmost FROM moving GROUP BY ALL),
marks AS (SELECT stream_id, firing_index, max(rearmost) OVER (PARTITION BY stream_id ORDER BY firing_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_unfinished FROM bounds)
SELECT pid, stream_id, point_column, first_unfinished, coalesce(point_column < first_unfinished, false) AS late FROM moving JOIN marks USING (stream_id, firing_index)
"""


def wrap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    firings = points(spark, sf_dir).groupBy("col").agg(F.min(F.col("col") % COLUMNS).alias("column_in_rotation"), F.count(F.lit(1)).alias("n_points")).withColumn("sensor", F.lit(0))
    found = range_image.unwrap_rotations(firings, COLUMNS, ["sensor"], "col", "column_in_rotation", F.floor(F.col("col") / BLOCK))
    return found.select("col", "n_points", "column_in_rotation", "rotation", "global_column")


WRAP_SESSIONS = POINTS + """,
firings AS (SELECT col, col % 128 AS c, count(*) AS n_points FROM points GROUP BY col),
turns AS (SELECT *, CASE WHEN c - lag(c) OVER w < -64 THEN 1 WHEN c - lag(c) OVER w > 64 AND lag(c) OVER w > 0 THEN -1 ELSE 0 END AS turn FROM firings WINDOW w AS (ORDER BY col)),
summed AS (SELECT *, CAST(sum(turn) OVER (ORDER BY col ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rotation FROM turns)
SELECT col, n_points, c AS column_in_rotation, rotation, rotation * 128 + c AS global_column FROM summed
"""


def crossing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firings three columns on each time whose lasers lag by up to six columns, so that many lie across the seam."""
    return points(spark, sf_dir).withColumn("column_in_rotation", F.pmod(F.col("col") * 3 + 40 - F.col("row_index") % 7, F.lit(COLUMNS)))


def seam_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = range_image.unwrap_points(crossing_points(spark, sf_dir), COLUMNS, ["stream_id"], "col", "row_index", "column_in_rotation", F.floor(F.col("col") / BLOCK))
    return found.select("pid", "stream_id", "column_in_rotation", "global_column", "first_unfinished", "late", "bad_start", "fell_back")


#: In this fixture the global column is known beforehand.
SEAM_ROTATIONS = POINTS + """,
placed AS (SELECT pid, stream_id, col, col * 3 + 40 - row_index % 7 AS global_column FROM points),
bounds AS (SELECT stream_id, col, min(global_column) AS rearmost FROM placed GROUP BY ALL),
marks AS (SELECT stream_id, col, max(rearmost) OVER (PARTITION BY stream_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_unfinished FROM bounds)
SELECT pid, stream_id, global_column % 128 AS column_in_rotation, global_column, first_unfinished, coalesce(global_column < first_unfinished, false) AS late, false AS bad_start, false AS fell_back
FROM placed JOIN marks USING (stream_id, col)
"""


def firing_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.firing_stamps(points(spark, sf_dir), ["stream_id", "col"], "stamp_ns")


FIRING_STAMPS = POINTS + "SELECT stream_id, col, count(*) AS n_points, min(stamp_ns) + (max(stamp_ns) - min(stamp_ns)) // 2 AS firing_ns FROM points GROUP BY ALL"


def full_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a range image from which some returns are missing."""
    p = points(spark, sf_dir).withColumn("sensor", F.lit(0))
    cells = p.where(F.col("event_type") != "error").select("sensor", "col", "row_index", "pid", F.col("az").alias("continuous_azimuth"))
    full = range_image.densify(cells, p.select("sensor", "col").distinct(), ROWS, ["sensor"])
    return range_image.refill(full, COLUMNS).select("col", "row_index", "pid", F.round("continuous_azimuth", 6).alias("continuous_azimuth"))


FULL_CELLS = POINTS + """,
cells AS (SELECT * FROM points WHERE event_type <> 'error')
SELECT c.col, CAST(r AS INTEGER) AS row_index, pid, round(coalesce(az, (c.col + 0.5) * (2 * pi() / 128)), 6) AS continuous_azimuth
FROM (SELECT DISTINCT col FROM points) c CROSS JOIN range(16) t(r) LEFT JOIN cells p ON p.col = c.col AND p.row_index = r
"""


def frame_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: where a point goes depends on those before it."""
    p = points(spark, sf_dir).withColumns({"frame": F.floor(F.col("col") / COLUMNS), "cell": range_image.column_of_frame(F.col("x"), F.col("y"), 48)})
    return range_image.organize_frame(p, ["stream_id", "frame"], "row_index", "cell", "pid", 48)


def topic_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of some topics in a span of time, with the last latched one before it."""
    e = events(spark, sf_dir).select("event_id", F.col("event_type").alias("topic"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    span = e.agg(F.min("micros").alias("a"), F.max("micros").alias("b")).first()
    start, end = (span["a"] + (span["b"] - span["a"]) * k // 4 for k in (1, 2)) if span["a"] is not None else (0, 0)
    return slice_topics(e, "topic", ["micros", "event_id"], ["click", "error"], ["purchase", "signup"], start, end)


TOPIC_SLICE = """
WITH e AS (SELECT event_id, event_type AS topic, epoch_us(ts) AS micros FROM events),
span AS (SELECT min(micros) + (max(micros) - min(micros)) // 4 AS a, min(micros) + (max(micros) - min(micros)) * 2 // 4 AS b FROM e),
latched AS (SELECT topic, arg_max(event_id, (micros, event_id)) AS event_id FROM e, span WHERE topic IN ('purchase', 'signup') AND micros < a GROUP BY topic)
SELECT event_id, topic, micros, false AS latched FROM e, span WHERE topic IN ('click', 'error', 'purchase', 'signup') AND micros BETWEEN a AND b
UNION ALL SELECT event_id, topic, micros, true FROM e JOIN latched USING (event_id, topic)
"""


def time_jump_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    found = range_image.time_jump_sessions(e, ["user_id"], ["micros", "event_id"], F.col("micros") / 1e6, 3600.0, F.floor(F.col("micros") / (7 * 86400 * 10**6)))
    return found.select("event_id", "user_id", "session")


TIME_JUMP_SESSIONS = """
WITH jumps AS (
  SELECT event_id, user_id, ts, coalesce(abs(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600, false) AS jump FROM events),
counted AS (SELECT *, CAST(sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM jumps)
SELECT event_id, user_id, session FROM counted WHERE NOT jump
"""


def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("cell_column", F.floor(F.col("col") / 3))
    return range_image.nearest_in_cell(p, ["cell_column", "row_index"], "dist", "pid")


NEAREST_CELL = POINTS + """
SELECT cell_column, row_index, pid, dist, n_points FROM (
  SELECT col // 3 AS cell_column, row_index, pid, dist, count(*) OVER (PARTITION BY col // 3, row_index) AS n_points,
         row_number() OVER (PARTITION BY col // 3, row_index ORDER BY dist, pid) AS k FROM points) WHERE k = 1
"""


def laser_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.floor(F.col("event_id") / 2048).alias("frame"), (F.pmod(F.col("value"), F.lit(100.0)) / 100 * F.lit(g.TWO_PI)).alias("angle"))
    return range_image.recover_lasers(e, ["frame"], "event_id", F.col("angle")).select("event_id", "frame", "laser_index")


LASER_RECOVERY = """
WITH a AS (SELECT event_id, event_id // 2048 AS frame, (value % 100) / 100 * (2 * pi()) AS angle FROM events),
b AS (SELECT *, CASE WHEN lag(angle) OVER (PARTITION BY frame ORDER BY event_id) - angle > 0.7 THEN 1 ELSE 0 END AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY frame ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS laser FROM b)
SELECT event_id, frame, CAST(CASE WHEN laser < 64 THEN laser ELSE 0 END AS INTEGER) AS laser_index FROM c
"""


def laser_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("known", F.when(F.col("event_type") != "error", F.round(F.col("inc") + F.col("dist") / 1000, 6)))
    return range_image.fill_gaps(p, ["row_index"], "col", F.col("known"), F.floor(F.col("col") / BLOCK)).select("pid", "row_index", "known", "gap")


LASER_GAP_FILL = POINTS + """,
known AS (SELECT *, CASE WHEN event_type <> 'error' THEN round(inc + dist / 1000, 6) END AS known FROM points)
SELECT pid, row_index, known, last_value(known IGNORE NULLS) OVER (PARTITION BY row_index ORDER BY col ROWS UNBOUNDED PRECEDING) AS gap FROM known
"""


def pose_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("stamp_ns"), "value").withColumn("sensor", F.lit(0))
    series = e.where(F.col("event_id") % 50 == 0).groupBy("sensor", "stamp_ns").agg(F.max("value").alias("tx"))
    joined = poses.as_of(e, series, "stamp_ns", ["tx"], ["sensor"], "event_id", F.floor(F.col("stamp_ns") / (3600 * 10**9)))
    return joined.select("event_id", F.col("before.stamp").alias("before_ns"), F.col("after.stamp").alias("after_ns"), F.round(poses.interpolate(F.col("before"), F.col("after"), F.col("stamp_ns"), "tx"), 6).alias("tx"))


POSE_ASOF = """
WITH e AS (SELECT event_id, epoch_us(ts) * 1000 AS stamp_ns, value FROM events),
series AS (SELECT stamp_ns, max(value) AS tx FROM e WHERE event_id % 50 = 0 GROUP BY stamp_ns),
b AS (SELECT e.event_id, e.stamp_ns, s.stamp_ns AS before_ns, s.tx AS before_tx FROM e ASOF LEFT JOIN series s ON e.stamp_ns >= s.stamp_ns),
a AS (SELECT b.*, s.stamp_ns AS after_ns, s.tx AS after_tx FROM b ASOF LEFT JOIN series s ON b.stamp_ns < s.stamp_ns)
SELECT event_id, before_ns, after_ns, round(coalesce(before_tx + (after_tx - before_tx) * (CAST(stamp_ns - before_ns AS DOUBLE) / CAST(after_ns - before_ns AS DOUBLE)), before_tx, after_tx), 6) AS tx FROM a
"""


def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = points(spark, sf_dir).groupBy("stream_id", F.floor(F.col("col") / COLUMNS).alias("frame")).agg(F.min("stamp_ns").alias("stamp_ns"))
    return poses.frame_bounds(frames, ["stream_id"], "frame", "stamp_ns")


FRAME_BOUNDS = POINTS + """,
frames AS (SELECT stream_id, col // 128 AS frame, min(stamp_ns) AS stamp_ns FROM points GROUP BY ALL)
SELECT stream_id, frame, stamp_ns,
       coalesce((stamp_ns + lag(stamp_ns) OVER w) // 2, stamp_ns - 50000000) AS start_ns,
       coalesce((stamp_ns + lead(stamp_ns) OVER w) // 2, stamp_ns + 50000000) AS end_ns
FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY frame)
"""


def column_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.column_firings(frame_bounds(spark, sf_dir), COLUMNS).select("stream_id", "frame", "column", "firing_ns")


COLUMN_FIRINGS = FRAME_BOUNDS.replace("\nSELECT stream_id, frame, stamp_ns,", ", bounds AS (SELECT stream_id, frame, stamp_ns,") + """)
SELECT stream_id, frame, CAST(c AS INTEGER) AS column, start_ns + (end_ns - start_ns) * c // 127 AS firing_ns FROM bounds, range(128) r(c)
"""

BINS = 97


def motion_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensor that turns and drives at a steady rate within each frame."""
    p = points(spark, sf_dir).select("pid", F.floor(F.col("col") / COLUMNS).alias("frame"), "x", "y", "z")
    at = lambda b: F.array(F.cos(b * 0.001), -F.sin(b * 0.001), F.lit(0.0), b * 0.1, F.sin(b * 0.001), F.cos(b * 0.001), F.lit(0.0), b * 0.05, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    bins = p.select("frame").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1)).cast("array<bigint>")))
    found = motion.undo_motion(p, bins.select("frame", "bin", at(F.col("bin")).alias("m"), at(F.lit(48)).alias("middle")), ["frame"], BINS)
    return found.select("pid", "bin", *rounded("x", "y", "z"))


MOTION_UNDONE = POINTS + """,
b AS (SELECT pid, x, y, z, CAST(least(floor((pi() - atan2(y, x)) / (2 * pi()) * 97), 96) AS BIGINT) AS bin FROM points),
m AS (SELECT *, cos(0.048) * x - sin(0.048) * y + 4.8 - bin * 0.1 AS u, sin(0.048) * x + cos(0.048) * y + 2.4 - bin * 0.05 AS v FROM b)
SELECT pid, bin, round(cos(bin * 0.001) * u + sin(bin * 0.001) * v, 6) + 0.0 AS x, round(-sin(bin * 0.001) * u + cos(bin * 0.001) * v, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM m
"""

GROUND = replace(Config.kitti().ground, fog_enabled=True, fog_intensity_below=100, fog_distance_below=18.0, fog_inclination_above=-0.06, ego_box=((-6.0, 6.0), (-6.0, 6.0), (-2.0, 2.0)))


def ego_fog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    fog, ego = ground.is_fog(F.col("intensity"), F.col("dist"), F.col("inc"), GROUND), ground.is_ego(F.col("x"), F.col("y"), F.col("z"), GROUND)
    return p.select("pid", fog.alias("is_fog"), ego.alias("is_ego"))


EGO_FOG_FILTER = POINTS + """
SELECT pid, intensity < 100 AND dist < 18 AND inc > -0.06 AS is_fog, x > -6 AND x < 6 AND y > -6 AND y < 6 AND z > -2 AND z < 2 AS is_ego FROM points
"""


def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"dist": F.when(F.col("event_type") != "error", F.col("dist")), "gap": F.lit(0.02)})
    return p.withColumn("ground_label", F.when(F.col("pid") % 5 == 0, 64).otherwise(119))


def ignore_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.ignore_flags(labelled_cells(spark, sf_dir), Config.library_defaults().clustering, [], ROWS).select("pid", "is_ignored")


IGNORE_FLAGS = POINTS + """,
cells AS (SELECT pid, row_index, col, CASE WHEN event_type <> 'error' THEN dist END AS d, CASE WHEN pid % 5 = 0 THEN 64 ELSE 119 END AS label FROM points)
SELECT pid, d IS NULL OR label <> 119 OR d < 0.7 OR (row_index < 15 AND atan2(0.7, d) < 0.02) OR col % 2 <> row_index % 2 AS is_ignored FROM cells
"""


def neighbor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.column_pairs(points(spark, sf_dir), DISTANCE, BACK, APART)


NEIGHBOR_PAIRS = PAIRS + "SELECT a, b FROM pairs"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return clusters.label_points(p, neighbors.column_pairs(p, DISTANCE, BACK, APART), ["pid", "col", "dist", "stamp_ns"])


def clusters_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_sizes(labelled(spark, sf_dir), CLUSTERING)


CLUSTERS_EXACT = COMPONENTS + "SELECT cluster_id, count(*) AS num_points, count(*) > 5 AS has_id, count(*) > 20 AS published FROM labelled GROUP BY cluster_id"


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster_statistics(labelled(spark, sf_dir), CLUSTERING, COLUMNS)
    return found.withColumn("finish_azimuth", F.round("finish_azimuth", 6))


CLUSTER_STATS = COMPONENTS + """
SELECT cluster_id, count(*) AS num_points, min(col) AS min_column, max(col) AS max_column, round(max(col * (2 * pi() / 128) + asin(least(1.0, 0.3 / dist))), 6) AS finish_azimuth,
       min(stamp_ns) + (max(stamp_ns) - min(stamp_ns)) // 2 AS stamp_ns, max(col) - min(col) + 1 >= 128 AS forced FROM labelled GROUP BY cluster_id
"""


def closed_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters with the columns in which they close, and the columns with their smallest azimuths."""
    found = clusters.cluster_statistics(labelled(spark, sf_dir), CLUSTERING, COLUMNS).withColumn("sensor", F.lit(0))
    cells = points(spark, sf_dir).select(F.lit(0).alias("sensor"), "col", F.col("az").alias("continuous_azimuth"))
    columns = clusters.column_azimuths(cells, ["sensor"])
    return clusters.closing_columns(found, columns, ["sensor"], COLUMNS), columns


def cluster_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, _ = closed_clusters(spark, sf_dir)
    numbered = clusters.number_closed(closed, ["sensor"], CLUSTERING, F.floor(F.col("closing_column") / BLOCK))
    return numbered.select("cluster_id", "num_points", "min_column", "closing_column", "id")


CLOSING = COMPONENTS + """,
stats AS (SELECT cluster_id, count(*) AS num_points, min(col) AS min_column, max(col * (2 * pi() / 128) + asin(least(1.0, 0.3 / dist))) AS finish FROM labelled GROUP BY cluster_id),
columns_ AS (SELECT col, min(az) AS min_azimuth FROM points GROUP BY col),
closed AS (SELECT cluster_id, any_value(num_points) AS num_points, any_value(min_column) AS min_column, min(col) AS closing_column FROM stats LEFT JOIN columns_ ON min_azimuth >= finish GROUP BY cluster_id)
"""
CLUSTER_CLOSING = CLOSING + """
SELECT cluster_id, num_points, min_column, closing_column, CASE WHEN num_points > 5 THEN CAST(sum(CASE WHEN num_points > 5 THEN 1 ELSE 0 END) OVER (ORDER BY closing_column, cluster_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS id
FROM closed WHERE closing_column IS NOT NULL
"""


def released_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, columns = closed_clusters(spark, sf_dir)
    return clusters.released_columns(closed, columns, ["sensor"], F.floor(F.col("col") / BLOCK)).select("col", "first_unpublished")


RELEASED_COLUMNS = CLOSING + """
SELECT c.col, least(c.col + 1, min(k.min_column)) AS first_unpublished FROM columns_ c LEFT JOIN closed k ON k.closing_column IS NULL OR k.closing_column > c.col GROUP BY c.col
"""


def truth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects for ground-truth clusters: a few instances of four classes in each frame."""
    kinds = F.array(*map(F.lit, (10, 30, 40, 71)))
    return points(spark, sf_dir).select(F.col("stream_id").cast("int").alias("sequence"), F.floor(F.col("col") / COLUMNS).cast("int").alias("frame"), F.col("pid").cast("int").alias("point_idx"), "x", "y", "z", F.element_at(kinds, (F.col("intensity") % 4 + 1).cast("int")).alias("semantic_label"), F.lit(1).alias("instance_label"))


def truth_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ground_truth.euclidean_clusters(truth_points(spark, sf_dir), least=2, most=60)
    return found.select("sequence", "frame", "point_idx", "semantic_label", "cluster_label")


TRUTH_CLUSTERS = POINTS.replace("WITH base", "WITH RECURSIVE base") + """,
truth AS (SELECT CAST(stream_id AS INTEGER) AS sequence, CAST(col // 128 AS INTEGER) AS frame, CAST(pid AS INTEGER) AS point_idx, x, y, z, [10, 30, 40, 71][intensity % 4 + 1] AS semantic_label FROM points),
pairs AS (
  SELECT a.point_idx AS a, b.point_idx AS b FROM truth a JOIN truth b USING (sequence, frame, semantic_label)
  WHERE a.point_idx < b.point_idx AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 1.0),
sym AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (SELECT u, u FROM sym UNION SELECT v, root FROM reach JOIN sym ON node = u WHERE v > root),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
named AS (SELECT t.*, coalesce(root, point_idx) AS root FROM truth t LEFT JOIN roots ON point_idx = node),
sizes AS (SELECT sequence, frame, root, any_value(semantic_label) AS kind FROM named GROUP BY sequence, frame, root HAVING count(*) BETWEEN 2 AND 60),
numbers AS (SELECT sequence, frame, root, kind, row_number() OVER (PARTITION BY sequence, frame ORDER BY root) AS number FROM sizes)
SELECT n.sequence, n.frame, n.point_idx, n.semantic_label, CAST(CASE WHEN number IS NULL OR kind = 40 THEN 0 ELSE number END AS INTEGER) AS cluster_label
FROM named n LEFT JOIN numbers k ON n.sequence = k.sequence AND n.frame = k.frame AND n.root = k.root
"""


def detections_on_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections carry packed ids; a part of them has none."""
    e = evaluation_points(spark, sf_dir).withColumn("point_idx", (F.col("event_id") % 2048).cast("int")).withColumns({"sequence": F.col("sequence").cast("int"), "frame": F.col("frame").cast("int")})
    found = e.select(g.pack_id(F.col("sequence"), F.col("frame"), F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("point_idx"))).alias("packed_id"), "is_ground", F.col("detection").alias("detection_label"))
    return evaluate.detections_on_truth(e.select("event_id", "sequence", "frame", "point_idx", "semantic"), found, ["sequence", "frame", "point_idx"])


def evaluation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and detections from events: eleven sequences, frames of a rotation."""
    classes = F.array(*map(F.lit, (0, 40, 44, 48, 49, 60, 72, 10, 50, 70)))
    return events(spark, sf_dir).select(
        "event_id",
        (F.col("user_id") % 3).alias("sequence"),
        F.floor(F.col("event_id") / 2048).alias("frame"),
        F.element_at(classes, (F.col("user_id") % 10 + 1).cast("int")).alias("semantic"),
        (F.floor(F.col("value")) % 3 != 0).alias("is_ground"),
        (F.col("user_id") % 7).alias("truth"),
        F.floor(F.col("value") / 50).alias("detection"),
    )


EVALUATION = """
WITH p AS (
  SELECT event_id, user_id % 3 AS sequence, event_id // 2048 AS frame, [0, 40, 44, 48, 49, 60, 72, 10, 50, 70][user_id % 10 + 1] AS semantic,
         CAST(floor(value) AS BIGINT) % 3 <> 0 AS is_ground, user_id % 7 AS truth, CAST(floor(value / 50) AS BIGINT) AS detection FROM events),
counted AS (
  SELECT sequence, frame, count(*) FILTER (semantic IN (40, 44, 48, 49, 60, 72) AND is_ground) AS tp, count(*) FILTER (semantic IN (40, 44, 48, 49, 60, 72) AND NOT is_ground) AS fn,
         count(*) FILTER (semantic NOT IN (40, 44, 48, 49, 60, 72) AND is_ground) AS fp, count(*) FILTER (semantic NOT IN (40, 44, 48, 49, 60, 72) AND NOT is_ground) AS tn
  FROM p WHERE semantic <> 0 GROUP BY ALL),
scored AS (SELECT *, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, (tp + tn) / nullif(tp + fn + fp + tn, 0) AS accuracy FROM counted)
"""


DETECTIONS_ON_TRUTH = EVALUATION + """
SELECT event_id, CAST(sequence AS INTEGER) AS sequence, CAST(frame AS INTEGER) AS frame, CAST(event_id % 2048 AS INTEGER) AS point_idx, semantic,
       event_id % 7 <> 0 AS found, event_id % 7 <> 0 AND is_ground AS is_ground, CASE WHEN event_id % 7 <> 0 THEN detection ELSE 0 END AS detection_label FROM p
"""


def ground_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.ground_confusion(evaluation_points(spark, sf_dir), ["sequence", "frame"], "semantic", F.col("is_ground"))
    scores = evaluate.metrics(*map(F.col, ("tp", "fn", "fp", "tn")))
    return counts.select("*", *[F.round(v, 6).alias(k) for k, v in scores.items()])


GROUND_CONFUSION = EVALUATION + """
SELECT sequence, frame, tp, fn, fp, tn, round(recall, 6) AS recall, round(precision, 6) AS precision, round(2 * recall * precision / nullif(recall + precision, 0), 6) AS f1, round(accuracy, 6) AS accuracy FROM scored
"""


def ose_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.over_segmentation(evaluation_points(spark, sf_dir), ["sequence", "frame"], "truth", "detection")
    return found.withColumn("over_segmentation_entropy", F.round("over_segmentation_entropy", 6))


ENTROPY = EVALUATION + """,
n AS (SELECT sequence, frame, {of} AS of, {over} AS over, count(*) AS n FROM p WHERE {of} <> 0 GROUP BY ALL),
f AS (SELECT *, n / sum(n) OVER (PARTITION BY sequence, frame, of) AS f, max(CASE WHEN over <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence, frame, of) AS has_label FROM n)
SELECT sequence, frame, round(sum(CASE WHEN {keep} THEN -f * ln(f) ELSE 0 END), 6) AS {out} FROM f GROUP BY sequence, frame
"""
OSE_FRAME = ENTROPY.format(of="truth", over="detection", keep="true", out="over_segmentation_entropy")


def use_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.under_segmentation(evaluation_points(spark, sf_dir), ["sequence", "frame"], "truth", "detection")
    return found.withColumn("under_segmentation_entropy", F.round("under_segmentation_entropy", 6))


USE_FRAME = ENTROPY.format(of="detection", over="truth", keep="has_label = 1", out="under_segmentation_entropy")


def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = evaluate.ground_confusion(evaluation_points(spark, sf_dir), ["sequence", "frame"], "semantic", F.col("is_ground"))
    scores = evaluate.metrics(*map(F.col, ("tp", "fn", "fp", "tn")))
    found = evaluate.summarize(frames.withColumns({k: scores[k] for k in ("recall", "precision", "accuracy")}), "sequence", ["recall", "precision", "accuracy"])
    return found.select("sequence", "num_frames", *rounded(*[c for c in found.columns if c not in ("sequence", "num_frames")]))


METRICS_ROLLUP = EVALUATION + """
SELECT sequence, count(*) AS num_frames, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std, round(avg(precision), 6) AS precision_mean,
       round(stddev_pop(precision), 6) AS precision_std, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std FROM scored GROUP BY ROLLUP (sequence)
"""


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("part", F.col("doc_id") % 10)
    return evaluate.confusion(labels, ["part"], F.col("quality") == 1, F.col("toxic") == 0)


LABEL_CONFUSION = """
SELECT doc_id % 10 AS part, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND NOT toxic = 0) AS fn,
       count(*) FILTER (NOT quality = 1 AND toxic = 0) AS fp, count(*) FILTER (NOT quality = 1 AND NOT toxic = 0) AS tn FROM labels GROUP BY 1
"""


def conditional_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the same label and a distance below the tolerance."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    links = vectors.near_links(e, F.col("embedding"), TOLERANCE, "label", "vec_id")
    return clusters.label_points(e.withColumnRenamed("vec_id", "pid"), links, ["pid", "label"]).groupBy("label", "cluster_id").agg(F.count(F.lit(1)).alias("num_points"))


CONDITIONAL_CLUSTERS = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_distance(a.p, b.p) < {TOLERANCE}),
sym AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
reach(node, root) AS (SELECT u, u FROM sym UNION SELECT v, root FROM reach JOIN sym ON node = u WHERE v > root),
labels_ AS (SELECT node, min(root) AS cluster_id FROM reach GROUP BY node)
SELECT e.label, coalesce(l.cluster_id, e.vec_id) AS cluster_id, count(*) AS num_points FROM e LEFT JOIN labels_ l ON e.vec_id = l.node GROUP BY ALL
"""


def stage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.stage_output(moving_points(spark, sf_dir), "raw")
    shown = evaluation_points(spark, sf_dir).select(F.col("event_id").alias("pid"), sinks.outcome(F.col("semantic").isin(40, 44, 48, 49, 60, 72), F.col("is_ground")).alias("outcome"))
    return rows.drop("x", "y", "z").join(shown, "pid")


STAGE_PROJECTION = POINTS + """
SELECT stream_id, pid, col AS firing_index, row_index, stamp_ns,
       CASE WHEN t AND g THEN 'tp' WHEN t THEN 'fn' WHEN g THEN 'fp' ELSE 'tn' END AS outcome
FROM (SELECT *, [0, 40, 44, 48, 49, 60, 72, 10, 50, 70][user_id % 10 + 1] IN (40, 44, 48, 49, 60, 72) AS t, CAST(floor(value) AS BIGINT) % 3 <> 0 AS g FROM points)
"""


def ground_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the rules follow a column from below."""
    p = points(spark, sf_dir)
    skip = F.when(ground.is_fog(F.col("intensity"), F.col("dist"), F.col("inc"), GROUND), ground.FOG).when(ground.is_ego(F.col("x"), F.col("y"), F.col("z"), GROUND), ground.EGO).otherwise(0)
    cells = p.withColumns({"skip_rule": skip, "sensor": F.lit(0).cast("long")})
    return ground.segment_ground(cells, ROWS, replace(GROUND, robot_height=1.7), ["sensor"])


def cell_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: where a point goes depends on those before it."""
    p = points(spark, sf_dir).withColumn("target_column", F.floor(F.col("col") / 2))
    return range_image.place_in_order(p, ["stream_id"], "row_index", "target_column", "pid", "dist", 512)


def stream_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived points as the input of a cluster stream of one sensor."""
    az = F.col("az").alias("continuous_azimuth")
    return points(spark, sf_dir).select(F.lit(0).cast("long").alias("stream_id"), "pid", F.col("col").alias("firing_index"), "col", "row_index", "x", "y", "z", "dist", az, "stamp_ns")


def run_stream(spark: SparkSession, sf_dir: str, slices: int = 2, **options) -> ClusterStream:
    """All points in micro-batches of as many columns each, through what foreachBatch calls."""
    p = stream_points(spark, sf_dir)
    most = p.agg(F.max("col").alias("n")).first()["n"]
    stream = ClusterStream(spark, f"{storage.checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}", CLUSTERING, COLUMNS, BACK, APART, **options)
    part = F.floor(F.col("col") * slices / F.lit((most or 0) + 1))
    for k in range(slices):
        stream.advance(p.where(part == k), k)
    stream.advance(p.where("false"), slices, last=True)
    return stream


def stream_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that come out of a stream are those of the whole table."""
    return run_stream(spark, sf_dir, force=False).clusters().select("cluster_id", "num_points", "min_column", "closing_column", "id")


STREAM_CLUSTERS = CLUSTER_CLOSING


def forced_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: where a component is cut depends on what was cut before. Clusters of 48 columns are cut."""
    return run_stream(spark, sf_dir, most_columns=48).clusters().select("cluster_id", "num_points", "min_column", "max_column", "closing_column", "forced", "id")


def nth_column_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing in every seventh column only."""
    found = clusters.cluster_statistics(labelled(spark, sf_dir), CLUSTERING, COLUMNS).withColumn("sensor", F.lit(0))
    columns = clusters.column_azimuths(points(spark, sf_dir).select(F.lit(0).alias("sensor"), "col", F.col("az").alias("continuous_azimuth")), ["sensor"])
    return clusters.closing_columns(found, columns, ["sensor"], COLUMNS, every=7).select("cluster_id", "min_column", "closing_column")


NTH_COLUMN_CLOSING = CLOSING.replace("min_azimuth >= finish GROUP", "min_azimuth >= finish AND col % 7 = 0 GROUP") + "SELECT cluster_id, min_column, closing_column FROM closed"


def nested_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firings of sixteen points each, some of them without a stamp, some points without a return."""
    p = points(spark, sf_dir)
    seen = F.col("event_type") != "error"
    number = lambda c: F.when(seen, F.col(c)).otherwise(F.lit(float("nan"))).alias(c)
    point = F.struct(number("x"), number("y"), number("z"), (F.col("intensity") / 255).alias("intensity"))
    one = p.groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("row_index", point))).alias("at"), F.min("stamp_ns").alias("first"))
    array = F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda i: F.try_element_at("at", i))
    nested = one.select(F.lit(0).alias("sensor"), "col", array.alias("points"), F.when(F.col("col") % 10 == 3, 0).otherwise(F.col("first")).alias("stamp_ns"))
    found = firing_points(nested, ["sensor"], "col", F.floor(F.col("col") / BLOCK))
    return found.select("col", "firing_index", "row_index", "stamp_ns", *rounded("x", "y", "z"), "intensity")


NESTED_FIRINGS = POINTS + """,
firings AS (SELECT col, min(stamp_ns) AS stamp_ns, row_number() OVER (ORDER BY col) - 1 AS firing_index FROM points WHERE col % 10 <> 3 GROUP BY col)
SELECT f.col, firing_index, CAST(r AS INTEGER) AS row_index, f.stamp_ns, round(CASE WHEN event_type <> 'error' THEN x END, 6) + 0.0 AS x, round(CASE WHEN event_type <> 'error' THEN y END, 6) + 0.0 AS y,
       round(CASE WHEN event_type <> 'error' THEN z END, 6) + 0.0 AS z, CAST(floor((intensity / 255) * 255) AS INTEGER) AS intensity
FROM firings f CROSS JOIN range(16) t(r) LEFT JOIN points p ON p.col = f.col AND p.row_index = r
"""


def view_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within the angle under which the distance is seen, four columns back at most."""
    return neighbors.view_pairs(points(spark, sf_dir), 0.7, COLUMNS, 4, APART)


VIEW_PAIRS = POINTS + """,
views AS (SELECT *, asin(least(1.0, 0.7 / dist)) AS view FROM points),
looks AS (SELECT *, unnest(range(col - least(4, CAST(ceil(view / (2 * pi() / 128)) AS BIGINT)), col + 1)) AS look FROM views)
SELECT a.pid AS a, b.pid AS b FROM looks a JOIN points b ON a.look = b.col
WHERE abs(a.row_index - b.row_index) <= 5 AND (b.col < a.col OR b.row_index < a.row_index) AND abs(a.inc - b.inc) <= a.view
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.7 * 0.7
"""


def frame_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that hang on each other, and where a frame's origin lies seen from the frame of the event before."""
    e = events(spark, sf_dir).select("event_id", F.floor("value").alias("v"))
    yaw, zero = F.col("v") * 0.01, F.lit(0.0)
    m = F.array(F.cos(yaw), -F.sin(yaw), zero, F.col("v") * 0.001, F.sin(yaw), F.cos(yaw), zero, F.lit(0.5), zero, zero, F.lit(1.0), F.lit(0.25))
    frames = e.select(F.lit(0).alias("tree"), F.col("event_id").alias("frame"), F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 3)).alias("parent"), m.alias("m"))
    asked = frames.where("frame > 0").select("tree", F.col("frame").alias("source"), (F.col("frame") - 1).alias("target"))
    at = g.translation(F.col("m"))
    found = motion.between_frames(asked, frames, ["tree"]).withColumns({c: at[c] for c in "xyz"})
    return found.select("source", "target", *rounded("x", "y", "z"))


FRAME_TRANSFORMS = """
WITH RECURSIVE frames AS (SELECT event_id AS frame, (event_id - 1) // 3 AS parent, floor(value) * 0.01 AS yaw, floor(value) * 0.001 AS tx FROM events WHERE event_id > 0),
climb(frame, up, yaw, x, y, z) AS (
  SELECT frame, parent, yaw, tx, CAST(0.5 AS DOUBLE), CAST(0.25 AS DOUBLE) FROM frames
  UNION ALL
  SELECT c.frame, f.parent, c.yaw + f.yaw, cos(f.yaw) * c.x - sin(f.yaw) * c.y + f.tx, sin(f.yaw) * c.x + cos(f.yaw) * c.y + 0.5, c.z + 0.25 FROM climb c JOIN frames f ON c.up = f.frame),
roots AS (SELECT frame, yaw, x, y, z FROM climb WHERE up = 0 UNION ALL SELECT 0, 0, 0, 0, 0)
SELECT s.frame AS source, t.frame AS target, round(cos(t.yaw) * (s.x - t.x) + sin(t.yaw) * (s.y - t.y), 6) + 0.0 AS x, round(-sin(t.yaw) * (s.x - t.x) + cos(t.yaw) * (s.y - t.y), 6) + 0.0 AS y, round(s.z - t.z, 6) + 0.0 AS z
FROM roots s JOIN roots t ON t.frame = s.frame - 1
"""


def drive_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of recorded drives, those of the sequences' own and one that is in none, in their sequences."""
    names = [x[2] for x in kitti.SEQUENCES] + ["2011_09_26_drive_0001_sync"]
    drive = F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 12 + 1).cast("int"))
    rows = events(spark, sf_dir).select("event_id", drive.alias("drive"), (F.col("event_id") * 7 % 6000).alias("frame"))
    return kitti.in_sequences(rows, kitti.sequences(spark))


DRIVE_SEQUENCES = f"""
WITH parts AS (SELECT * FROM (VALUES {", ".join(f"({s}, '{d}', {a}, {b})" for s, _, d, a, b in kitti.SEQUENCES)}) t(sequence, drive, first, last)),
rows_ AS (SELECT event_id, {[x[2] for x in kitti.SEQUENCES] + ["2011_09_26_drive_0001_sync"]}[user_id % 12 + 1] AS drive, event_id * 7 % 6000 AS frame FROM events)
SELECT event_id, r.drive, frame AS drive_frame, sequence, CAST(frame - first AS INTEGER) AS frame FROM rows_ r JOIN parts p ON r.drive = p.drive AND frame BETWEEN first AND last
"""


def pose_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses at the stamps of all events, between those of every fiftieth: places in proportion, turns by slerp."""
    e = events(spark, sf_dir).select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("stamp_ns"), "value").withColumn("sensor", F.lit(0))
    series = e.where(F.col("event_id") % 50 == 0).groupBy("sensor", "stamp_ns").agg(F.max("value").alias("v"))
    series = series.select("sensor", "stamp_ns", F.array(F.col("v"), F.col("v") * 2, F.lit(1.0)).alias("place"), poses.quaternion(F.pmod(F.floor("v"), F.lit(3)) * 1.0).alias("turn"))
    found = poses.pose_at(e.drop("value"), series, "stamp_ns", "place", "turn", ["sensor"], "event_id", F.floor(F.col("stamp_ns") / (3600 * 10**9)))
    m = F.col("m")
    return found.select("event_id", *[(F.round(m[i], 5) + 0.0).alias(n) for i, n in ((0, "cos_yaw"), (4, "sin_yaw"), (3, "x"), (7, "y"), (11, "z"))])


POSE_MIXED = """
WITH e AS (SELECT event_id, epoch_us(ts) * 1000 AS stamp_ns, value FROM events),
series AS (SELECT stamp_ns, max(value) AS v, floor(max(value)) % 3 AS yaw FROM e WHERE event_id % 50 = 0 GROUP BY stamp_ns),
b AS (SELECT e.event_id, e.stamp_ns, s.stamp_ns AS s0, s.v AS v0, s.yaw AS y0 FROM e ASOF LEFT JOIN series s ON e.stamp_ns >= s.stamp_ns),
a AS (SELECT b.*, s.stamp_ns AS s1, s.v AS v1, s.yaw AS y1 FROM b ASOF LEFT JOIN series s ON b.stamp_ns < s.stamp_ns),
k AS (SELECT event_id, coalesce(v0, v1) AS v0, coalesce(v1, v0) AS v1, coalesce(y0, y1) AS y0, coalesce(y1, y0) AS y1, coalesce(CAST(stamp_ns - s0 AS DOUBLE) / CAST(s1 - s0 AS DOUBLE), 0) AS t FROM a)
SELECT event_id, round(cos(y0 + (y1 - y0) * t), 5) + 0.0 AS cos_yaw, round(sin(y0 + (y1 - y0) * t), 5) + 0.0 AS sin_yaw, round(v0 + (v1 - v0) * t, 5) + 0.0 AS x, round(2 * (v0 + (v1 - v0) * t), 5) + 0.0 AS y, 1.0 AS z FROM k
"""


def inclination_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclinations of empty cells: all cells of the image, gaps between lasers carried along rows, and a chain from the lowest known cell up."""
    p = points(spark, sf_dir).withColumns({"sensor": F.lit(0), "inc": F.round(F.col("inc") + F.col("col") % 7 / 1000, 6)})
    full = range_image.densify(p.where(F.col("event_type") != "error").select("sensor", "col", "row_index", "inc"), p.select("sensor", "col").distinct(), ROWS, ["sensor"])
    below = full.select("sensor", "col", (F.col("row_index") - 1).alias("row_index"), F.col("inc").alias("below"))
    known = full.join(below, ["sensor", "col", "row_index"], "left").withColumn("known", F.col("inc") - F.col("below"))
    gaps = range_image.fill_gaps(known, ["sensor", "row_index"], "col", F.col("known"), F.floor(F.col("col") / BLOCK))
    found = ground.supplement_inclinations(gaps.withColumn("measured", F.col("inc")), ["sensor"])
    return found.select("col", "row_index", *rounded("measured", "gap", "inc"))


INCLINATION_CHAIN = POINTS + """,
cells AS (SELECT c.col, CAST(r AS INTEGER) AS row_index, CASE WHEN event_type <> 'error' THEN round(inc + c.col % 7 / 1000, 6) END AS measured FROM (SELECT DISTINCT col FROM points) c CROSS JOIN range(16) t(r) LEFT JOIN points p ON p.col = c.col AND p.row_index = r),
known AS (SELECT *, measured - lead(measured) OVER (PARTITION BY col ORDER BY row_index) AS known FROM cells),
gaps AS (SELECT col, row_index, measured, last_value(known IGNORE NULLS) OVER (PARTITION BY row_index ORDER BY col ROWS UNBOUNDED PRECEDING) AS gap FROM known),
climbs AS (SELECT *, sum(coalesce(gap, 0)) OVER (PARTITION BY col ORDER BY row_index DESC ROWS UNBOUNDED PRECEDING) AS climb FROM gaps),
based AS (SELECT *, last_value(measured - climb IGNORE NULLS) OVER (PARTITION BY col ORDER BY row_index DESC ROWS UNBOUNDED PRECEDING) AS base FROM climbs)
SELECT col, row_index, round(measured, 6) + 0.0 AS measured, round(gap, 6) + 0.0 AS gap, round(coalesce(measured, base + climb), 6) + 0.0 AS inc FROM based
"""


def cluster_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the last stage; what has no value in this fixture is null."""
    cells = ground.ignore_flags(labelled_cells(spark, sf_dir), Config.library_defaults().clustering, [], ROWS)
    found = labelled(spark, sf_dir).select("pid", "cluster_id", F.round(F.col("col") * F.lit(g.TWO_PI / COLUMNS) + F.asin(F.lit(DISTANCE) / F.col("dist")), 6).alias("finish_azimuth"))
    rows = cells.join(found, "pid").withColumns({"firing_index": F.col("col"), "global_column": F.col("col"), "continuous_azimuth": F.round("az", 6), "az": F.round(F.pmod("az", F.lit(g.TWO_PI)), 5), "inc": F.round("inc", 6), **dict(zip("xyz", (F.round(c, 6) + 0.0 for c in "xyz")))})
    kept = sinks.stage_output(rows, "cluster")
    return kept.select(*[c for c in kept.columns if dict(kept.dtypes)[c] != "void"])


CLUSTER_COLUMNS = COMPONENTS + """
SELECT stream_id, p.pid, p.col AS firing_index, row_index, p.stamp_ns, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, intensity, CASE WHEN event_type <> 'error' THEN p.dist END AS dist,
       round(p.az % (2 * pi()), 5) AS az, round(p.inc, 6) AS inc, p.col, round(p.az, 6) AS continuous_azimuth, p.col AS global_column, CASE WHEN p.pid % 5 = 0 THEN 64 ELSE 119 END AS ground_label,
       event_type = 'error' OR p.pid % 5 = 0 OR p.dist < 0.7 OR (row_index < 15 AND atan2(0.7, p.dist) < 0.02) OR p.col % 2 <> row_index % 2 AS is_ignored, cluster_id,
       round(p.col * (2 * pi() / 128) + asin(0.3 / p.dist), 6) AS finish_azimuth FROM labelled p
"""


def row_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"frame": F.floor(F.col("col") / COLUMNS), "cell": F.col("col") % COLUMNS})
    return evaluate.row_statistics(p, ["stream_id", "frame"], "row_index", "cell", COLUMNS)


ROW_STATISTICS = POINTS + "SELECT stream_id, col // 128 AS frame, row_index, count(*) AS n_points, count(DISTINCT col % 128) AS n_columns, max(col % 128) AS max_column FROM points GROUP BY ALL"


def published_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of clusters large enough to be published."""
    return clusters.published(labelled(spark, sf_dir), CLUSTERING).select("pid", "cluster_id")


PUBLISHED_POINTS = COMPONENTS + "SELECT pid, cluster_id FROM labelled QUALIFY count(*) OVER (PARTITION BY cluster_id) > 20"


def rotation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of an image a hundred wide, and azimuths that go on from rotation to rotation, of a sensor that turns either way."""
    p = points(spark, sf_dir).select("pid", F.floor(F.col("col") / COLUMNS).alias("rotation"), F.pmod(F.col("az") + 0.01, F.lit(g.TWO_PI)).alias("turn"))
    turned = p.withColumns({"down": g.increasing_azimuth(F.lit(g.TWO_PI / 2) - F.col("turn")), "up": g.increasing_azimuth(F.lit(g.TWO_PI / 2) - F.col("turn"), clockwise=False)})
    return turned.select("pid", g.column_in_rotation(F.col("down"), 100).alias("column"), g.column_in_rotation(F.col("up"), 100).alias("column_up"), F.round(g.continuous_azimuth(F.col("rotation"), F.col("down")), 6).alias("continuous_azimuth"))


ROTATION_COLUMNS = POINTS + """,
turned AS (SELECT pid, col // 128 AS rotation, (az + 0.01) % (2 * pi()) AS turn FROM points)
SELECT pid, CAST(floor(turn / (2 * pi() / 100)) AS BIGINT) AS column, CAST(floor((2 * pi() - turn) / (2 * pi() / 100)) AS BIGINT) AS column_up, round(rotation * 2 * pi() + turn, 6) AS continuous_azimuth FROM turned
"""


FUNCTIONS = [points_cartesian, vector_algebra, pack_ids, column_minmax, late_points, wrap_sessions, seam_rotations, firing_stamps, full_cells, frame_images, topic_slice, time_jump_sessions, nearest_cell, laser_recovery, laser_gap_fill, pose_asof, frame_bounds, column_firings, motion_undone, ego_fog_filter, ignore_flags, neighbor_pairs, clusters_exact, cluster_stats, cluster_closing, released_columns, truth_clusters, detections_on_truth, ground_confusion, ose_frame, use_frame, metrics_rollup, label_confusion, conditional_clusters, stage_projection, ground_scan, cell_placement, stream_clusters, forced_clusters, nth_column_closing, nested_firings, view_pairs, frame_transforms, drive_sequences, pose_mixed, inclination_chain, cluster_columns, row_statistics, published_points, rotation_columns]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: globals()[f.__name__.upper()] for f in FUNCTIONS if f.__name__.upper() in globals()}
