"""Readers of a folder of LiDAR sequences, all through Spark's own file sources.

A sequence folder SS holds velodyne/NNNNNN.bin (little-endian float32 x, y, z,
intensity), labels/NNNNNN.label (two uint16 a point), optional clusters (one
uint16 a point), times.txt, poses.txt and calib.txt. A binary file is decoded by
the task that read it; sequence, frame and the point's place in its file are
columns, on which labels are joined to points. A recorded drive DD holds
oxts/data/NNNNNNNNNN.txt, one row of GPS and IMU values a frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, labels

POINT = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<f4")]
LABEL = [("semantic_label", "<u2"), ("instance_label", "<u2")]
CLUSTER = [("cluster_label", "<u2")]
#: Rows of [R | t] from a camera's axes (right, down, forward) to a vehicle's (forward, left, up).
VEHICLE_FROM_CAMERA = [0.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0]
#: Places of the fields in a row of GPS and IMU values.
OXTS = {"lat": 0, "lon": 1, "alt": 2, "roll": 3, "pitch": 4, "yaw": 5, "forward": 8, "left": 9, "up": 10}
#: The drive and the frames, first and last, of which each sequence is a part.
SEQUENCES = [
    (0, "2011_10_03", "2011_10_03_drive_0027_sync", 0, 4540), (1, "2011_10_03", "2011_10_03_drive_0042_sync", 0, 1100), (2, "2011_10_03", "2011_10_03_drive_0034_sync", 0, 4660),
    (3, "2011_09_26", "2011_09_26_drive_0067_sync", 0, 800), (4, "2011_09_30", "2011_09_30_drive_0016_sync", 0, 270), (5, "2011_09_30", "2011_09_30_drive_0018_sync", 0, 2760),
    (6, "2011_09_30", "2011_09_30_drive_0020_sync", 0, 1100), (7, "2011_09_30", "2011_09_30_drive_0027_sync", 0, 1100), (8, "2011_09_30", "2011_09_30_drive_0028_sync", 1100, 5170),
    (9, "2011_09_30", "2011_09_30_drive_0033_sync", 0, 1590), (10, "2011_09_30", "2011_09_30_drive_0034_sync", 0, 1200),
]


def _numbers(path: Column) -> tuple[Column, Column]:
    """Sequence and frame from .../SS/<kind>/NNNNNN.<type>."""
    at = r"(\d+)/[^/]+/(\d+)\.[a-z]+$"
    return F.regexp_extract(path, at, 1).cast("int"), F.regexp_extract(path, at, 2).cast("int")


def read_flat(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """sequence, frame, point_idx and the fields of flat binary files. A file whose size is no multiple of a point stops the job."""
    kind = np.dtype(fields)
    types = {"f": "float", "u": "int"}
    schema = "sequence int, frame int, point_idx int, " + ", ".join(f"{n} {types[kind[n].kind]}" for n, _ in fields)

    def decode(batches):
        for batch in batches:
            for sequence, frame, data, name in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if len(data) % kind.itemsize:
                    raise ValueError(f"{name}: {len(data)} bytes are no multiple of {kind.itemsize}")
                a = np.frombuffer(data, kind)
                wide = [a[n] if kind[n].kind == "f" else a[n].astype(np.int32) for n, _ in fields]
                columns = [np.full(len(a), sequence, np.int32), np.full(len(a), frame, np.int32), np.arange(len(a), dtype=np.int32), *wide]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["sequence", "frame", "point_idx", *[n for n, _ in fields]])

    sequence, frame = _numbers(F.col("path"))
    return spark.read.format("binaryFile").load(path).select(sequence.alias("sequence"), frame.alias("frame"), "content", "path").mapInArrow(decode, schema)


def points(spark: SparkSession, root: str, sequence: str = "*") -> DataFrame:
    """Points; NaN coordinates become null."""
    found = read_flat(spark, f"{root}/{sequence}/velodyne/*.bin", POINT)
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in "xyz"})


def with_labels(found: DataFrame, spark: SparkSession, root: str, sequence: str = "*") -> DataFrame:
    """Adds the labels. A frame with more or fewer labels than points stops the job."""
    truth = read_flat(spark, f"{root}/{sequence}/labels/*.label", LABEL)
    keys = ["sequence", "frame", "point_idx"]
    joined = found.join(truth, keys, "full")
    both = F.col("x").isNotNull() | F.col("i").isNotNull()
    bad = (both != F.col("semantic_label").isNotNull()) & F.lit(True)
    message = F.format_string("sequence %s frame %s: labels and points differ in number", "sequence", "frame")
    return joined.withColumn("semantic_label", F.when(~bad, F.col("semantic_label")).otherwise(F.raise_error(message)))


def clusters(spark: SparkSession, root: str, sequence: str = "*") -> DataFrame:
    return read_flat(spark, f"{root}/{sequence}/labels_euclidean_clustering/*.label", CLUSTER)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """sequence, line and value: one small text file for each sequence, read whole, so that lines have numbers."""
    read = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    lines = read.select(F.regexp_extract("path", r"(\d+)/[^/]+$", 1).cast("int").alias("sequence"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("line", "value"))
    return lines.where("trim(value) <> ''")


def times(spark: SparkSession, root: str, sequence: str = "*", epoch_ns: int = 0) -> DataFrame:
    """sequence, frame and stamp_ns, counted from a fixed epoch rather than from the time of reading."""
    return _lines(spark, f"{root}/{sequence}/times.txt").select("sequence", F.col("line").alias("frame"), (F.round(F.trim("value").cast("double") * 1e9).cast("long") + epoch_ns).alias("stamp_ns"))


def _matrix(value: Column) -> Column:
    return F.transform(F.split(F.trim(value), r"\s+"), lambda x: x.cast("double"))


def poses(spark: SparkSession, root: str, sequence: str = "*") -> DataFrame:
    """sequence, frame and m, the rows of [R | t] of the camera's pose."""
    return _lines(spark, f"{root}/{sequence}/poses.txt").select("sequence", F.col("line").alias("frame"), _matrix(F.col("value")).alias("m"))


def calibration(spark: SparkSession, root: str, sequence: str = "*") -> DataFrame:
    """sequence, key (P0 to P3, Tr) and m."""
    found = _lines(spark, f"{root}/{sequence}/calib.txt")
    return found.select("sequence", F.trim(F.split("value", ":")[0]).alias("key"), _matrix(F.split("value", ":")[1]).alias("m"))


def sensor_poses(spark: SparkSession, root: str, sequence: str = "*", epoch_ns: int = 0) -> DataFrame:
    """sequence, frame, stamp_ns and m, the sensor's pose in axes of the vehicle, of each stamp.

    The camera's pose is turned to the vehicle's axes and joined with the
    sequence's Tr, camera from sensor. A stamp without a pose, or a sequence
    without Tr, stops the job; poses beyond the last stamp are left out.
    """
    from_sensor = calibration(spark, root, sequence).where("key = 'Tr'").select("sequence", F.col("m").alias("sensor"))
    found = times(spark, root, sequence, epoch_ns).join(poses(spark, root, sequence), ["sequence", "frame"], "left").join(from_sensor, "sequence", "left")
    turned = geometry.compose(F.array(*map(F.lit, VEHICLE_FROM_CAMERA)), geometry.compose(F.col("m"), F.col("sensor")))
    missing = F.raise_error(F.format_string("sequence %s frame %s: no pose or no calibration", "sequence", "frame"))
    return found.select("sequence", "frame", "stamp_ns", F.when(F.col("m").isNotNull() & F.col("sensor").isNotNull(), turned).otherwise(missing).alias("m"))


def static_transform(spark: SparkSession, path: str) -> DataFrame:
    """path and m of files with a line of nine numbers after R: and one of three after T:. A file without them stops the job."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    numbers = lambda key: _matrix(F.regexp_extract("value", rf"(?m)^{key}:[ \t]*(.*)$", 1))
    rows = read.select("path", numbers("R").alias("r"), numbers("T").alias("t"))
    m = F.array(*[x for i in range(3) for x in (F.col("r")[3 * i], F.col("r")[3 * i + 1], F.col("r")[3 * i + 2], F.col("t")[i])])
    broken = F.raise_error(F.concat("path", F.lit(": no R with nine and T with three numbers")))
    return rows.select("path", F.when((F.size("r") == 9) & (F.size("t") == 3), m).otherwise(broken).alias("m"))


def oxts(spark: SparkSession, root: str, drive: str = "*") -> DataFrame:
    """drive, frame and the fields of OXTS, from one small file a frame, of which the first line counts."""
    read = spark.read.text(f"{root}/{drive}/oxts/data/*.txt", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    at = r"([^/]+)/oxts/data/(\d+)\.txt$"
    numbered = read.select(F.regexp_extract("path", at, 1).alias("drive"), F.regexp_extract("path", at, 2).cast("int").alias("frame"), _matrix(F.split("value", "\r?\n")[0]).alias("v"))
    return numbered.select("drive", "frame", *[F.col("v")[i].alias(n) for n, i in OXTS.items()])


def sequences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEQUENCES, "sequence int, day string, drive string, first int, last int")


def in_sequences(rows: DataFrame, parts: DataFrame, drive: str = "drive", frame: str = "frame", bucket: int = 500) -> DataFrame:
    """Rows of recorded drives with the sequence they belong to and the frame within it; rows outside all sequences go.

    An interval join: a part is copied for each bucket of frames that it covers,
    and rows meet the parts of their own bucket, so that the join is on equal
    keys. A row comes once for each part that it lies in.
    """
    covered = parts.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket)))).select(F.col("drive").alias("__drive"), "__bucket", "sequence", "first", "last")
    kept = [c for c in rows.columns if c != frame]
    placed = rows.withColumn("__at", F.floor(F.col(frame) / bucket))
    met = placed.join(covered, (F.col(drive) == F.col("__drive")) & (F.col("__at") == F.col("__bucket")) & F.col(frame).between(F.col("first"), F.col("last")))
    return met.select(*kept, F.col(frame).alias("drive_frame"), "sequence", (F.col(frame) - F.col("first")).cast("int").alias("frame"))


def raw_stamps(spark: SparkSession, path: str) -> DataFrame:
    """frame and stamp_ns of lines with a date, a time and nine digits of a second, taken as UTC."""
    read = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("frame", "value")).where("trim(value) <> ''")
    seconds = F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(F.substring("value", 1, 19), "yyyy-MM-dd HH:mm:ss"), F.current_timezone()))
    return read.select("frame", (seconds * 1_000_000_000 + F.substring("value", 21, 9).cast("long")).alias("stamp_ns"))


def semantic_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(labels.SEMANTIC.items()), "semantic_label int, name string")
