"""Frames of LiDAR sequences as a stream, and label files written frame by frame, as data sources of Spark.

Both open files by pyarrow's file systems, so that a folder may be a local one
or one in a store that they reach.

`register(spark)` makes the formats `lidar_frames` (readStream) and
`lidar_labels` (write) known to a session.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<f4")])
NAMES = ["sequence", "frame", "point_idx", "x", "y", "z", "i"]


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def frame_files(root: str) -> list[tuple[int, int, str]]:
    """Sequence, frame and path of SS/velodyne/NNNNNN.bin, in order."""
    system, base = store(root)
    found = [re.search(r"(\d+)/velodyne/(\d+)\.bin$", f.path) for f in system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)) if f.is_file]
    return sorted((int(m[1]), int(m[2]), m.string) for m in found if m)


@dataclass
class Frames(InputPartition):
    files: list[tuple[int, int, str]]


class FrameReader(DataSourceStreamReader):
    """Frames in order of sequence and number. An offset is the last frame that a trigger takes.

    A trigger takes `framesPerTrigger` frames at most, one task `framesPerTask`.
    Spark does not tell a source where it goes on from, so the last offset that
    was planned is kept in the folder `progress`, which belongs to the query as
    its checkpoint does. A frame that comes before the last offset is not read.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.progress = options["path"], options["progress"]
        self.most, self.each = int(options.get("framesPerTrigger", "100")), int(options.get("framesPerTask", "10"))

    def initialOffset(self) -> dict:
        return {"sequence": -1, "frame": -1}

    def _planned(self) -> dict:
        system, base = store(self.progress)
        path = posixpath.join(base, "planned.json")
        if system.get_file_info(path).type == pafs.FileType.NotFound:
            return self.initialOffset()
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        at = self._planned()
        after = [f for f in frame_files(self.root) if f[:2] > (at["sequence"], at["frame"])][: self.most]
        return {"sequence": after[-1][0], "frame": after[-1][1]} if after else at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        low, high = (start["sequence"], start["frame"]), (end["sequence"], end["frame"])
        planned = self._planned()
        if high > (planned["sequence"], planned["frame"]):
            system, base = store(self.progress)
            system.create_dir(base, recursive=True)
            with system.open_output_stream(posixpath.join(base, "planned.new")) as f:
                f.write(json.dumps(end).encode())
            system.move(posixpath.join(base, "planned.new"), posixpath.join(base, "planned.json"))
        files = [f for f in frame_files(self.root) if low < f[:2] <= high]
        return [Frames(files[i : i + self.each]) for i in range(0, len(files), self.each)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        system, _ = store(self.root)
        for sequence, frame, path in partition.files:
            with system.open_input_stream(path) as f:
                data = f.read()
            if len(data) % POINT.itemsize:
                raise ValueError(f"{path}: {len(data)} bytes are no multiple of {POINT.itemsize}")
            a = np.frombuffer(data, POINT)
            columns = [np.full(len(a), sequence, np.int32), np.full(len(a), frame, np.int32), np.arange(len(a), dtype=np.int32), *[np.ascontiguousarray(a[c]) for c in "xyzi"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) if c.dtype == np.float32 else pa.array(c) for c in columns], names=NAMES)


class FrameSource(DataSource):
    """readStream.format("lidar_frames"): points of the frames of a folder of sequences, NaN as null."""

    @classmethod
    def name(cls) -> str:
        return "lidar_frames"

    def schema(self) -> str:
        return "sequence int, frame int, point_idx int, x float, y float, z float, i float"

    def streamReader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class LabelWriter(DataSourceArrowWriter):
    """Writes uint16 label files. A task writes into a folder of the job; the commit moves files to their places, an abort deletes the folder.

    All rows of a frame come to one task, ordered by point_idx from 0 on without
    a gap, as write_label_files() deals them out. A file of an earlier job is
    replaced only if the job may overwrite.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.folder, self.overwrite = options["path"].rstrip("/"), options.get("folder", "labels_euclidean_clustering"), overwrite
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = store(self.root)
        task = posixpath.join(base, self.job, uuid.uuid4().hex)
        system.create_dir(task, recursive=True)
        files, key, parts, size = [], None, [], 0

        def close() -> None:
            name = f"{key[0]:02d}-{key[1]:06d}.label"
            with system.open_output_stream(posixpath.join(task, name)) as f:
                f.write(b"".join(parts))
            files.append((posixpath.join(task, name), posixpath.join(base, f"{key[0]:02d}", self.folder, f"{key[1]:06d}.label")))

        for batch in iterator:
            sequence, frame, at, label = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sequence", "frame", "point_idx", "label"))
            if len(label) and (label.min() < 0 or label.max() > 0xFFFF):
                raise ValueError(f"labels from {label.min()} to {label.max()} don't fit into 16 bits")
            cuts = np.flatnonzero((np.diff(sequence) != 0) | (np.diff(frame) != 0)) + 1
            for part in np.split(np.arange(len(label)), cuts):
                if not len(part):
                    continue
                here = (int(sequence[part[0]]), int(frame[part[0]]))
                if here != key:
                    if key:
                        close()
                    key, parts, size = here, [], 0
                if (at[part] != np.arange(size, size + len(part))).any():
                    raise ValueError(f"sequence {here[0]} frame {here[1]}: points have a gap or come twice")
                parts.append(label[part].astype("<u2").tobytes())
                size += len(part)
        if key:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = store(self.root)
        files = [f for m in messages if m for f in m.files]
        there = [] if self.overwrite else [to for _, to in files if system.get_file_info(to).type != pafs.FileType.NotFound]
        if there:
            self.abort(messages)
            raise FileExistsError(f"{len(there)} label files are there already, {there[0]} among them")
        folders = defaultdict(list)
        for a, b in files:
            folders[posixpath.dirname(b)].append((a, b))
        for folder, moves in folders.items():
            system.create_dir(folder, recursive=True)
            for a, b in moves:
                system.move(a, b)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = store(self.root)
        if system.get_file_info(posixpath.join(base, self.job)).type != pafs.FileType.NotFound:
            system.delete_dir(posixpath.join(base, self.job))


class LabelSink(DataSource):
    """write.format("lidar_labels"): rows of sequence, frame, point_idx and label."""

    @classmethod
    def name(cls) -> str:
        return "lidar_labels"

    def schema(self) -> str:
        return "sequence int, frame int, point_idx int, label int"

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(LabelSink)


def write_label_files(rows: DataFrame, path: str, label: str = "cluster_label", folder: str = "labels_euclidean_clustering", overwrite: bool = False) -> None:
    """Writes SS/<folder>/NNNNNN.label, a uint16 for each point in order; a frame is one sweep, so it fits a task."""
    register(rows.sparkSession)
    named = rows.selectExpr("sequence", "frame", "point_idx", f"CAST(`{label}` AS INT) AS label")
    dealt = named.repartition("sequence", "frame").sortWithinPartitions("sequence", "frame", "point_idx")
    dealt.write.format("lidar_labels").mode("overwrite" if overwrite else "append").option("path", path).option("folder", folder).save()
