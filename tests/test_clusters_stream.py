"""Clusters that come out of a stream: against the batch, against a plain loop, cut at several places, restarted, and run again."""

from __future__ import annotations

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sweepflow.jobs import queries as jobs
from sweepflow.operators import clusters
from sweepflow.streaming.clusters import INPUT, ClusterStream

SF = "/root/testdata/sf0.001"
BACK, APART, DISTANCE = 3, 2, 1.0


def cloud(seed, columns, num_columns, rows=4, streams=2):
    """Objects at several distances with a few gaps; one of them, without any, goes round the sensor."""
    r = random.Random(seed)
    out, pid = [], 0
    for s in range(streams):
        for c in range(columns):
            for k in range(rows):
                if k and r.random() < 0.15:
                    continue
                dist = 2.0 if k == 0 else r.choice([3.0, 9.0])
                az = 2 * math.pi * (c + 0.3 * r.random()) / num_columns
                inc = (1.5 - k) * 0.1
                out.append((s, pid, c, c, k, dist * math.cos(inc) * math.cos(-az), dist * math.cos(inc) * math.sin(-az), dist * math.sin(inc), dist, az, c * 1000 + k))
                pid += 1
    return out


def plain_clusters(rows, num_columns, force):
    """Columns one after the other, with all pairs in reach and a list of members for each cluster."""
    out = []
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1]))
        label, members, number, done = {}, {}, 1, {}
        for c in sorted({r[3] for r in own}):
            here = [r for r in own if r[3] == c]
            for p in here:
                label[p[1]], members[p[1]] = p[1], [p]
            for p in here:
                for q in own:
                    near = 0 <= c - q[3] <= BACK and abs(p[4] - q[4]) <= APART and (q[3] < c or q[4] < p[4]) and math.dist(p[5:8], q[5:8]) < DISTANCE
                    if near and label[p[1]] != label[q[1]] and not {label[p[1]], label[q[1]]} & set(done):
                        low, high = sorted((label[p[1]], label[q[1]]))
                        for m in members.pop(high):
                            label[m[1]] = low
                            members[low].append(m)
            least = min(p[9] for p in here)
            for k, m in sorted(members.items()):
                span = max(p[3] for p in m) - min(p[3] for p in m) + 1
                finish = max(p[9] + math.asin(min(1.0, DISTANCE / p[8])) for p in m)
                forced = force and span >= num_columns
                if k not in done and (forced or least >= finish):
                    done[k] = None
                    if len(m) > 5:
                        number += 1
                    out.append((s, k, len(m), min(p[3] for p in m), max(p[3] for p in m), c, forced, number - 1 if len(m) > 5 else 0))
    return sorted(out)


def new_stream(spark, num_columns=20, force=True):
    return ClusterStream(spark, tempfile.mkdtemp(prefix="stream-"), jobs.replace(jobs.CLUSTERING, max_distance=DISTANCE), num_columns, BACK, APART, force)


def result(stream):
    return sorted((r.stream_id, r.cluster_id, r.num_points, r.min_column, r.max_column, r.closing_column, r.forced, r.id) for r in stream.clusters().collect())


@pytest.mark.parametrize(("force", "cuts"), [(True, [0, 13, 14, 40, 70]), (True, [0, 70]), (False, [0, 33, 70])])
def test_stream_equals_plain_loop(spark, force, cuts):
    rows = cloud(5, 70, 20)
    df = spark.createDataFrame(rows, INPUT).cache()
    stream = new_stream(spark, force=force)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        stream.advance(df.where(F.col("col").between(a, b - 1)), k)
    stream.advance(df.limit(0), len(cuts), last=True)
    want = plain_clusters(rows, 20, force)
    assert result(stream) == want and (any(w[6] for w in want) == force)
    # Every point comes out once its column is released, with the id of its cluster, and every published cluster's points do.
    ids = {(w[0], w[1]): w[7] for w in want}
    out = stream.columns().collect()
    released = {r.stream_id: r.released for r in stream.sensors().collect()}
    assert len({r.pid for r in out}) == len(out) and {r.pid for r in out} == {r[1] for r in rows if r[3] < released[r[0]]}
    assert {r.id for r in out} <= {0, *ids.values()}
    sizes = {(r.stream_id, r.id): r["count"] for r in stream.cluster_points().groupBy("stream_id", "id").count().collect()}
    assert sizes == {(w[0], w[7]): w[2] for w in want if w[2] > 20}


def test_stream_restarts_and_counts_late_points(spark):
    rows = cloud(9, 60, 20, streams=1)
    path, state = tempfile.mkdtemp(prefix="in-"), tempfile.mkdtemp(prefix="state-")
    stream = new_stream(spark)

    def run():
        source = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(path)
        query = source.writeStream.foreachBatch(lambda df, k: stream.advance(df, k)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    for a, b in ((0, 20), (20, 35)):
        spark.createDataFrame([r for r in rows if a <= r[3] < b], INPUT).coalesce(1).write.mode("append").parquet(path)
    run()
    # The same micro-batch again, as after a failure: nothing is written twice.
    stream.advance(spark.createDataFrame(rows[:5], INPUT), 1)
    late = [(0, 100_000 + i, 3, 3, 0, 1.0, 1.0, 1.0, 2.0, 0.9, 5) for i in range(4)]
    spark.createDataFrame([r for r in rows if r[3] >= 35] + late, INPUT).coalesce(1).write.mode("append").parquet(path)
    stream = ClusterStream(spark, stream.path, stream.clustering, 20, BACK, APART)
    run()
    stream.advance(spark.createDataFrame([], INPUT), 99, last=True)
    assert result(stream) == plain_clusters(rows, 20, True)
    assert [r.n_late for r in stream.sensors().collect()] == [4]
    assert len(stream._states()) == 2


def test_batch_that_failed_half_way_is_written_anew(spark):
    rows = cloud(2, 40, 20, streams=1)
    df, stream = spark.createDataFrame(rows, INPUT).cache(), new_stream(spark)
    stream.advance(df.where("col < 20"), 0)
    store = stream._store
    stream._store = lambda d, path: (_ for _ in ()).throw(RuntimeError("lost")) if path.startswith("state/1/sensors") else store(d, path)
    with pytest.raises(RuntimeError, match="lost"):
        stream.advance(df.where("col >= 20"), 1)
    stream._store = store
    stream.advance(df.where("col >= 20"), 1)
    stream.advance(df.limit(0), 2, last=True)
    assert result(stream) == plain_clusters(rows, 20, True)


def test_stored_points_stay_level(spark):
    """Open clusters reach back no more than a rotation, however long the stream."""
    df, stream = spark.createDataFrame(cloud(4, 160, 20, rows=2, streams=1), INPUT).cache(), new_stream(spark)
    sizes = []
    for k in range(4):
        stream.advance(df.where(F.col("col").between(40 * k, 40 * k + 39)), k)
        sizes.append(stream._load(k, "points", INPUT + ", label long").count())
    assert max(sizes) <= 2 * (20 + BACK + 1)


def test_closing_looks_past_absent_columns(spark):
    found = spark.createDataFrame([(0, 1, 2 * math.pi * 11.5 / 128), (0, 2, 2 * math.pi * 3.2 / 128), (0, 3, 2 * math.pi * 90 / 128), (1, 4, 0.0)], "sensor int, cluster_id long, finish_azimuth double")
    columns = spark.createDataFrame([(0, c, 2 * math.pi * c / 128) for c in range(40) if not 10 <= c <= 16], "sensor int, col long, min_azimuth double")
    got = {r.cluster_id: r.closing_column for r in clusters.closing_columns(found, columns, ["sensor"], 128, block_columns=8).collect()}
    assert got == {1: 17, 2: 4, 3: None, 4: None}
