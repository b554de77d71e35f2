"""Components of near vectors against all pairs in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepflow.jobs import queries as jobs
from sweepflow.operators import clusters, components, vectors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, label int, embedding array<double>"


def near(x, y, tolerance):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return False
    total = 0.0
    for a, b in zip(x, y):
        total += (a - b) * (a - b)
    return math.sqrt(total) < tolerance


def brute(rows, tolerance):
    """Smallest id that can be reached, for each id."""
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, x) in enumerate(rows):
        for j, b, y in rows[:k]:
            if None not in (i, j, a, b) and a == b and near(x, y, tolerance):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def found(spark, rows, tolerance, block):
    points = spark.createDataFrame(rows, SCHEMA)
    links = vectors.near_links(points, F.col("embedding"), tolerance, "label", "vec_id", block)
    out = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    return {i: out.get(i, i) for i, *_ in rows if i is not None}


def heaps(r, n, heaps, wide, spread, dims):
    """Vectors in heaps, some of which touch others: no component has most of them."""
    at = [[r.uniform(0, wide) for _ in range(dims)] for _ in range(heaps)]
    return [[c + r.gauss(0, spread) for c in r.choice(at)] for _ in range(n)]


def odd_rows():
    return [
        (2000, 1, None), (2001, 1, [NAN, 0.0, 0.0]), (2002, 1, [NAN, 0.0, 0.0]), (2003, 1, [INF, 0.0, 0.0]), (2004, 1, [INF, 0.0, 0.0]),
        (2005, 1, [None, 0.0, 0.0]), (2006, 1, [None, 0.0, 0.0]), (2007, None, [900.0, 0.0, 0.0]), (2008, None, [900.0, 0.0, 0.0]),
        (2009, 1, [901.0, 0.0]), (2010, 1, [901.0, 0.0]), (2011, 1, [901.0, 0.0, 0.0]), (None, 1, [901.0, 0.0]), (2012, 1, []), (2013, 1, []),
        (2014, 1, [950.0, 0.0, 0.0]), (2014, 2, [970.0, 0.0, 0.0]), (2015, 1, [950.5, 0.0, 0.0]), (2016, 2, [970.5, 0.0, 0.0]), (2016, 2, [970.5, 0.0, 0.0]),
        (2017, 3, [1e200, 0.0, 0.0]), (2018, 3, [1e200, 0.0, 0.0]), (2019, 3, [-1e200, 0.0, 0.0]),
    ]


@pytest.mark.parametrize("block", [40, 10_000])
def test_components_are_those_of_all_pairs(spark, block):
    r = random.Random(3)
    rows = [(i, i % 2, x) for i, x in enumerate(heaps(r, 240, 30, 30, 0.5, 3))]
    # All but a few in one component, and a component that lies only in blocks other than the first.
    rows += [(500 + i, 2, [r.gauss(0, 1) for _ in range(3)]) for i in range(150)] + [(700 + i, 2, [r.uniform(-40, 40) for _ in range(3)]) for i in range(30)]
    rows += [(800 + i, 4 + i, [0.0, 0.0, 0.0]) for i in range(20)] + odd_rows()
    assert found(spark, rows, 1.2, block) == brute(rows, 1.2)


def test_a_distance_of_the_tolerance_is_no_link(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, 0, [1.2, 0.0]), (3, 1, [0.0, 0.0]), (4, 1, [math.nextafter(1.2, 0), 0.0]), (5, 2, [1e6, 1e6]), (6, 2, [1e6 + 1.25, 1e6]), (7, 2, [1e6 + 1.25, 1e6 + 1.125])]
    assert found(spark, rows, 1.2, 100) == brute(rows, 1.2) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}


def test_join_tells_pairs_that_products_cannot():
    """Norms of 1e16 hide all differences from the products."""
    x = np.array([[1e8, k * 0.9] for k in (0, 1, 2, 4, 5, 8)])
    lab = np.arange(6)
    vectors.Near(x, 1.0).components(lab, lab.copy())
    assert lab.tolist() == [0, 0, 0, 3, 3, 5]


def test_conditional_clusters_makes_few_links(spark, tmp_path, monkeypatch):
    """All vectors of a label lie near each other: a link for each, not one for each pair."""
    r, seen = random.Random(1), []
    rows = [(i, i % 2, [r.uniform(0, 0.5) for _ in range(4)]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def counted(links):
        seen.append(links.count())
        return components.connected_components(links)

    monkeypatch.setattr(clusters, "connected_components", counted)
    out = jobs.conditional_clusters(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == [(0, 0, 200), (1, 1, 200)]
    assert seen[0] <= 2 * len(rows)
