"""Components of vectors of any width that lie near each other, without a table of all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..jobs.storage import written
from .components import connected_components
from .joins import join_heavy

#: Vectors of a key that a task compares with as many others, those that it multiplies at a time, and most partitions of a shuffle.
BLOCK, ROWS, PARTITIONS = 8192, 256, 10_000


def merge(lab: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the components of u and v. `lab` has the smallest member of each element's component."""
    while True:
        low, high = np.minimum(lab[u], lab[v]), np.maximum(lab[u], lab[v])
        apart = low != high
        if not apart.any():
            return
        root = np.arange(len(lab), dtype=lab.dtype)
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up
        lab[:] = root[lab]


class Near:
    """Vectors, and which of them are nearer to each other than the tolerance.

    Products of matrices find all pairs that may be, with a bound on what they
    are off by; the squares of differences, added in order as SQL adds them,
    then tell of each pair that is used.
    """

    def __init__(self, x: np.ndarray, tolerance: float):
        self.x, self.tolerance = x, tolerance
        with np.errstate(over="ignore"):
            squares = np.einsum("ij,ij->i", x, x)
            # Norms less than they are by more than the products are off by.
            least, ones = squares * (1 - 4 * (x.shape[1] + 4) * np.finfo(float).eps), np.ones(len(x))
            self.left, self.right = np.column_stack([x, least, ones]), np.column_stack([-2 * x, ones, least])

    def exact(self, i: np.ndarray, j: np.ndarray, most: int = 1 << 16) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), most):
            with np.errstate(over="ignore"):
                squares = (self.x[i[at : at + most]] - self.x[j[at : at + most]]) ** 2
                total = np.zeros(len(squares))
                for k in range(squares.shape[1]):
                    total += squares[:, k]
            out[at : at + most] = np.sqrt(total) < self.tolerance
        return out

    def join(self, lab: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Joins the components of all near pairs of `rows` and `columns`."""
        if not len(rows) or not len(columns):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            may = ~(self.left[rows] @ self.right[columns].T > self.tolerance * self.tolerance)
        columns, may = columns[kept := may.any(0)], may[:, kept]
        # Each element with a link to another component joins one: as often as components halve.
        while len(columns):
            across = may & (lab[rows][:, None] != lab[columns][None, :])
            down, right = np.flatnonzero(across.any(0)), np.flatnonzero(across.any(1))
            if not len(down):
                return
            i, j = np.append(across[:, down].argmax(0), right), np.append(down, across[right].argmax(1))
            if not (near := self.exact(rows[i], columns[j])).all():
                i, j = np.nonzero(across)
                near = self.exact(rows[i], columns[j])
                may = np.zeros_like(may)
                may[i[near], j[near]] = True
            merge(lab, rows[i[near]], columns[j[near]])

    def components(self, lab: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None) -> None:
        """Joins the components of all near pairs of `rows` and `columns`, of all pairs of `rows` where there are none.

        Pairs within one component need no look: those in the component that
        most of the columns are in look at the others only.
        """
        for at in range(0, len(rows), ROWS):
            some, others = rows[at : at + ROWS], rows[at:] if columns is None else columns
            if not len(others):
                return
            most = np.bincount(lab[others]).argmax()
            inside = lab[some] == most
            self.join(lab, some[inside], others[lab[others] != most])
            self.join(lab, some[~inside], others)


def vectors_of(table: pa.Table, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the vectors, for each width. Those with a value that is no finite number are near to none."""
    column = table.column(name).combine_chunks()
    flat, width = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(width) - width
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        x = flat[start[at][:, None] + np.arange(w)]
        whole = np.isfinite(x).all(1)
        yield at[whole], x[whole]


def groups_of(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The table's parts with equal keys."""
    codes = np.array([table.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in keys])
    part = np.unique(codes, axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        yield table.take(at)


def own_links(tolerance: float) -> Callable[[pa.Table], pa.Table]:
    """Links of each vector to the smallest id of its component within a block and the hub."""

    def work(table: pa.Table) -> pa.Table:
        out = [pa.table({"a": table.column("id")[:0], "b": table.column("id")[:0]})]
        for part in groups_of(table, ["key", "block"]):
            part = part.sort_by("id")
            lab = np.arange(len(part))
            for at, x in vectors_of(part, "p"):
                own = np.arange(len(at))
                Near(x, tolerance).components(own, own.copy())
                lab[at] = at[own]
            linked = np.flatnonzero(lab != np.arange(len(lab)))
            out.append(pa.table({"a": part.column("id").take(linked), "b": part.column("id").take(lab[linked])}))
        return pa.concat_tables(out)

    return work


def cross_links(tolerance: float) -> Callable[[pa.Table], pa.Table]:
    """Links of components, of which vectors that stand outside are near to any of a block."""

    def work(table: pa.Table) -> pa.Table:
        out = [pa.table({"a": table.column("component")[:0], "b": table.column("component")[:0]})]
        for part in groups_of(table, ["key", "outer", "block"]):
            names = part.column("component").combine_chunks().dictionary_encode()
            order = names.dictionary.take(pc.sort_indices(names.dictionary))
            number = pc.index_in(names.dictionary, order).to_numpy()[names.indices.to_numpy()].astype(int)
            lab = np.arange(len(order))
            outside = np.array(part.column("outside").to_pylist(), bool)
            for at, x in vectors_of(part, "p"):
                # Elements are named by the first of their component.
                first, mine = np.unique(lab[number[at]], return_index=True, return_inverse=True)[1:]
                own = first[mine]
                Near(x, tolerance).components(own, np.flatnonzero(outside[at]), np.flatnonzero(~outside[at]))
                merge(lab, number[at], number[at][own])
            linked = np.flatnonzero(lab != np.arange(len(lab)))
            out.append(pa.table({"a": order.take(linked), "b": order.take(lab[linked])}))
        return pa.concat_tables(out)

    return work


def near_links(points: DataFrame, coordinates: Column, tolerance: float, key: str, point_id: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of ids whose components are those of all pairs with an equal key and a distance below the tolerance.

    A link needs no pair of its own, so a vector has a few links however many
    are near it. Vectors of a key are dealt into blocks. First each block is
    compared within itself and with the first block of its key, the hub, which
    takes one copy of it. A pair within one component can change nothing, so
    only vectors outside the component that has the most of a key are compared
    with all others of that key, block by block. Where most vectors are in one
    component, the work grows with their number; where none is large, all pairs
    are compared, spread over tasks that hold two blocks each.

    Nulls are near to none, nor are vectors of different width.
    """
    there = F.col("id").isNotNull() & F.col("key").isNotNull() & F.col("p").isNotNull() & ~F.exists("p", lambda v: v.isNull())
    rows = points.select(F.col(key).alias("key"), F.col(point_id).alias("id"), coordinates.alias("p")).where(there).distinct()
    rows = written(rows, "vectors")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    blocks = F.ceil(F.col("__n") / block)
    figures = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(blocks > 1, blocks)), F.lit(0)).alias("blocks"), F.coalesce(F.sum(F.when(blocks == 1, F.col("__n"))), F.lit(0)).alias("small")).first()
    dealt = join_heavy(rows, sizes.withColumn("blocks", blocks), "key", total=figures["n"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "p"), "blocks"))
    hub = dealt.where("block = 0 AND blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    # Keys of one block share groups, so that many small keys are no small tasks.
    shared = max(1, -(-figures["small"] // block))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(shared))).otherwise(F.xxhash64("key", "block"))
    kind = dict(rows.dtypes)["id"]
    grouped = dealt.unionByName(hub).withColumn("group", group).repartition(min(PARTITIONS, shared + figures["blocks"]), "group").groupBy("group")
    first = grouped.applyInArrow(own_links(tolerance), f"a {kind}, b {kind}")
    if not figures["blocks"]:
        return first
    found = connected_components(first)
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    large = dealt.where("blocks > 1").drop("block").join(found.withColumnRenamed("node", "id"), "id", "left")
    large = large.withColumn("component", F.coalesce("component", "id"))
    most = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("most"))
    # One row for each key that has more than one block.
    outside = written(large.join(F.broadcast(most), "key").where("component <> most").drop("most"), "vectors-outside")
    counts = outside.groupBy("key", "blocks").agg(F.ceil(F.count(F.lit(1)) / block).alias("outers"))
    groups = counts.agg(F.coalesce(F.sum(F.col("blocks") * F.col("outers")), F.lit(0)).alias("n")).first()["n"]
    if not groups:
        return links
    counts = F.broadcast(counts.select("key", "outers"))
    own, every = F.pmod(F.xxhash64("id", "p"), "outers"), F.pmod(F.xxhash64("id", "p"), "blocks")
    name = lambda c, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)
    left = outside.join(counts, "key").select("key", "component", "p", F.lit(True).alias("outside"), own.alias("outer"), name("block", "blocks"))
    right = large.join(counts, "key").select("key", "component", "p", F.lit(False).alias("outside"), every.alias("block"), name("outer", "outers"))
    pairs = left.unionByName(right).withColumn("group", F.xxhash64("key", "outer", "block"))
    more = pairs.repartition(min(PARTITIONS, groups), "group").groupBy("group").applyInArrow(cross_links(tolerance), f"a {kind}, b {kind}")
    return links.unionByName(more)
