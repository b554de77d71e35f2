"""The trie of conversation prefixes, from sorted conversations and their longest common prefixes.

A turn becomes 16 bytes, the MD5 of its role and text, and a conversation the
bytes of its turns one after the other. Sorted by these bytes, all that begin
with the same turns stand side by side, and a prefix's members are an interval.
LCP j is the number of turns that conversation j shares with the one before it.

Each block of the sorted table has a sparse table of minima over ranges of a
power of two. Each candidate prefix, a conversation and a depth d, binary
searches in it for the last place to the left and the first to the right with
an LCP below d. Between them lie its members. A prefix is kept where the left
end is the candidate itself. No candidate needs another one, and there is no
stack. Where an interval leaves its block, a sparse table of the blocks' minima
finds the block in which it ends, and a join on that block's running minima the
place. Numbers over an interval (members, the smallest id, leaves, tokens that
are shared) come from running sums and minima in the same order.

The sorted table is dealt out by ranges into at most `most_blocks` blocks, of
about `block_rows` conversations each as long as that is enough; what the driver
holds is a few numbers for each block. A conversation is one row, with 24 bytes
for each turn.

Turns are ordered by turn (null first), then role and text; a null role or text
is empty; repeated rows are turns of their own. Rows without a conversation
belong to none and are left out. Equal conversations are members of the same
nodes. Texts of any length count whole. An empty table has no nodes. Other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_heavy, small_batches, written

#: Bytes of a turn, and how far conversations are rebuilt from the first one of their hundred.
TURN = 16
HUNDRED, HEADS = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max


def turn_lists(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (token, chars) in order."""
    role, text = F.coalesce(F.col("`role`"), F.lit("")), F.coalesce(F.col("`text`"), F.lit(""))
    token = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    one = F.struct(F.col("`turn`").alias("turn"), role.alias("role"), token.alias("token"), F.char_length(text).cast("long").alias("chars"))
    found = rows.where(F.col("`conv_id`").isNotNull()).select(F.col("`conv_id`").alias("conv_id"), one.alias("t"))
    # Null turns are sorted first; turns that tie in turn and role follow their tokens.
    return found.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["chars"].alias("chars"))).alias("turns"))


def rebuild(lists: DataFrame) -> DataFrame:
    """conv_id and turns, the first ones taken from the first conversation of the hundred. Each of those goes to a hundred ids at most."""
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    taken = lists.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS).alias("first"))
    own = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % HUNDRED, "h": heads})
    kept = F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))
    joined = own.join(taken, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h")))
    return joined.select("conv_id", F.concat("first", kept).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two conversations begin with in common."""
    n = min(len(a), len(b)) // TURN
    x, y = np.frombuffer(a, np.uint8, n * TURN), np.frombuffer(b, np.uint8, n * TURN)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) // TURN if len(differ) else n


def sort_conversations(lists: DataFrame, block_rows: int, most_blocks: int) -> DataFrame:
    """The stored sorted table: block, idx, conv_id, upto (characters of the first 0, 1, ... turns), lcp (null for a block's first row), and key for a block's first and last row."""
    upto = F.aggregate("turns", F.array(F.lit(0).cast("long")), lambda t, x: F.concat(t, F.array(F.element_at(t, -1) + x["chars"])))
    keyed = written(lists.select("conv_id", F.array_join(F.transform("turns", lambda x: F.hex(x["token"])), "").alias("key"), upto.alias("upto")).withColumn("key", F.unhex("key")), "trie-rows")
    blocks = min(most_blocks, max(1, -(-keyed.count() // block_rows)))
    schema = "block int, idx long, conv_id long, upto array<long>, lcp long, key binary"
    small_batches(lists.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, idx, held = None, 0, None
        names = ["block", "idx", "conv_id", "upto", "lcp", "key"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            rows = []
            for block, conv_id, key, upto in zip(*(c.to_pylist() for c in batch.columns)):
                if held:
                    rows.append(held)
                # The last row keeps its key; it is not known before the end, so each row waits for the next one.
                held = (block, idx, conv_id, upto, None if before is None else shared_turns(before, key), key if before is None else None)
                before, idx = key, idx + 1
            if rows:
                yield make(rows)
        if held:
            yield make([(*held[:5], before)])

    ranged = keyed.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id").select(F.spark_partition_id().alias("block"), "conv_id", "key", "upto")
    return written(ranged.mapInArrow(compare, schema), "trie-sorted")


class Minima:
    """A sparse table: minima over ranges of a power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def last_below(self, start: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The last place at or before start with a value below d; -1 if there is none."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            low = at - (1 << k) + 1
            whole = (low >= 0) & (self.levels[k][np.clip(low, 0, len(self.levels[k]) - 1)] >= d)
            at = np.where(whole, low - 1, at)
        return at

    def first_below(self, start: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The first place at or after start with a value below d; n if there is none."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            whole = (at + (1 << k) <= self.n) & (self.levels[k][np.clip(at, 0, len(self.levels[k]) - 1)] >= d)
            at = np.where(whole, at + (1 << k), at)
        return at

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum from first to last, both included; FAR where there is nothing between."""
        out = np.full(len(first), FAR)
        size = last - first + 1
        for k, level in enumerate(self.levels):
            fit = (size >= 1 << k) & ((size < 2 << k) | (k == len(self.levels) - 1))
            out[fit] = np.minimum(level[first[fit]], level[last[fit] - (1 << k) + 1])
        return out


class Blocks:
    """What every task knows of all blocks, a few numbers each: rows before it, LCP of its first row with the row before it, the smallest LCP, and sums."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.number = table["block"].to_numpy(np.int64)
        self.start, self.rows, self.border = (table[c].to_numpy(np.int64) for c in ("start", "rows", "border"))
        self.place = {int(b): i for i, b in enumerate(self.number)}

    def add(self, sums: pd.DataFrame) -> None:
        table = sums.set_index("block").loc[self.number]
        self.lcp = Minima(table["least_lcp"].to_numpy(np.int64))
        self.ids = Minima(table["least_id"].to_numpy(np.int64))
        self.shared, self.leaves = (np.concatenate([[0], np.cumsum(table[c].to_numpy(np.int64))]) for c in ("shared", "leaves"))


def block_table(rows: DataFrame) -> pd.DataFrame:
    """block, rows, start and border of the stored blocks, in order; their number has a bound."""
    ends = rows.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.min_by("key", "idx").alias("first"), F.max_by("key", "idx").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(W.orderBy("block")))

    @F.pandas_udf("long")
    def border(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None else shared_turns(bytes(x), bytes(y)) for x, y in zip(a, b)])

    found = before.select("block", "rows", border("before", "first").alias("border")).toPandas().sort_values("block", ignore_index=True)
    found["start"] = found["rows"].cumsum() - found["rows"]
    return found


def arrays_of(frame: pd.DataFrame, blocks: Blocks) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block in order: its place, LCPs, ids, upto, lengths, characters shared with the row before, whether a row is the last of a childless node, and whether it equals the row before."""
    frame = frame.sort_values("idx", ignore_index=True)
    b = blocks.place[int(frame["block"].iloc[0])]
    lcp = frame["lcp"].to_numpy(float)
    lcp = np.where(np.isnan(lcp), blocks.border[b], lcp).astype(np.int64)
    upto = [np.asarray(u, np.int64) for u in frame["upto"]]
    length = np.array([len(u) - 1 for u in upto], np.int64)
    shared = np.array([u[max(c, 0)] for u, c in zip(upto, lcp.tolist())], np.int64)
    after = blocks.border[b + 1] if b + 1 < len(blocks.border) else -1
    leaf = np.append(lcp[1:], after) < length
    return b, lcp, frame["conv_id"].to_numpy(np.int64), upto, length, shared, leaf, lcp == length


SUMS = "block int, least_lcp long, least_id long, shared long, leaves long"
STEPS = "block int, value long, last_value long, place long, side int, shared long, leaves long, least_id long"
NODES = "place long, depth long, block int, last long, least_id long, shared long, leaves long, ends_block int, up_place long, up_block int, upto long"
CHUNKS = "place long, depth long, up_block int, position long, ids string"


def block_sums(frame: pd.DataFrame, blocks: Blocks) -> pd.DataFrame:
    b, lcp, ids, _, _, shared, leaf, _ = arrays_of(frame, blocks)
    return pd.DataFrame({"block": [blocks.number[b]], "least_lcp": [lcp.min()], "least_id": [ids.min()], "shared": [shared.sum()], "leaves": [int(leaf.sum())]})


def block_steps(frame: pd.DataFrame, blocks: Blocks) -> pd.DataFrame:
    """Where a search that enters a block ends: for each new running minimum of the LCPs, from the left (side 1) and from the right (side -1), the depths above it and up to the minimum before, and sums of what lies ahead of the place."""
    b, lcp, ids, _, _, shared, leaf, _ = arrays_of(frame, blocks)
    parts = []
    for side, values in ((1, lcp), (-1, lcp[::-1])):
        running = np.minimum.accumulate(values)
        new = np.flatnonzero(np.diff(np.concatenate([[FAR], running])) < 0)
        place = new if side == 1 else len(lcp) - 1 - new
        least = np.concatenate([[FAR], np.minimum.accumulate(ids)])
        parts.append(pd.DataFrame({
            "block": blocks.number[b], "value": running[new], "last_value": np.concatenate([[FAR], running[new][:-1]]), "place": blocks.start[b] + place, "side": side,
            "shared": np.concatenate([[0], np.cumsum(shared)])[place], "leaves": np.concatenate([[0], np.cumsum(leaf)])[place], "least_id": least[place],
        }))
    return pd.concat(parts)


def block_nodes(frame: pd.DataFrame, blocks: Blocks) -> pd.DataFrame:
    """The nodes whose first member is in a block. Sums are over the block's members behind the first one and the whole blocks after it; ends_block and up_block say in which block the right end, and the parent's left end, have yet to be found."""
    b, lcp, ids, upto, length, shared, leaf, _ = arrays_of(frame, blocks)
    n, start = len(lcp), blocks.start[b]
    table, smallest = Minima(lcp), Minima(ids)
    who = np.repeat(np.arange(n), length + 1)
    depth = np.arange(len(who)) - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1)
    own = table.last_below(who, depth) == who  # else an earlier conversation has the prefix too
    who, depth = who[own], depth[own]
    end = table.first_below(who + 1, depth)
    # Beyond the block: the first block with a smaller LCP.
    target = np.where(end < n, -1, blocks.lcp.first_below(np.full(len(who), b + 1), depth))
    closed = (end < n) | (target >= blocks.lcp.n)
    upper = np.where(end < n, b, np.minimum(target, blocks.lcp.n) - 1)  # last whole block
    leaves, sums = np.concatenate([[0], np.cumsum(leaf)]), np.concatenate([[0], np.cumsum(shared)])
    within = end
    far = np.where(end < n, b, upper)
    up = table.last_below(who, depth - 1)
    crosses = (up < 0) & (depth > 0)
    # To the left: the last block before this one with an LCP below the parent's depth.
    left = np.where(crosses, blocks.lcp.last_below(np.full(len(who), b - 1), depth - 1), -1) if b else np.full(len(who), -1)
    return pd.DataFrame({
        "place": start + who, "depth": depth, "block": blocks.number[b],
        "last": np.where(end < n, start + end - 1, blocks.start[np.clip(far, 0, None)] + blocks.rows[np.clip(far, 0, None)] - 1),
        "least_id": np.minimum(smallest.least(who, within - 1), blocks.ids.least(np.full(len(who), b + 1), far)),
        "shared": sums[within] - sums[who + 1] + blocks.shared[far + 1] - blocks.shared[b + 1],
        "leaves": leaves[within] - leaves[who] + blocks.leaves[far + 1] - blocks.leaves[b + 1],
        "ends_block": pd.array(np.where(closed, None, blocks.number[np.clip(target, 0, len(blocks.number) - 1)]), "Int32"),
        "up_place": pd.array(np.where((depth == 0) | crosses, None, start + up), "Int64"),
        "up_block": pd.array(np.where(crosses, blocks.number[np.clip(left, 0, len(blocks.number) - 1)], None), "Int32"),
        "upto": np.array([upto[i][max(d - 1, 0)] for i, d in zip(who.tolist(), depth.tolist())], np.int64),
    })


def block_chunks(frame: pd.DataFrame, blocks: Blocks) -> pd.DataFrame:
    """Ids of equal conversations that stand together in a block, comma-joined, with the place of the first such conversation, or the block in which it has yet to be found."""
    b, lcp, ids, _, length, _, _, same = arrays_of(frame, blocks)
    begins = np.flatnonzero(np.concatenate([[True], ~same[1:]]))
    stops = np.append(begins[1:], len(ids))
    earlier = same[begins]  # only the block's first run can go on from the block before
    left = blocks.lcp.last_below(np.full(len(begins), b - 1), length[begins]) if b else np.full(len(begins), -1)
    return pd.DataFrame({
        "place": pd.array(np.where(earlier, None, blocks.start[b] + begins), "Int64"), "depth": length[begins],
        "up_block": pd.array(np.where(earlier, blocks.number[np.clip(left, 0, len(blocks.number) - 1)], None), "Int32"),
        "position": blocks.start[b] + begins, "ids": [",".join(map(str, ids[a:z].tolist())) for a, z in zip(begins.tolist(), stops.tolist())],
    })


def found_to_the_left(rows: DataFrame, steps: DataFrame, depth: Column) -> DataFrame:
    """Adds left_place: in up_block, the last place with an LCP below the depth. One step of a block covers each depth."""
    left = steps.where("side = -1").select(F.col("block").alias("up_block"), "value", "last_value", F.col("place").alias("left_place"))
    at = depth
    return rows.join(left, "up_block").where((F.col("value") < at) & (at <= F.col("last_value"))).drop("value", "last_value")


def join_ids(chunks: DataFrame) -> DataFrame:
    """place, depth and ends_sha256 of the nodes at which conversations end; chunks are hashed one after the other, so none is held with others."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher = None, None
        make = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([hasher.hexdigest()], pa.string())], names=["place", "depth", "ends_sha256"])
        for batch in batches:
            for place, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (place, depth) == now:
                    hasher.update(b"," + ids.encode())
                    continue
                if now:
                    yield make()
                now, hasher = (place, depth), hashlib.sha256(ids.encode())
        if now:
            yield make()

    ordered = chunks.repartition("place", "depth").sortWithinPartitions("place", "depth", "position")
    return ordered.select("place", "depth", "ids").mapInArrow(digest, "place long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, block_rows: int = 2000, most_blocks: int = 4096) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each distinct prefix of rebuilt conversations. Expects conv_id, turn, role and text."""
    ordered = sort_conversations(rebuild(turn_lists(rows)), block_rows, most_blocks)
    blocks = Blocks(block_table(ordered))
    each = lambda work, schema: ordered.groupBy("block").applyInPandas(lambda frame: work(frame, blocks), schema)
    if len(blocks.number):
        blocks.add(each(block_sums, SUMS).toPandas())
    steps = written(each(block_steps, STEPS), "trie-steps")
    nodes = written(each(block_nodes, NODES), "trie-nodes")
    columns = ["place", "depth", "last", "least_id", "shared", "leaves", "upto", "up_place"]
    # Right ends in later blocks.
    right = steps.where("side = 1").select(F.col("block").alias("ends_block"), "value", "last_value", F.col("place").alias("stop"), F.col("shared").alias("s"), F.col("leaves").alias("l"), F.col("least_id").alias("m"))
    wide = nodes.where("ends_block IS NOT NULL").join(right, "ends_block").where("value < depth AND depth <= last_value")
    wide = wide.withColumns({"last": F.col("stop") - 1, "least_id": F.least("least_id", "m"), "shared": F.col("shared") + F.col("s"), "leaves": F.col("leaves") + F.col("l")})
    ended = nodes.where("ends_block IS NULL").select(*columns, "up_block").unionByName(wide.select(*columns, "up_block"))
    # Left ends of parents in earlier blocks.
    linked = ended.where("up_block IS NULL").select(*columns).unionByName(found_to_the_left(ended.where("up_block IS NOT NULL"), steps, F.col("depth") - 1).withColumn("up_place", F.col("left_place")).select(*columns))
    full = written(linked.withColumn("n_convs", F.col("last") - F.col("place") + 1), "trie-intervals")
    chunks = written(each(block_chunks, CHUNKS), "trie-ends")
    named = chunks.where("up_block IS NULL").select("place", "depth", "position", "ids").unionByName(found_to_the_left(chunks.where("up_block IS NOT NULL"), steps, F.col("depth")).select(F.col("left_place").alias("place"), "depth", "position", "ids"))
    children = full.where("depth > 0").groupBy(F.col("up_place").alias("place"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    known = full.join(children, ["place", "depth"], "left").join(join_ids(named), ["place", "depth"], "left")
    saved = F.col("shared") - (F.col("n_convs") - 1) * F.col("upto")
    known = written(known.select(
        "place", "up_place", F.col("least_id").alias("conv_id"), "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    ), "trie-known")
    key = lambda place, depth: F.struct(F.col(place).alias("place"), depth.cast("long").alias("depth"))
    parents = known.where("n_children > 0").select(key("place", F.col("depth")).alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    below = join_heavy(known.where("depth > 0").withColumn("up", key("up_place", F.col("depth") - 1)), parents, "up")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*result).unionByName(known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*result))
