"""Benchmark decontamination by Wu-Manber search over words.

An item's windows, all runs of ten consecutive words (all its words where they
are fewer), are the patterns. Windows of one length are searched together: a
table over blocks of two words says how far the search may jump from a
position, for it knows how far from a window's end each block stands in any
window. Where the jump is 0, the hash of the last words selects a bucket of
windows, the hash of the first ones a part of it, and a comparison of all words
confirms. Words are compared by their numbers in the items' vocabulary, so a
confirmed window is the same words; a word that no item has stops all windows
over it.

Each task searches a batch of texts at once: the words of all its texts are one
array, cut into lanes that jump side by side.

Items are taken in blocks of a fixed number of words, whose tables go to all
tasks, one block after another; so what a task holds has a bound whatever the
size of the benchmark. Marks of several blocks are put together document by
document. An item longer than a block comes in pieces that overlap.

Null texts have no words, and items without a word no window. An item without
an id marks words, but is not counted or named; items with the same id are one.
Texts of any length are searched whole. Rows are told apart by their place in
the table, so repeated ids do no harm. Empty tables give empty results. Columns
that are carried along give way to a result's columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, others, written

#: Bytes of words after A-Z are lowered: digits, letters and all that is not ASCII.
_WORD = [*range(48, 58), *range(97, 123), *range(128, 256)]
_TABLE = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WINDOW = 10
#: Words of a text that one lane of the search covers, and slots of the table of jumps (a power of two).
LANE, SLOTS = 256, 1 << 20
#: Words at the end of a window that select its bucket.
SUFFIX = 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def fold(words: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers."""
    h = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ (words[:, j].astype(np.uint64) + np.uint64(1))) * MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Patterns:
    """Distinct windows of one length with the tables of their search."""

    length: int
    windows: np.ndarray
    jumps: np.ndarray
    order: np.ndarray
    keys: np.ndarray
    block: int

    @staticmethod
    def slots(blocks: np.ndarray) -> np.ndarray:
        return (fold(blocks) & np.uint64(SLOTS - 1)).astype(np.int64)

    @staticmethod
    def bucket(windows: np.ndarray) -> np.ndarray:
        """What a window is sorted by: the hash of its last words above that of its first ones."""
        cut = max(0, windows.shape[1] - SUFFIX)
        return (fold(windows[:, cut:]) & np.uint64(0xFFFFFFFF00000000)) | (fold(windows[:, :cut]) >> np.uint64(32))

    @classmethod
    def build(cls, windows: np.ndarray) -> Patterns:
        m = windows.shape[1]
        block = min(2, m)
        jumps = np.full(SLOTS, m - block + 1, np.int8)
        for end in range(block, m + 1):
            np.minimum.at(jumps, cls.slots(windows[:, end - block : end]), np.int8(m - end))
        keys = cls.bucket(windows)
        order = np.argsort(keys, kind="stable")
        return cls(m, windows, jumps, order, keys[order], block)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions and numbers of the windows that occur in an array of word numbers."""
        m, n = self.length, len(words)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, n, LANE, dtype=np.int64)
        end = np.minimum(at + LANE, n)
        at = np.maximum(at, m - 1)
        found: list[np.ndarray] = []
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(at):
            blocks = np.stack([words[at - k] for k in range(self.block - 1, -1, -1)], axis=1)
            jump = self.jumps[self.slots(blocks)].astype(np.int64)
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < end
            at, end = at[on], end[on]
        ends = np.concatenate(found)
        seen = words[ends[:, None] + np.arange(1 - m, 1)]
        keys = self.bucket(seen)
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        many = last - first
        who = np.repeat(np.arange(len(ends)), many)
        which = self.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        same = (self.windows[which] == seen[who]).all(axis=1)
        return ends[who[same]], which[same]


@dataclass
class Index:
    """A block of items: vocabulary (numbers from 1), patterns by length, and for each pattern the numbers of its items."""

    vocabulary: dict[bytes, int]
    patterns: list[Patterns]
    owners: list[tuple[np.ndarray, np.ndarray]]
    ids: list[str | None]

    @classmethod
    def build(cls, items: list[tuple[str | None, list[bytes]]]) -> Index:
        """items: id and words, no more than WINDOW long or a run of windows."""
        vocabulary: dict[bytes, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(names)}
        for name, words in items:
            if not words:
                continue
            numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
            m = min(WINDOW, len(words))
            made = np.lib.stride_tricks.sliding_window_view(numbers, m)
            rows.setdefault(m, []).append(made)
            owner.setdefault(m, []).append(np.full(len(made), number.get(name, -1)))
        patterns, owners = [], []
        for m in sorted(rows):
            windows, which = np.unique(np.concatenate(rows[m]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owner[m])], axis=1), axis=0)
            patterns.append(Patterns.build(np.ascontiguousarray(windows)))
            owners.append((np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]))
        return cls(vocabulary, patterns, owners, names)

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each text the spans of hit words (first, one past the last; apart from each other), and the items found in it."""
        get = self.vocabulary.get
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        # 0, which no window has, stands for any other word and between texts.
        words = np.fromiter((x for t in texts for x in (*map(get, t, [0] * len(t)), 0)), np.int32, int(sizes.sum()))
        hit = np.zeros(len(words) + 1, np.int32)
        where: list[np.ndarray] = []
        which: list[np.ndarray] = []
        for patterns, (first, owned) in zip(self.patterns, self.owners):
            ends, windows = patterns.search(words)
            np.add.at(hit, ends - patterns.length + 1, 1)
            np.add.at(hit, ends + 1, -1)
            # A window that occurs again in the same text names the same items.
            text = np.searchsorted(starts, ends, "right") - 1
            pairs = np.unique(np.stack([text, windows], axis=1), axis=0)
            many = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
            where.append(np.repeat(pairs[:, 0], many))
            which.append(owned[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[pairs[:, 1]], many)])
        covered = np.concatenate([[0], (np.cumsum(hit)[:-1] > 0).astype(np.int8), [0]])
        begin, stop = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
        in_text = np.searchsorted(starts, begin, "right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for t, a, b in zip(in_text.tolist(), (begin - starts[in_text]).tolist() if len(begin) else [], (stop - starts[in_text]).tolist() if len(begin) else []):
            spans[t].append((a, b))
        items: list[list[str]] = [[] for _ in texts]
        if where:
            named = np.unique(np.stack([np.concatenate(where), np.concatenate(which)], axis=1), axis=0)
            for t, i in named.tolist():
                if i >= 0:
                    items[t].append(self.ids[i])
        return list(zip(spans, items))


def pieces(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Runs of at most `most` words that together have all windows."""
    for start in range(0, max(1, len(words) - WINDOW + 1), most - WINDOW + 1):
        yield words[start : start + most]


def item_pieces(items: DataFrame, item_id: str, text: str, most: int) -> DataFrame:
    """id (as text) and words of the items' pieces, equal ones once, with a running count of words by which they are dealt to blocks."""
    schema = "id string, words array<binary>, n long"

    def cut(batches):
        for batch in batches:
            out = [(i, p, len(p)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces(words_of(t), most) if p]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.binary())), pa.array([x[2] for x in out], pa.int64())], names=["id", "words", "n"])

    return items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, schema)


def blocks_of(found: DataFrame, most: int) -> tuple[int, Iterator[list[tuple[str | None, list[bytes]]]]]:
    """Number of blocks of the stored pieces, and the blocks, of about `most` words each: dealt out by hash, and only one on the driver at a time."""
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // most))
    place = F.pmod(F.xxhash64("id", "words"), F.lit(parts))

    def blocks():
        for k in range(parts):
            yield [(r["id"], [bytes(w) for w in r["words"]]) for r in found.where(place == k).select("id", "words").collect()]

    return parts, blocks()


def marks(docs: DataFrame, block: list[tuple[str | None, list[bytes]]], text: str, keep: list[str]) -> DataFrame:
    """Adds n_words, spans and items of one block to the columns in keep. The block's tables are a broadcast of a bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(Index.build(block))
    fields = [
        ("n_words", T.LongType()),
        ("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))),
        ("items", T.ArrayType(T.StringType())),
    ]

    def start():
        index = shared.value

        def work(texts: list[str | None]) -> dict[str, list]:
            cut = list(map(words_of, texts))
            found = index.search(cut)
            return {"n_words": list(map(len, cut)), "spans": [[{"first": a, "past": b} for a, b in s] for s, _ in found], "items": [i for _, i in found]}

        return work

    return annotate(docs, start, fields, text, keep)


def join_spans(spans: Column) -> Column:
    """How many places spans cover together."""
    sorted_spans = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda t, s: F.struct((t["n"] + F.greatest(F.lit(0), s["past"] - F.greatest(t["upto"], s["first"]))).cast("long").alias("n"), F.greatest(t["upto"], s["past"]).alias("upto"))
    return F.aggregate(sorted_spans, start, step)["n"]


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_words: int = 1_000_000) -> DataFrame:
    """Adds n_words, n_hit, items (ids of the items with occurring windows, sorted as text) and spans of hit words to documents."""
    carried = others(docs, ["n_words", "n_hit", "items", "spans"], keep)
    found = written(item_pieces(items, item_id, item_text, block_words).dropDuplicates(["id", "words"]), "benchmark-pieces")
    parts, blocks = blocks_of(found, block_words)
    if parts == 1:
        return marks(docs, next(blocks), text, carried).withColumn("n_hit", join_spans(F.col("spans")))
    # Rows of several blocks meet by a number of their own, on stored rows; texts stay behind.
    row = "row"
    while row in carried or row == text:
        row += "_"
    numbered = written(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, text])]).withColumn(row, F.monotonically_increasing_id()), "benchmark-rows")
    all_marks = [written(marks(numbered, b, text, [row]), "benchmark-marks") for b in blocks]
    every = all_marks[0]
    for m in all_marks[1:]:
        every = every.unionByName(m)
    merged = every.groupBy(row).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = numbered.select(*[F.col(f"`{c}`") for c in carried], row).join(merged, row).drop(row)
    return joined.withColumn("n_hit", join_spans(F.col("spans")))
