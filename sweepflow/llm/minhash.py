"""Near-duplicate documents: circulant MinHash for candidates, full sets for links.

A document's set holds its distinct shingles. Documents with equal sets are one
class from the start. A first permutation scatters a set over 2^32 places; a
second one, shifted around the circle by a different amount for each
coordinate, gives every coordinate of the signature. Bands of coordinates are
hashed to buckets.

Within a bucket not all pairs are made. Every member is compared, on full
sets, with the bucket's hub, its best connected class: what the comparison leaves of
a member is its difference from the hub. Two members of which one has no link
to the hub can only be linked if their differences overlap by an amount that
follows from the sizes, so those pairs come from a prefix join on the elements
of the differences, those that the fewest members have first, with the same
exact test at the end. Elements whose members
are all in one component by then are left out: they can join nothing. So a
group of n near copies costs about n comparisons for each of its buckets, and a
bucket has no limit on its size.

With BANDS bands of ROWS rows, a pair exactly at similarity 0.85 shares no
bucket with a chance of 6e-9 (about 1e-5 at 0.8), and no pair is linked that
isn't similar enough. Documents without words (or text) have the empty set,
no links, and are their own component. Null ids are never the smallest of a
component that has any other id. Rows that repeat an id are rows of their own
with the set of their own text. A text of any length is read whole. Columns but
id and text are not read by components_of, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .common import annotate, aside, back, join_heavy, small_batches, written


@dataclass(frozen=True)
class Near:
    """Shingle length, similarity in hundredths, bands, and the size of the filter of classes that have partners."""

    words: int = 3
    percent: int = 85
    bands: int = 40
    rows: int = 6
    filter_bits: int = 1 << 23
    seed: int = 1


BLOCK = 1 << 15
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def scatter(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes of words, kept up to a bound, and sets of shingles as sorted arrays of 64-bit numbers."""

    def __init__(self, size: int, most: int = 200_000):
        self.size, self.most, self.known = size, most, {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        h = self.word_hashes(words)
        k = min(self.size, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total = scatter(total * MIX[2] + h[j : j + n])
        return np.unique(total)


class Signer:
    """Signatures of many sets at once, cut into bands."""

    def __init__(self, near: Near):
        self.near = near
        r = np.random.default_rng(near.seed)
        #: How far the second permutation is shifted for each coordinate.
        self.shifts = r.integers(0, 1 << 32, near.bands * near.rows, np.uint32)
        self.first, self.second = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each set; none is empty."""
        out = np.empty((len(sets), len(self.shifts)), np.uint32)
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        flat = np.concatenate(sets)
        place = (scatter(flat ^ MIX[2]) >> np.uint64(32)).astype(np.uint32) * self.first
        # The permutation multiplies by an odd number first, so a shift before it is a shift after it by a multiple.
        buffer, spare = np.empty_like(place), np.empty_like(place)
        for k, s in enumerate(self.shifts * self.first):
            np.add(place, s, out=buffer)
            np.right_shift(buffer, np.uint32(15), out=spare)
            np.bitwise_xor(buffer, spare, out=buffer)
            np.multiply(buffer, self.second, out=buffer)
            out[:, k] = np.minimum.reduceat(buffer, starts)
        return out

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """One 64-bit bucket for each band of each set. Sets are signed in blocks that stay in the cache; a larger one in pieces."""
        rows, at = [], 0
        while at < len(sets):
            end, held = at, 0
            while end < len(sets) and (end == at or held + len(sets[end]) <= BLOCK):
                held += len(sets[end])
                end += 1
            if end == at + 1 and held > BLOCK:
                parts = [sets[at][i : i + BLOCK] for i in range(0, held, BLOCK)]
                rows.append(np.min([self.signatures([p])[0] for p in parts], axis=0)[None])
            else:
                rows.append(self.signatures(sets[at:end]))
            at = end
        signed = np.concatenate(rows).reshape(len(sets), self.near.bands, self.near.rows).astype(np.uint64)
        total = np.broadcast_to(np.arange(self.near.bands, dtype=np.uint64), signed.shape[:2]).copy()
        for j in range(self.near.rows):
            total = scatter(total * MIX[2] + signed[:, :, j])
        return total.view(np.int64)


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sign(docs: DataFrame, near: Near, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, cls (null for the empty set) and bands."""

    def start():
        shingler, signer = Shingler(near.words), Signer(near)

        def work(texts):
            sets = list(map(shingler.shingles, texts))
            some = [s for s in sets if len(s)]
            bands = iter(signer.bands(some) if some else [])
            return {"n_shingles": list(map(len, sets)), "cls": [class_of(s) if len(s) else None for s in sets], "bands": [next(bands) if len(s) else None for s in sets]}

        return work

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return annotate(rows, start, [("n_shingles", T.LongType()), ("cls", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], keep=["doc_id"])


def hub_pairs(signed: DataFrame) -> DataFrame:
    """Distinct (cls, hub): each class with the hub of each of its buckets that has another one.

    A bucket's hub is the member whose buckets have the most members in all
    (of several the largest class). In a group of near copies that is one with
    few edits of its own, and the same one in most buckets.
    """
    classes = signed.where("cls is not null").groupBy("cls").agg(F.first("bands").alias("bands"))
    entries = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(entries.join(sizes, "bucket"), "shared-buckets")
    ranked = shared.join(shared.groupBy("cls").agg(F.sum("n").alias("rank")), "cls").select("cls", "bucket", "rank")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("rank", "cls")).alias("hub")).select("bucket", F.col("hub.cls").alias("hub"))
    return shared.select("cls", "bucket").join(hubs, "bucket").where("cls <> hub").select("cls", "hub").distinct()


def slot_of(cls: Column, bits: int) -> Column:
    return F.conv(F.hex(F.substring(cls, 1, 6)), 16, 10).cast("long") % bits


def sets_of(docs: DataFrame, wanted: DataFrame, near: Near, text: str) -> DataFrame:
    """cls and shingles (bytes) of the classes in `wanted`, made from the texts again.

    A bit array of fixed size, near.filter_bits, tells the tasks which classes
    may be wanted, so that the other sets are never shuffled; a join with
    `wanted` removes what the array lets through by chance.
    """
    bits = near.filter_bits
    slots = wanted.select(slot_of(F.col("cls"), bits).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("word")).collect()
    table = np.zeros(bits // 32, np.uint32)
    for r in words:  # as many as the array has words, at most
        table[r["at"]] = r["word"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def start():
        shingler, have = Shingler(near.words), shared.value

        def work(texts):
            out = {"cls": [], "shingles": []}
            for s in map(shingler.shingles, texts):
                cls = class_of(s) if len(s) else None
                slot = int.from_bytes(cls[:6], "big") % bits if cls else 0
                found = cls is not None and have[slot >> 5] >> np.uint32(slot & 31) & np.uint32(1)
                out["cls"].append(cls if found else None)
                out["shingles"].append(s.tobytes() if found else None)
            return out

        return work

    made = annotate(docs.select(F.col(f"`{text}`").alias("text")), start, [("cls", T.BinaryType()), ("shingles", T.BinaryType())], keep=[])
    # Copies become one in their tasks, before anything is shuffled.
    return made.where("cls is not null").groupBy("cls").agg(F.first("shingles").alias("shingles")).join(wanted, "cls", "left_semi")


def compare_with_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cls, hub, hub_size, and the member's difference from the hub: `added` and `removed` elements, sorted, as bytes; weight, and whether they are linked.

    With a removed and p added elements of a hub of h, two members X and Y have
    h - aX - aY + o elements in common and h + pX + pY - o in all, where o is
    what their differences share. So they are linked if
    (100 + percent) * o >= weight(X) + weight(Y) - (100 - percent) * h, where
    weight = percent * p + 100 * a, and a member is linked to the hub if its
    weight is at most (100 - percent) * h.
    """
    small_batches(pairs.sparkSession)
    own = pairs.groupBy("cls").agg(F.collect_list("hub").alias("hubs")).join(sets, "cls")  # a class has no more hubs than bands
    moved = own.select("cls", "shingles", F.explode("hubs").alias("hub"))
    both = moved.join(sets.select(F.col("cls").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub").select("cls", "hub", "shingles", "hub_shingles")
    schema = T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("hub", T.BinaryType()), T.StructField("hub_size", T.LongType()), T.StructField("added", T.ArrayType(T.LongType())), T.StructField("removed", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            sizes, added, removed = [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                sizes.append(len(b))
                added.append(np.setdiff1d(a, b, assume_unique=True))
                removed.append(np.setdiff1d(b, a, assume_unique=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(sizes, pa.int64()), pa.array(added, arrow.field(3).type), pa.array(removed, arrow.field(4).type)], schema=arrow)

    weight = (percent * F.size("added") + 100 * F.size("removed")).cast("long")
    return both.mapInArrow(run, schema).withColumn("weight", weight).withColumn("linked", F.col("weight") <= (100 - percent) * F.col("hub_size"))


def by_rarity(compared: DataFrame) -> DataFrame:
    """Adds `difference`, added and removed elements, those first that the fewest members of the hub have in theirs.

    Rows and the hub's elements go by numbers of 64 bits on the way; elements
    whose hashes agree are counted together, and any order is right.
    """
    rows = written(compared.withColumn("row", F.monotonically_increasing_id()), "strays")
    exploded = rows.select("row", "hub", F.explode(F.concat("added", "removed")).alias("element")).select("row", F.xxhash64("hub", "element").alias("key"), "element")
    counts = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("__n", F.col("n"))
    ranked = join_heavy(exploded, counts, "key", how="left").select("row", F.struct(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "element").alias("x"))
    ordered = ranked.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["element"]).alias("difference"))
    return rows.drop("added", "removed").join(ordered, "row").drop("row")


def probe_and_index(compared: DataFrame, components: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of hubs that have strays, and the elements by which strays look for others and by which members are found."""
    hundred, spare = 100 + percent, 100 - percent
    strays = compared.where(~F.col("linked")).select("hub").distinct()
    known = components.select(F.col("node").alias("cls"), "component")
    rows = compared.join(strays, "hub", "left_semi").join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    rows = written(by_rarity(rows), "differences")
    size = F.size("difference")
    elements = rows.select("cls", "hub", "hub_size", "weight", "linked", "component", size.alias("size"), F.posexplode("difference").alias("at", "element"))
    # What two differences share weighs at least `percent` an element in the other one too, so 100 times it is at least this weight less spare * hub_size.
    least = F.ceil((F.col("weight") - spare * F.col("hub_size")) / 100)
    least_any = F.greatest(F.floor(F.col("weight") / hundred) + 1, least)
    least_stray = F.greatest(F.floor((F.col("weight") - spare * F.col("hub_size") - 1) / hundred) + 1, least)
    index = elements.where(F.col("at") <= F.col("size") - least_any)
    probe = elements.where(~F.col("linked") & (F.col("at") <= F.col("size") - least_stray))
    # Elements of one component alone can join nothing, and neither can a row that fits not even the best one on the other side of its element.
    rest = F.col("size") - F.col("at")
    sides = [df.select("hub", "element", "component", *[v.alias(f"{n}_{m}") if n == own else F.lit(None).cast("long").alias(f"{n}_{m}") for n in "pq" for m, v in (("weight", F.col("weight")), ("rest", rest.cast("long")))]) for own, df in (("p", probe), ("q", index))]
    best = [F.min("component").alias("x"), F.max("component").alias("y"), *[f(f"{n}_{m}").alias(f"{n}_{m}") for n in "pq" for m, f in (("weight", F.min), ("rest", F.max))]]
    mixed = sides[0].unionByName(sides[1]).groupBy("hub", "element").agg(*best).where("x <> y")
    fits = lambda n: hundred * F.least(rest, F.col(f"{n}_rest")) >= F.col("weight") + F.col(f"{n}_weight") - spare * F.col("hub_size")
    met = lambda df, n: df.join(mixed, ["hub", "element"]).where(fits(n)).select(*df.columns)
    return rows, met(probe, "q"), met(index, "p")


def remaining_links(compared: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of the same hub that lie in different components; at least one has no link to the hub."""
    hundred, spare = 100 + percent, 100 - percent
    rows, probe, index = probe_and_index(compared, components, percent)
    p, q = probe.alias("p"), index.alias("q")
    c = lambda name: F.col(name)
    most = F.least(c("p.size") - c("p.at"), c("q.size") - c("q.at"))
    needed = c("p.weight") + c("q.weight") - spare * c("p.hub_size")
    on = (c("p.hub") == c("q.hub")) & (c("p.element") == c("q.element")) & (c("p.component") != c("q.component")) & (hundred * most >= needed)
    candidates = p.join(q, on).select(c("p.hub").alias("hub"), F.least("p.cls", "q.cls").alias("a"), F.greatest("p.cls", "q.cls").alias("b")).distinct()
    side = lambda n: rows.select("hub", F.col("cls").alias(n), F.col("weight").alias(f"{n}_weight"), F.col("difference").alias(f"{n}_difference"), F.col("hub_size").alias(f"{n}_hub_size"))
    checked = candidates.join(side("a"), ["hub", "a"]).join(side("b"), ["hub", "b"])
    shared = F.size(F.array_intersect("a_difference", "b_difference"))
    return checked.where(hundred * shared >= F.col("a_weight") + F.col("b_weight") - spare * F.col("a_hub_size")).select("a", "b")


def components_of(docs: DataFrame, near: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (it is its component's smallest id) for each row."""
    signed = written(sign(docs, near, doc_id, text), "signed")
    pairs = written(hub_pairs(signed), "hub-pairs")
    wanted = pairs.select("cls").unionByName(pairs.select(F.col("hub").alias("cls"))).distinct()
    sets = written(sets_of(docs, wanted, near, text), "sets")
    compared = written(compare_with_hubs(pairs, sets, near.percent), "compared")
    links = compared.where("linked").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    first = connected_components(links)
    more = remaining_links(compared, first, near.percent)
    # The components so far stand for their links.
    final = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # Rows without a word are set aside; a class or a component may have a large share of the others.
    rows = signed.where("cls is not null").select("doc_id", "n_shingles", "cls")
    classes = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("__n"), F.min("doc_id").alias("smallest")).join(final.withColumnRenamed("node", "cls"), "cls", "left")
    classes = written(classes.withColumn("component", F.coalesce("component", "cls")), "classes")
    components = classes.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("__classes"))
    owners = join_heavy(classes.drop("smallest").withColumnRenamed("__n", "__rows"), components.withColumnRenamed("__classes", "__n"), "component")
    owners = written(owners.select("cls", "component_id", F.col("__rows").alias("__n")), "owners")
    joined = join_heavy(rows, owners, "cls").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, near: Near = Near(words=5, percent=80, bands=50, rows=5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are their component's smallest id; of rows with the same id and text, one.

    All columns stay. With 50 bands of 5 rows, a pair exactly at similarity 0.8
    shares no bucket with a chance of 2e-9.
    """
    key, no_key = F.coalesce(F.col(f"`{doc_id}`"), F.lit(0).cast("long")), F.col(f"`{doc_id}`").isNull()
    kept = components_of(docs, near, doc_id, text).where("kept").select(F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("key"), F.col("doc_id").isNull().alias("no_key")).distinct()
    rows = docs.select(*aside(docs.columns), key.alias("key"), no_key.alias("no_key"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").isNull().alias("no_text"))
    # The join has dealt the rows out by id, which serves the second step too.
    return rows.join(kept, ["key", "no_key"], "left_semi").dropDuplicates(["key", "no_key", "hash", "no_text"]).select(*back(docs.columns))
