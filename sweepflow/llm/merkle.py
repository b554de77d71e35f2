"""A Merkle tree over all rows of a dataset, and proofs that climb it by a recursive query.

A row is a leaf: the SHA-256 of its fields. Leaves of a language stand in the
order of their ids; every eight consecutive nodes become one by the SHA-256 of
their hex digests, until one remains, the subroot. Subroots, in the order of
their languages, become the root in the same way.

Levels are built from below, each an eighth of the one before, and stored as
node rows: a node, its parent, its place among the parent's children, and the
digests of its own children. A recursive query then climbs from every leaf: it
appends the siblings that it meets and folds its hash, tampered or not, up to
the root. The leaves of a run climb in one row.

Positions come from a range sort that is stored with its ranges, so no language
is one task: counts of (range, language) carry numbers over. Digests are kept
as 32 bytes and hashed as hex text.

Null fields count as `-`; the null language comes first, as do null ids. Rows
with the same id are ordered by their digest; equal rows are equal leaves, each
with its own place. Texts of any length are hashed whole. An empty table has no
nodes and gives an empty result. Other columns are not read, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: Children of a node, fields of a leaf.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots has this number; the others count from 0.
TOP = -1

CLIMB = """
WITH RECURSIVE climb (tree, pos, up_tree, up_at, slot, subroot, siblings, folded) AS (
  SELECT tree, pos, up_tree, up_at, slot, subroot, X'', folded FROM {runs}
  UNION ALL
  SELECT c.tree, c.pos, n.up_tree, n.up_at, n.slot, CASE WHEN n.is_subroot THEN n.digest ELSE c.subroot END,
         concat(c.siblings, substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33)),
         transform(c.folded, f -> unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.slot), f, substring(n.children, 32 * c.slot + 33)))), 256)))
  FROM climb c JOIN {nodes} n ON n.tree = c.up_tree AND n.at = c.up_at)
SELECT tree, pos, subroot, siblings, folded FROM climb WHERE up_at IS NULL
"""


def hash_fields(*fields: Column) -> Column:
    """SHA-256 of the fields as text, each with its length ahead of it, so that no two rows give the same text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_tampered(doc_id: Column) -> Column:
    """Where 3 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def hash_children(children: Column) -> Column:
    """The digest of a node from the digests of its children, one after the other as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(children)).cast("binary"), 256))


def place_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (the leaf of a tampered row, else null), tree (the number of the language in order), pos and n, the leaves of the tree."""
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in FIELDS)
    leaves = docs.select(
        doc_id.alias("doc_id"),
        lang.alias("lang"),
        F.unhex(hash_fields(doc_id, source, lang, n_chars, text)).alias("leaf"),
        F.when(is_tampered(doc_id), F.unhex(hash_fields(doc_id, source, lang, n_chars, lower_ascii(text)))).alias("tampered"),
    )
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ranged = leaves.repartitionByRange(F.col("lang").asc_nulls_first(), *order).withColumn("block", F.spark_partition_id())
    ranged = written(ranged, "merkle-ranges")
    parts = written(ranged.groupBy("block", "lang").agg(F.count(F.lit(1)).alias("n")), "merkle-parts")
    # Languages are numbered by the range in which they begin, then within it: no window holds more than a range's languages or the ranges.
    langs = parts.groupBy("lang").agg(F.min("block").alias("first"), F.sum("n").alias("total"))
    begun = langs.groupBy("first").agg(F.count(F.lit(1)).alias("k"))
    begun = begun.select("first", F.coalesce(F.sum("k").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = langs.withColumn("rank", F.row_number().over(W.partitionBy("first").orderBy(F.col("lang").asc_nulls_first())) - 1).join(begun, "first")
    numbered = numbered.select(F.col("lang").alias("l"), (F.col("before") + F.col("rank")).cast("long").alias("tree"), "total")
    start = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("start", start).join(numbered, F.col("lang").eqNullSafe(F.col("l"))).select(F.col("block").alias("b"), "l", "start", "tree", "total")
    within = F.row_number().over(W.partitionBy("block", "lang").orderBy(*order)) - 1
    placed = ranged.withColumn("within", within).join(written(starts, "merkle-starts"), (F.col("block") == F.col("b")) & F.col("lang").eqNullSafe(F.col("l")))
    return written(placed.select("doc_id", "leaf", "tampered", "tree", (F.col("start") + F.col("within")).alias("pos"), F.col("total").alias("n")), "merkle-placed")


def up(tree: Column, level: int, pos: Column, n: Column, trees: int) -> dict[str, Column]:
    """Parent and place among its children of a node on a level that has n nodes. The last one of a language's tree goes on in the tree of subroots; the root has no parent."""
    key = lambda p: F.lit((level + 1) << 48) + F.shiftright(p, 3)
    more, top = n > 1, (tree != TOP) & F.lit(trees > 1)
    return {
        "up_tree": F.when(more, tree).when(top, F.lit(TOP)).cast("long"),
        "up_at": F.when(more, key(pos)).when(top, F.lit(1 << 48) + F.shiftright(tree, 3)).cast("long"),
        "slot": F.when(more, pos % FAN).when(top, tree % FAN).cast("int"),
    }


def first_level(placed: DataFrame) -> DataFrame:
    """The runs of eight leaves: their rows, n (nodes of the tree on this level), digest, link, and the leaves' own hashes folded once. A lone leaf is its tree's only node."""
    leaf = F.struct(F.pmod("pos", F.lit(FAN)).alias("slot"), "doc_id", "leaf", "tampered")
    runs = placed.groupBy("tree", F.shiftright("pos", 3).alias("pos")).agg(F.array_sort(F.collect_list(leaf)).alias("leaves"), F.max("n").alias("n"))
    rows = runs.withColumn("children", F.aggregate("leaves", F.lit(b""), lambda t, x: F.concat(t, x["leaf"])))
    own = lambda x: F.coalesce(x["tampered"], x["leaf"])
    folded = F.transform("leaves", lambda x: hash_children(F.concat(F.substring(F.col("children"), F.lit(1), F.lit(32) * x["slot"]), own(x), F.substring(F.col("children"), F.lit(32) * x["slot"] + 33, F.lit(32 * FAN)))))
    lone = F.col("n") == 1
    rows = rows.withColumns({"digest": F.when(lone, F.col("children")).otherwise(hash_children(F.col("children"))), "folded": F.when(lone, F.transform("leaves", own)).otherwise(folded)})
    return rows.withColumn("n", F.ceil(F.col("n") / FAN).cast("long"))


def build_levels(nodes: DataFrame, level: int, most: int, trees: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stored levels above the given nodes (tree, pos, n, digest) on `level`, and the last nodes of the trees; `most` is the size of the largest tree."""
    levels, tops = [], []
    while most > 1:
        tops.append(nodes.where("n = 1"))
        runs = nodes.where("n > 1").groupBy("tree", F.shiftright("pos", 3).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.pmod("pos", F.lit(FAN)).alias("slot"), "digest"))).alias("run"), F.max("n").alias("n"))
        children = F.aggregate("run", F.lit(b""), lambda t, x: F.concat(t, x["digest"]))  # at most FAN of them
        level, most = level + 1, -(-most // FAN)
        rows = runs.select("tree", "pos", F.ceil(F.col("n") / FAN).cast("long").alias("n"), children.alias("children"))
        nodes = rows.withColumns({"digest": hash_children(F.col("children")), "at": F.lit(level << 48) + F.col("pos")})
        nodes = written(nodes.withColumns(up(F.col("tree"), level, F.col("pos"), F.col("n"), trees)), "merkle-level")
        levels.append(nodes)
    tops.append(nodes.where("n = 1"))
    return levels, tops


def together(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    first, *rest = [f.select(*columns) for f in frames]
    for f in rest:
        first = first.unionByName(f)
    return first


@contextmanager
def recursion_without_limit(spark: SparkSession) -> Iterator[None]:
    """A recursive query has a row for every run of leaves and level; the session's own limit comes back afterwards."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def build_tree(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, str | None]:
    """Runs of leaves, nodes above them (None where there are none) with their links to parents, and the root's hex digest (None for an empty table)."""
    placed = place_leaves(docs)
    size = placed.agg(F.max("n").alias("most"), F.max("tree").alias("last")).first()
    if size["most"] is None:
        return placed, None, None
    trees, most = size["last"] + 1, -(-size["most"] // FAN)
    runs = first_level(placed)
    runs = written(runs.withColumns({**up(F.col("tree"), 1, F.col("pos"), F.col("n"), trees), "subroot": F.when(F.col("n") == 1, F.col("digest"))}), "merkle-runs")
    levels, tops = build_levels(runs, 1, most, trees)
    subroots = written(together(tops, ["tree", "digest"]), "merkle-subroots")
    above, last = build_levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "digest"), 0, trees, trees)
    root = together(last, ["digest"]).select(F.lower(F.hex("digest")).alias("root")).first()["root"]
    stored = [f.withColumn("is_subroot", F.expr(f"tree <> {TOP} AND n = 1")) for f in [*levels, *above]]
    return runs, together(stored, ["tree", "at", "up_tree", "up_at", "slot", "children", "digest", "is_subroot"]) if stored else None, root


def prove(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    The leaves of a run meet the same siblings from there on, so they climb in
    one row: the siblings once, and a folded hash of each leaf.
    """
    spark = docs.sparkSession
    runs, nodes, root = build_tree(docs)
    if root is None:
        empty = runs.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
        return empty.where("false").withColumn("verified", F.lit(False))
    base = runs.select("tree", "pos", "up_tree", "up_at", "slot", "subroot", "folded")
    if nodes is None:
        climbed = base.withColumn("siblings", F.lit(b""))
    else:
        with recursion_without_limit(spark):
            climbed = written(spark.sql(CLIMB, runs=base, nodes=nodes), "merkle-proofs")
    joined = runs.select("tree", "pos", "leaves", "children").join(climbed.select("tree", "pos", "subroot", "siblings", "folded"), ["tree", "pos"])
    each = joined.select("subroot", "siblings", "children", F.explode(F.arrays_zip("leaves", "folded")).alias("x")).select("*", "x.leaves.*", F.col("x.folded").alias("own"))
    others = F.concat(F.substring(F.col("children"), F.lit(1), 32 * F.col("slot")), F.substring(F.col("children"), 32 * F.col("slot") + 33, F.lit(32 * FAN)), F.col("siblings"))
    text = lambda c: F.lower(F.hex(c))
    found = each.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(root).alias("root"), F.sha2(text(others).cast("binary"), 256).alias("proof_sha256"), text("own").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == root)
