"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text's paragraphs are its lines. A fingerprint is the number of paragraphs and
the sum of their vectors: the SHA-512 of a paragraph gives WIDE numbers of 60
bits, and each is summed modulo 2^60. The order of the paragraphs plays no part;
paragraphs are put in and taken out by adding and subtracting. Equal multisets
have equal fingerprints, and others differ but for a chance of 2^-480 or so.

For the likeness of texts that share parts of paragraphs a second vector goes
along, of pieces of paragraphs: cut after the ends of sentences and clauses, and
where a clause runs on for PIECE characters. The bits of a piece's SHA-256 are
its vector of LANES zeros and ones; two lanes of 30 bits are in a word, summed
modulo 2^60. The likeness of two fingerprints is the cosine of these sums, with
ones and minus ones for bits, and not below 0: the share of pieces that the
texts have in common, give or take a tenth for the chance of the hash. Pieces
begin anew with each paragraph, so both vectors are sums over paragraphs.

Null text counts as empty: no paragraphs. Two empty fingerprints have likeness
1, an empty one and another have 0. Texts of any length are handled row by row:
a text has less than 2^30 pieces, so lanes don't run over. Columns but id and
text are not read by compare_edits, so their names can't clash; a column
`fingerprint` gives way to the result of fingerprints(). Rows of an id that very
many rows have, null among them, are dealt out over several keys of the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import aside, back, join_heavy, others, written

#: Ids with more than one in so many of the rows are split.
PARTS = 1000
#: Parameters of the hash; fingerprints made with different ones can't be compared.
WIDE, PIECE, WORDS, SHIFTS, BITS = 8, 80, 2, 30, 30
LANES = WORDS * SHIFTS * 2
MODULUS = 1 << 60
MASK = 1 | 1 << BITS
ENDS = r"\n.!?,;:|"
PIECES = rf"[^{ENDS}]{{1,{PIECE}}}[{ENDS[2:]}]*\n?|[{ENDS[2:]}]+\n?|\n"


def paragraphs(text: Column) -> Column:
    """Lines, each with the line end that it has."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), 0)


def pieces(text: Column) -> Column:
    """Pieces of a text; no piece goes on after a line end."""
    return F.regexp_extract_all(text, F.lit(PIECES), 0)


def with_fingerprint(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds <prefix>_n, the number of paragraphs, <prefix>_wide, the sum of their vectors, and of the pieces <prefix>_pieces and <prefix>_sums. `text` isn't null.

    Each step is a projection of its own, so that no digest is computed twice.
    """
    digests, fine, words = f"{prefix}_digests", f"{prefix}_fine", [f"{prefix}_word{k}" for k in range(WORDS)]
    df = df.withColumns({digests: F.transform(paragraphs(F.col(text)), lambda p: F.sha2(p, 512)), fine: F.transform(pieces(F.col(text)), lambda p: F.sha2(p, 256))})
    number = lambda k: lambda d: F.conv(F.substring(d, 1 + 15 * k, 15), 16, 10).cast("long")
    df = df.withColumns({w: F.transform(fine, number(k)) for k, w in enumerate(words)})
    plain = lambda k: lambda total, d: (total + number(k)(d)).bitwiseAND(F.lit(MODULUS - 1))
    add = lambda j: lambda total, h: (total + F.shiftright(h, j).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MODULUS - 1))
    wide = F.array(*[F.aggregate(digests, F.lit(0).cast("long"), plain(k)) for k in range(WIDE)])
    sums = F.array(*[F.aggregate(w, F.lit(0).cast("long"), add(j)) for w in words for j in range(SHIFTS)])
    return df.withColumns({f"{prefix}_n": F.size(digests).cast("long"), f"{prefix}_wide": wide, f"{prefix}_pieces": F.size(fine).cast("long"), f"{prefix}_sums": sums}).drop(digests, fine, *words)


def combine(n: Column, sums: Column, other_n: Column, other_sums: Column, sign: int = 1) -> tuple[Column, Column]:
    """A number and sums with the other one's put in (sign 1) or taken out (sign -1), of paragraphs or of pieces."""
    return n + sign * other_n, F.zip_with(sums, other_sums, lambda a, b: F.pmod(a + sign * b, F.lit(MODULUS)))


def as_text(n: Column, wide: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(":"), F.concat_ws("", F.transform(wide, lambda s: F.lpad(F.lower(F.hex(s)), 15, "0"))))


def likeness(n: Column, sums: Column, other_n: Column, other_sums: Column) -> Column:
    """The cosine of two sums over n and other_n pieces."""
    lane = (1 << BITS) - 1
    signed = lambda count, s: F.flatten(F.transform(s, lambda x: F.array(*[(2 * F.shiftright(x, BITS * k).bitwiseAND(F.lit(lane)) - count).cast("double") for k in range(60 // BITS)])))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    a, b = signed(n, sums), signed(other_n, other_sums)
    cosine = F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x))))
    same = (n == other_n) & (sums == other_sums)
    return F.when(same, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the column `fingerprint` to the documents."""
    carried = others(docs, ["fingerprint"], None)
    rows = docs.select(*aside(carried), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return with_fingerprint(rows, "text", "own").select(*back(carried), as_text(F.col("own_n"), F.col("own_wide")).alias("fingerprint"))


def neighbours(ids: DataFrame) -> DataFrame:
    """next_id of each id in descending order (null last, and after the last the first), and prev_id and prev_chars the other way.

    Expects distinct `id` with `chars`. Ids are dealt out by range and stored
    with the number of their range; inside a range a window finds the
    neighbours, and the ends of ranges, a row each, are put together.
    """
    order = F.col("id").desc_nulls_last()
    ranged = written(ids.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranged")
    own = W.partitionBy("part").orderBy(order)
    row = lambda f: f(F.struct("id", "chars")).over(own)
    inner = ranged.select("*", row(F.lead).alias("next"), row(F.lag).alias("prev"))
    # nulls are the last in this order and the smallest in a struct: both ends come from min and max.
    ends = ranged.groupBy("part").agg(F.max(F.struct("id", "chars")).alias("top"), F.min(F.struct("id", "chars")).alias("bottom"))
    over, every = W.orderBy("part"), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("top").over(over), F.first("top").over(every)).alias("after"), F.coalesce(F.lag("bottom").over(over), F.last("bottom").over(every)).alias("before"))
    # One row for each partition of the shuffle.
    joined = inner.join(F.broadcast(ends), "part")
    following, previous = F.coalesce("next", "after"), F.coalesce("prev", "before")
    kept = [c for c in ids.columns if c not in ("id", "chars")]
    return joined.select("id", *kept, following["id"].alias("next_id"), previous["id"].alias("prev_id"), previous["chars"].alias("prev_chars"))


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and the likeness to the next document's.

    The edited text has the last third of its characters replaced by the first
    as many of the next document in descending order of ids. Where several rows
    have an id, each has a result, and the one with the smallest hash of its
    text stands for the id as others' next document.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sized = rows.select("id", F.char_length("text").cast("long").alias("chars"), F.xxhash64("text").alias("text_hash"))
    counted = sized.groupBy("id").agg(F.max("chars").alias("chars"), F.min("text_hash").alias("chosen"), F.count(F.lit(1)).alias("rows"))
    ids = written(neighbours(counted), "neighbours")
    total = ids.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    # An id that more than one in PARTS of the rows have, null among them, has a key for each of its parts; there are less than PARTS of them.
    copies = F.greatest(F.lit(1), F.ceil(F.col("rows") * PARTS / F.lit(max(total, 1)))).cast("int")
    keyed = lambda df, c: df.withColumns({"k": F.coalesce(c, F.lit(0).cast("long")), "no_k": F.col(c).isNull()})
    hot = F.broadcast(keyed(ids.where(copies > 1), "id").select("k", "no_k", copies.alias("copies")))
    some = F.coalesce("copies", F.lit(1))
    dealt = lambda df: df.join(hot, ["k", "no_k"], "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), some).cast("int")).drop("copies")
    copied = lambda df: df.join(hot, ["k", "no_k"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), some - 1))).drop("copies")

    # Joins and aggregates are on the same columns, so what one has dealt out serves the next.
    key = ["k", "no_k", "part"]
    # Both uses of the texts' shuffle read the same columns of it, or else it would be made twice: the id comes back from its key.
    placed = dealt(keyed(rows, "id").drop("id")).join(copied(keyed(ids, "id").drop("id", "rows")), key)
    # `chosen` is the smallest hash of the id's texts. As an inequality the test stays a filter; as an equality it would
    # become another join key, and the texts would be shuffled twice.
    chosen = F.xxhash64("text") <= F.col("chosen")
    # Of a next document only what its neighbour may need goes on, once.
    heads = keyed(placed.where(chosen).select("prev_id", F.expr("substring(text, 1, cast(prev_chars div 3 as int))").alias("head")), "prev_id")
    heads = copied(heads.select("k", "no_k", "head").dropDuplicates(["k", "no_k"]))
    edited = placed.join(heads, key).select(F.when(~F.col("no_k"), F.col("k")).alias("id"), "next_id", chosen.alias("is_chosen"), "text", "head")
    edited = edited.withColumn("n_chars", F.char_length("text").cast("long"))
    third = "cast(n_chars div 3 as int)"
    edited = edited.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {third}), substring(head, 1, {third}))")).drop("head")
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = with_fingerprint(with_fingerprint(edited, "text", "own").drop("text"), "edited", "new").drop("edited")
    found = written(found, "fingerprints")

    whole = lambda df, c: keyed(df, c).withColumn("whole", F.struct("k", "no_k")).drop("k", "no_k")
    other = whole(found.where("is_chosen"), "id").select("whole", F.col("own_pieces").alias("next_n"), F.col("own_sums").alias("next_sums")).dropDuplicates(["whole"])
    following = whole(ids.groupBy("next_id").agg(F.sum("rows").alias("__n")), "next_id").select("whole", "__n")
    joined = join_heavy(whole(found, "next_id"), other.join(following, "whole"), "whole", PARTS, total=total)
    own, new = (F.col("own_pieces"), F.col("own_sums")), (F.col("new_pieces"), F.col("new_sums"))
    return joined.select(
        F.col("id").alias(doc_id),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own_n"), F.col("own_wide")).alias("fingerprint"),
        as_text(F.col("new_n"), F.col("new_wide")).alias("edited_fingerprint"),
        likeness(*own, *new).alias("near_edited"),
        likeness(*own, F.col("next_n"), F.col("next_sums")).alias("near_next"),
    )
