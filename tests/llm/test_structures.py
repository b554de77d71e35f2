"""Merkle manifest, prefix trie and decontamination against brute force and their own SQL."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepflow.llm import decontaminate, merkle, queries, trie

from ..test_oracle import rows
from .test_text import SF, documents, empty, odd


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_prefix_trie", "op13_wu_manber"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


# 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(items):
    """Siblings of each item, level by level as (left, right), and the last node."""
    paths, now, at = [[] for _ in items], items, list(range(len(items)))
    while len(now) > 1:
        for i, p in enumerate(at):
            run = now[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append((run[: p % 8], run[p % 8 + 1 :]))
        at = [p // 8 for p in at]
        now = [sha("".join(now[k : k + 8])) for k in range(0, len(now), 8)]
    return paths, now[0]


def plain_manifest(rows):
    leaf = lambda *fields: sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))
    langs = {}
    for doc_id, source, lang, n_chars, text in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        changed = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n_chars, lowered(text)) if changed else own, doc_id))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    inner = {x: climb([r[2] for r in sorted(langs[x])]) for x in order}
    above, root = climb([inner[x][1] for x in order])
    for x, top in zip(order, above):
        for (_, _, own, changed, doc_id), path in zip(sorted(langs[x], key=lambda r: r[:4]), inner[x][0]):
            folded = changed
            for left, right in path + top:
                folded = sha("".join(left) + folded + "".join(right))
            yield doc_id, own, inner[x][1], root, sha("".join("".join(a) + "".join(b) for a, b in path + top)), folded, folded == root


def manifest(df):
    return sorted(map(str, (tuple(r) for r in merkle.prove(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())))


def table_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_equals_plain_tree(spark):
    docs = documents(spark)
    many = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 37).cast("string"))).unionByName(docs.limit(9).withColumn("lang", F.lit(None).cast("string")))
    for df in (many, docs.limit(1), docs.limit(8), docs.limit(9).withColumn("lang", F.lit("x")), docs.withColumns({"lang": F.lit("é"), "doc_id": F.lit(7).cast("long"), "text": F.lit("A")})):
        stored = df.cache()
        assert manifest(stored) == sorted(map(str, plain_manifest(table_of(stored))))


def test_manifest_of_odd_rows(spark):
    df = odd(spark).withColumns({"leaf": F.lit(1), "tree": F.lit(2), "block": F.lit(3), "pos": F.lit(4)})
    assert manifest(df) == sorted(map(str, plain_manifest(table_of(df))))
    assert merkle.prove(empty(spark)).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"


def test_no_range_holds_a_language(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert max(r["count"] for r in merkle.place_leaves(docs).groupBy(F.floor(F.col("pos") / 8)).count().collect()) == 8
    got = merkle.prove(docs)
    assert got.where("verified").count() == 20_000  # digits have no upper case


# 12


def plain_trie(rows):
    conversations = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            conversations.setdefault(conv_id, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in conversations.items()}
    rebuilt = {c: turns.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + own[zlib.crc32(str(c).encode()) % 6 :] for c, own in turns.items()}
    members, children = {}, {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(p))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(",".join(map(str, ends)))


def trie_of(df, **options):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(str, (tuple(r) for r in trie.prefix_trie(df, **options).select(*columns).collect())))


@pytest.mark.parametrize("block_rows", [3, 50])
def test_trie_equals_plain_prefixes(spark, block_rows):
    rng = random.Random(block_rows)
    table = []
    for c in range(120):
        for t in range(rng.choice([1, 2, 3, 9])):
            table.append((c if rng.random() < 0.97 else None, t if rng.random() < 0.95 else None, rng.choice(["u", None, "a"]), "x" if rng.random() < 0.3 else rng.choice(["x", "yy", None, "zzz", "é" * 2000])))
    # A third of all conversations are copies, and one is long; ids without a first one of their hundred.
    table += [(c, t, "u", "same") for c in range(200, 260) for t in range(3)] + [(c, t, "u", f"same {t}") for c in (7001, 7002) for t in range(300)]
    df = spark.createDataFrame([(*r, 1, "k") for r in table], "conv_id long, turn long, role string, text string, lcp int, key string")
    assert trie_of(df, block_rows=block_rows) == sorted(map(str, plain_trie(table)))


def test_trie_of_small_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    for table in ([], [(None, 1, "u", "x")], [(5, None, None, None)], [(5, 0, "u", "x"), (5, 0, "u", "x")]):
        assert trie_of(spark.createDataFrame(table, schema)) == sorted(map(str, plain_trie(table)))


def test_searches_in_sparse_tables():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(-1, 5, n)
        table, start, d = trie.Minima(values), rng.integers(0, n, 200), rng.integers(-1, 7, 200)
        assert table.last_below(start, d).tolist() == [max((j for j in range(s + 1) if values[j] < x), default=-1) for s, x in zip(start, d)]
        assert table.first_below(start, d).tolist() == [min((j for j in range(s, n) if values[j] < x), default=n) for s, x in zip(start, d)]
        last = rng.integers(0, n, 200)
        assert table.least(start, last).tolist() == [min(values[a : b + 1], default=trie.FAR) for a, b in zip(start, last)]


# 13


def plain_hits(words, items):
    hit, named = set(), set()
    for name, item in items:
        m = min(10, len(item))
        windows = {tuple(item[k : k + m]) for k in range(len(item) - m + 1)} if item else set()
        for k in range(len(words) - m + 1):
            if tuple(words[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                named |= {name} - {None}
    return hit, sorted(named)


def test_search_equals_plain_windows():
    rng = random.Random(3)
    for _ in range(150):
        kinds = rng.choice([2, 3, 6, 40])
        some = lambda n: [b"w%d" % rng.randrange(kinds) for _ in range(n)]  # noqa: E731, B023
        items = [(str(i % 7) if rng.random() < 0.9 else None, some(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(rng.randrange(12))]
        texts = [some(rng.choice([0, 1, 5, 10, 40, 300, 900])) for _ in range(rng.randrange(6))]
        for text, (spans, names) in zip(texts, decontaminate.Index.build(items).search(texts)):
            assert ({x for a, b in spans for x in range(a, b)}, names) == plain_hits(text, items)


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))


@pytest.mark.parametrize("block_words", [25, 1_000_000])
def test_contamination_of_odd_rows(spark, block_words):
    passage = "One two THREE four five six; seven eight nine ten éleven twelve 13"
    docs = odd(spark).unionByName(odd(spark).limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.lit(f"x {passage} y {passage.upper()}")}))
    docs = docs.withColumns({"row": F.lit(1), "items": F.lit("clash"), "Spans": F.lit(2)})
    items = [(1, passage), (2, "long " * 40), (3, None), (4, ""), (None, "some words"), (5, "word"), (5, "two words"), (6, "same text here, twice."), (10, passage[:40])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, table, keep=["doc_id", "row"], block_words=block_words)
    assert got.columns.count("row") == 1
    want = []
    cut = [(None if i is None else str(i), plain_words(t)) for i, t in items]
    for r in docs.collect():
        words = plain_words(r.text)
        hit, named = plain_hits(words, cut)
        want.append((r.doc_id, len(words), len(hit), named))
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()))) == sorted(map(str, want))


def test_contamination_of_empty_tables(spark):
    table = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contaminated(empty(spark), table, keep=["doc_id"]).count() == 0
    assert decontaminate.contaminated(odd(spark), table.limit(0), keep=["doc_id"]).where("n_hit > 0").count() == 0
