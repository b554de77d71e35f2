"""The operators as queries over the whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, langid, lm, merkle, minhash, mixing, quality, secrets, trie, urls, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"))


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op4_attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id"])


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.prepare(docs), keep=["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langid.train(docs)
    return langid.identify(docs, network, keep=["doc_id"]).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times", "source")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumn("host_rate", F.round("host_rate", 6))


def op10_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), warc.new_archive_path(spark))
    return warc.read_records(spark, archive).drop("url")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_circulant_minhash, op3_multiset_fingerprint, op4_attention_score, op5_url_filter, op6_bpe_lexicon, op7_language_id, op8_fair_mix, op9_host_quality, op10_content_archive, op11_merkle_manifest, op12_prefix_trie, op13_wu_manber)}


#: Sizes of documents and the mix: the same order, running sums over all rows.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS cap
  FROM by_source),
levels AS (
  SELECT *, cap / weight AS full_at,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at)), cap) AS target FROM levels),
queued AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER () AS row_id
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rounds AS (
  SELECT row_id, size, source, upto, CAST(r * source_size + upto AS DOUBLE) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS r) WHERE size > 0),
cut AS (SELECT row_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, upto ROWS UNBOUNDED PRECEDING) AS upto_all FROM rounds),
times AS (SELECT row_id, count(*) AS times FROM cut WHERE upto_all <= (SELECT sum(size) FROM sized) GROUP BY row_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(times, 0) * size AS BIGINT) AS taken, CAST(coalesce(times, 0) AS INTEGER) AS times, source
FROM queued LEFT JOIN times USING (row_id)
"""


WORDS_SQL = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Shingles by an inverted index, links on full sets, and components by reaching.
NEAR_SQL = (
    r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, """
    + WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + r""" AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM cut),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
elements AS (SELECT doc_id, unnest(s) AS e FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
sym AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT u, u FROM sym UNION SELECT v, root FROM reach JOIN sym ON node = u),
labels_ AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept FROM sized LEFT JOIN labels_ ON doc_id = node
"""
)

QUALITY_SQL = (
    r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, """
    + WORDS_SQL.format(text="text")
    + r""" AS w FROM docs),
placed AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM cut),
windows AS (SELECT doc_id, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
found AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS twice FROM windows),
covered AS (SELECT doc_id, twice OR coalesce(lag(twice) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS repeats FROM found WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (repeats) AS n FROM covered GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS lines FROM docs) JOIN cut USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars < 2.5 * n_words OR word_chars > 12.0 * n_words OR n_symbols > 0.3 * n_words OR 100 * n_dup_lines > 30.0 * n_lines OR 100 * n_repeat_words > 30.0 * n_words AS soft FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS f FROM judged GROUP BY source),
prior AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS v FROM hosts),
weight AS (SELECT m, greatest(1.0, least(1e6, coalesce(m * (1 - m) / nullif(greatest(v, 0.0), 0) - 1, 1e6))) AS k FROM prior),
rates AS (SELECT source, n, m, k, (f + m * k) / (n + k) AS host_rate FROM hosts, weight)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 6) AS host_rate, NOT base_failed AND NOT (soft AND host_rate > m + 1.0 * sqrt(host_rate * (1 - host_rate) / (r.n + k + 1))) AS kept
FROM judged j JOIN rates r ON j.source IS NOT DISTINCT FROM r.source
"""
)

ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
o AS (SELECT *, octet_length(encode(payload)) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS owner FROM p),
k AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner AS again FROM o)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to, true AS verified FROM k
"""


#: CRC-32 of the text of {text}, by its bits.
CRC_SQL = """xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT)),
  lambda c, b: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""

MERKLE_SQL = (
    r"""
WITH RECURSIVE crc AS (SELECT doc_id, """
    + CRC_SQL.format(text="CAST(doc_id AS VARCHAR)")
    + r""" AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
fields AS (
  SELECT doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS f, text,
         CASE WHEN doc_id IN (SELECT doc_id FROM crc WHERE h % 3 = 0) THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(array_to_string(list_transform(list_append(f, text), lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS leaf,
         sha256(array_to_string(list_transform(list_append(f, changed), lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')), '')) AS start FROM fields),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
levels(tree, level, pos, n, digest) AS (
  SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM levels WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (SELECT tree, digest FROM levels WHERE n = 1),
above(tree, level, pos, n, digest) AS (
  SELECT CAST(-1 AS BIGINT), 0, tree, (SELECT count(*) FROM subroots), digest FROM subroots
  UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY tree, level, pos // 8, n),
runs AS (SELECT tree, level, pos // 8 AS parent, list(digest ORDER BY pos) AS run FROM (FROM levels UNION ALL FROM above) WHERE n > 1 GROUP BY ALL),
trees AS (SELECT count(*) AS n FROM subroots),
climb(doc_id, leaf, own, tree, level, pos, n, siblings, folded) AS (
  SELECT doc_id, leaf, tree, CASE WHEN l.n = 1 THEN -1 ELSE tree END, 0, CASE WHEN l.n = 1 THEN tree ELSE pos END, CASE WHEN l.n = 1 THEN t.n ELSE l.n END, '', start FROM leaves l, trees t
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own, CASE WHEN c.n <= 8 THEN -1 ELSE c.tree END, CASE WHEN c.n <= 8 AND c.tree >= 0 THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.n <= 8 AND c.tree >= 0 THEN c.tree ELSE c.pos // 8 END, CASE WHEN c.n <= 8 AND c.tree >= 0 THEN t.n ELSE (c.n + 7) // 8 END,
         c.siblings || array_to_string(r.run[:c.pos % 8], '') || array_to_string(r.run[c.pos % 8 + 2:], ''),
         sha256(array_to_string(r.run[:c.pos % 8], '') || c.folded || array_to_string(r.run[c.pos % 8 + 2:], ''))
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.parent = c.pos // 8, trees t WHERE c.n > 1),
root AS (SELECT digest FROM above WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM climb c JOIN subroots s ON s.tree = c.own, root r WHERE c.tree = -1 AND c.n = 1
"""
)


TRIE_SQL = (
    r"""
WITH crc AS (SELECT conv_id, """
    + CRC_SQL.format(text="CAST(conv_id AS VARCHAR)")
    + r""" AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars,
         md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS token FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'token': token, 'chars': chars} ORDER BY turn NULLS FIRST, role, token) AS t FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT l.conv_id, list_concat(coalesce(b.t, [])[:h % 6], l.t[h % 6 + 1:]) AS t
  FROM lists l JOIN crc USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 100),
prefixes AS (SELECT conv_id, d, len(t) = d AS ends, list_transform(t[:d], lambda x: x.token) AS p, coalesce(t[d].chars, 0) AS chars FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY p),
children AS (SELECT p[:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
sized AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.p = c.p),
above AS (SELECT p[:k] AS p, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM sized)),
sums AS (SELECT p, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM sized n JOIN sums s ON n.p = s.p LEFT JOIN nodes u ON n.d > 0 AND u.p = n.p[:n.d - 1]
"""
)

LEAK_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS window_ FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
seen AS (SELECT row_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS window_ FROM (SELECT row_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths)),
found AS (SELECT row_id, item_id, s.m, i FROM seen s JOIN windows p ON s.m = p.m AND s.window_ = p.window_),
hits AS (SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(i, i + m)) AS place FROM found) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_circulant_minhash": NEAR_SQL, "op8_fair_mix": MIX_SQL, "op9_host_quality": QUALITY_SQL, "op10_content_archive": ARCHIVE_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_prefix_trie": TRIE_SQL, "op13_wu_manber": LEAK_SQL}
