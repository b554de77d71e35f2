"""URL filters: rules on hosts and paths, and a classifier on segmented names.

Names in hosts and paths are runs of letters. A unigram model splits them into
words by Viterbi search. Its counts are those of the words in the text of all
pages, with a list of common words added; urls themselves add nothing, so a
name is no word only because it is a name. A word whose two halves are words
many times as frequent is taken for a compound and left out, so that it comes
apart.

A multinomial naive Bayes model scores the words of host and path. A url with
a seed word in its host is an example to block, any other one to allow. The
seed by which a url is an example is not among its features: a seed is one only
next to another seed. So what the model learns is what stands next to seeds,
and a seed alone blocks nothing. Rules come first; the model judges what no rule
fits.

Counts cover all rows, and none is cut: words meet names, and weights meet
features, in joins on tables. Keys of more than a fixed share of all rows, of
which there can only be so many, are joined by a broadcast. Words of the lexicon
have at most Filter.longest_word letters; names of any length are split.

Null urls and those without `://` have an empty host and path; nothing fits
those, and the model allows them. Null pages have no words. Repeated rows count
as often as they occur; of equally good splits the one with the longest last
word counts. With an empty table there is nothing to judge. Carried columns
whose names clash with a result's give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, aside, back, join_heavy, others, written

#: The rules of the query, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

SEEDS = "adult xxx porn porno sex sexy nude escort casino poker slots roulette bet bets betting gamble gambling pill pills viagra cialis pharmacy spam spammer malware phishing warez torrent crack keygen ads adserver adware banner popunder popup track tracker tracking clickbait jackpot lottery payday"
COMMON = (
    "the of and to in for on with at by from up about into over after best big black blog blue book box business buy call car care cheap "
    "city click club code cool daily data day deal deals design digital direct discount doctor drug drugs easy express family farm fast "
    "film find fire first fit food forum free fun game games gift girl girls global go gold good green group guide health help home host "
    "hot hotel house info jobs kids land life line link links list live local loan loans login love mail map market media mobile money "
    "movie music my net network new news now offer offers office online page park party photo pink play plus portal prize pro quick "
    "red safe sale school search secret secure server service shop shopping site smart social soft solution space sport sports star stock "
    "store stream style super support team tech test time tip tips tool tools top town trade travel tube tv video view vip virus web "
    "weight win winner wiki wine wireless woman women wood word work world your zone"
)


@dataclass(frozen=True)
class Filter:
    """Rules and parameters of the two models."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    seeds: frozenset[str] = frozenset(SEEDS.split())
    common: tuple[str, ...] = tuple(dict.fromkeys((COMMON + " " + SEEDS).split()))
    common_count: int = 200
    longest_word: int = 24
    compound: float = 10.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    pattern = "://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. Rules are a parameter, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda x: (len(x[0] + x[1]), x)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segment(name: str, counts: dict[str, int], total: int, options: Filter = Filter()) -> list[str]:
    """The best split by unigram Viterbi. A run of letters that is no word costs ten times more with each letter."""
    compound = lambda w, c: any(counts.get(w[:i], 0) >= options.compound * c and counts.get(w[i:], 0) >= options.compound * c for i in range(1, len(w)))
    base = math.log(max(total, 1))
    known = {w: math.log(c) - base for w, c in counts.items() if not compound(w, c)}
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        score, start = max((best[s] + known.get(name[s:end], math.log(10) * (s - end) - base), -s) for s in range(max(0, end - options.longest_word), end))
        best.append(score)
        back.append(-start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def page_words(pages: DataFrame, options: Filter, html: str | None) -> DataFrame:
    """word and n: words in the text of all pages, tags, scripts and styles taken off, and the common words."""
    common = pages.sparkSession.createDataFrame([(w, options.common_count) for w in options.common], "word string, n long")
    if html is None:
        return common
    text = F.regexp_replace(F.lower(F.coalesce(F.col(f"`{html}`"), F.lit(""))), r"(?s)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.filter(F.split(text, "[^a-z]+"), lambda w: (w != "") & (F.length(w) <= options.longest_word))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(common).groupBy("word").agg(F.sum("n").alias("n"))


def name_runs(column: Column) -> Column:
    return F.filter(F.split(column, "[^a-z]+"), lambda w: w != "")


def text_key(text: Column) -> Column:
    """A short key of a text: two hashes of 64 bits and its length."""
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.reverse(text))), F.length(text).cast("string"))


def split_names(names: DataFrame, lexicon: DataFrame, options: Filter) -> DataFrame:
    """Adds `words` to stored distinct names. All runs within a name meet the lexicon: the short ones, whose number the alphabet bounds, by a broadcast.

    Runs carry their name's hash and length, not the name, and are taken from
    stretches of it that overlap by a word, so that a name of n letters makes
    no more than a multiple of n bytes.
    """
    short, stretch = 3, 1024
    names = names.withColumn("key", text_key(F.col("name")))
    parts = names.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name")), F.lit(stretch)), lambda at: F.substring(F.col("name"), at, F.lit(stretch + options.longest_word - 1)))).alias("part"))
    total = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    starts = parts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda at: F.substring(F.col("part"), at, F.lit(options.longest_word)))).alias("rest"))
    runs = starts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("rest")), lambda k: F.substring(F.col("rest"), F.lit(1), k))).alias("word")).distinct()
    long = F.length("word") > short
    # At most 26 + 26^2 + 26^3 words are short.
    met = runs.where(~long).join(F.broadcast(lexicon.where(~long)), "word").unionByName(runs.where(long).join(lexicon.where(long), "word"))
    known = met.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("known"))  # as many as a name has runs, at most
    given = names.join(known, "key", "left").withColumn("given", F.struct("name", "known"))

    def start():
        return lambda rows: {"words": [segment(r["name"], dict(r["known"] or ()), total, options) for r in rows]}

    return annotate(given, start, [("words", T.ArrayType(T.StringType()))], "given", ["name", "n"])


def judge(pages: DataFrame, options: Filter = Filter(), url: str = "url", html: str | None = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and score, the model's log odds to block. Without html the lexicon is that of common words."""
    host, path = url_parts(F.col(f"`{url}`"))
    carried = others(pages, ["host", "path", "rule", "verdict", "score"], keep)
    # What the model sees of a url: its names, the host's without the last label.
    names = F.concat_ws("\n", F.array_join(name_runs(F.left(host, F.greatest(F.lit(0), F.length(host) - F.length(F.substring_index(host, ".", -1)) - 1))), " "), F.array_join(name_runs(F.lower(path)), " "))
    rows = written(pages.select(*aside(carried), host.alias("host"), path.alias("path"), names.alias("names")).withColumn("unit", text_key(F.col("names"))), "urls")
    # Tables of words and scores have a key in place of a url's names, which may be long.
    whole = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.first("names").alias("names"))
    rows, whole = rows.drop("names"), written(whole, "url-units")
    units = whole.drop("names")
    sides = whole.select("unit", "n", F.posexplode(F.split("names", "\n")).alias("side", "part"))
    used = sides.select("unit", "n", "side", F.explode(F.filter(F.split("part", " "), lambda w: w != "")).alias("name"))
    distinct = used.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    split = written(split_names(written(distinct, "url-names"), written(page_words(pages, options, html), "url-lexicon"), options), "url-words")
    met = join_heavy(used.drop("n"), split.withColumnRenamed("n", "__n"), "name")
    is_seed = lambda w: w.isin(*sorted(options.seeds)) if options.seeds else F.lit(False)
    words = written(met.select("unit", "side", F.explode("words").alias("word")).withColumn("seed", (F.col("side") == 0) & is_seed(F.col("word"))), "url-features")
    labels = words.where("seed").groupBy("unit").agg(F.count_distinct("word").alias("seeds"))
    labelled = units.join(labels, "unit", "left").select("unit", "n", F.coalesce("seeds", F.lit(0)).alias("seeds"))
    prior = labelled.agg(F.coalesce(F.sum(F.when(F.col("seeds") > 0, F.col("n"))), F.lit(0)).alias("block"), F.coalesce(F.sum("n"), F.lit(0)).alias("every")).first()
    feature = F.concat(F.when(F.col("side") == 0, F.lit("h:")).otherwise(F.lit("p:")), "word").alias("feature")
    rated = words.join(labelled, "unit").where(~F.col("seed") | (F.col("seeds") > 1))
    counts = rated.groupBy(feature).agg(F.sum(F.when(F.col("seeds") > 0, F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("seeds") == 0, F.col("n")).otherwise(0)).alias("allow"), F.count(F.lit(1)).alias("__n"))
    counts = written(counts, "url-counts")
    sums = counts.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.count(F.lit(1)).alias("kinds")).first()
    # One added to every count; a word that was never seen tells nothing.
    weight = F.log((F.col("block") + 1) / F.lit(float(sums["block"] + sums["kinds"] + 1))) - F.log((F.col("allow") + 1) / F.lit(float(sums["allow"] + sums["kinds"] + 1)))
    start = math.log((prior["block"] + 1) / (prior["every"] - prior["block"] + 1))
    sums = join_heavy(words.select("unit", feature), counts.select("feature", weight.alias("weight"), "__n"), "feature").groupBy("unit").agg(F.sum("weight").alias("sum"))
    scores = units.join(sums, "unit", "left").select("unit", F.col("n").alias("__n"), (F.coalesce("sum", F.lit(0.0)) + start).alias("score"))
    scored = join_heavy(rows, written(scores, "url-scores"), "unit").drop("unit")
    rule, verdict = rule_of(F.col("host"), F.col("path"), options.rules)
    # Without a host there is nothing that the model could hold against a url.
    method = F.when((F.col("score") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method)).select(*back(carried), "host", "path", "score", "rule", "verdict")
