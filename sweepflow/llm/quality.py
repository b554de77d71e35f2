"""Quality rules with verdicts on hosts.

Every document gets the counts of the base rules and a set of soft rules. The
failures of the soft rules are summed by host (two partial aggregates, so a
host with a third of all rows is no hot key), each host's failure rate is
shrunk towards the mean of all documents by a beta prior fitted to the hosts
themselves, and the verdicts go back to the documents by a join on the host. A
host is rejected where its rate is above the mean of all documents with a
chance of more than 84 %, by its beta posterior, for which the normal
distribution of the same mean and variance stands. A document goes if it fails
a base rule, or fails a soft rule on a rejected host: a clean document of a bad
host stays.

Null or empty text: no words, so base_failed. Null host: a host of its own.
Texts of any length are counted whole. Repeated rows count as often as they
occur, ties don't matter. Empty tables give empty results. Carried columns
whose names clash with a result's give way to it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, aside, back, join_heavy, others, written

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """Soft rules and the host limit."""

    mean_word_chars: tuple[float, float] = (2.5, 12.0)
    symbols_per_word: float = 0.3
    dup_lines_percent: float = 30.0
    repeat_words_percent: float = 30.0
    #: Standard deviations of its posterior by which a host's rate has to be above the mean: 84 % of a normal distribution are below one.
    deviations: float = 1.0


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    found = text.encode("utf-8", "surrogatepass").split()  # cuts at exactly the six ASCII white-space characters
    n = len(found)
    windows = list(zip(found, found[1:], found[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {k for k, c in Counter(windows).items() if c > 1}
        end = 0
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def count_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the five counts and n_lines to each document."""
    names = [*COUNTS, "n_lines"]

    def start():
        return lambda texts: dict(zip(names, zip(*map(count_text, texts)), strict=True))

    return annotate(docs, start, [(n, T.LongType()) for n in names], text, keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def soft_failures(limits: Limits) -> Column:
    """Number of soft rules that a document fails. All comparisons are on products, so nothing divides by zero."""
    low, high = limits.mean_word_chars
    rules = [
        (F.col("word_chars") < low * F.col("n_words")) | (F.col("word_chars") > high * F.col("n_words")),
        F.col("n_symbols") > limits.symbols_per_word * F.col("n_words"),
        100 * F.col("n_dup_lines") > limits.dup_lines_percent * F.col("n_lines"),
        100 * F.col("n_repeat_words") > limits.repeat_words_percent * F.col("n_words"),
    ]
    return sum((F.when(r, 1).otherwise(0) for r in rules), F.lit(0))


def host_verdicts(counted: DataFrame, host: str, limits: Limits = Limits()) -> DataFrame:
    """One row for each host: documents, failures, the rate shrunk by the prior, and whether the host is rejected.

    The prior's mean is the rate of all documents; its weight comes from the
    spread of the hosts' rates by the method of moments, weighted by size, and
    is at least one document. Both are sums over the table of hosts.
    """
    failed = (base_failed() | (soft_failures(limits) > 0)).cast("long")
    hosts = counted.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed).alias("n_failed"))
    rate = F.try_divide(F.col("n_failed"), F.col("n_docs"))
    total = hosts.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_failed").alias("all_failed"), F.sum(F.col("n_docs") * rate * rate).alias("sq"))
    mean = F.try_divide(F.col("all_failed"), F.col("all_docs"))
    variance = F.greatest(F.try_divide(F.col("sq"), F.col("all_docs")) - mean * mean, F.lit(0.0))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.coalesce(F.try_divide(mean * (1 - mean), variance) - 1, F.lit(1e6))))
    prior = total.select(mean.alias("prior_mean"), weight.alias("prior_weight"))
    shrunk = (F.col("n_failed") + F.col("prior_mean") * F.col("prior_weight")) / (F.col("n_docs") + F.col("prior_weight"))
    # The prior is one row.
    rated = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", shrunk)
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n_docs") + F.col("prior_weight") + 1))
    return rated.select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > F.col("prior_mean") + limits.deviations * deviation).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """Adds the counts, base_failed, host_rate and kept to each document; the counts are made once, in a stored table that both uses read."""
    carried = others(docs, [*COUNTS, "n_lines", "base_failed", "host_rate", "kept"], keep)
    held = [f"carried {i}" for i in range(len(carried))]
    # A null host has a key as well.
    key = F.when(F.col(f"`{host}`").isNull(), "null").otherwise(F.concat(F.lit("host "), F.col(f"`{host}`").cast("string")))
    rows = docs.select(*aside(carried), F.col(f"`{text}`").alias("words"), key.alias("host"))
    counted = count_rules(rows, "words", [*held, "host"])
    counted = written(counted.withColumn("base_failed", base_failed()).withColumn("soft", soft_failures(limits) > 0), "quality")
    hosts = written(host_verdicts(counted, "host", limits), "hosts").select("host", "host_rate", "host_rejected", F.col("n_docs").alias("__n"))
    kept = ~F.col("base_failed") & ~(F.col("soft") & F.col("host_rejected"))
    return join_heavy(counted, hosts, "host").withColumn("kept", kept).select(*back(carried), *COUNTS, "base_failed", "host_rate", "kept")
