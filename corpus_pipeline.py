"""From raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; run()
stores what a stage returns as Parquet in the shared folder, deletes what the
stage wrote on the way, and hands the next one what it reads back. All but the
last return the columns of `documents`, and any further ones that the table has,
whatever their names. Texts of any length are taken whole. An empty table goes
through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepflow.jobs.storage import scratch
from sweepflow.llm import bpe, langid, minhash, mixing, secrets
from sweepflow.llm.common import table

#: The stages learn from their own input, so no SQL says the same; tests hold them against brute force.
ORACLE_SQL = None
#: From which score on a found language replaces a label.
SURE = 0.9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter go, for they have no language.

    The others get the language found where they have no label, or where the network's score is at least SURE. Repeated
    rows and null ids are rows like any other.
    """
    found = langid.identify(docs, langid.train(docs))
    found = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked at a similarity of 0.8 over shingles of five words, the smallest id stays.

    Texts without a word are linked with nothing and stay, as do null texts. Of rows with the same id and text one stays;
    rows of one id whose texts aren't linked all stay where that id does. A null id is never the smallest.
    """
    return minhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within the texts; every document stays, repeated ones too, and n_chars follows its text.

    A null text stays null, as does its n_chars; ids play no part.
    """
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, up to three times.

    Texts without a word, null ones too, have size 0, so the mix never takes them. Rows with the same id and text come as
    often as they do together; ties in the shuffled order go by id, then size. Null sources and ids are values.
    """
    return mixing.repeat_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of the ids and of the text they decode to: a row for each row, repeated ones too.

    A null text has no ids and decodes to the empty text.
    """
    return bpe.encode(docs, bpe.prepare(docs), keep=["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
