"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..jobs.storage import written  # noqa: F401
from ..operators.joins import join_heavy, join_salted  # noqa: F401

#: Words are runs of anything but ASCII white space (fixed value).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text as an array column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows that go to Python at a time. Texts and sets are large, and a batch is held by the JVM and by Python, for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def others(df: DataFrame, taken: list[str], keep: list[str] | None) -> list[str]:
    """Names of the columns that a result carries along: keep (all, where it is None) without those that clash with a result's own."""
    low = {x.lower() for x in taken}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in low]


def aside(carried: list[str]) -> list[Column]:
    """A table's columns under names that no operator uses, so that none of theirs can clash; back() undoes it."""
    return [F.col(f"`{c}`").alias(f"carried {i}") for i, c in enumerate(carried)]


def back(carried: list[str]) -> list[Column]:
    return [F.col(f"`carried {i}`").alias(c) for i, c in enumerate(carried)]


def annotate(df: DataFrame, start: Callable[[], Callable[[list], dict[str, list]]], fields: list[tuple[str, T.DataType]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds columns that are computed from a text column, batch by batch.

    start() is called once in each task and returns a function from a list of
    texts (None for null) to a dictionary of lists, one for each of `fields`.
    Columns in `keep` are carried along (all, if it is None); one whose name
    clashes with a result's, in any case of letters, gives way to the result.
    """
    small_batches(df.sparkSession)
    names = [n for n, _ in fields]
    carried = others(df, names, keep)
    source = df.select(*aside(carried), F.col(f"`{text}`").alias("given"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)
    n_carried = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = work(batch.column(n_carried).to_pylist())
            columns = [batch.column(i).cast(arrow.field(i).type) if batch.column(i).type != arrow.field(i).type else batch.column(i) for i in range(n_carried)]
            columns += [pa.array(out[n], type=arrow.field(n_carried + i).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema).select(*back(carried), *[F.col(f"`{n}`") for n in names])
