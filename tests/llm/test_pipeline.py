"""The stages one after the other, against what each of them may keep."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sweepflow.llm import mixing, secrets

from .test_text import SF, clashing, documents, odd, plain_components


def test_stages(spark):
    docs, columns = documents(spark), documents(spark).columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "secret_scan", "mix_sources", "bpe_encode"]
    first = stages["language_id"](spark, docs, SF).cache()
    assert first.columns == columns and {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in first.collect()}
    second = stages["near_dedup"](spark, first, SF).cache()
    want = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in first.collect()], 5, 80)}
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(want)
    third = stages["secret_scan"](spark, second, SF).cache()
    assert third.count() == second.count() and all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in third.collect())
    fourth = stages["mix_sources"](spark, third, SF).cache()
    times = Counter({r.doc_id: r.times for r in mixing.mix(third.withColumn("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))).collect()})
    assert fourth.columns == columns and Counter(r.doc_id for r in fourth.collect()) == Counter({int(k.split(":")[0]): v for k, v in times.items() if v})
    texts = {r.doc_id: r.text for r in third.collect()}
    last = stages["bpe_encode"](spark, fourth, SF).collect()
    assert len(last) == fourth.count() and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_what_stages_make_of_odd_rows(spark):
    """Null, empty and very long texts, repeated rows and ids, and further columns with clashing names."""
    docs, stages = clashing(odd(spark)), dict(corpus_pipeline.STAGES)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    letters = sorted(str(x) for x in texts if any(c.isalpha() for c in x[1] or ""))
    rows = lambda df: sorted(str((r.doc_id, r.text)) for r in df.collect())
    assert rows(stages["language_id"](spark, docs, SF)) == letters
    kept = {c for _, _, c in plain_components(texts, 5, 80)}
    assert rows(stages["near_dedup"](spark, docs, SF)) == sorted({str(x) for x in texts if x[0] in kept})
    masked = stages["secret_scan"](spark, docs, SF).collect()
    assert len(masked) == len(texts) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked)
    assert sorted(r.doc_id for r in masked if r.text is None) == [1] and "AKIA" not in "".join(r.text or "" for r in masked)
    mixed = stages["mix_sources"](spark, docs, SF)
    assert {x for x, t in texts if t and t.split()} >= {r.doc_id for r in mixed.collect()} and mixed.columns == docs.columns
    last = stages["bpe_encode"](spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in last) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd(spark), SF).count() > 0
    assert stage(spark, odd(spark).limit(0), SF).count() == 0
