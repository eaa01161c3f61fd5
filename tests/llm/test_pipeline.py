from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from samples import odd_rows, said

import corpus_pipeline
from shelfsight.llm.common import stored

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizer files")


def test_stages_take_effect(spark, documents):
    rng = random.Random(3)
    english = "the of and to in is that it was for on as with they at be this from have or by one had not but what all were when".split()
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(english, k=60)) + " " + said(rng, 40)
        rows += [(3 * i, text, "a"), (3 * i + 1, text, "b"), (3 * i + 2, text + " more", "b")]
    rows += [(1000, "mail me at jane@example.org " + " ".join(rng.choices(english, k=60)), "a"), (1001, "12 !! 34", "a")]
    docs = documents(rows)
    kept = stored(corpus_pipeline.language_stage(spark, docs, ""))
    assert kept.columns == docs.columns and kept.where("doc_id = 1001").count() == 0
    one = stored(corpus_pipeline.dedup_stage(spark, kept, ""))
    assert sorted(r.doc_id for r in one.collect()) == [*range(0, 180, 3), 1000]
    clean = stored(corpus_pipeline.redact_stage(spark, one, ""))
    assert clean.count() == one.count() and clean.where("text like '%jane@%'").count() == 0
    assert clean.where(F.col("n_chars") != F.char_length("text")).count() == 0
    mix = stored(corpus_pipeline.mix_stage(spark, clean, ""))
    assert mix.columns == docs.columns and mix.count() > 0
    packed = corpus_pipeline.pack_stage(spark, mix, "")
    assert packed.where("start = 0").count() == mix.count()


def test_stages_on_odd_and_no_rows(spark, documents):
    for docs in (documents(odd_rows()), documents(odd_rows()).where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, ""))
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_run_over_the_small_tables(spark):
    found = corpus_pipeline.run(spark, SMALL)
    rows = found.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    assert rows.n > 0 and rows.length > 0
    # Sequences are full but for the last of each shard.
    full = found.groupBy("sequence_id").agg(F.sum("length").alias("held"))
    assert full.where("held > 1024").count() == 0
