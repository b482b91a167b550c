"""The pipeline's stages by their own contracts, on odd documents, and its run over a given table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import decontamination, mixing, near_dedup, quality_rules

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_each_stage_does_its_own_part(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = {r.doc_id for r in quality_rules.apply_rules(docs).where("kept").select("doc_id").collect()}
    first = stages["quality_rules"](spark, docs, SF).cache()
    assert first.columns == COLUMNS and {r.doc_id for r in first.select("doc_id").collect()} == kept
    classes = near_dedup.classes(first).collect()
    second = stages["near_dedup"](spark, first, SF).cache()
    assert second.columns == COLUMNS and sorted(r.doc_id for r in second.select("doc_id").collect()) == sorted({r.class_id for r in classes})
    bad = {r.doc_id for r in decontamination.contaminated(second, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    third = stages["decontamination"](spark, second, SF).cache()
    assert third.columns == COLUMNS and {r.doc_id for r in third.select("doc_id").collect()} == {r.doc_id for r in second.select("doc_id").collect()} - bad
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(third).select("doc_id", "copies").collect() if r.copies})
    fourth = stages["mixing"](spark, third, SF).cache()
    assert fourth.columns == COLUMNS and Counter(r.doc_id for r in fourth.select("doc_id").collect()) == copies
    fifth = stages["sharding"](spark, fourth, SF)
    assert fifth.count() == fourth.count()
    assert Counter(tuple(r) for r in fifth.select(COLUMNS).collect()) == Counter(tuple(r) for r in fourth.collect())


def test_stages_on_odd_documents(spark):
    text = " ".join(f"word{k}" for k in range(30))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (3, None, "en", "a", 1), (4, "", "en", None, 0), (None, text + " end", "en", "b", 2), (None, None, None, None, None), (5, "x" * 300_000, "en", "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("_whole", "_row", "size", "kept", "copies", "_stay", "_bad", "shard", "_words")])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, SF)
        found = got.collect()
        assert len(set(got.columns)) == len(got.columns), name
        if name != "sharding":
            assert got.columns == df.columns, name
            assert all(r.kept == 1 and r["size"] == 1 and r.copies == 1 for r in found), name
        assert stage(spark, df.where("false"), SF).collect() == [], name
        if name == "near_dedup":
            assert Counter(r.doc_id for r in found) == Counter([1, 3, 5])


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    rows = got.select("doc_id", "shard", "slot").collect()
    assert rows and got.columns[:5] == COLUMNS
    per = Counter(r.shard for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in per.items())
