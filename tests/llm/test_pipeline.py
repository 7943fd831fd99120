"""The corpus pipeline, stage by stage on what the stage before kept."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import BAD, GOOD
from tracelight.llm import mixing, registry, simhash

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing_sources",
    ]
    assert corpus_pipeline.ORACLE_SQL is None


@tables
def test_a_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        ids, kept = {r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and kept, name
        if name == "simhash_near_dedup":
            # the stage links what the fingerprints link, and similar documents besides
            assert kept <= {r.component_id for r in simhash.near_duplicates(before).collect()}
            texts = [r.text for r in after.select("text").collect()]
            assert len(texts) == len(set(texts))
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == copies
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.mix_copy) for r in again.collect()) == sorted((r.doc_id, r.mix_copy) for r in out.collect())


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with the names that stages use themselves."""
    rows = [(i, f"{GOOD} {i} " + GOOD.upper() * (i % 3), "en" if i % 4 else None, f"s{i % 3}" if i % 5 else None, None, 1.5, "x") for i in range(40)]
    rows += [(100, BAD, "en", "s1", 1, 0.0, "y"), (100, BAD, "en", "s1", 1, 0.0, "y"), (None, GOOD, None, None, None, None, None), (101, None, "en", "s1", 1, 0.0, "y"), (102, "", "en", "s1", 1, 0.0, "y"), (103, f"{GOOD}\n" * 30000, "en", "s2", 1, 0.0, "y"), (104, "123 !", "en", "s1", 1, 0.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, mix_rate string")
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(["fp", "component_id", "kept_id", "other_id", "size", "mix_zero"])})
    bench = spark.createDataFrame([(1, None), (None, "some words that no document has at all"), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(100, 0, 0), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    for d, keep in (("full", 1000), ("empty", 0)):
        for name, t in (("documents", docs), ("benchmark", bench), ("labels", labels)):
            t.limit(keep).write.parquet(f"{tmp_path}/{d}/{name}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{d}")
        assert set(docs.columns) <= set(out.columns)
        found = [r.doc_id for r in out.collect()]
        assert not {101, 102, 104} & set(found) and bool(found) == bool(keep)


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))
