"""The pipeline's stages on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))


def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, LONG), (None, BASE), (None, BASE), (900_005, BASE), (900_005, BASE), (900_006, BASE + " more"), (None, None)]
    extra = spark.createDataFrame(texts, "doc_id long, text string")
    for name, kind in docs.dtypes:
        if name not in extra.columns:
            extra = extra.withColumn(name, F.lit(None).cast(kind))
    names = ["shard", "score", "component_id", "held", "tokens"]
    return docs.unionByName(extra.select(docs.columns)).select("*", *[F.lit(1).alias(n) for n in names])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage(spark, name, stage):
    rows = odd(spark)
    found = stage(spark, rows, DATA)
    assert found.columns == rows.columns
    got = [(r.doc_id, r.text) for r in found.collect()]
    if name == "secret_scan":
        assert len(got) == rows.count()
    for ident, text in ((900_001, None), (900_002, ""), (900_003, " \t\n"), (900_004, LONG), (None, None)):
        assert (ident, text) in got
    if name != "toxicity":  # that one goes by what it learned
        assert got.count((None, BASE)) == 2  # without an id no row is another's copy
        assert got.count((900_005, BASE)) == (1 if name == "ngram_jaccard" else 2)
        assert ((900_006, BASE + " more") in got) == (name != "ngram_jaccard")
    assert stage(spark, rows.limit(0), DATA).count() == 0


def test_last_stage(spark):
    rows = odd(spark)
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, rows, DATA).count() == rows.count() and stage(spark, rows.limit(0), DATA).count() == 0
