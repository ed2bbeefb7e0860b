"""A corpus pipeline out of the operators of palimpsest.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for every stage: null, empty and blank texts go through all filters and reach the end (they are not toxic, no one's copies, hold no
benchmark passage and no secret); rows with a null id are kept and judged by their own text, but take no part in groups of near copies; of repeated rows of one id and text
one stays, as the smallest of a group; ties go to the smaller id; an empty table gives an empty one; further columns, whatever their names, go along unchanged up to the last
stage, which returns ids and checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import _exchange, decontaminate, ngram_jaccard, secret_forest, sentencepiece_tokens, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a toxicity score of 0.3 or more. Without words, or without labels of both classes, nothing is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.ordinary(docs, toxicity.fit(docs, labels, ~toxicity.held_out()), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of documents with a shingle similarity of 0.75 or more; of repeated rows of that id one. Rows without words or without an id stay."""
    return ngram_jaccard.deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are benchmark passages, each row by its own text."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, in the words where they were found; n_chars, if there is such a column, follows."""
    forest = secret_forest.train(secret_forest.labelled_findings(spark))
    _exchange.release(spark)  # what the training left, before the scan is planned
    out = secret_forest.redacted(docs, forest)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by SentencePiece, as their number and checksum, and the checksum of the text decoded from them."""
    return sentencepiece_tokens.digest(sentencepiece_tokens.encoded(docs, sentencepiece_tokens.tokenizer_path("piece_bpe_32k.model")))


STAGES = [("toxicity", toxic), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark_passages), ("secret_scan", secrets), ("sentencepiece", tokens)]

#: The toxicity model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output goes when its successor is written; the last one stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = _exchange.scratch_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _exchange.remove_folder(spark, f"{folder}/{k - 1}")
        _exchange.drop_scratch(spark)  # tables of shards of this stage
        _exchange.release(spark)
    return docs
