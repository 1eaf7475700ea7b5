"""A training corpus from documents: rules, near duplicates, secrets, mixture, packed sequences.

Each stage takes null ids and texts, repeated rows, empty tables and columns of any names besides those of documents;
what becomes of them stands with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegraph.llm import mixing, ngram_join, packing, quality, secret_scan
from cinegraph.llm.common import table, words_of, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go; null and empty texts do, for they have fewer than ten words. Repeated rows are judged each."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows with a null id stay, and so do all rows of one id."""
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, and n_chars follows its text. Null texts stay null, with a null n_chars."""
    return secret_scan.redact(docs, size="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole documents: the one that a source's share ends in rounds.

    Null sources are one source; documents without words are not taken, for they have nothing to give.
    """
    mixed = mixing.mix(docs, F.size(words_of(F.col("text"))))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("_times", times).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is one end id, and repeated rows are packed each."""
    return packing.pack(docs.select("doc_id", "text")).select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: SQL has neither the tokenizer nor the battery of tests; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs)
    return docs
