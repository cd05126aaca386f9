"""From raw documents to tokens, in five stages; each stage's result is a Parquet table that the next one reads.

A stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the
last return the columns of docs. Every row is a document, whether it repeats an
id or has none: rows are told apart by a hash of id and text. Null texts are
empty ones; very long texts count whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargohold.llm.common import row_key, written
from cargohold.llm.decontamination import decontaminated
from cargohold.llm.exact_dedup import exact_dedup
from cargohold.llm.queries import fitted_chain, token_digests
from cargohold.llm.simhash import simhash_components
from cargohold.llm.toxicity import not_toxic


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each of rows (stays, a row_key, and n, how many rows of docs have it) one row of docs; of several, the least by its other columns."""
    keyed = docs.withColumn("stays", row_key()).join(rows, "stays")
    single = keyed.filter("n = 1").select(docs.columns)
    several = keyed.filter("n > 1").groupBy("stays").agg(F.min(F.struct(*docs.columns)).alias("one"))
    return single.unionByName(several.select("one.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier chain rejects; it is fitted on the labels of docs. Rows that repeat go or stay alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return not_toxic(docs, fitted_chain(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: one with the largest doc_id. Copies without an id give way to others; of none but such, one stays."""
    kept = exact_dedup(docs).filter("kept").groupBy("digest", "row").agg(F.count("*").alias("n"))
    best = kept.groupBy("digest").agg(F.min(F.struct("row", "n")).alias("b"))
    return _only(docs, best.select(F.col("b.row").alias("stays"), "b.n"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: one with the smallest doc_id."""
    kept = simhash_components(docs).filter("is_first").groupBy("component_id", F.col("row").alias("stays")).agg(F.count("*").alias("n"))
    return _only(docs, kept.select("stays", "n"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of the benchmark occurs. Rows that repeat go or stay alike."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes; one row per row of docs with the digests of both."""
    return token_digests(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokens)]

#: Stages 1, 3 and 5 have no SQL: a trained model, seeded XXH64, and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
