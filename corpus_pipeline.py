"""Documents to training sequences: five stages, each written as Parquet and read again as the next one's input.

    quality classifier        rows whose score is below 0.3 go
    SimHash near-duplicates   one row of each group stays
    benchmark decontamination rows with a test item in them go
    PII                       every span found is replaced by its kind in angle brackets
    best-fit packing          the pieces of all that is left, placed in sequences of 2048 tokens

Every stage but the last returns the columns of its input. Null texts count as empty; see the operators for ties, nulls
and repeated rows. Further columns of the input stay, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taskledger.llm import decontamination, packing, pii, quality_classifier, simhash_dedup
from taskledger.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels, quality_classifier.learned_rows()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, path=packing.vocabulary_path()))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
