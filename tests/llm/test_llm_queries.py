"""The registered queries on the smallest given tables: against their SQL where they have one, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from taskledger.llm.queries import llm_checks, llm_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = llm_queries(), llm_checks()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = QUERIES[name](spark, FOLDER)
    answer = con.execute(CHECKS[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, answer.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - {"op4_decontamination", "op6_best_fit_packing"}))
def test_query_has_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES[name](spark, FOLDER)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = stage_last(spark, docs)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def stage_last(spark, docs):
    return corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()


NAMES = ["meta.src", "_key_of_span", "_text_of_row", "_hash_of_row", "row", "key", "seeds", "contexts", "masked", "by_text", "_text", "_row", "value", "fp", "a b", "`x`"]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n in NAMES if "`" not in n]
    wide = docs.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id")).alias(n) for i, n in enumerate(names)], F.array("doc_id").alias("list"))
    odd = wide.filter("doc_id % 20 = 0")
    odd = odd.unionByName(odd.withColumn("text", F.lit(None).cast("string")).limit(3)).unionByName(odd.limit(2)).unionByName(
        odd.withColumn("doc_id", F.lit(None).cast("long")).limit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, FOLDER)
        assert got.columns == odd.columns, name
        rows = got.collect()
        assert rows, name
        for r in rows:
            assert r["doc_id"] is None or all(r[n] == f"{i}-{r['doc_id']}" for i, n in enumerate(names)), name
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, FOLDER)
    assert packed.count() >= odd.count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
