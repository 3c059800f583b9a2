"""Queries over declared functions and their stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.operators import memo as ops
from taskledger.plans.registry import query
from taskledger.plans.relations import frame
from taskledger.sources import fixtures as fx


def double_size(brand: str, size: int) -> int:
    """The example task: deterministic for large sizes, failing at random for one brand."""
    if size > 45:
        raise ops.CacheableError("too_large", {"size": size})
    if brand == "Brand#7":
        raise ValueError("no such brand")
    return size * 2


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return ops.cache_keys(
        fx.memo_inputs(spark, sf), "double_size", "1.0.0", F.lit("env-1"), F.lit("python3"), ["brand", "size"]
    )


def _cache(keyed: DataFrame) -> DataFrame:
    """Results of small sizes are already stored."""
    empty = F.lit(None).cast("string")
    return keyed.filter("size < 10").dropDuplicates(["cache_key"]).select(
        "cache_key", (F.col("size") * 2).alias("output"), empty.alias("error_code"), empty.alias("error_details")
    )


_CALL = " || ".join(frame(p) for p in (
    "'task-cache-call.v1'", "'env-1'", "'double_size'", "'1.0.0'", "'11'", "brand", "size::VARCHAR", "''"))
_KEY = f"sha256(unhex({frame(chr(39) + 'task-cache.v1' + chr(39))} || {frame(f'sha256(unhex({_CALL}))')} || {frame(chr(39) + 'python3' + chr(39))}))"


@query(f"SELECT p_partkey, {_KEY} AS cache_key FROM memo_inputs")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).select("p_partkey", "cache_key")


@query("""SELECT p_partkey, CASE WHEN size <= 45 AND brand <> 'Brand#7' THEN size * 2 END AS output,
  CASE WHEN size > 45 THEN 'too_large' WHEN brand = 'Brand#7' THEN 'no such brand' END AS error,
  CASE WHEN size > 45 THEN 'too_large' END AS error_code,
  CASE WHEN size <= 45 AND brand = 'Brand#7' THEN 3 ELSE 1 END::BIGINT AS attempts FROM memo_inputs""")
def task_map(spark: SparkSession, sf: str) -> DataFrame:
    made = ops.task_map(fx.memo_inputs(spark, sf), double_size, ["brand", "size"], "bigint", max_attempts=3)
    return made.select("p_partkey", "output", "error", "error_code", "attempts")


@query("""SELECT p_partkey, CASE WHEN size < 10 OR size <= 45 AND brand <> 'Brand#7' THEN size * 2 END AS output,
  CASE WHEN size < 10 THEN NULL WHEN size > 45 THEN 'too_large' WHEN brand = 'Brand#7' THEN 'no such brand' END AS error,
  CASE WHEN size < 10 THEN 0 WHEN size <= 45 AND brand = 'Brand#7' THEN 2 ELSE 1 END::BIGINT AS attempts,
  size < 10 AS cache_hit FROM memo_inputs""")
def memo_map(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf)
    result, _ = ops.memo_map(keyed, double_size, ["brand", "size"], "bigint", _cache(keyed), max_attempts=2)
    return result.select("p_partkey", "output", "error", "attempts", "cache_hit")


@query(f"""SELECT DISTINCT {_KEY} AS cache_key, CASE WHEN size <= 45 THEN size * 2 END AS output,
  CASE WHEN size > 45 THEN 'too_large' END AS error_code FROM memo_inputs
  WHERE size >= 10 AND (size > 45 OR brand <> 'Brand#7')""")
def cached_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What a run adds to the store: results and deterministic errors, no others."""
    keyed = _keyed(spark, sf)
    _, added = ops.memo_map(keyed, double_size, ["brand", "size"], "bigint", _cache(keyed))
    return added.select("cache_key", "output", "error_code")
