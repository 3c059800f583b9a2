"""Declared Python functions over rows, with retries and a result table keyed by content.

The function is the user's; everything around it (keys, lookup, one call per distinct input, joining
results back) is DataFrame work. Calls run in Arrow batches on the executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from taskledger.functions import expr as X
from taskledger.session import ship_package, written

MAX_ERROR_DETAILS = 64 * 1024


class CacheableError(Exception):
    """A failure that the same input always gives, so it may be stored and replayed."""

    def __init__(self, code: str, details: object = None) -> None:
        super().__init__(code)
        text = json.dumps(details)
        problems = {
            f"not an error code: {code!r}": re.fullmatch(X.ERROR_CODE.strip("^$"), code) is None,
            f"details take more than {MAX_ERROR_DETAILS} bytes": len(text.encode("utf-8")) > MAX_ERROR_DETAILS,
        }
        for problem, there in problems.items():
            if there:
                raise ValueError(problem)
        self.code = code
        self.details = text


def task_map(
    df: DataFrame, fn: Callable[..., object], inputs: Sequence[str], result_type: str, max_attempts: int = 1
) -> DataFrame:
    """Call `fn(**inputs)` for every row: adds output, error, error_code, error_details and attempts.

    A CacheableError is never retried; other exceptions are, up to `max_attempts` calls. Columns travel as Arrow
    arrays, so whole numbers stay whole numbers beside nulls; a null input is None. An output that does not fit the
    result type is an error of its row.
    """
    added = StructType.fromDDL(
        f"output {result_type}, error string, error_code string, error_details string, attempts bigint"
    )
    schema = StructType([*df.schema.fields, *added.fields])
    output_kind = to_arrow_type(added["output"].dataType)
    names, tries = list(inputs), max(max_attempts, 1)
    places = [df.columns.index(n) for n in names]
    ship_package(df.sparkSession)

    def call(args: dict[str, object]) -> tuple[object, str | None, str | None, str | None, int]:
        message = None
        for attempt in range(1, tries + 1):
            try:
                return fn(**args), None, None, None, attempt
            except CacheableError as failure:
                return None, failure.code, failure.code, failure.details, attempt
            except Exception as failure:  # noqa: BLE001 - the row reports what its function raised
                message = str(failure) or type(failure).__name__
        return None, message, None, None, tries

    def outputs(rows: list[tuple]) -> pa.Array:
        try:
            return pa.array([r[0] for r in rows], output_kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):
            for i, row in enumerate(rows):
                try:
                    pa.array([row[0]], output_kind)
                except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as failure:
                    rows[i] = (None, str(failure), None, None, row[4])
            return pa.array([r[0] for r in rows], output_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(i).to_pylist() for i in places]
            rows = [call(dict(zip(names, values, strict=True))) for values in zip(*given, strict=True)]
            columns = [outputs(rows), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3)]]
            columns.append(pa.array([r[4] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def cache_key(
    fn_name: str, version: str, env_name: Column, env_fingerprint: Column, inputs: Sequence[Column],
    dependency_digest: Column | None = None,
) -> Column:
    """Two-step key: what is called with what, then where it runs. Every part is length-framed."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in inputs]
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "0").otherwise("1") for c in inputs])
    dependencies = F.lit("") if dependency_digest is None else dependency_digest
    call = X.framed_sha256(
        F.lit("task-cache-call.v1"), env_name, F.lit(fn_name), F.lit(version), nulls, *text, dependencies
    )
    return X.framed_sha256(F.lit("task-cache.v1"), call, env_fingerprint)


def cache_keys(
    df: DataFrame, fn_name: str, version: str, env_name: Column, env_fingerprint: Column, inputs: Sequence[str],
    dependency_digest: Column | None = None,
) -> DataFrame:
    key = cache_key(fn_name, version, env_name, env_fingerprint, [F.col(c) for c in inputs], dependency_digest)
    return df.withColumn("cache_key", key)


def memo_map(
    df: DataFrame, fn: Callable[..., object], inputs: Sequence[str], result_type: str, cache: DataFrame,
    max_attempts: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Answer rows from `cache` (cache_key, output, error_code, error_details) and run the rest once per key.

    `df` has a column cache_key. Returns all rows with output, error, attempts (0 on a hit) and cache_hit,
    and the rows to add to the cache: results and cacheable errors, nothing else.
    """
    cache = cache.dropDuplicates(["cache_key"])
    stored = cache.select(
        "cache_key", F.col("output").alias("_output"), F.col("error_code").alias("_code"),
        F.lit(True).alias("_stored"),
    )
    todo = df.join(cache.select("cache_key"), "cache_key", "left_anti").select(
        "cache_key", *inputs
    ).dropDuplicates(["cache_key"])
    # Spread the distinct calls over all tasks, then store them: they feed the answer and the cache.
    ran = written(task_map(todo.repartition("cache_key"), fn, inputs, result_type, max_attempts), "calls")
    fresh = ran.select(
        "cache_key", F.col("output").alias("_new_output"), F.col("error").alias("_new_error"),
        F.col("attempts").alias("_new_attempts"),
    )
    hit = F.coalesce("_stored", F.lit(False))
    result = df.join(stored, "cache_key", "left").join(fresh, "cache_key", "left").select(
        *df.columns,
        F.when(hit, F.col("_output")).otherwise(F.col("_new_output")).alias("output"),
        F.when(hit, F.col("_code")).otherwise(F.col("_new_error")).alias("error"),
        F.when(hit, F.lit(0).cast("long")).otherwise(F.col("_new_attempts")).alias("attempts"),
        hit.alias("cache_hit"),
    )
    return result, cacheable_results(ran)


def cacheable_results(ran: DataFrame) -> DataFrame:
    """What may be stored: results, and errors with a valid code and details up to 64 KiB."""
    good = F.col("error").isNull()
    code_ok = X.matches(F.col("error_code"), X.ERROR_CODE) & (
        X.byte_length(F.col("error_details")) <= MAX_ERROR_DETAILS
    )
    return ran.filter(good | code_ok).select("cache_key", "output", "error_code", "error_details")
