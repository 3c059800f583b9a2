"""Ordered per-key computations that hold when one key has a large share of all rows.

A window partitioned by a key sends all rows of that key to one task. The functions here measure the
keys first. Keys up to the limit use the ordinary window. Rows of larger keys are range-partitioned by
(key, order), each piece is computed on its own, and the pieces are joined up through a table of
per-piece totals. Both ways give the same rows. An input that takes more than a scan is stored first, so it is
computed once however often it is read here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskledger.session import max_group_rows, written

READ_BUCKET = 1024
TASK_ROWS = 250_000
TASK_BYTES = 8 << 20


_COSTLY = re.compile(r"\b(Join|Aggregate|Window|Generate|Repartition\w*|Sort|Union|Distinct|MapIn\w+|FlatMap\w+)\b")


def _once(df: DataFrame) -> DataFrame:
    """`df`, stored if it takes more than a scan: it is read several times below but should be computed once."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return written(df, "running") if _COSTLY.search(plan) else df


def _large_keys(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, int] | None:
    """The keys with more than `limit` rows and their total row count, or None if there are none."""
    if df.count() <= limit:
        return None
    large = written(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit),
        "large-keys",
    )
    total = large.agg(F.sum("_rows")).first()[0]
    return None if total is None else (large.drop("_rows"), int(total))


@contextmanager
def tasks_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of what is written inside have a partition for each TASK_ROWS of `rows` at least, and those that adaptive
    execution puts together stay below TASK_BYTES. So a task's rows do not grow with the input.

    Adaptive execution still cuts skewed partitions, which it would not do with a number of partitions given to repartition.
    """
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    usual = spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")
    wanted = {
        first: str(max(int(usual), math.ceil(rows / TASK_ROWS))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    count: str | None = None,
    sums: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Add running values of each key's rows in ascending `order`, which must be a total order.

    `count` names a column for the 1-based position; `sums` maps output to the column summed up to and
    including the row; `previous` maps output to the column taken from the preceding row. Keys must not
    be null.
    """
    keys, order = list(keys), list(order)
    sums, previous = dict(sums or {}), dict(previous or {})
    limit = max_rows or max_group_rows(df.sparkSession)

    def with_windows(rows: DataFrame, group: list[str], count_as: str | None) -> DataFrame:
        window = Window.partitionBy(*group).orderBy(*order)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added: dict[str, Column] = {}
        if count_as:
            added[count_as] = F.row_number().over(window).cast("long")
        for out, column in sums.items():
            added[out] = F.sum(column).over(upto)
        for out, column in previous.items():
            added[out] = F.lag(column).over(window)
        return rows.withColumns(added)

    df = _once(df)
    found = _large_keys(df, keys, limit)
    if found is None:
        return with_windows(df, keys, count)

    large, large_rows = found
    small_part = with_windows(df.join(large, keys, "left_anti"), keys, count)

    pieces = max(2, math.ceil(2 * large_rows / limit))
    ranged = written(
        df.join(large, keys, "left_semi")
        .repartitionByRange(pieces, *keys, *order)
        .withColumn("_piece", F.spark_partition_id()),
        "pieces",
    )
    at_end = [F.count(F.lit(1)).alias("_n")]
    at_end += [F.sum(column).alias(f"_sum_{out}") for out, column in sums.items()]
    if previous:
        carried = F.struct(*[F.col(column).alias(out) for out, column in previous.items()])
        at_end.append(F.max_by(carried, F.struct(*order)).alias("_last"))
    # One narrow row per (key, piece): a key's rows divided by half the limit.
    earlier = Window.partitionBy(*keys).orderBy("_piece")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    carry |= {f"_carry_{out}": F.sum(f"_sum_{out}").over(before) for out in sums}
    if previous:
        carry["_carried"] = F.lag("_last").over(earlier)
    starts = (
        ranged.groupBy(*keys, "_piece").agg(*at_end).withColumns(carry)
        .select(*keys, "_piece", *carry)
    )
    local = with_windows(ranged, [*keys, "_piece"], "_local").join(starts, [*keys, "_piece"])
    fixed: dict[str, Column] = {}
    if count:
        fixed[count] = F.col("_local") + F.col("_before")
    for out in sums:
        carried_sum = F.col(f"_carry_{out}")
        fixed[out] = F.when(carried_sum.isNull(), F.col(out)).otherwise(
            F.coalesce(F.col(out) + carried_sum, carried_sum)
        )
    for out in previous:
        fixed[out] = F.when(F.col("_local") == 1, F.col(f"_carried.{out}")).otherwise(F.col(out))
    large_part = local.withColumns(fixed).select(*small_part.columns)
    return small_part.unionByName(large_part)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1
) -> DataFrame:
    """The first `n` rows of each key.

    Spark turns the filter on row_number into a per-task group limit before the shuffle, so a key of
    any size reaches its task as at most n rows per input task.
    """
    _allow_group_limit(df, n)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def _allow_group_limit(df: DataFrame, n: int) -> None:
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(df.sparkSession.conf.get(name, "1000")) < n:
        df.sparkSession.conf.set(name, str(n))


def read_after(
    rows: DataFrame,
    requests: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    request_id: str,
    limit: str,
) -> DataFrame:
    """Answer many "next `limit` rows after this cursor" requests in one job.

    `requests` has one row per `request_id` with `keys`, the cursor in columns named like `order` (null
    means from the start) and `limit`. Rows and cursors are numbered together once; each request then
    meets only the blocks of READ_BUCKET positions that it covers, never a whole key. Result: the
    request id, the row's columns, `position` (1-based within the request) and `more` (rows remain).
    """
    keys, order = list(keys), list(order)
    requests = _once(requests)
    payload = [c for c in rows.columns if c not in keys and c not in order]
    as_row = rows.select(
        *keys, *order, F.struct(*payload).alias("_row") if payload else F.lit(None).alias("_row"),
        F.lit(0).alias("_mark"), F.lit(1).cast("long").alias("_one"),
        F.lit(None).cast(requests.schema[request_id].dataType).alias("_request"),
    )
    row_type = as_row.schema["_row"].dataType
    as_mark = requests.select(
        *keys, *order, F.lit(None).cast(row_type).alias("_row"),
        F.lit(1).alias("_mark"), F.lit(0).cast("long").alias("_one"),
        F.col(request_id).alias("_request"),
    )
    # stored, since rows and cursors are taken from it apart
    placed = written(running(
        as_row.unionByName(as_mark), keys, [*order, "_mark", "_request"], sums={"_at": "_one"}
    ), "placed")
    block = F.lit(READ_BUCKET)
    found = placed.filter("_mark = 0").withColumn("_block", F.floor((F.col("_at") - 1) / block))
    starts = (
        placed.filter("_mark = 1")
        .select(F.col("_request").alias(request_id), F.col("_at").alias("_start"))
        .join(requests.select(request_id, *keys, F.col(limit).cast("long").alias("_limit")), request_id)
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.floor(F.col("_start") / block),
                    F.floor((F.col("_start") + F.col("_limit")) / block),
                )
            ),
        )
    )
    joined = (
        found.join(starts, [*keys, "_block"])
        .filter((F.col("_at") > F.col("_start")) & (F.col("_at") <= F.col("_start") + F.col("_limit") + 1))
        .withColumn("position", F.col("_at") - F.col("_start"))
    )
    # A request holds at most limit + 1 rows here, so this window is bounded.
    reached = F.max("position").over(Window.partitionBy(request_id))
    return (
        joined.withColumn("more", reached > F.col("_limit"))
        .filter(F.col("position") <= F.col("_limit"))
        .select(request_id, *keys, *order, *[F.col("_row").getField(c).alias(c) for c in payload],
                "position", "more")
    )
