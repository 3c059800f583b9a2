"""Structured Streaming over append logs.

Sinks write one folder per micro-batch and overwrite it on a repeated batch, so a restarted query leaves
each record once. State that a later batch needs is stored the same way and read from earlier batches only.
Stream ends and current rows are stored as what changed, and in full every SNAPSHOT_EVERY micro-batches, so a
read takes at most that many folders. Accepted batches are kept in buckets by stream, and a micro-batch reads
only the buckets of its own streams. A target belongs to one checkpoint: with a new checkpoint, take a new
target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from taskledger.functions import expr as X
from taskledger.operators.logs import append_reconcile, assign_sequence, batch_digest, batch_limits, check_cursors, spill_large_values
from taskledger.operators.scale import running
from taskledger.session import written

LEDGER = (
    "run_id bigint, stream string, append_id string, digest string, n bigint, first_seq bigint, last_seq bigint"
)
ENDS = "run_id bigint, stream string, end_seq bigint"


SNAPSHOT_EVERY = 16
LEDGER_BUCKETS = 256


def _since_snapshot(path: str, epoch: int) -> list[str]:
    """Folders of the last full state before `epoch` and of the changes after it.

    Every micro-batch writes its state, so a missing folder is an error and never an empty state.
    """
    start = (epoch - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    return [f"{path}/epoch={e}" for e in range(start, epoch)]


def _ends_before(spark: SparkSession, path: str, epoch: int) -> DataFrame | None:
    """Stream ends after the micro-batch before `epoch`; None before the first."""
    if epoch == 0:
        return None
    stored = spark.read.schema(ENDS).parquet(*_since_snapshot(path, epoch))
    return stored.groupBy("run_id", "stream").agg(F.max("end_seq").alias("end_seq"))


def _write_ends(ends: DataFrame, before: DataFrame | None, path: str, epoch: int) -> None:
    if before is not None and epoch % SNAPSHOT_EVERY == 0:
        ends = ends.unionByName(before).groupBy("run_id", "stream").agg(F.max("end_seq").alias("end_seq"))
    ends.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("run_id", "stream"), F.lit(LEDGER_BUCKETS)).cast("int")


def _ledger_before(spark: SparkSession, path: str, epoch: int, batches: DataFrame) -> DataFrame | None:
    """Accepted batches of earlier micro-batches, of the buckets that the streams of `batches` are in."""
    if epoch == 0:
        return None
    asked = [r[0] for r in batches.select(_bucket().alias("bucket")).distinct().collect()]  # at most LEDGER_BUCKETS
    stored = spark.read.schema(LEDGER + ", epoch bigint, bucket int").parquet(path)
    return stored.filter((F.col("epoch") < epoch) & F.col("bucket").isin(asked)).drop("epoch", "bucket")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write what is available now to Parquet, once, and return the sink's content."""
    query = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _each_batch(
    stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(action).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def tail_filtered(stream: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records after each cursor (run_id, stream, after_seq, prefix; null prefix: all keys).

    The cursors are a static table joined to the stream; `check_cursors` refuses those that break a rule.
    """
    check_cursors(cursors)
    prefix = F.coalesce("prefix", F.lit(b""))
    return (
        stream.join(cursors.select("run_id", "stream", "after_seq", prefix.alias("_prefix")), ["run_id", "stream"])
        .filter((F.col("seq") > F.col("after_seq")) & F.startswith("key", "_prefix"))
        .drop("after_seq", "_prefix")
    )


APPEND = ["run_id", "stream", "append_id", "attempt", "_own"]


def _judge(entries: DataFrame) -> DataFrame:
    """Entry count and verdict of each batch: the rules on names first, then those on sizes."""
    return batch_limits(entries, APPEND).withColumn(
        "verdict",
        F.when(F.col("run_id").isNull() | ~X.matches(F.col("stream"), X.STREAM_NAME), "invalid stream name")
        .when(X.byte_length(F.col("append_id")) > X.MAX_APPEND_ID, "append id too long")
        .otherwise(F.col("verdict")),
    )


def _decide(entries: DataFrame, target: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    """Outcomes of all batches of `entries`, written below `target`, with the accepted ones and new ends.

    Returns the good batches' arrivals (APPEND, arrival) and the accepted rows.
    """
    spark = entries.sparkSession
    judged = written(_judge(entries), "judged")
    good = entries.join(judged.filter("verdict = 'ok'").select(*APPEND), APPEND, "left_semi")
    heads = good.groupBy(*APPEND).agg(F.min("ord").alias("_low"))
    # Attempts come in order; within one, the batch with the lowest entry came first.
    arrivals = written(
        running(heads, ["run_id", "stream"], ["attempt", "_low", "append_id", "_own"], count="arrival").drop("_low"), "arrivals"
    )
    batches = batch_digest(good, APPEND, ["ord"]).join(arrivals, APPEND).drop("attempt", "_own")
    known_ends = _ends_before(spark, f"{target}/ends", epoch)
    ledger = _ledger_before(spark, f"{target}/ledger", epoch, arrivals)
    decided = written(append_reconcile(batches, ledger, known_ends), "decided")
    accepted = decided.filter("outcome = 'appended'")
    refused = judged.filter("verdict <> 'ok'").select(
        "run_id", "stream", "append_id", F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("string").alias("digest"),
        F.col("entries").alias("n"), F.lit("rejected").alias("outcome"), F.lit(None).cast("long").alias("first_seq"),
        F.lit(None).cast("long").alias("last_seq"), F.col("verdict").alias("reason"),
    )
    decided.withColumn("reason", F.lit(None).cast("string")).unionByName(refused).write.mode("overwrite").parquet(
        f"{target}/outcomes/epoch={epoch}"
    )
    accepted.filter("append_id <> ''").select(
        "run_id", "stream", "append_id", "digest", "n", "first_seq", "last_seq", _bucket().alias("bucket")
    ).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/ledger/epoch={epoch}")
    ends = accepted.groupBy("run_id", "stream").agg(F.max("last_seq").alias("end_seq"))
    _write_ends(ends, known_ends, f"{target}/ends", epoch)
    return arrivals, accepted


def _digest_bucket() -> Column:
    return F.substring("digest", 1, 2)


def _not_stored(blobs: DataFrame, path: str, epoch: int) -> DataFrame:
    """Blobs whose content no earlier micro-batch has stored: only digests are read, of the buckets asked for."""
    asked = [r[0] for r in blobs.select(_digest_bucket()).distinct().collect()]  # 256 at most
    if epoch == 0 or not asked:
        return blobs
    stored = blobs.sparkSession.read.schema("digest string, epoch bigint, bucket string").option("basePath", path).parquet(path)
    known = stored.filter((F.col("epoch") < epoch) & F.col("bucket").isin(asked)).select("digest")
    return blobs.join(known, "digest", "left_anti")


def _entries(batch: DataFrame) -> DataFrame:
    """The micro-batch, stored; an append without a name or attempt has an empty name and attempt 0.

    `_own` tells appends without a name apart: each of their entries is a batch of its own.
    """
    named = batch.withColumns({"append_id": F.coalesce("append_id", F.lit("")), "attempt": F.coalesce("attempt", F.lit(0))})
    return written(named.withColumn("_own", F.when(F.col("append_id") == "", F.col("ord").cast("string")).otherwise("")), "append")


def append_log_sink(
    stream: DataFrame, target: str, checkpoint: str, *, inline_limit: int = X.INLINE_LIMIT
) -> StreamingQuery:
    """Append batches exactly once per append id, numbering records without gaps.

    `stream`: run_id, stream, append_id, attempt, ord, key, value. All entries of one attempt must come in one
    micro-batch (write each batch as one file); a later part would be another batch under the same name. An entry
    without an append id is a batch of its own. Batches that break a rule are rejected as a whole and get no numbers.
    Below `target`: records, outcomes (one per batch and attempt, with the reason of a rejection), ledger (accepted
    batches), ends and blobs (spilled values, each content once), each in folders `epoch=N`.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        entries = _entries(batch)
        arrivals, accepted = _decide(entries, target, epoch)
        attempts = arrivals.join(
            accepted.select("run_id", "stream", "arrival", "first_seq"), ["run_id", "stream", "arrival"]
        ).drop("arrival")
        placed = running(entries.join(attempts, APPEND), APPEND, ["ord"], count="_nth")
        records = placed.withColumn("seq", F.col("first_seq") + F.col("_nth") - 1).select(
            "run_id", "stream", "seq", "key", "value", X.byte_length(F.col("value")).cast("long").alias("payload_size")
        )
        inline, blobs = spill_large_values(records, "value", inline_limit)
        inline.write.mode("overwrite").parquet(f"{target}/records/epoch={epoch}")
        fresh = _not_stored(written(blobs, "spilled"), f"{target}/blobs", epoch)
        fresh.withColumn("bucket", _digest_bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/blobs/epoch={epoch}")

    return _each_batch(stream, checkpoint, append)


def stream_assign_sequence(
    stream: DataFrame, target: str, checkpoint: str, order: tuple[str, ...] = ("arrival", "ord")
) -> StreamingQuery:
    """Number entries per stream as they come; earlier micro-batches come first.

    Within a micro-batch this is the batch operator, so a stream of any size is split over tasks.
    """

    def number(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ends = _ends_before(spark, f"{target}/ends", epoch)
        numbered = assign_sequence(written(batch, "entries"), ends, order=order)
        path = f"{target}/records/epoch={epoch}"
        numbered.write.mode("overwrite").parquet(path)
        now = spark.read.schema(numbered.schema).parquet(path).groupBy("run_id", "stream").agg(
            F.max("seq").alias("end_seq")
        )
        _write_ends(now, ends, f"{target}/ends", epoch)

    return _each_batch(stream, checkpoint, number)


def stream_append_dedup(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Outcome of every append attempt (appended, replay, conflict, rejected) below `target`/outcomes.

    Decides and numbers batches as the sink does, but stores no records.
    """
    return _each_batch(stream, checkpoint, lambda batch, epoch: _decide(_entries(batch), target, epoch) and None)


def drop_replays_within(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Bounded-state variant: drop repeated append ids that come within `delay`; sees no conflicts."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
        ["run_id", "stream", "append_id", "ord"]
    )


def _current(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Store the rows that changed in each micro-batch; `read_current` gives the latest per key."""

    def store(batch: DataFrame, epoch: int) -> None:
        if epoch and epoch % SNAPSHOT_EVERY == 0:
            before = _latest(batch.sparkSession, target, batch.schema, keys, epoch)
            changed = written(batch, "changed")
            batch = before.join(changed, keys, "left_anti").unionByName(changed)
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return _each_batch(stream, checkpoint, store, "update")


def _latest(spark: SparkSession, target: str, schema: StructType, keys: list[str], epoch: int) -> DataFrame:
    """The latest row per key after the micro-batch before `epoch`."""
    wide = StructType([*schema.fields, StructType.fromDDL("epoch bigint").fields[0]])
    changed = spark.read.schema(wide).option("basePath", target).parquet(*_since_snapshot(target, epoch))
    rest = [f.name for f in schema.fields if f.name not in keys]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_row")).select(
        *[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in schema.names]
    )


def read_current(spark: SparkSession, target: str, schema: str, keys: list[str]) -> DataFrame:
    last = spark.read.schema("epoch bigint").parquet(target).agg(F.max("epoch")).first()[0]
    return _latest(spark, target, StructType.fromDDL(schema), keys, 0 if last is None else last + 1)


def stream_run_status(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Current status per (run_id, action): the first closed status if any, else the latest.

    Aggregates in update mode combine on the map side, so one busy key is no burden for a task.
    """
    closed = X.is_terminal(F.col("status"))
    mark = F.struct("seq", "status")
    status = events.groupBy("run_id", "action").agg(
        F.min(F.when(closed, mark)).alias("_closed"), F.max(mark).alias("_last")
    ).select(
        "run_id", "action",
        F.coalesce("_closed.status", "_last.status").alias("status"),
        F.coalesce("_closed.seq", "_last.seq").alias("seq"),
    )
    return _current(status, ["run_id", "action"], target, checkpoint)


def stream_latest_state(checkpoints: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """`latest_state` kept up to date."""
    latest = checkpoints.groupBy("run_id", "name").agg(F.max(F.struct("seq", "value")).alias("_last")).select(
        "run_id", "name", "_last.value", "_last.seq"
    )
    return _current(latest, ["run_id", "name"], target, checkpoint)


def bounded_drain(stream: DataFrame, ends: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Read every stream up to its recorded end (run_id, stream, end_seq) and finish."""
    until = stream.join(ends.select("run_id", "stream", "end_seq"), ["run_id", "stream"]).filter(
        F.col("seq") <= F.col("end_seq")
    ).drop("end_seq")
    return run_to_end(until, path, checkpoint)


def resume_tail(stream: DataFrame, cursors: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Go on after a break: the checkpoint knows the files read, the cursors the records seen."""
    return run_to_end(tail_filtered(stream, cursors), path, checkpoint)
