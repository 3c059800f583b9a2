"""Keyed append logs: numbering, idempotent appends, cursor and prefix reads, saved state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators.scale import read_after, running
from taskledger.session import ship_package, written

STREAM = ("run_id", "stream")


def assign_sequence(
    entries: DataFrame,
    ends: DataFrame | None = None,
    keys: Sequence[str] = STREAM,
    order: Sequence[str] = ("arrival", "ord"),
) -> DataFrame:
    """Number each stream's entries without gaps, after `ends` (keys, end_seq) or from 1."""
    numbered = running(entries, keys, order, count="seq")
    if ends is None:
        return numbered
    last = ends.select(*keys, F.col("end_seq").alias("_end"))
    return (
        numbered.join(last, list(keys), "left")
        .withColumn("seq", F.col("seq") + F.coalesce("_end", F.lit(0)))
        .drop("_end")
    )


def stream_end(records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Last sequence number per stream; 0 for a wanted stream without records."""
    ends = records.groupBy(*STREAM).agg(F.max("seq").alias("end_seq"))
    if wanted is None:
        return ends
    return wanted.select(*STREAM).distinct().join(ends, list(STREAM), "left").withColumn(
        "end_seq", F.coalesce("end_seq", F.lit(0).cast("long"))
    )


def batch_limits(
    entries: DataFrame,
    by: Sequence[str],
    *,
    order: str = "ord",
    headers: DataFrame | None = None,
    max_key: int = X.MAX_KEY,
    max_record: int = X.MAX_RECORD,
    max_batch: int = X.MAX_BATCH,
) -> DataFrame:
    """Entry count, total bytes and verdict per batch; the earliest entry at fault decides.

    `headers` (by columns) lists batches that may have no entry at all.
    """
    key_size, value_size = X.byte_length(F.col("key")), X.byte_length(F.col("value"))
    size = key_size + value_size
    fault = F.when(key_size > max_key, "key too large").when(
        (value_size == 0) | (size > max_record), "record too large or empty"
    )
    measured = entries.select(
        *by, F.col(order).alias("_ord"), size.cast("long").alias("_size"), fault.alias("_fault")
    )
    totals = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("_size").alias("bytes"),
        F.min(F.when(F.col("_fault").isNotNull(), F.struct("_ord", "_fault"))).alias("_first"),
    )
    # Only a batch that is too large and also has a bad entry needs the bytes in front of that entry.
    unclear = totals.filter((F.col("bytes") > max_batch) & F.col("_first").isNotNull()).select(
        *by, F.col("_first._ord").alias("_until")
    )
    before = (
        measured.join(unclear, list(by)).filter(F.col("_ord") < F.col("_until"))
        .groupBy(*by).agg(F.sum("_size").alias("_before"))
    )
    judged = totals.join(before, list(by), "left").withColumn(
        "verdict",
        F.when(F.coalesce("_before", F.lit(0)) > max_batch, "batch too large")
        .when(F.col("_first").isNotNull(), F.col("_first._fault"))
        .when(F.col("bytes") > max_batch, "batch too large")
        .otherwise("ok"),
    )
    judged = judged.select(*by, "entries", "bytes", "verdict")
    if headers is None:
        return judged
    zero = F.lit(0).cast("long")
    return headers.select(*by).distinct().join(judged, list(by), "left").select(
        *by, F.coalesce("entries", zero).alias("entries"), F.coalesce("bytes", zero).alias("bytes"),
        F.coalesce("verdict", F.lit("empty batch")).alias("verdict"),
    )


def batch_digest(entries: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SHA-256 over a batch's entries in order, every key and value preceded by its length.

    Entries are sorted within their batch's task and the hash is carried from one Arrow batch to the next, so a batch
    of any size is never gathered.
    """
    by = list(by)
    ship_package(entries.sparkSession)
    sorted_entries = (
        entries.select(*by, *order, F.col("key").cast("binary").alias("_key"), F.col("value").cast("binary").alias("_value"))
        .repartition(*by).sortWithinPartitions(*by, *order).select(*by, "_key", "_value")
    )
    head = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, sha, schema = None, 0, None, None
        for batch in batches:
            done, schema = [], batch.schema
            for row in zip(*[batch.column(i).to_pylist() for i in range(head + 2)], strict=True):
                if sha is None or row[:head] != current:
                    if sha is not None:
                        done.append((*current, n, sha.hexdigest()))
                    current, n, sha = row[:head], 0, hashlib.sha256()
                for part in row[head:]:
                    part = part or b""
                    sha.update(len(part).to_bytes(8, "big") + part)
                n += 1
            if done:
                yield rows(done, schema)
        if sha is not None:
            yield rows([(*current, n, sha.hexdigest())], schema)

    def rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [*[schema.field(i).type for i in range(head)], pa.int64(), pa.string()]
        names = [*by, "n", "digest"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

    kinds = ", ".join(f"`{c}` {sorted_entries.schema[c].dataType.simpleString()}" for c in by)
    return sorted_entries.mapInArrow(run, f"{kinds}, n long, digest string")


def append_reconcile(
    batches: DataFrame, ledger: DataFrame | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """Decide each batch: appended, replay (with the first range) or conflict.

    `batches`: run_id, stream, append_id, arrival (unique per stream), digest, n. An empty or null
    append id never repeats. `ledger` holds accepted batches (digest, first_seq, last_seq), `ends` the
    streams' last numbers.
    """
    key = [*STREAM, "append_id"]
    # One narrow row per batch, used several times below: the digests are computed once.
    batches = written(batches, "batches")
    named = F.coalesce(F.col("append_id"), F.lit("")) != ""
    first = batches.filter(named).groupBy(*key).agg(F.min_by("digest", "arrival").alias("_first_digest"),
                                                    F.min("arrival").alias("_first_arrival"))
    marked = batches.join(first, key, "left")
    if ledger is not None:
        known = ledger.select(
            *key, F.col("digest").alias("_known"), F.col("first_seq").alias("_known_first"),
            F.col("last_seq").alias("_known_last"), F.lit(True).alias("_is_known"),
        )
        marked = marked.join(known, key, "left")
    else:
        nothing = F.lit(None).cast("long")
        marked = marked.withColumns(
            {"_known": F.lit(None).cast("string"), "_known_first": nothing, "_known_last": nothing,
             "_is_known": F.lit(None).cast("boolean")}
        )
    marked = marked.withColumn(
        "outcome",
        F.when(~named, "appended")
        .when(
            F.col("_is_known"),
            F.when(F.col("_known").eqNullSafe(F.col("digest")), "replay").otherwise("conflict"),
        )
        .when(F.col("arrival") == F.col("_first_arrival"), "appended")
        .when(F.col("digest").eqNullSafe(F.col("_first_digest")), "replay")
        .otherwise("conflict"),
    )
    marked = written(marked, "outcomes")
    placed = running(
        marked.filter("outcome = 'appended'").select(*key, "arrival", "n"),
        STREAM, ["arrival"], sums={"_last": "n"},
    )
    if ends is not None:
        placed = placed.join(ends.select(*STREAM, "end_seq"), list(STREAM), "left")
    else:
        placed = placed.withColumn("end_seq", F.lit(0).cast("long"))
    base = F.coalesce("end_seq", F.lit(0).cast("long"))
    ranges = placed.select(
        *STREAM, F.col("arrival").alias("_first_arrival"),
        (base + F.col("_last") - F.col("n") + 1).alias("_first_seq"),
        (base + F.col("_last")).alias("_last_seq"),
    )
    # A replay points at the batch that was kept; an unnamed batch at itself.
    target = F.when(F.col("outcome") == "appended", F.col("arrival")).when(
        F.col("outcome") == "replay", F.col("_first_arrival")
    )
    return (
        marked.withColumn("_first_arrival", target)
        .join(ranges, [*STREAM, "_first_arrival"], "left")
        .select(
            *key, "arrival", "digest", "n", "outcome",
            F.when(F.col("outcome") != "conflict", F.coalesce("_known_first", "_first_seq")).alias("first_seq"),
            F.when(F.col("outcome") != "conflict", F.coalesce("_known_last", "_last_seq")).alias("last_seq"),
        )
    )


def key_prefix_scan(records: DataFrame, prefix: bytes) -> DataFrame:
    return records.filter(X.has_prefix(F.col("key"), prefix))


def read_limit(limit: Column) -> Column:
    """0 means the default; outside 1..1000 there is no valid limit (null)."""
    chosen = F.when(limit == 0, F.lit(X.READ_LIMIT)).otherwise(limit)
    return F.when(chosen.between(1, X.READ_LIMIT_MAX), chosen)


def cursor_read(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records after each request's cursor, with `truncated` when more remain.

    `requests`: request_id, run_id, stream, after_seq, key (null for any), limit. Every request gets a row: one
    that is refused (`verdict` invalid limit or invalid cursor) or finds nothing has null record columns.
    """
    # One selector per exact key, one for whole streams; each record is numbered per selector.
    judged = requests.withColumn("limit", read_limit(F.col("limit"))).withColumn(
        "verdict",
        F.when(F.col("limit").isNull(), "invalid limit")
        .when(F.coalesce(F.col("after_seq") < 0, F.lit(True)), "invalid cursor").otherwise("ok"),
    )
    valid = judged.filter("verdict = 'ok'").withColumn("_select", F.coalesce(F.hex("key"), F.lit("*")))
    selectors = valid.select(*STREAM, "_select").distinct()
    offered = records.withColumn(
        "_select", F.explode(F.array(F.lit("*"), F.hex("key")))
    ).join(selectors, [*STREAM, "_select"], "left_semi")
    read = _read_selected(offered, valid.drop("verdict").withColumnRenamed("after_seq", "seq")).withColumnRenamed(
        "more", "truncated"
    ).drop("run_id", "stream")
    return judged.select("request_id", *STREAM, "verdict").join(read, "request_id", "left")


def _read_selected(offered: DataFrame, requests: DataFrame) -> DataFrame:
    return read_after(
        offered, requests, keys=[*STREAM, "_select"], order=["seq"], request_id="request_id", limit="limit"
    ).drop("_select")


def filtered_batch(records: DataFrame, requests: DataFrame) -> DataFrame:
    """One round of a tail: up to `batch` matching records and where to look next.

    `requests`: request_id, run_id, stream, after_seq, prefix (null or empty for all keys), batch. When
    the batch is full, `inspect_seq` is its last number, otherwise the end of the stream. A request
    without a match gives one row with null record columns.
    """
    asked = requests.withColumns({
        "_select": F.coalesce(F.hex("prefix"), F.lit("")),
        "limit": F.col("batch"),
        "seq": F.col("after_seq"),
    })
    selectors = asked.select(*STREAM, "_select").distinct()
    # Keys are at most 1024 bytes, so a stream has at most that many prefix lengths.
    lengths = selectors.groupBy(*STREAM).agg(F.collect_set(F.length("_select")).alias("_lengths"))
    key_hex = F.hex("key")
    offered = (
        records.join(lengths, list(STREAM))
        .withColumn("_length", F.explode("_lengths"))
        .filter(F.length(key_hex) >= F.col("_length"))
        .withColumn("_select", F.substring(key_hex, F.lit(1), F.col("_length")))
        .drop("_lengths", "_length")
        .join(selectors, [*STREAM, "_select"], "left_semi")
    )
    found = _read_selected(offered, asked).drop("more", *STREAM)
    per_request = Window.partitionBy("request_id")
    found = found.withColumns({
        "_n": F.count(F.lit(1)).over(per_request), "_top": F.max("seq").over(per_request)
    })
    ends = stream_end(records)
    full = F.coalesce(F.col("_n") == F.col("batch"), F.lit(False))
    return (
        requests.join(found, "request_id", "left").join(ends, list(STREAM), "left")
        .withColumn(
            "inspect_seq",
            F.when(full, F.col("_top")).otherwise(F.coalesce("end_seq", F.lit(0).cast("long"))),
        )
        .drop("_n", "_top", "end_seq", "position")
    )


def latest_state(checkpoints: DataFrame, wanted: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """Latest value per (run_id, name); for a wanted name without one, the default and found = false."""
    latest = checkpoints.groupBy("run_id", "name").agg(
        F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")
    )
    if wanted is None:
        return latest
    return wanted.join(latest, ["run_id", "name"], "left").select(
        "run_id", "name", F.col("seq").isNotNull().alias("found"),
        F.when(F.col("seq").isNull(), F.lit(default)).otherwise(F.col("value")).alias("value"),
    )


def record_counts(logs: DataFrame, prefix: bytes = b"") -> DataFrame:
    return key_prefix_scan(logs, prefix).groupBy("run_id").agg(F.count(F.lit(1)).alias("records"))


def log_batches(lines: DataFrame, size: int = X.LOG_BATCH_LINES, order: Sequence[str] = ("ord",)) -> DataFrame:
    """Group each attempt's lines into batches of `size`, in order, with a stable append id."""
    keys = ["run_id", "action", "attempt"]
    numbered = running(lines, keys, order, count="_line")
    batch = F.floor((F.col("_line") - 1) / size) + 1
    return numbered.withColumn("batch", batch).withColumn(
        "append_id",
        F.concat_ws(":", F.lit("task-log"), *[F.col(c).cast("string") for c in ("action", "attempt", "batch")]),
    ).drop("_line")


def spill_large_values(
    df: DataFrame, value: str = "value", threshold: int = X.INLINE_LIMIT, mime: str = X.LOG_VALUE_MIME
) -> tuple[DataFrame, DataFrame]:
    """Values over the threshold leave the row: value null and value_uri set, else the reverse.

    The second result has each distinct spilled content once, by digest.
    """
    large = X.byte_length(F.col(value)) > threshold
    digest = F.sha2(F.col(value).cast("binary"), 256)
    inline = df.withColumn("value_uri", F.when(large, X.blob_uri(F.lit(mime), digest))).withColumn(
        value, F.when(~large, F.col(value))
    )
    # Content moves only once per digest; equal digests mean equal content.
    blobs = df.filter(large).select(
        digest.alias("digest"), F.octet_length(value).cast("long").alias("size"), F.col(value).alias("content")
    ).dropDuplicates(["digest"])
    return inline, blobs


def status_transitions(events: DataFrame, keys: Sequence[str] = ("run_id", "action")) -> DataFrame:
    """Each event with the status before it (null for the first)."""
    return running(events, keys, ["seq"], previous={"from_status": "status"}).withColumnRenamed(
        "status", "to_status"
    )


def run_timeline(runs: DataFrame, status: DataFrame, logs: DataFrame, with_logs: bool = True) -> DataFrame:
    """One feed per run: its state, the action status events and the task logs.

    `runs`: run_id, ts, status. `status`: run_id, ts, seq, key, action, status. `logs`: run_id, ts, seq,
    key, message. Events with the key `status` belong to the run itself and are not repeated. Without
    logs the feed has the run's state only. Order: run_id, ts, stream, seq.
    """
    feed = runs.select(
        "run_id", "ts", F.lit("run").alias("stream"), F.lit(0).cast("long").alias("seq"), "status"
    )
    if not with_logs:
        return feed
    changes = status.filter(F.col("key") != "status").select(
        "run_id", "ts", F.lit("status").alias("stream"), "seq", "key", "action", "status"
    )
    lines = logs.select("run_id", "ts", F.lit("task_log").alias("stream"), "seq", "key", "message")
    return feed.unionByName(changes, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True)


def _messages(events: DataFrame, *items: Column) -> DataFrame:
    """One row per message (struct of source and message, or null) of each event, in order."""
    return events.select(
        "run_id", "ts", "seq", F.posexplode(F.array_compact(F.array(*items))).alias("part", "_item")
    ).select("run_id", "ts", "seq", F.col("part").cast("long").alias("part"), "_item.source", "_item.message")


def _message(source: Column | str, pattern: str, *columns: str) -> Column:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.struct(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        F.format_string(pattern, *texts).alias("message"),
    )


def action_messages(events: DataFrame) -> DataFrame:
    """Messages of action events.

    Columns run_id, ts, seq, action_id, caller_action_id, entrypoint_id, status, attempt, error, cache_hit.
    """
    fault = F.col("status").isin("queued", "failed", "canceled") & (F.coalesce("error", F.lit("")) != "")
    return _messages(
        events,
        F.when(F.col("cache_hit"), _message("cache", "hit entrypoint=%s action=%s", "entrypoint_id", "action_id")),
        _message("task", "entrypoint=%s %s action=%s parent=%s attempt=%s",
                 "entrypoint_id", "status", "action_id", "caller_action_id", "attempt"),
        F.when(fault, _message("error", "entrypoint=%s action=%s attempt=%s | %s",
                               "entrypoint_id", "action_id", "attempt", "error")),
    )


def line_messages(lines: DataFrame) -> DataFrame:
    """Messages of task log lines. Columns run_id, ts, seq, source, action_id, attempt, message."""
    source = F.coalesce("source", F.lit("task"))
    return _messages(lines, _message(source, "action=%s attempt=%s | %s", "action_id", "attempt", "message"))


def run_messages(states: DataFrame) -> DataFrame:
    """Messages of a run's states: where it runs (once), status with elapsed time, and each new error.

    Columns run_id, ts, seq, entrypoint_id, namespace_id, version, root_action_id, status, error,
    created_at, updated_at.
    """
    placed = running(
        states.withColumn("error", F.coalesce("error", F.lit(""))), ["run_id"], ["seq"],
        count="_nth", previous={"_error_before": "error"},
    )
    first = F.col("_nth") == 1
    elapsed = F.concat(F.lit(" elapsed="), X.elapsed_seconds(F.col("created_at"), F.col("updated_at")), F.lit("s"))
    placed = placed.withColumn("_state", F.concat("status", F.coalesce(elapsed, F.lit(""))))
    new_error = (F.col("error") != "") & (F.col("error") != F.coalesce("_error_before", F.lit("")))
    return _messages(
        placed,
        F.when(first & F.col("version").isNotNull(),
               _message("deployment", "entrypoint=%s namespace_id=%s version=%s", "entrypoint_id", "namespace_id", "version")),
        F.when(first & F.col("root_action_id").isNotNull(), _message("root", "action=%s", "root_action_id")),
        _message("status", "%s", "_state"),
        F.when(new_error, _message("error", "%s", "error")),
    )


def render_run_log(messages: DataFrame) -> DataFrame:
    """Text lines of messages with columns run_id, ts, seq, source, message and, optionally, part.

    The source is padded to twelve characters; a message gives one line per line of text.
    """
    keys = ["run_id", "ts", "seq", *(["part"] if "part" in messages.columns else [])]
    return messages.select(
        *keys,
        F.when(F.col("source") == "error", "warning").otherwise("info").alias("level"),
        "source",
        F.posexplode(X.text_lines(F.coalesce("message", F.lit("")))).alias("line_no", "_text"),
    ).select(
        *keys, F.col("line_no").cast("long").alias("line_no"), "level",
        F.format_string("%-12s  %s", "source", "_text").alias("line"),
    )


def check_cursors(cursors: DataFrame) -> None:
    """At least one cursor (run_id, stream, after_seq), valid stream names, none twice, no negative position."""
    valid = X.matches(F.col("stream"), X.STREAM_NAME)
    one = cursors.groupBy("run_id", "stream").agg(
        F.count(F.lit(1)).alias("n"), F.max((~F.coalesce(valid, F.lit(False))).cast("int")).alias("bad"), F.min("after_seq").alias("low")
    ).agg(F.max("n").alias("n"), F.max("bad").alias("bad"), F.min("low").alias("low")).first()
    if one["n"] is None:
        raise ValueError("at least one stream cursor is required")
    if one["bad"]:
        raise ValueError("invalid stream")
    if one["low"] is not None and one["low"] < 0:
        raise ValueError("after_seq must not be negative")
    if one["n"] > 1:
        raise ValueError("duplicate stream cursor")
