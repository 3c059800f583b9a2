from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from taskledger.sources.tables import log_source_stream
from taskledger.streaming import logs as live

ENTRY = "run_id bigint, stream string, append_id string, attempt bigint, ord bigint, key binary, value string"


def put(spark, folder, schema, rows, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")


def open_stream(spark, folder, schema):
    return log_source_stream(spark, f"{folder}/*", schema, files_per_trigger=1)


def entry(run, stream, append_id, attempt, ord_, value):
    return (run, stream, append_id, attempt, ord_, bytearray(b"k"), value)


def test_append_sink_over_several_batches_and_a_restart(spark, tmp_path):
    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, ENTRY, [entry(1, "s", "a", 1, 1, "x"), entry(1, "s", "a", 1, 2, "y"), entry(2, "s", "", 1, 1, "z")], 1)
    live.append_log_sink(open_stream(spark, src, ENTRY), target, state, inline_limit=3).awaitTermination()
    # A replay, a conflict, an unnamed batch and a large value come in later micro-batches.
    put(spark, src, ENTRY, [entry(1, "s", "a", 2, 3, "x"), entry(1, "s", "a", 2, 4, "y"), entry(1, "s", "b", 1, 5, "long value")], 2)
    put(spark, src, ENTRY, [entry(1, "s", "a", 3, 6, "other"), entry(2, "s", "", 1, 7, "z"), entry(1, "s", "c", 1, 8, "long value"),
                            entry(1, "s", "d", 1, 9, "long other")], 3)
    live.append_log_sink(open_stream(spark, src, ENTRY), target, state, inline_limit=3).awaitTermination()
    live.append_log_sink(open_stream(spark, src, ENTRY), target, state, inline_limit=3).awaitTermination()
    records = {(r.run_id, r.seq): (r.value, r.value_uri is not None) for r in spark.read.parquet(f"{target}/records").collect()}
    assert records == {(1, 1): ("x", False), (1, 2): ("y", False), (1, 3): (None, True), (1, 4): (None, True), (1, 5): (None, True), (2, 1): ("z", False), (2, 2): ("z", False)}
    outcomes = sorted((r.append_id, r.epoch, r.outcome, r.first_seq or 0) for r in spark.read.parquet(f"{target}/outcomes").collect())
    assert ("a", 1, "replay", 1) in outcomes and ("a", 2, "conflict", 0) in outcomes
    assert [o for *_, o, _ in outcomes].count("appended") == 6
    # content of an earlier micro-batch is not stored again
    assert sorted((r.epoch, r.content) for r in spark.read.parquet(f"{target}/blobs").collect()) == [(1, "long value"), (2, "long other")]


def test_numbers_go_on_across_batches(spark, tmp_path):
    schema = "run_id bigint, stream string, arrival bigint, ord bigint"
    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, schema, [(1, "s", 2, 1), (1, "s", 1, 1)], 1)
    live.stream_assign_sequence(open_stream(spark, src, schema), target, state).awaitTermination()
    put(spark, src, schema, [(1, "s", 3, 1), (2, "s", 3, 1)], 2)
    live.stream_assign_sequence(open_stream(spark, src, schema), target, state).awaitTermination()
    got = sorted((r.run_id, r.arrival, r.seq) for r in spark.read.parquet(f"{target}/records").collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 3, 1)]


RECORD = "run_id bigint, stream string, seq bigint, key binary, value string"


def test_resume_reads_each_record_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    cursors = spark.createDataFrame([(1, "s", 7, bytearray(b"k"))], "run_id bigint, stream string, after_seq bigint, prefix binary")
    put(spark, src, RECORD, [(1, "s", 7, bytearray(b"k"), "seen"), (1, "s", 8, bytearray(b"k1"), "a"), (1, "s", 9, bytearray(b"x"), "no")], 1)
    assert live.resume_tail(open_stream(spark, src, RECORD), cursors, out, state).count() == 1
    put(spark, src, RECORD, [(1, "s", 10, bytearray(b"k2"), "b"), (1, "t", 11, bytearray(b"k"), "no")], 2)
    got = live.resume_tail(open_stream(spark, src, RECORD), cursors, out, state)
    assert sorted(r.seq for r in got.collect()) == [8, 10]
    with pytest.raises(ValueError):
        live.tail_filtered(open_stream(spark, src, RECORD), cursors.unionByName(cursors))


def test_drain_stops_at_the_recorded_end(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, RECORD, [(1, "s", i, bytearray(b"k"), "v") for i in range(1, 6)], 1)
    ends = spark.createDataFrame([(1, "s", 3)], "run_id bigint, stream string, end_seq bigint")
    got = live.bounded_drain(open_stream(spark, src, RECORD), ends, out, state)
    assert sorted(r.seq for r in got.collect()) == [1, 2, 3]


def test_status_stops_at_the_first_closed_one(spark, tmp_path):
    schema = "run_id bigint, action bigint, seq bigint, status string"
    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, schema, [(1, 1, 1, "queued"), (1, 2, 1, "queued")], 1)
    put(spark, src, schema, [(1, 1, 2, "failed"), (1, 2, 2, "running")], 2)
    put(spark, src, schema, [(1, 1, 3, "running")], 3)
    live.stream_run_status(open_stream(spark, src, schema), target, state).awaitTermination()
    got = live.read_current(spark, target, "run_id bigint, action bigint, status string, seq bigint", ["run_id", "action"])
    assert sorted((r.action, r.status, r.seq) for r in got.collect()) == [(1, "failed", 2), (2, "running", 2)]


def test_replays_within_a_watermark(spark, tmp_path):
    schema = "run_id bigint, stream string, append_id string, ord bigint, at timestamp"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    from datetime import datetime

    put(spark, src, schema, [(1, "s", "a", 1, datetime(2024, 1, 1)), (1, "s", "a", 1, datetime(2024, 1, 1, 0, 1))], 1)
    got = live.run_to_end(live.drop_replays_within(open_stream(spark, src, schema), "at", "10 minutes"), out, state)
    assert got.count() == 1


def test_a_batch_that_broke_off_is_repeated_without_duplicates(spark, tmp_path, monkeypatch):
    from pyspark.errors import StreamingQueryException

    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, ENTRY, [entry(1, "s", "a", 1, 1, "x")], 1)
    live.append_log_sink(open_stream(spark, src, ENTRY), target, state).awaitTermination()
    put(spark, src, ENTRY, [entry(1, "s", "b", 1, 2, "y"), entry(1, "s", "a", 2, 3, "x")], 2)
    read_state = live._ends_before

    def broken(session, path, epoch):
        # The state of the second batch cannot be read while it is written.
        found = read_state(session, path, epoch)
        return found.withColumn("end_seq", F.raise_error(F.lit("disk gone")).cast("bigint")) if epoch else found

    monkeypatch.setattr(live, "_ends_before", broken)
    with pytest.raises(StreamingQueryException):
        live.append_log_sink(open_stream(spark, src, ENTRY), target, state).awaitTermination()
    monkeypatch.setattr(live, "_ends_before", read_state)
    live.append_log_sink(open_stream(spark, src, ENTRY), target, state).awaitTermination()
    assert sorted((r.seq, r.value) for r in spark.read.parquet(f"{target}/records").collect()) == [(1, "x"), (2, "y")]
    assert sorted(r.outcome for r in spark.read.parquet(f"{target}/outcomes").collect()) == ["appended", "appended", "replay"]


def test_bad_and_unnamed_batches(spark, tmp_path):
    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    put(spark, src, ENTRY, [
        entry(1, "s", None, 1, 1, "x"), entry(1, "s", "a", 1, 2, "y"), entry(1, "bad stream!", "b", 1, 3, "z"),
        entry(1, "s", "c", 1, 4, ""), entry(2, "s", None, 1, 9, "good"), entry(2, "s", None, 1, 10, ""), entry(2, "s", "", 1, 11, "too"), entry(1, "s", "d" * 201, 1, 5, "w"), (1, "s", "e", 1, 6, bytearray(b"k" * 2000), "v"),
    ], 1)
    put(spark, src, ENTRY, [entry(1, "s", None, 2, 7, "x"), entry(1, "s", "a", None, 8, "y")], 2)
    live.append_log_sink(open_stream(spark, src, ENTRY), target, state).awaitTermination()
    stored = spark.read.parquet(f"{target}/records")
    assert sorted((r.seq, r.value) for r in stored.filter("run_id = 1").collect()) == [(1, "x"), (2, "y"), (3, "x")]
    assert sorted((r.seq, r.value) for r in stored.filter("run_id = 2").collect()) == [(1, "good"), (2, "too")]
    outcomes = spark.read.parquet(f"{target}/outcomes")
    assert sorted(r.outcome for r in outcomes.filter("run_id = 2").collect()) == ["appended", "appended", "rejected"]
    got = sorted((r.append_id[:1], r.epoch, r.outcome, r.reason or "") for r in outcomes.filter("run_id = 1").collect())
    assert got == [
        ("", 0, "appended", ""), ("", 1, "appended", ""), ("a", 0, "appended", ""), ("a", 1, "replay", ""),
        ("b", 0, "rejected", "invalid stream name"), ("c", 0, "rejected", "record too large or empty"),
        ("d", 0, "rejected", "append id too long"), ("e", 0, "rejected", "key too large"),
    ]


def test_state_reads_do_not_grow_with_history(monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 4)
    assert [len(live._since_snapshot("p", epoch)) for epoch in range(1, 10)] == [1, 2, 3, 4, 1, 2, 3, 4, 1]
    assert live._since_snapshot("p", 6) == ["p/epoch=4", "p/epoch=5"]


def test_current_rows_over_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 2)
    schema = "run_id bigint, action bigint, seq bigint, status string"
    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for n in range(5):
        put(spark, src, schema, [(1, n, n, "queued"), (1, 0, n, "running")], n + 1)
    live.stream_run_status(open_stream(spark, src, schema), target, state).awaitTermination()
    got = live.read_current(spark, target, "run_id bigint, action bigint, status string, seq bigint", ["run_id", "action"])
    assert sorted((r.action, r.status, r.seq) for r in got.collect()) == [
        (0, "running", 4), (1, "queued", 1), (2, "queued", 2), (3, "queued", 3), (4, "queued", 4),
    ]
