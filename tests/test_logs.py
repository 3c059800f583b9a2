from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from taskledger.operators import logs

ENTRY = "run_id bigint, stream string, append_id string, ord int, key string, value string"


def test_batch_digest(spark):
    data = [(1, "s", "a", 2, "k2", "v2"), (1, "s", "a", 1, "k", "1v1"), (1, "s", "b", 1, "k1", "v1"), (1, "s", "big", 1, "k", "x" * 50)]
    got = {r.append_id: r for r in logs.batch_digest(
        spark.createDataFrame(data, ENTRY), ["run_id", "stream", "append_id"], ["ord"]).collect()}
    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in (b"k", b"1v1", b"k2", b"v2"))).hexdigest()
    assert got["a"].digest == want and got["a"].n == 2
    # The same bytes split differently between key and value are another batch.
    assert got["b"].digest != hashlib.sha256(b"k" + b"1v1").hexdigest()
    assert got["big"].digest == hashlib.sha256(
        b"".join(len(p).to_bytes(8, "big") + p for p in (b"k", b"x" * 50))).hexdigest()


def test_append_reconcile(spark, rows):
    batches = spark.createDataFrame([
        (1, "s", "a", 1, "d1", 3), (1, "s", "a", 2, "d1", 3), (1, "s", "a", 3, "d2", 3),
        (1, "s", "", 4, "d1", 2), (1, "s", None, 5, "d1", 2), (1, "s", "old", 6, "d9", 4), (1, "s", "old", 7, "d8", 4),
    ], "run_id bigint, stream string, append_id string, arrival bigint, digest string, n bigint")
    ledger = spark.createDataFrame([(1, "s", "old", "d9", 1, 4)],
                                   "run_id bigint, stream string, append_id string, digest string, first_seq bigint, last_seq bigint")
    ends = spark.createDataFrame([(1, "s", 10)], "run_id bigint, stream string, end_seq bigint")
    got = rows(logs.append_reconcile(batches, ledger, ends), "arrival", "outcome", "first_seq", "last_seq")
    assert got == [
        (1, "appended", 11, 13), (2, "replay", 11, 13), (3, "conflict", None, None), (4, "appended", 14, 15),
        (5, "appended", 16, 17), (6, "replay", 1, 4), (7, "conflict", None, None),
    ]


def test_assign_sequence_after_ends(spark, rows):
    entries = spark.createDataFrame([(1, "s", 5, 1), (1, "s", 4, 1), (2, "s", 1, 1)], "run_id bigint, stream string, arrival int, ord int")
    ends = spark.createDataFrame([(1, "s", 7)], "run_id bigint, stream string, end_seq bigint")
    assert rows(logs.assign_sequence(entries, ends), "run_id", "arrival", "seq") == [(1, 4, 8), (1, 5, 9), (2, 1, 1)]


def records(spark):
    data = [(1, "s", i, bytearray(b"action/%d" % (i % 2)), f"v{i}") for i in range(1, 10)] + [(1, "t", 1, bytearray(b"x"), "w")]
    return spark.createDataFrame(data, "run_id bigint, stream string, seq bigint, key binary, value string")


def test_cursor_read(spark, rows):
    asked = spark.createDataFrame([
        ("all", 1, "s", 0, None, 0), ("two", 1, "s", 7, None, 1), ("key", 1, "s", 0, bytearray(b"action/1"), 2), ("end", 1, "s", 9, None, 5),
        ("bad", 1, "s", 0, None, 1001), ("neg", 1, "s", -1, None, 5), ("max", 1, "s", 0, None, 1000),
    ], "request_id string, run_id bigint, stream string, after_seq bigint, key binary, limit int")
    read = logs.cursor_read(records(spark), asked)
    assert dict(rows(read.filter("seq IS NULL"), "request_id", "verdict")) == {"end": "ok", "bad": "invalid limit", "neg": "invalid cursor"}
    got = rows(read.filter("seq IS NOT NULL"), "request_id", "seq", "truncated")
    by = {}
    for rid, seq, cut in got:
        by.setdefault(rid, []).append((seq, cut))
    assert by["all"] == by["max"] == [(i, False) for i in range(1, 10)]
    assert by["two"] == [(8, True)]
    assert by["key"] == [(1, True), (3, True)]
    assert set(by) == {"all", "max", "two", "key"}


def test_filtered_batch(spark):
    asked = spark.createDataFrame([
        ("full", 1, "s", 8 - 1, bytearray(b"action/"), 1), ("some", 1, "s", 8, bytearray(b"action"), 5),
        ("none", 1, "s", 0, bytearray(b"zzz"), 5), ("empty", 1, "u", 0, None, 5),
    ], "request_id string, run_id bigint, stream string, after_seq bigint, prefix binary, batch int")
    got = {r.request_id: (r.seq, r.inspect_seq) for r in logs.filtered_batch(records(spark), asked).collect()}
    assert got == {"full": (8, 8), "some": (9, 9), "none": (None, 9), "empty": (None, 0)}


def test_batch_limits_earliest_fault_decides(spark, rows):
    data = [(1, "s", "ok", 1, "k", "v"), (1, "s", "key", 1, "kkkkk", "v"), (1, "s", "empty", 1, "k", ""),
            (1, "s", "sum", 1, "k", "123456789"), (1, "s", "sum", 2, "k", "123456789"), (1, "s", "sum", 3, "kkkkk", "v"),
            (1, "s", "mix", 1, "kkkkk", "v"), (1, "s", "mix", 2, "k", "123456789"), (1, "s", "mix", 3, "k", "123456789")]
    heads = spark.createDataFrame([(1, "s", n) for n in ("ok", "void")], "run_id bigint, stream string, append_id string")
    by = ["run_id", "stream", "append_id"]
    df = spark.createDataFrame(data, ENTRY)
    got = dict(rows(logs.batch_limits(df, by, max_key=4, max_record=10, max_batch=19), "append_id", "verdict"))
    assert got == {"ok": "ok", "key": "key too large", "empty": "record too large or empty", "sum": "batch too large", "mix": "key too large"}
    assert dict(rows(logs.batch_limits(df, by, headers=heads), "append_id", "verdict")) == {"ok": "ok", "void": "empty batch"}


def test_spill_threshold(spark):
    df = spark.createDataFrame([(1, "x" * 65536), (2, "x" * 65537), (3, "x" * 65537)], "id int, value string")
    inline, blobs = logs.spill_large_values(df)
    got = {r.id: (r.value is None, r.value_uri is None) for r in inline.collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False)}
    assert blobs.count() == 1 and blobs.first().size == 65537


def test_latest_state_default(spark, rows):
    saved = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 2, "y")], "run_id bigint, name string, seq bigint, value string")
    wanted = spark.createDataFrame([(1, "a"), (1, "b")], "run_id bigint, name string")
    assert rows(logs.latest_state(saved, wanted, "none"), "name", "found", "value") == [("a", True, "y"), ("b", False, "none")]


def test_check_cursors(spark):
    def given(*rows):
        return spark.createDataFrame([(1, *r) for r in rows], "run_id bigint, stream string, after_seq bigint")

    logs.check_cursors(given(("a", 0), ("b", 3)))
    for bad, said in (([], "at least one"), ([("a", 0), ("a", 1)], "duplicate"), ([("9", 0)], "invalid stream"), ([(None, 0)], "invalid stream"), ([("a", -1)], "negative")):
        with pytest.raises(ValueError, match=said):
            logs.check_cursors(given(*bad))


def test_render(spark):
    df = spark.createDataFrame([(1, 1, "error", "a\nb"), (1, 2, "task", "")], "run_id int, seq int, source string, message string")
    got = [(r.level, r.line) for r in logs.render_run_log(df.withColumn("ts", F.lit(None).cast("timestamp"))).orderBy("seq", "line_no").collect()]
    assert got == [("warning", "error         a"), ("warning", "error         b"), ("info", "task          ")]


def test_messages_of_a_run(spark):
    from taskledger.functions import expr as X

    states = spark.createDataFrame(
        [(1, 1, 2, "n", "v", 10, "running", None), (1, 2, 2, "n", "v", 10, "running", "a\nb"), (1, 3, 2, "n", "v", 10, "failed", "a\nb")],
        "run_id int, seq int, entrypoint_id int, namespace_id string, version string, root_action_id int, status string, error string",
    ).withColumns({"ts": X.as_ntz("2024-01-01 00:00:02"), "created_at": X.as_ntz("2024-01-01 00:00:00"),
                   "updated_at": X.as_ntz("2024-01-01 00:00:01.5")})
    got = logs.render_run_log(logs.run_messages(states)).orderBy("seq", "part", "line_no").collect()
    assert [(r.seq, r.level, r.line) for r in got] == [
        (1, "info", "deployment    entrypoint=2 namespace_id=n version=v"), (1, "info", "root          action=10"),
        (1, "info", "status        running elapsed=1.500s"), (2, "info", "status        running elapsed=1.500s"),
        (2, "warning", "error         a"), (2, "warning", "error         b"), (3, "info", "status        failed elapsed=1.500s"),
    ]


def test_messages_of_actions_and_lines(spark):
    events = spark.createDataFrame(
        [(1, 1, "x", None, 3, "failed", 2, "no", True), (1, 2, "y", "x", 3, "running", 1, "no", False)],
        "run_id int, seq int, action_id string, caller_action_id string, entrypoint_id int, status string, attempt int, "
        "error string, cache_hit boolean",
    ).withColumn("ts", F.lit(None).cast("timestamp"))
    got = [(r.source, r.message) for r in logs.action_messages(events).orderBy("seq", "part").collect()]
    assert got == [
        ("cache", "hit entrypoint=3 action=x"), ("task", "entrypoint=3 failed action=x parent= attempt=2"),
        ("error", "entrypoint=3 action=x attempt=2 | no"), ("task", "entrypoint=3 running action=y parent=x attempt=1"),
    ]
    lines = spark.createDataFrame([(1, 1, None, "x", 1, "hi")], "run_id int, seq int, source string, action_id string, attempt int, message string")
    line = logs.line_messages(lines.withColumn("ts", F.lit(None).cast("timestamp"))).first()
    assert (line.source, line.message) == ("task", "action=x attempt=1 | hi")
