from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators import runs, tables

AS_OF = "2024-01-01 12:00:00"
RUN = "id bigint, claim_token string, lease_until timestamp_ntz"


def make_runs(spark):
    from datetime import datetime

    return spark.createDataFrame(
        [(1, "t1", datetime(2024, 1, 2)), (2, "t2", datetime(2024, 1, 1, 12)), (3, None, None)], RUN
    )


@pytest.mark.parametrize("limit", [10_000, 4])
def test_fold_transitions_against_brute_force(spark, limit):
    spark.conf.set("spark.taskledger.maxGroupRows", str(limit))
    rng = random.Random(limit)
    try:
        acts, moves = [], []
        for a in range(30):
            acts.append((a, a % 3 + 1, rng.choice(["queued", "running", "succeeded"]), rng.randrange(2), 0))
            for seq in range(1, rng.randrange(1, 30 if a == 1 else 9)):
                expected = rng.randrange(3)
                moves.append((a, seq, rng.choice(["t1", "t1", "t1", "t2"]), expected, expected + rng.choice([0, 0, 1]), seq,
                              rng.choice(["queued", "running", "waiting", "running", "failed"])))
        state = {a: [status, attempts, failures] for a, _, status, attempts, failures in acts}
        run_of = {a: r for a, r, *_ in acts}
        verdict = {}
        for a, seq, token, expected, attempt, failures, status in sorted(moves):
            held = run_of[a] == 1 and token == "t1"
            ok = held and state[a][1] == expected and state[a][0] not in X.TERMINAL
            verdict[a, seq] = "applied" if ok else "lease lost"
            if ok:
                state[a] = [status, attempt, failures]
        new, report = tables.fold_transitions(
            spark.createDataFrame(acts, "id bigint, run_id bigint, status string, attempts bigint, failures bigint"),
            spark.createDataFrame(moves, "action_id bigint, seq bigint, claim_token string, expected_attempt bigint, "
                                  "attempt bigint, failures bigint, status string"),
            make_runs(spark), X.as_ntz(AS_OF),
        )
        assert {r.id: [r.status, r.attempts, r.failures] for r in new.collect()} == state
        assert {(r.action_id, r.seq): r.verdict for r in report.collect()} == verdict
        assert "applied" in verdict.values()
    finally:
        spark.conf.unset("spark.taskledger.maxGroupRows")


def test_reset_needs_a_valid_claim(spark, rows):
    acts = spark.createDataFrame([(i, i, "running") for i in (1, 2, 3)] + [(4, 1, "failed")], "id bigint, run_id bigint, status string")
    claims = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "run_id bigint, claim_token string")
    got = dict(rows(tables.reset_inflight(acts, make_runs(spark), claims, X.as_ntz(AS_OF)), "id", "status"))
    assert got == {1: "queued", 2: "running", 3: "running", 4: "failed"}


def test_cancel_only_under_an_open_root_but_claim_always_clears(spark, rows):
    acts = spark.createDataFrame(
        [(10, 1, "running"), (11, 1, "queued"), (20, 2, "succeeded"), (21, 2, "running")], "id bigint, run_id bigint, status string"
    )
    table = make_runs(spark).withColumn("root_action_id", F.col("id") * 10)
    ids = spark.createDataFrame([(1,), (2,)], "run_id bigint")
    new, new_runs = tables.cancel_active(acts, table, ids)
    assert dict(rows(new, "id", "status")) == {10: "canceled", 11: "canceled", 20: "succeeded", 21: "running"}
    assert dict(rows(new_runs, "id", "claim_token")) == {1: None, 2: None, 3: None}


def test_insert_if_absent(spark, rows):
    table = spark.createDataFrame([("a", "old")], "k string, v string")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y", 3), ("b", "z", 2)], "k string, v string, at int")
    after, report = tables.insert_if_absent(table, new, ["k"], ["at"])
    assert rows(after) == [("a", "old"), ("b", "z")]
    assert rows(report, "at", "outcome") == [(1, "duplicate"), (2, "inserted"), (3, "duplicate")]


def test_promote_uploads_with_parts(spark, rows):
    mib = 1024 * 1024
    uploads = spark.createDataFrame([
        (1, "d1", "o1", 5, None, 1), (2, "d1", "o2", 5, None, 2), (3, "d3", "o3", 9 * mib, "m", 3), (4, "d4", "o4", 9 * mib, "m", 4),
        (5, "d5", "o5", 9 * mib, "m", 5), (6, "d6", "o6", 5, None, 6), (7, "d7", "o7", 5, None, 7), (8, "d8", "o8", 5, None, 8),
        (9, "d9", "o9", 9 * mib, "m", 9),
    ], "session bigint, sha256 string, object_key string, size bigint, multipart_id string, arrival bigint")
    objects = spark.createDataFrame(
        [(f"o{i}", 9 * mib if i in (3, 4, 5, 9) else 5, f"d{1 if i == 2 else i}") for i in (1, 2, 3, 4, 5, 9)] + [("o7", 6, "d7"), ("o8", 5, "other")],
        "object_key string, stored_size bigint, stored_sha256 string")
    parts = spark.createDataFrame(
        [(3, 1, "e"), (3, 2, "e"), (4, 1, "e"), (5, 1, "e"), (5, 1, "e"), (6, 1, "e"), (9, 1, "e"), (9, 2, " ")],
        "session bigint, number int, etag string")
    blobs = spark.createDataFrame([], "sha256 string, object_key string")
    table, verdicts = tables.promote_uploads(uploads, objects, parts, blobs)
    assert dict(rows(verdicts, "session", "verdict")) == {
        1: "inserted", 2: "duplicate", 3: "inserted", 4: "incorrect part count", 5: "invalid part list",
        6: "single upload takes no parts", 7: "size mismatch", 8: "digest mismatch", 9: "invalid part list",
    }
    assert rows(table) == [("d1", "o1"), ("d3", "o3")]


def test_page_tokens_lead_through_all_rows(spark, rows):
    acts = spark.createDataFrame([(1, i, i % 3) for i in range(7)], "run_id bigint, id bigint, day int").withColumn(
        "created_at", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("day")))
    )
    seen, token = [], None
    while True:
        asked = spark.createDataFrame([("q", 1, token, 3)], "request_id string, run_id bigint, page_token string, size int")
        page = runs.keyset_page(acts, runs.with_page_tokens(asked, "bigint")).orderBy("position").collect()
        seen += [r.id for r in page]
        token = page[-1].next_page_token
        if token is None:
            break
    assert seen == [0, 3, 6, 1, 4, 2, 5]
    bad = spark.createDataFrame([("q", 1, "%%%", 3)], "request_id string, run_id bigint, page_token string, size int")
    assert runs.with_page_tokens(bad).first().bad_token


def test_requests_of_pages_are_computed_once(spark):
    acts = spark.range(40).select(
        (F.col("id") % 4).alias("run_id"), "id", F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at")
    )
    named = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()  # other names whenever it is computed again
    asked = spark.range(4).select(
        named().alias("request_id"), F.col("id").alias("run_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("long").alias("id"), F.lit(3).alias("size"),
    )
    page = runs.keyset_page(acts, asked).collect()
    assert sorted((r.run_id, r.id) for r in page) == [(k, k + 4 * i) for k in range(4) for i in range(3)]


def test_every_upstream_has_a_row(spark, rows):
    acts = spark.createDataFrame([(1,), (2,)], "id bigint")
    edges = spark.createDataFrame([(1, 10 + i) for i in range(7)], "dependent_action_id bigint, source_action_id bigint")
    assert rows(runs.actions_with_upstreams(acts, edges), "id", "position", "upstream_id") == [
        *[(1, i + 1, 10 + i) for i in range(7)], (2, None, None),
    ]


def test_retry_plan(spark, rows):
    df = spark.createDataFrame([(1, 0, 3, False), (2, 2, 3, False), (3, 0, 3, True), (4, 0, 0, False), (5, 9, 20, False)],
                               "id int, failures int, max_attempts int, cacheable boolean").withColumn("at", X.as_ntz("2024-01-01 00:00:00"))
    got = {r.id: (r.next_status, r.failures, str(r.next_attempt_at)[-8:]) for r in runs.retry_plan(df).collect()}
    assert got == {1: ("queued", 1, "00:00:01"), 2: ("failed", 3, "None"), 3: ("failed", 1, "None"), 4: ("failed", 1, "None"),
                   5: ("queued", 10, "00:01:04")}


def test_retry_policy(spark, rows):
    df = spark.createDataFrame([(1, "none", None), (2, "idempotent", None), (3, "none", 2), (4, "idempotent", 101), (5, "always", 1), (6, None, 1)],
                               "id int, retry string, max_attempts int")
    assert rows(runs.retry_policy(df), "id", "attempts", "verdict") == [
        (1, 1, "ok"), (2, 3, "ok"), (3, 2, "one attempt only"), (4, 101, "attempts out of range"), (5, 1, "invalid retry mode"),
        (6, 1, "invalid retry mode"),
    ]
