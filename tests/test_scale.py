"""The split route for large keys gives what the plain windows give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from taskledger.operators.scale import first_rows, read_after, running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        data.append((key, rng.randrange(20), i, rng.choice([None, 1, 2, 5])))
    return spark.createDataFrame(data, "key string, t int, id int, v bigint").repartition(3)


def test_running_same_on_both_routes(skewed):
    def result(limit):
        df = running(
            skewed, ["key"], ["t", "id"], count="n", sums={"total": "v"}, previous={"before": "v", "last": "id"},
            max_rows=limit,
        )
        return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r[2]))

    plain, split = result(10_000), result(15)
    assert plain == split
    state: dict[str, tuple] = {}
    for key, _, row_id, value, n, total, before, last in sorted(plain, key=lambda r: (r[0], r[1], r[2])):
        count, so_far, prev_value, prev_id = state.get(key, (0, None, None, None))
        so_far = so_far if value is None else (so_far or 0) + value
        assert (n, total, before, last) == (count + 1, so_far, prev_value, prev_id)
        state[key] = (count + 1, so_far, value, row_id)


def test_first_rows_limits_groups_before_the_shuffle(skewed):
    top = first_rows(skewed, ["key"], ["t", "id"], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.filter("key = 'hot'").count() == 2


@pytest.mark.parametrize("limit_rows", [10_000, 20])
def test_read_after_against_brute_force(spark, skewed, limit_rows):
    spark.conf.set("spark.taskledger.maxGroupRows", str(limit_rows))
    try:
        rng = random.Random(3)
        asked = [(f"r{i}", rng.choice(["hot", "k1", "k2", "none"]), rng.choice([None, rng.randrange(22)]),
                  rng.randrange(900), rng.randrange(1, 50)) for i in range(30)]
        asked = [(r, k, t, None if t is None else i, n) for r, k, t, i, n in asked]
        requests = spark.createDataFrame(asked, "rid string, key string, t int, id int, n int")
        got = read_after(skewed, requests, keys=["key"], order=["t", "id"], request_id="rid", limit="n")
        found = {}
        for r in got.collect():
            found.setdefault(r.rid, []).append((r.position, r.t, r.id, r.v, r.more))
        every = sorted((tuple(r) for r in skewed.collect()), key=lambda r: (r[0], r[1], r[2]))
        for rid, key, t, row_id, n in asked:
            after = [r for r in every if r[0] == key and (t is None or (r[1], r[2]) > (t, row_id))]
            expected = [(i + 1, r[1], r[2], r[3], len(after) > n) for i, r in enumerate(after[:n])]
            assert sorted(found.get(rid, [])) == expected
    finally:
        spark.conf.unset("spark.taskledger.maxGroupRows")
