from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from taskledger.operators import blobs, memo, quality
from taskledger.sources.tables import blob_source, load_tables

NAME = base64.b64encode(hashlib.sha256(b"hello").digest()).decode()


def test_blob_uris(spark):
    cases = {
        f"blob:application/cbor,{NAME}": "application/cbor", f"blob:text/plain; charset=utf-8;resolve,{NAME}": "text/plain; charset=utf-8",
        "blob:application/cbor,invalid": None, f"data:text/plain,{NAME}": None, f"blob:application/cbor,{NAME}x": None,
        f"blob:,{NAME}": None, f"blob:text plain,{NAME}": None, "blob:text/plain": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "uri string")
    got = {r.uri: r for r in blobs.validate_blob_uris(df).collect()}
    assert {u: r.mime_type for u, r in got.items()} == cases
    assert all(r.digest == hashlib.sha256(b"hello").hexdigest() for r in got.values() if r.verdict == "ok")
    assert got[f"blob:text/plain; charset=utf-8;resolve,{NAME}"].resolve


def test_nested_references(spark, rows):
    inner = hashlib.sha256(b"inner").digest()
    uri = lambda d: f"blob:text/plain;resolve,{base64.b64encode(d).decode()}"
    outer_text = uri(inner)
    outer = hashlib.sha256(outer_text.encode()).digest()
    deep = [hashlib.sha256(f"deep{i}".encode()).digest() for i in range(70)]
    ring = [hashlib.sha256(f"ring{i}".encode()).digest() for i in range(3)]
    content = [(inner.hex(), "inner"), (outer.hex(), outer_text), (outer.hex(), outer_text), (deep[69].hex(), "bottom")]
    content += [(d.hex(), uri(n)) for d, n in zip(deep, deep[1:], strict=False)] + [(ring[i].hex(), uri(ring[(i + 1) % 3])) for i in range(3)]
    stored = spark.createDataFrame(content, "digest string, content string")
    lost = uri(b"\0" * 32)
    values = spark.createDataFrame(
        [(1, uri(outer)), (2, "plain"), (3, lost), (4, uri(deep[0])), (5, uri(ring[1])), (6, None), (7, uri(outer))], "id int, value string"
    )
    assert rows(blobs.resolve_nested(values, stored), "id", "value", "outcome") == [
        (1, "inner", "resolved"), (2, "plain", "plain"), (3, lost, "missing"), (4, "bottom", "resolved"), (5, uri(ring[1]), "cycle"),
        (6, None, "plain"), (7, "inner", "resolved"),
    ]


def test_blob_source(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b").write_bytes(b"\0\1")
    (tmp_path / "none.json").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.digest, r.size, r.mime_type) for r in blob_source(spark, f"{tmp_path}/*").collect()}
    assert got == {"a.txt": (hashlib.sha256(b"hello").hexdigest(), 5, "text/plain"),
                   "b": (hashlib.sha256(b"\0\1").hexdigest(), 2, "application/octet-stream"),
                   "none.json": (hashlib.sha256(b"").hexdigest(), 0, "application/json")}


def test_load_tables(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("string").alias("run_id"), F.lit("a").alias("source_action_id"),
                          F.lit("b").alias("dependent_action_id")).write.parquet(f"{tmp_path}/task_action_edges")
    assert load_tables(spark, str(tmp_path), ["task_action_edges"])["task_action_edges"].count() == 3


def test_memo_map_round_trip(spark, rows):
    # Local, so that it travels to the workers by value.
    def work(x: int) -> int:
        if x == 3:
            raise memo.CacheableError("bad_input", {"x": x})
        if x == 4:
            raise ValueError("try later")
        return x * 10

    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 2, 3, 4])], "id int, x bigint")
    keyed = memo.cache_keys(df, "work", "1.0.0", F.lit("env"), F.lit("fp"), ["x"])
    cache = spark.createDataFrame([], "cache_key string, output bigint, error_code string, error_details string")
    first, added = memo.memo_map(keyed, work, ["x"], "bigint", cache, max_attempts=3)
    assert rows(first, "id", "output", "error", "attempts", "cache_hit") == [
        (0, 10, None, 1, False), (1, 10, None, 1, False), (2, 20, None, 1, False), (3, None, "bad_input", 1, False),
        (4, None, "try later", 3, False),
    ]
    assert added.count() == 3
    second, more = memo.memo_map(keyed, work, ["x"], "bigint", cache.unionByName(added), max_attempts=1)
    assert rows(second, "id", "output", "error", "attempts", "cache_hit") == [
        (0, 10, None, 0, True), (1, 10, None, 0, True), (2, 20, None, 0, True), (3, None, "bad_input", 0, True),
        (4, None, "try later", 1, False),
    ]
    assert more.isEmpty()


def test_cache_key_depends_on_every_part(spark):
    base = dict(fn_name="f", version="1.0.0", env_name=F.lit("e"), env_fingerprint=F.lit("p"), inputs=[F.lit("ab"), F.lit("c")])
    others = [dict(base, fn_name="g"), dict(base, version="1.0.1"), dict(base, env_name=F.lit("x")), dict(base, env_fingerprint=F.lit("q")),
              dict(base, inputs=[F.lit("a"), F.lit("bc")]), dict(base, inputs=[F.lit("ab"), F.lit(None)]),
              dict(base, dependency_digest=F.lit("d"))]
    keys = spark.range(1).select(*[memo.cache_key(**o).alias(f"k{i}") for i, o in enumerate([base, *others])]).first()
    assert len(set(keys)) == len(others) + 1


def test_cacheable_error_limits():
    for code in ("", "Bad", "9x", "a" * 129):
        with pytest.raises(ValueError):
            memo.CacheableError(code)
    with pytest.raises(ValueError):
        memo.CacheableError("ok", "x" * 70000)


def test_manifest_rules(spark, rows):
    sha = "sha256:" + "0" * 64
    data = [
        ("a", 1, "x", "reg", 5, 0, 5, sha, ""), ("a", 2, "x/", "dir", 0, 0, 0, "", ""), ("a", 3, "l", "symlink", 0, 0, 0, "", "../outside"),
        ("a", 4, "d/l", "symlink", 0, 0, 0, "", "../x"), ("a", 5, "y", "reg", 5, 4, 9, sha, ""), ("a", 6, "z", "fifo", 0, 0, 0, "", ""),
        ("a", 7, "w", "reg", 5, 20, 20, "sha1:00", ""), ("a", 8, "q", "reg", 0, 0, 0, "", "x"), ("a", 9, "dir/", "dir", 3, 30, 33, "", ""),
    ]
    df = spark.createDataFrame(data, "archive string, doc_id int, name string, kind string, size bigint, start bigint, "
                               "`end` bigint, digest string, link string")
    got = set(rows(quality.validate_manifest(df), "doc_id", "rule"))
    assert got == {(1, "duplicate path"), (2, "duplicate path"), (3, "link"), (5, "overlap"), (6, "type"), (7, "range"), (7, "digest"),
                   (8, "link"), (9, "no content")}


def test_environment_rules(spark, rows):
    source = f"blob:{quality.ARCHIVE_MIME},{NAME}"
    good = dict(k=1, namespace_id="n", name="env", source_uri=source, provider="local-python", reference=None, build_context_uri=source,
                build_command=["make"], workdir="a/b", cpu_millis=0, memory_bytes=0, env_vars={"A": "b"},
                dependencies=[("n", "dep", "0" * 64)], entrypoints=[(["python"], True, "1.0.0", 1)])
    cases = [
        ({}, None), (dict(name="Env"), "name"), (dict(source_uri=source + ";"), "source"), (dict(provider="vm"), "provider"),
        (dict(reference="x"), "local reference"), (dict(build_context_uri=None), "build context"), (dict(build_command=[]), "build command"),
        (dict(workdir="a/../b"), "workdir"), (dict(provider="docker"), "reference missing"), (dict(cpu_millis=1_000_001), "resources"),
        (dict(memory_bytes=2**50 + 1), "resources"), (dict(env_vars={"PATH": ""}), "environment variable"),
        (dict(env_vars={"UV_X": ""}), "environment variable"), (dict(env_vars={"A": "x" * 65536}), "environment size"),
        (dict(dependencies=[("n", "env", "0" * 64)]), "dependencies"), (dict(dependencies=[("m", "dep", "0" * 64)]), "dependencies"),
        (dict(dependencies=[("n", f"d{i}", "0" * 64) for i in range(129)]), "dependency count"), (dict(entrypoints=[]), "entrypoint count"),
        (dict(entrypoints=[(["python"], False, "1.0.0", 1)]), "entrypoint"), (dict(entrypoints=[(["python"], True, "1.0", 1)]), "entrypoint"),
        (dict(entrypoints=[([""], False, "", 1)]), "entrypoint"), (dict(entrypoints=[(["p"], False, "", 101)]), "entrypoint"),
    ]
    schema = ("k int, namespace_id string, name string, source_uri string, provider string, reference string, build_context_uri string, "
              "build_command array<string>, workdir string, cpu_millis bigint, memory_bytes bigint, env_vars map<string,string>, "
              "dependencies array<struct<namespace_id:string,name:string,version:string>>, "
              "entrypoints array<struct<command:array<string>,cache:boolean,task_version:string,max_attempts:int>>")
    data = [tuple(dict(good, **change, k=i).values()) for i, (change, _) in enumerate(cases)]
    got = set(rows(quality.validate_environments(spark.createDataFrame(data, schema), ["k"]), "k", "rule"))
    assert got == {(i, rule) for i, (_, rule) in enumerate(cases) if rule}


def test_split_valid(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    found = quality.violations(df, ["id"], [("large", F.col("v") > 10), ("odd", F.col("v") % 2 == 0)])
    assert rows(found, "id", "rule") == [(2, "large"), (2, "odd"), (3, "large"), (3, "odd")]
    good, bad = quality.split_valid(df, found, ["id"])
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_whole_numbers_stay_whole_beside_nulls_and_failures(spark, rows):
    def double(x):
        if x is None:
            raise ValueError("nothing")
        return 2 * x

    big = 2**53 + 1
    df = spark.createDataFrame([(1, big, None), (2, None, big), (3, 2**62, big)], "id bigint, x bigint, other bigint")
    got = rows(memo.task_map(df, double, ["x"], "bigint"), "id", "x", "other", "output", "error")
    assert got[0] == (1, big, None, 2 * big, None)
    assert got[1] == (2, None, big, None, "nothing")
    assert got[2][:4] == (3, 2**62, big, None) and got[2][4]


def test_constraints_meet_in_one_shuffle(spark):
    runs = spark.createDataFrame([("a", "n1", "a1"), ("b", "n2", None), ("b", "n1", "b1")], "id string, namespace_id string, root_action_id string")
    actions = spark.createDataFrame(
        [("a1", "a", None, "x"), ("a2", "a", "a1", "queued"), ("a3", "a", "zz", "queued"), ("a|4", "c", None, "queued"), ("a4", "c", None, "queued")],
        "id string, run_id string, caller_action_id string, status string",
    )
    spaces = spark.createDataFrame([("n1", "s"), ("n3", "s")], "id string, slug string")
    tables = {"runs": runs, "task_actions": actions, "namespaces": spaces}
    got = {tuple(r) for r in quality.check_table_constraints(tables).collect()}
    assert got == {
        ("namespaces", "unique slug", "s"), ("runs", "primary key", "b"), ("runs", "namespace exists", "b"), ("runs", "root exists", "b"),
        ("task_actions", "one root", "c"), ("task_actions", "status", "a1"), ("task_actions", "caller exists", "a3"),
        ("task_actions", "run exists", "a|4"), ("task_actions", "run exists", "a4"),
    }
    rules = quality._Constraints(tables)
    rules.unique("runs", ["id"])
    rules.refers("task_actions", ["id"], "runs", {"run_id": "id"}, "run exists")
    plan = rules.met()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_environments_spelled_in_two_ways_have_one_version(spark):
    name = "blob:" + quality.ARCHIVE_MIME + "," + base64.b64encode(hashlib.sha256(b"a").digest()).decode()
    schema = (
        "id int, namespace_id string, name string, source_uri string, provider string, reference string, build_context_uri string, "
        "build_command array<string>, workdir string, cpu_millis bigint, memory_bytes bigint, env_vars map<string,string>, "
        "dependencies array<struct<namespace_id:string,name:string,version:string>>, "
        "entrypoints array<struct<command:array<string>,cache:boolean,task_version:string,max_attempts:bigint>>"
    )
    entry, deps = [(["run", "x"], None, None, 2)], [("n", "a", "1"), ("n", "b", "2")]
    first = (1, "n", "env", name, "local", None, name, ["make"], ".", None, 0, {"A": "1", "B": "2"}, deps, entry)
    same = (2, "n", "env", name, "local", "", name, ["make"], ".", 1000, 2**30, {"B": "2", "A": "1"}, deps[::-1], [(["run", "x"], False, "", 2)])
    others = [
        (3, *first[1:7], ["ma", "ke"], *first[8:]), (4, *first[1:11], {"A": "12", "B": ""}, *first[12:]), (5, *first[1:9], 1001, *first[10:]),
        (6, *first[1:13], [*entry, *entry]), (7, *first[1:12], None, entry), (8, *first[1:5], "r", *first[6:]),
    ]
    got = {r["id"]: r["version"] for r in quality.canonical_environment(spark.createDataFrame([first, same, *others], schema)).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 7 and None not in got.values()


def test_blob_source_lists_folders(spark, tmp_path, monkeypatch):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"{i}.txt").write_text(f"{name}{i}" if i else "")
        (tmp_path / name / "other.json").write_text("{}")
    asked, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, path=None, **more: asked.append(path) or load(self, path, **more))

    def sizes(glob):
        return sorted(("/".join(r.path.rsplit("/", 2)[1:]), r.size) for r in blob_source(spark, glob).collect())

    expected = [(f"{d}/{i}.txt", 2 * (i > 0)) for d in "ab" for i in range(3)]
    assert sizes(f"{tmp_path}/*/*.txt") == expected and asked == [f"{tmp_path}/*"]
    assert sizes(f"{tmp_path}/b/[12].txt") == [("b/1.txt", 2), ("b/2.txt", 2)]
    assert ("b/other.json", 2) in sizes(f"{tmp_path}/*")  # a glob of folders reads what is in them
    (tmp_path / "a" / "k=1").mkdir()
    (tmp_path / "a" / "k=1" / "deep.txt").write_text("deep")
    assert sizes(f"{tmp_path}/a/*.txt") == expected[:3]
    assert sizes(f"{tmp_path}/b/1.txt") == [("b/1.txt", 2)]


def test_constraint_keys_are_hashed_and_compared_by_value(spark):
    runs = spark.createDataFrame([(7, "n|1"), (8, "n|1"), (8, None)], "id int, namespace_id string")
    actions = spark.createDataFrame(
        [(1, 7, None, "a|b", "queued"), (2, 7, 1, "a|b", "queued"), (3, 9, 1, None, "queued"), (4, 9, 2, "c", "lost"), (5, 8, 10**12, "c", "queued")],
        "id bigint, run_id bigint, caller_action_id bigint, idempotency_key string, status string",
    )
    spaces = spark.createDataFrame([("n", "s")], "id string, slug string")
    tables = {"runs": runs, "task_actions": actions, "namespaces": spaces}
    got = sorted(tuple(r) for r in quality.check_table_constraints(tables).collect())
    assert got == sorted([
        ("runs", "primary key", "8"), ("runs", "namespace exists", "7"), ("runs", "namespace exists", "8"),
        ("task_actions", "unique idempotency key", "7|a|b"), ("task_actions", "run exists", "3"), ("task_actions", "run exists", "4"),
        ("task_actions", "caller exists", "3"), ("task_actions", "caller exists", "4"), ("task_actions", "caller exists", "5"), ("task_actions", "status", "4"),
    ])
    texts = actions.withColumn("run_id", F.concat(F.lit("0"), F.col("run_id").cast("string")))  # 07 is not 7
    found = quality.check_table_constraints({"runs": runs, "task_actions": texts}).filter("rule = 'run exists'")
    assert sorted(r["row_key"] for r in found.collect()) == ["1", "2", "3", "4", "5"]
    rules = quality._Constraints(tables)
    rules.unique("runs", ["id"])
    rules.refers("task_actions", ["id"], "runs", {"run_id": "id"}, "run exists")
    plan = rules.met()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
