"""All stored relations with faults made in some of their columns, and the constraints they break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taskledger.operators import quality as ops
from taskledger.plans.registry import query
from taskledger.session import fresh_path, written
from taskledger.sources import fixtures as fx
from taskledger.sources.tables import SCHEMAS, source_table
from taskledger.sources.tables import load_tables as read_tables

#: Each relation as the check sees it.
STORED = """WITH s_env AS (SELECT id, CASE WHEN id % 23 = 3 THEN -1 ELSE namespace_id END AS namespace_id, name,
    CASE WHEN id % 40 < 2 THEN 'same' ELSE version END AS version FROM environments),
  s_runs AS (SELECT r.id, CASE WHEN r.id % 89 = 1 THEN 99 ELSE r.namespace_id END AS namespace_id, q.key AS idem,
    CASE WHEN r.id % 101 = 7 THEN -root_action_id ELSE root_action_id END AS root_action_id FROM runs r JOIN requests q ON q.arrival = r.id),
  s_actions AS (SELECT id, run_id, CASE WHEN pos = 4 AND status = 'canceled' THEN -caller_action_id WHEN pos = 2 AND run_id % 29 = 0 THEN NULL
      ELSE caller_action_id END AS caller_action_id, CASE WHEN environment_id % 37 = 5 THEN -environment_id ELSE environment_id END AS environment_id,
    CASE WHEN pos = 7 THEN 0 ELSE entrypoint_id END AS entrypoint_id, CASE WHEN pos = 6 AND status = 'canceled' THEN 'gone' ELSE status END AS status,
    CASE WHEN pos > 1 THEN 'k' || (pos // 3) END AS idem FROM actions),
  s_edges AS (SELECT run_id, CASE WHEN pos = 5 AND status = 'canceled' THEN -id WHEN pos = 6 AND status = 'failed' THEN caller_action_id ELSE id END AS source_action_id,
    CASE WHEN pos = 3 AND status = 'failed' THEN -caller_action_id ELSE caller_action_id END AS dependent_action_id
    FROM actions WHERE caller_action_id IS NOT NULL),
  s_streams AS (SELECT run_id, stream, CASE WHEN run_id % 17 = 0 THEN 0 ELSE max(seq) + 1 END AS next_seq FROM log_records GROUP BY run_id, stream),
  s_records AS (SELECT run_id, CASE WHEN ord % 71 = 0 THEN 'lost' ELSE stream END AS stream, seq, CASE WHEN ord % 61 = 0 THEN NULL ELSE value END AS value,
    NULL AS value_uri, CASE WHEN ord % 53 = 0 THEN 0 ELSE 1 END AS payload_size FROM (SELECT *, value::BIGINT AS ord FROM log_records)),
  s_appends AS (SELECT run_id, stream, CASE WHEN week % 10 = 0 THEN '' ELSE week::VARCHAR END AS append_id,
    CASE WHEN week % 7 = 0 THEN high ELSE low END AS first_seq, CASE WHEN week % 7 = 0 THEN low ELSE high END AS last_seq,
    CASE WHEN stream = 'error' THEN 'short' ELSE sha256(week::VARCHAR) END AS batch_digest
    FROM (SELECT run_id, stream, weekofyear(created_at) AS week, min(seq) AS low, max(seq) AS high FROM log_records GROUP BY ALL)),
  s_blobs AS (SELECT CASE WHEN arrival % 41 = 0 THEN substr(digest, 2) ELSE digest END AS sha256 FROM contents),
  s_uploads AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE o_orderkey END AS session_id, 'obj-' || o_custkey || '-' || year(o_orderdate) AS object_key FROM orders),
  s_cache AS (SELECT CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE sha256(p_brand || '|' || p_size) END AS cache_key,
    CASE WHEN p_partkey % 50 = 0 THEN 'gone' WHEN p_partkey % 2 = 0 THEN 'ready' ELSE 'building' END AS status,
    CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS output FROM part),
  s_images AS (SELECT id, image_key, CASE WHEN id % 43 = 0 THEN 'lost' ELSE status END AS status, CASE WHEN id % 47 = 0 THEN '' ELSE artifact_uri END AS artifact_uri
    FROM image_builds)
"""

DIGEST = "'[0-9a-f]{64}'"


def _twice(table: str, rule: str, source: str, keys: str, where: str = "true") -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, concat_ws('|', {keys}) AS row_key FROM {source} WHERE {where} GROUP BY {keys} HAVING count(*) > 1"


def _broken(table: str, rule: str, source: str, keys: str, where: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, concat_ws('|', {keys}) AS row_key FROM {source} WHERE {where}"


_EDGE, _STREAM = "run_id, source_action_id, dependent_action_id", "run_id, stream"
_IN_STREAMS = "(run_id, stream) NOT IN (SELECT (run_id, stream) FROM s_streams)"
_RULES = [
    _twice("settings", "primary key", "setting_rows", "namespace_id, path"),
    _twice("task_environments", "unique version", "s_env", "namespace_id, name, version"),
    _broken("task_environments", "namespace exists", "s_env", "id", "namespace_id NOT IN (SELECT id FROM namespaces)"),
    _twice("image_builds", "one build in progress", "s_images", "image_key", "status = 'building'"),
    _broken("image_builds", "ready has artifact", "s_images", "id", "status = 'ready' AND artifact_uri = ''"),
    _broken("image_builds", "status", "s_images", "id", "status NOT IN ('building', 'ready', 'failed')"),
    _twice("task_cache", "primary key", "s_cache", "cache_key"),
    _broken("task_cache", "key length", "s_cache", "cache_key", f"NOT regexp_full_match(cache_key, {DIGEST})"),
    _broken("task_cache", "status", "s_cache", "cache_key", "status NOT IN ('building', 'ready')"),
    _broken("task_cache", "ready has result", "s_cache", "cache_key", "status = 'ready' AND output IS NULL"),
    _twice("runs", "unique idempotency key", "s_runs", "namespace_id, idem"),
    _broken("runs", "namespace exists", "s_runs", "id", "namespace_id NOT IN (SELECT id FROM namespaces)"),
    _broken("runs", "root exists", "s_runs", "id", "root_action_id NOT IN (SELECT id FROM s_actions)"),
    _twice("task_actions", "one root", "s_actions", "run_id", "caller_action_id IS NULL"),
    _twice("task_actions", "unique idempotency key", "s_actions", "run_id, idem", "idem IS NOT NULL"),
    _broken("task_actions", "entrypoint range", "s_actions", "id", "NOT entrypoint_id BETWEEN 1 AND 4294967295"),
    _broken("task_actions", "status", "s_actions", "id", "status = 'gone'"),
    _broken("task_actions", "environment exists", "s_actions", "id", "environment_id NOT IN (SELECT id FROM s_env)"),
    _broken("task_actions", "caller exists", "s_actions", "id", "caller_action_id NOT IN (SELECT id FROM s_actions)"),
    _twice("task_action_edges", "primary key", "s_edges", _EDGE),
    _broken("task_action_edges", "no self edge", "s_edges", _EDGE, "source_action_id = dependent_action_id"),
    _broken("task_action_edges", "source exists", "s_edges", _EDGE, "source_action_id NOT IN (SELECT id FROM s_actions)"),
    _broken("task_action_edges", "dependent exists", "s_edges", _EDGE, "dependent_action_id NOT IN (SELECT id FROM s_actions)"),
    _broken("run_log_streams", "next number", "s_streams", _STREAM, "next_seq < 1"),
    _broken("run_log_streams", "run exists", "s_streams", _STREAM, "run_id NOT IN (SELECT id FROM s_runs)"),
    _twice("run_log_records", "primary key", "s_records", f"{_STREAM}, seq"),
    _broken("run_log_records", "inline or stored", "s_records", f"{_STREAM}, seq", "value IS NULL"),
    _broken("run_log_records", "payload size", "s_records", f"{_STREAM}, seq", "payload_size <= 0"),
    _broken("run_log_records", "stream exists", "s_records", f"{_STREAM}, seq", _IN_STREAMS),
    _twice("run_log_appends", "primary key", "s_appends", f"{_STREAM}, append_id"),
    _broken("run_log_appends", "range", "s_appends", f"{_STREAM}, append_id", "last_seq < first_seq"),
    _broken("run_log_appends", "append id length", "s_appends", f"{_STREAM}, append_id", "append_id = ''"),
    _broken("run_log_appends", "digest length", "s_appends", f"{_STREAM}, append_id", "batch_digest = 'short'"),
    _twice("blobs", "primary key", "s_blobs", "sha256"),
    _broken("blobs", "digest length", "s_blobs", "sha256", f"NOT regexp_full_match(sha256, {DIGEST})"),
    _twice("blob_uploads", "primary key", "s_uploads", "session_id"),
    _twice("blob_uploads", "unique object", "s_uploads", "object_key"),
]


def stored_relations(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The thirteen relations of STORED."""
    number = F.col("id")
    environments = fx.environments(spark, sf).select(
        "id", F.when(number % 23 == 3, -1).otherwise(F.col("namespace_id")).alias("namespace_id"), "name",
        F.when(number % 40 < 2, "same").otherwise(F.col("version")).alias("version"),
    )
    keys = fx.requests(spark, sf).select(F.col("arrival").alias("id"), F.col("key").alias("root_idempotency_key"))
    root = F.col("root_action_id")
    runs = fx.runs(spark, sf).join(keys, "id").select(
        "id", F.when(number % 89 == 1, 99).otherwise(F.col("namespace_id")).alias("namespace_id"), "root_idempotency_key",
        F.when(number % 101 == 7, -root).otherwise(root).alias("root_action_id"),
    )
    pos, status, caller, where = F.col("pos"), F.col("status"), F.col("caller_action_id"), F.col("environment_id")
    given = written(fx.actions(spark, sf).select("id", "run_id", "caller_action_id", "environment_id", "entrypoint_id", "status", "pos"), "actions")
    actions = given.select(
        "id", "run_id",
        F.when((pos == 4) & (status == "canceled"), -caller).when((pos == 2) & (F.col("run_id") % 29 == 0), F.lit(None)).otherwise(caller).alias("caller_action_id"),
        F.when(where % 37 == 5, -where).otherwise(where).alias("environment_id"),
        F.when(pos == 7, 0).otherwise(F.col("entrypoint_id")).alias("entrypoint_id"),
        F.when((pos == 6) & (status == "canceled"), "gone").otherwise(status).alias("status"),
        F.when(pos > 1, F.concat(F.lit("k"), F.floor(pos / 3).cast("string"))).alias("idempotency_key"),
    )
    edges = given.filter("caller_action_id IS NOT NULL").select(
        "run_id",
        F.when((pos == 5) & (status == "canceled"), -number).when((pos == 6) & (status == "failed"), caller).otherwise(number).alias("source_action_id"),
        F.when((pos == 3) & (status == "failed"), -caller).otherwise(caller).alias("dependent_action_id"),
    )
    records = written(fx.log_records(spark, sf), "records")
    order = F.col("value").cast("long")
    streams = records.groupBy("run_id", "stream").agg((F.max("seq") + 1).alias("next_seq")).withColumn(
        "next_seq", F.when(F.col("run_id") % 17 == 0, 0).otherwise(F.col("next_seq"))
    )
    stored = records.select(
        "run_id", F.when(order % 71 == 0, "lost").otherwise(F.col("stream")).alias("stream"), "seq", "key",
        F.when(order % 61 != 0, F.col("value")).alias("value"), F.lit(None).cast("string").alias("value_uri"),
        F.when(order % 53 == 0, 0).otherwise(1).alias("payload_size"),
    )
    week, low, high = F.col("week"), F.col("low"), F.col("high")
    appends = records.groupBy("run_id", "stream", F.extract(F.lit("WEEK"), "created_at").alias("week")).agg(
        F.min("seq").alias("low"), F.max("seq").alias("high")
    ).select(
        "run_id", "stream", F.when(week % 10 == 0, "").otherwise(week.cast("string")).alias("append_id"),
        F.when(week % 7 == 0, high).otherwise(low).alias("first_seq"), F.when(week % 7 == 0, low).otherwise(high).alias("last_seq"),
        F.when(F.col("stream") == "error", "short").otherwise(F.sha2(week.cast("string"), 256)).alias("batch_digest"),
    )
    digest, order_key, part = F.col("digest"), F.col("o_orderkey"), F.col("p_partkey")
    blobs = fx.values(spark, sf).select(F.when(F.col("arrival") % 41 == 0, F.substring(digest, 2, 63)).otherwise(digest).alias("sha256"))
    uploads = source_table(spark, sf, "orders").select(
        F.when(order_key % 97 == 0, 0).otherwise(order_key).alias("session_id"),
        F.concat_ws("-", F.lit("obj"), "o_custkey", F.year("o_orderdate")).alias("object_key"),
    )
    cache = source_table(spark, sf, "part").select(
        F.when(part % 19 == 0, "x").otherwise(F.sha2(F.concat_ws("|", "p_brand", "p_size"), 256)).alias("cache_key"),
        F.when(part % 50 == 0, "gone").when(part % 2 == 0, "ready").otherwise("building").alias("status"),
        F.when(part % 5 != 0, F.col("p_name")).alias("output"), F.lit("").alias("error_code"),
    )
    images = fx.image_builds(spark, sf).select(
        "id", "image_key", F.when(number % 43 == 0, "lost").otherwise(status).alias("status"),
        F.when(number % 47 == 0, "").otherwise(F.col("artifact_uri")).alias("artifact_uri"),
    )
    return {
        "namespaces": fx.namespaces(spark, sf), "settings": fx._setting_rows(spark, sf), "task_environments": environments,
        "image_builds": images, "task_cache": cache, "runs": written(runs, "runs"), "task_actions": actions, "task_action_edges": edges,
        "run_log_streams": written(streams, "streams"), "run_log_records": stored, "run_log_appends": written(appends, "appends"),
        "blobs": blobs, "blob_uploads": uploads,
    }


@query(STORED + " UNION ALL ".join(_RULES))
def check_table_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """All thirteen relations, every row of them."""
    return ops.check_table_constraints(stored_relations(spark, sf))


#: Where the check has each relation, and a column to compare.
_PLACES = {
    "namespaces": ("namespaces", "id"), "settings": ("setting_rows", "path"), "task_environments": ("s_env", "id"),
    "image_builds": ("s_images", "id"), "task_cache": ("s_cache", "cache_key"), "runs": ("s_runs", "id"),
    "task_actions": ("s_actions", "id"), "task_action_edges": ("s_edges", "source_action_id"), "run_log_streams": ("s_streams", "stream"),
    "run_log_records": ("s_records", "stream"), "run_log_appends": ("s_appends", "append_id"), "blobs": ("s_blobs", "sha256"),
    "blob_uploads": ("s_uploads", "session_id"),
}


@query(STORED + " UNION ALL ".join(
    f"SELECT '{relation}' AS relation, count(*) AS n, min({key}::VARCHAR) AS first, max({key}::VARCHAR) AS last FROM {source}"
    for relation, (source, key) in _PLACES.items()))
def load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All relations stored in their own types, one folder each, and loaded again."""
    folder = fresh_path(spark, "relations")
    for relation, df in stored_relations(spark, sf).items():
        df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(SCHEMAS[relation]).fields
        ]).write.parquet(f"{folder}/{relation}")
    loaded = read_tables(spark, folder)
    return reduce(DataFrame.unionByName, [
        loaded[relation].agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).select(
            F.lit(relation).alias("relation"), "n", "first", "last")
        for relation, (_, key) in _PLACES.items()
    ])
