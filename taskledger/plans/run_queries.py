"""Queries over runs, actions, environments and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators import runs as ops
from taskledger.operators import tables
from taskledger.plans.registry import query
from taskledger.plans.relations import AS_OF, TERMINAL
from taskledger.session import written
from taskledger.sources import fixtures as fx
from taskledger.sources.tables import source_table


@query(f"SELECT id, status, status IN {TERMINAL} AS is_terminal FROM actions")
def terminal_flag(spark: SparkSession, sf: str) -> DataFrame:
    return ops.terminal_flag(fx.actions(spark, sf).select("id", "status"))


@query("""SELECT r.id AS run_id, r.root_action_id, r.created_at AS run_created_at, a.status, a.updated_at, a.entrypoint_id,
  a.environment_id, e.namespace_id, e.name AS environment_name, e.version
  FROM runs r JOIN actions a ON a.run_id = r.id AND a.id = r.root_action_id JOIN environments e ON e.id = a.environment_id""")
def run_detail(spark: SparkSession, sf: str) -> DataFrame:
    return ops.run_detail(fx.runs(spark, sf), fx.actions(spark, sf), fx.environments(spark, sf))


@query("""SELECT a.id, a.run_id, a.caller_action_id, a.entrypoint_id, a.status, a.attempts, a.created_at, a.updated_at,
  a.environment_id, e.namespace_id, e.name AS environment_name, e.version
  FROM actions a JOIN environments e ON e.id = a.environment_id""")
def action_detail(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.actions(spark, sf).select(
        "id", "run_id", "caller_action_id", "entrypoint_id", "status", "attempts", "created_at", "updated_at",
        "environment_id",
    )
    return ops.action_detail(wanted, fx.environments(spark, sf))


@query("""SELECT a.id, e.source_action_id AS upstream_id,
    CASE WHEN e.source_action_id IS NOT NULL THEN row_number() OVER (PARTITION BY a.id ORDER BY e.source_action_id) END AS position
  FROM actions a LEFT JOIN edges e ON e.dependent_action_id = a.id""")
def actions_with_upstreams(spark: SparkSession, sf: str) -> DataFrame:
    return ops.actions_with_upstreams(fx.actions(spark, sf).select("id"), fx.edges(spark, sf))


@query(f"""SELECT a.id, a.run_id, a.status, a.attempts, a.environment_id, r.claim_token, e.name AS environment_name
  FROM actions a JOIN environments e ON e.id = a.environment_id JOIN runs r ON r.id = a.run_id
  WHERE a.status IN ('running', 'waiting') AND r.claim_token IS NOT NULL AND r.lease_until > {AS_OF}""")
def active_callers(spark: SparkSession, sf: str) -> DataFrame:
    return ops.active_callers(
        fx.actions(spark, sf), fx.environments(spark, sf), fx.runs(spark, sf), fx.as_of()
    )


@query("""SELECT c.id AS action_id, CASE WHEN ce.namespace_id <> pe.namespace_id THEN 'other namespace'
    WHEN ce.id = pe.id THEN 'same' WHEN d.id IS NOT NULL THEN 'declared' ELSE 'undeclared' END AS verdict
  FROM actions c JOIN actions p ON p.id = c.caller_action_id JOIN environments ce ON ce.id = c.environment_id
  JOIN environments pe ON pe.id = p.environment_id
  LEFT JOIN environment_deps d ON d.id = pe.id AND d.dependency_id = ce.id""")
def dependency_check(spark: SparkSession, sf: str) -> DataFrame:
    return ops.dependency_check(fx.actions(spark, sf), fx.environments(spark, sf), fx.environment_deps(spark, sf))


@query("""SELECT r.scope, r.key, r.payload, r.arrival, CASE WHEN r.arrival = f.arrival THEN 'new'
    WHEN r.payload = f.payload THEN 'replay' ELSE 'conflict' END AS outcome, f.arrival AS first_arrival
  FROM requests r JOIN (SELECT scope, key, min(arrival) AS arrival, arg_min(payload, arrival) AS payload
    FROM requests GROUP BY ALL) f USING (scope, key)""")
def idempotency_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return ops.idempotency_reconcile(fx.requests(spark, sf), None)


@query("""WITH stored AS (SELECT scope, key, arg_min(payload, arrival) AS payload FROM requests WHERE payload < '3' GROUP BY ALL),
 incoming AS (SELECT * FROM requests WHERE payload >= '3')
 SELECT r.scope, r.key, r.payload, r.arrival,
   CASE WHEN s.key IS NULL AND r.arrival = f.arrival THEN 'new'
     WHEN r.payload = coalesce(s.payload, f.payload) THEN 'replay' ELSE 'conflict' END AS outcome,
   CASE WHEN s.key IS NULL THEN f.arrival END AS first_arrival
 FROM incoming r JOIN (SELECT scope, key, min(arrival) AS arrival, arg_min(payload, arrival) AS payload
    FROM incoming GROUP BY ALL) f USING (scope, key) LEFT JOIN stored s USING (scope, key)""")
def idempotency_against_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of low priority against stored runs of high priority."""
    every = fx.requests(spark, sf)
    stored = every.filter("payload < '3'").groupBy("scope", "key").agg(F.min_by("payload", "arrival").alias("payload"))
    return ops.idempotency_reconcile(every.filter("payload >= '3'"), stored)


@query("""SELECT c.c_custkey, w.slug, n.id AS namespace_id, n.id IS NOT NULL AS found FROM customer c
  JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'region-' ELSE 'nation-' END || c_nationkey AS slug FROM customer) w
    USING (c_custkey) LEFT JOIN namespaces n ON n.slug = w.slug""")
def resolve_namespace(spark: SparkSession, sf: str) -> DataFrame:
    asked = source_table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.when(F.col("c_acctbal") < 0, "region-").otherwise("nation-"),
                 F.col("c_nationkey").cast("string")).alias("slug"),
    )
    return ops.resolve_namespace(asked, fx.namespaces(spark, sf))


@query("SELECT id, namespace_id, claim_token, lease_until, created_at, root_action_id FROM claimable")
def claimable_runs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.claimable_runs(fx.runs(spark, sf), fx.actions(spark, sf), fx.as_of())


@query("""SELECT id, namespace_id, claim_token, lease_until, created_at, root_action_id FROM claimable
  QUALIFY row_number() OVER (PARTITION BY namespace_id ORDER BY created_at, id) = 1""")
def oldest_claimable(spark: SparkSession, sf: str) -> DataFrame:
    return ops.oldest_claimable(fx.runs(spark, sf), fx.actions(spark, sf), fx.as_of(), per=["namespace_id"])


@query("SELECT id, namespace_id, created_at FROM claimable ORDER BY created_at, id LIMIT 1")
def oldest_claimable_overall(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.oldest_claimable(fx.runs(spark, sf), fx.actions(spark, sf), fx.as_of())
    return found.select("id", "namespace_id", "created_at")


@query("SELECT id, run_id, next_attempt_at FROM due")
def due_retries(spark: SparkSession, sf: str) -> DataFrame:
    from taskledger.operators.graph import due_retries as due

    return due(fx.actions(spark, sf), fx.as_of()).select("id", "run_id", "next_attempt_at")


@query(f"SELECT id, image_key, lease_until FROM image_builds WHERE status = 'building' AND lease_until <= {AS_OF}")
def expired_leases(spark: SparkSession, sf: str) -> DataFrame:
    return tables.expired_leases(fx.image_builds(spark, sf), fx.as_of())[0].select("id", "image_key", "lease_until")


@query(f"""SELECT id, image_key, CASE WHEN status = 'building' AND lease_until <= {AS_OF} THEN 'failed' ELSE status END
  AS status FROM image_builds""")
def expired_leases_swept(spark: SparkSession, sf: str) -> DataFrame:
    return tables.expired_leases(fx.image_builds(spark, sf), fx.as_of())[1].select("id", "image_key", "status")


@query(f"""SELECT session, size, expires_at FROM uploads WHERE expires_at <= {AS_OF}""")
def expired_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return tables.expired_uploads(fx.uploads(spark, sf), fx.as_of()).select("session", "size", "expires_at")


@query(f"SELECT session, size, expires_at FROM uploads WHERE expires_at > {AS_OF}")
def active_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return tables.active_uploads(fx.uploads(spark, sf), fx.as_of()).select("session", "size", "expires_at")


@query("""WITH asked AS (SELECT r.id AS run_id, CASE WHEN claim_token IS NOT NULL THEN a.created_at END AS created_at,
    CASE WHEN claim_token IS NOT NULL THEN a.id END AS id FROM runs r JOIN actions a ON a.id = r.root_action_id),
 hits AS (SELECT a.run_id, a.id, a.created_at, a.status,
    row_number() OVER (PARTITION BY a.run_id ORDER BY a.created_at, a.id) AS position,
    count(*) OVER (PARTITION BY a.run_id) AS total
  FROM asked q JOIN actions a ON a.run_id = q.run_id AND (q.id IS NULL OR (a.created_at, a.id) > (q.created_at, q.id)))
 SELECT run_id, id, created_at, status, position, CASE WHEN position = 2 AND total > 2 THEN
   rtrim(replace(replace(to_base64(encode(strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '|' || id)), '+', '-'), '/', '_'), '=')
   END AS next_page_token FROM hits WHERE position <= 2 AND run_id % 50 <> 3""")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """Two actions of every run: by the token of the root for claimed runs, without one for the others. Some tokens are
    malformed and get no page."""
    acts = written(fx.actions(spark, sf).select("run_id", "id", "created_at", "status"), "actions")
    claimed = F.col("claim_token").isNotNull()
    asked = fx.runs(spark, sf).select("claim_token", F.col("root_action_id").alias("id")).join(acts, "id").select(
        F.col("run_id").alias("request_id"), "run_id", F.lit(2).alias("size"),
        F.when(F.col("run_id") % 50 == 3, "no token!").when(claimed, X.page_token(F.col("created_at"), F.col("id"))).alias("page_token"),
    )
    read = ops.with_page_tokens(asked, "bigint").filter(~F.coalesce("bad_token", F.lit(False)))
    typed = read.withColumn("created_at", F.col("created_at").cast(acts.schema["created_at"].dataType))
    return ops.keyset_page(acts, typed.drop("bad_token")).drop("request_id")


@query("""SELECT id, run_id, (row_number() OVER (PARTITION BY run_id ORDER BY created_at, id) - 1) // 3 + 1 AS page FROM actions""")
def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    return ops.all_pages(fx.actions(spark, sf).select("id", "run_id", "created_at"), 3).select("id", "run_id", "page")


@query("""SELECT id, caller_action_id, caller_action_id || ':' || row_number() OVER (PARTITION BY caller_action_id
  ORDER BY created_at, id) AS idempotency_key FROM actions WHERE caller_action_id IS NOT NULL""")
def child_keys(spark: SparkSession, sf: str) -> DataFrame:
    calls = fx.actions(spark, sf).select("id", "caller_action_id", "created_at")
    return ops.child_keys(calls, ["created_at", "id"]).select("id", "caller_action_id", "idempotency_key")


@query("""SELECT p_partkey, unnest(string_split(p_name, ' ')) AS entrypoint,
  generate_subscripts(string_split(p_name, ' '), 1) AS entrypoint_id FROM part""")
def number_entrypoints(spark: SparkSession, sf: str) -> DataFrame:
    declared = source_table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("entrypoints"))
    return ops.number_entrypoints(declared)


@query("""SELECT id, CASE WHEN id % 10 >= 2 THEN 'env-' || ((id - 1) % 40) || ',env-' || ((id - 2) % 40)
    WHEN id % 10 = 1 THEN 'env-' || ((id - 1) % 40) ELSE '' END AS distinct_dependencies,
  CASE WHEN id % 10 >= 2 THEN least('env-' || ((id - 1) % 40), 'env-' || ((id - 2) % 40)) || ','
      || greatest('env-' || ((id - 1) % 40), 'env-' || ((id - 2) % 40))
    WHEN id % 10 = 1 THEN 'env-' || ((id - 1) % 40) ELSE '' END AS sorted_dependencies FROM environments""")
def distinct_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    def name(back: int):
        return F.concat(F.lit("env-"), ((F.col("id") - back) % 40).cast("string"))

    rank = F.col("id") % 10
    declared = F.when(rank >= 2, F.array(name(1), name(2), name(1))).when(rank == 1, F.array(name(1), name(1)))
    envs = fx.environments(spark, sf).select(
        "id", F.coalesce(declared, F.array().cast("array<string>")).alias("dependencies")
    )
    found = ops.distinct_dependencies(envs)
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("distinct_dependencies", "sorted_dependencies")])


@query("""SELECT id, failures + 1 AS failures,
  CASE WHEN entrypoint_id <> 1 AND failures + 1 < greatest(max_attempts, 1) THEN 'queued' ELSE 'failed' END AS next_status,
  CASE WHEN entrypoint_id <> 1 AND failures + 1 < greatest(max_attempts, 1)
    THEN updated_at + to_seconds((2 ** least(greatest(failures, 0), 6))::INTEGER) END AS next_attempt_at
  FROM actions""")
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    attempts = fx.actions(spark, sf).select(
        "id", "failures", "max_attempts", (F.col("entrypoint_id") == 1).alias("cacheable"), F.col("updated_at").alias("at")
    )
    return ops.retry_plan(attempts).select("id", "failures", "next_status", "next_attempt_at")


# Snapshot maintenance --------------------------------------------------------------------------------


@query("""SELECT s.namespace_id, s.path, s.value FROM settings s JOIN namespaces n ON n.id = s.namespace_id
  JOIN nation ON n_nationkey = n.id JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'""")
def settings_list(spark: SparkSession, sf: str) -> DataFrame:
    asia = source_table(spark, sf, "region").filter("r_name = 'ASIA'")
    spaces = source_table(spark, sf, "nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(
        F.col("n_nationkey").cast("long").alias("id")
    )
    return tables.settings_list(fx.settings(spark, sf), spaces).select("namespace_id", "path", "value")


@query("""SELECT s.namespace_id, s.path, s.value FROM settings s JOIN nation ON n_nationkey = s.namespace_id JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'ASIA' AND s.path IN (SELECT path FROM setting_changes)""")
def settings_list_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Of the settings of these namespaces those whose path was changed in some namespace."""
    asia = source_table(spark, sf, "region").filter("r_name = 'ASIA'")
    spaces = source_table(spark, sf, "nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(
        F.col("n_nationkey").cast("long").alias("id")
    )
    return tables.settings_list(fx.settings(spark, sf), spaces, fx.setting_changes(spark, sf)).select("namespace_id", "path", "value")


@query("""SELECT namespace_id, path, value, version FROM (SELECT *, 0 AS c FROM settings UNION ALL SELECT *, 1 FROM setting_changes)
  QUALIFY row_number() OVER (PARTITION BY namespace_id, path ORDER BY c DESC, version DESC) = 1""")
def upsert_settings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.upsert_settings(fx.settings(spark, sf), fx.setting_changes(spark, sf))


@query("SELECT * FROM settings s WHERE NOT EXISTS (SELECT 1 FROM setting_changes c WHERE c.namespace_id = s.namespace_id AND c.path = s.path)")
def delete_settings(spark: SparkSession, sf: str) -> DataFrame:
    return tables.delete_settings(fx.settings(spark, sf), fx.setting_changes(spark, sf))


@query("SELECT * FROM image_builds QUALIFY row_number() OVER (PARTITION BY image_key ORDER BY created_at DESC, id DESC) = 1")
def latest_build(spark: SparkSession, sf: str) -> DataFrame:
    return tables.latest_build(fx.image_builds(spark, sf))


@query("""SELECT * FROM image_builds WHERE status = 'ready'
  QUALIFY row_number() OVER (PARTITION BY image_key ORDER BY created_at DESC, id DESC) = 1""")
def latest_ready_build(spark: SparkSession, sf: str) -> DataFrame:
    return tables.latest_ready_build(fx.image_builds(spark, sf))


@query("""SELECT c.arrival, c.digest, CASE WHEN k.digest IS NULL AND c.arrival = f.arrival THEN 'inserted' ELSE 'duplicate' END
  AS outcome FROM contents c JOIN (SELECT digest, min(arrival) AS arrival FROM contents GROUP BY digest) f USING (digest)
  LEFT JOIN known_blobs k ON k.digest = c.digest""")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return tables.insert_if_absent(*_insert(spark, sf), ["digest"], ["arrival"])[1].select("arrival", "digest", "outcome")


@query("""SELECT digest, object_key FROM known_blobs UNION ALL SELECT digest, 'blobs/' || min(arrival) FROM contents
  WHERE digest NOT IN (SELECT digest FROM known_blobs) GROUP BY digest""")
def insert_if_absent_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.insert_if_absent(*_insert(spark, sf), ["digest"], ["arrival"])[0]


def _insert(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    new = fx.values(spark, sf).select(
        "arrival", "digest", F.concat(F.lit("blobs/"), F.col("arrival").cast("string")).alias("object_key")
    )
    return fx.known_blobs(spark, sf), new


def _cancelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    runs = fx.runs(spark, sf)
    ids = runs.filter("namespace_id < 5").select(F.col("id").alias("run_id"))
    return tables.cancel_active(fx.actions(spark, sf), runs, ids, fx.as_of())


@query(f"""SELECT a.id, CASE WHEN a.status NOT IN {TERMINAL} AND r.namespace_id < 5 AND o.status NOT IN {TERMINAL}
    THEN 'canceled' ELSE a.status END AS status,
  CASE WHEN a.status NOT IN {TERMINAL} AND r.namespace_id < 5 AND o.status NOT IN {TERMINAL} THEN 'run canceled' ELSE '' END AS error,
  CASE WHEN a.status NOT IN {TERMINAL} AND r.namespace_id < 5 AND o.status NOT IN {TERMINAL} THEN {AS_OF} ELSE a.updated_at END AS updated_at
  FROM actions a JOIN runs r ON r.id = a.run_id JOIN actions o ON o.id = r.root_action_id""")
def cancel_active(spark: SparkSession, sf: str) -> DataFrame:
    return _cancelled(spark, sf)[0].select("id", "status", "error", "updated_at")


@query("""SELECT id, CASE WHEN namespace_id >= 5 THEN claim_token END AS claim_token,
  CASE WHEN namespace_id >= 5 THEN lease_until END AS lease_until FROM runs""")
def cancel_active_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _cancelled(spark, sf)[1].select("id", "claim_token", "lease_until")


@query(f"""SELECT a.id, CASE WHEN a.status IN ('running', 'waiting') AND r.claim_token = 'w' || ((a.run_id + r.namespace_id) % 7)
    AND r.lease_until > {AS_OF} THEN 'queued' ELSE a.status END AS status,
    CASE WHEN a.status IN ('running', 'waiting') AND r.claim_token = 'w' || ((a.run_id + r.namespace_id) % 7)
    AND r.lease_until > {AS_OF} THEN {AS_OF} ELSE a.updated_at END AS updated_at FROM actions a JOIN runs r ON r.id = a.run_id""")
def reset_inflight(spark: SparkSession, sf: str) -> DataFrame:
    runs = fx.runs(spark, sf)
    claims = runs.select(
        F.col("id").alias("run_id"),
        F.concat(F.lit("w"), ((F.col("id") + F.col("namespace_id")) % 7).cast("string")).alias("claim_token"),
    )
    return tables.reset_inflight(fx.actions(spark, sf), runs, claims, fx.as_of()).select("id", "status", "updated_at")


def _folded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One action per (run, action number), queued at attempt 0; its status events are the transitions."""
    events = written(fx.status_events(spark, sf), "events")
    number = F.concat_ws("/", F.col("run_id").cast("string"), F.col("action").cast("string"))
    runs = fx.runs(spark, sf)
    acts = events.filter("seq = 1").select(
        number.alias("id"), "run_id", F.lit("queued").alias("status"), F.lit(0).cast("long").alias("attempts"),
        F.lit(0).cast("long").alias("failures"), F.lit("").alias("error"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    moves = events.select(
        number.alias("action_id"), "seq", F.concat(F.lit("w"), (F.col("run_id") % 7).cast("string")).alias("claim_token"),
        (F.col("seq") - 1).alias("expected_attempt"), F.col("seq").alias("attempt"),
        F.lit(0).cast("long").alias("failures"), "status",
        F.when(F.col("status") == "failed", F.concat(F.lit("at "), F.col("seq").cast("string"))).otherwise("").alias("error"),
    )
    return tables.fold_transitions(acts, moves, runs, fx.as_of())


_FOLD = f"""WITH moves AS (SELECT e.run_id || '/' || e.action AS action_id, e.run_id, e.seq, e.status,
    coalesce(r.claim_token = 'w' || (e.run_id % 7) AND r.lease_until > {AS_OF}, false) AND coalesce(max(CASE WHEN e.status IN {TERMINAL}
      THEN 1 ELSE 0 END) OVER (PARTITION BY e.run_id, e.action ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
      AS applied FROM status_events e JOIN runs r ON r.id = e.run_id)"""


@query(_FOLD + """ SELECT action_id AS id, coalesce(arg_max(status, seq) FILTER (applied), 'queued') AS status,
  coalesce(max(seq) FILTER (applied), 0) AS attempts,
  coalesce(arg_max(CASE WHEN status = 'failed' THEN 'at ' || seq ELSE '' END, seq) FILTER (applied), '') AS error,
  CASE WHEN bool_or(applied) THEN """ + AS_OF + """ END AS updated_at FROM moves GROUP BY action_id""")
def fold_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf)[0].select("id", "status", "attempts", "error", "updated_at")


@query(_FOLD + """ SELECT run_id, action_id, seq, status FROM moves WHERE applied
  UNION ALL SELECT run_id, NULL, seq, status FROM moves WHERE applied AND action_id = run_id || '/1'""")
def transition_events(spark: SparkSession, sf: str) -> DataFrame:
    """Action 1 of each run stands for its root."""
    actions, verdicts = _folded(spark, sf)
    roots = actions.select(F.col("run_id").alias("id"), F.concat_ws("/", F.col("run_id").cast("string"), F.lit("1")).alias("root_action_id"))
    return tables.transition_events(actions, verdicts, roots.distinct())


@query(_FOLD + " SELECT action_id, seq, CASE WHEN applied THEN 'applied' ELSE 'lease lost' END AS verdict FROM moves")
def fold_transitions_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf)[1].select("action_id", "seq", "verdict")


def _promoted(spark: SparkSession, sf: str):
    """Orders as uploads; those with an even number have parts, their lines, and as many bytes as 1 to 7 parts.

    Pending ones were not sent, low priority ones are one byte off, urgent ones lack a digest. Some lines have no etag or the
    number of the next one; some orders without parts got their lines sent nevertheless.
    """
    key, line = F.col("o_orderkey"), F.col("l_orderkey")
    orders = source_table(spark, sf, "orders")
    parted = F.col("session") % 2 == 0
    size = F.when(parted, (F.col("session") % 7 + 1) * 8388608 - F.col("session") % 1000).otherwise(F.col("size"))
    sessions = fx.uploads(spark, sf).withColumns({
        "arrival": F.col("session"), "multipart_id": F.when(parted, F.concat(F.lit("parts-"), F.col("session").cast("string"))), "size": size,
    })
    lines = source_table(spark, sf, "lineitem").filter((line % 2 == 0) | (line % 9 == 0)).select(
        line.alias("session"), (F.col("l_linenumber") + F.when(F.col("l_suppkey") % 13 == 0, 1).otherwise(0)).alias("number"),
        F.when(F.col("l_partkey") % 11 == 0, " ").otherwise(F.concat(F.lit("e"), F.col("l_partkey").cast("string"))).alias("etag"),
    )
    sent = sessions.join(orders.select(key.alias("session"), "o_orderstatus", "o_orderpriority"), "session").filter("o_orderstatus <> 'P'")
    objects = sent.select(
        "object_key", (F.col("size") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)).alias("stored_size"),
        F.when((F.col("o_orderpriority") != "1-URGENT") & ~parted, F.col("sha256")).alias("stored_sha256"),
    )
    stored = source_table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"),
        F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("object_key"),
    )
    return tables.promote_uploads(sessions, objects, lines, stored)


_PROMOTE = """WITH sent_parts AS (SELECT l_orderkey AS session, l_linenumber + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS number,
    l_partkey % 11 = 0 AS blank FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 9 = 0),
 per AS (SELECT session, count(*) AS n, count(DISTINCT number) AS d, min(number) AS low, max(number) AS high, bool_or(blank) AS blank FROM sent_parts GROUP BY session),
 checked AS (SELECT o_orderkey AS session, sha256(o_custkey::VARCHAR) AS sha256, 'obj-' || o_orderkey AS object_key,
    CASE WHEN o_orderkey % 2 <> 0 AND coalesce(n, 0) > 0 THEN 'single upload takes no parts'
      WHEN o_orderkey % 2 = 0 AND coalesce(n, 0) <> o_orderkey % 7 + 1 THEN 'incorrect part count'
      WHEN o_orderkey % 2 = 0 AND (blank OR low <> 1 OR high <> n OR d <> n) THEN 'invalid part list'
      WHEN o_orderstatus = 'P' THEN 'not uploaded' WHEN o_orderpriority = '5-LOW' THEN 'size mismatch'
      WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 <> 0 THEN 'digest mismatch' ELSE 'ok' END AS verdict
    FROM orders LEFT JOIN per ON session = o_orderkey),
 stored AS (SELECT sha256(c_custkey::VARCHAR) AS sha256, 'old-' || c_custkey AS object_key FROM customer WHERE c_acctbal < 0),
 firsts AS (SELECT sha256, min(session) AS session FROM checked WHERE verdict = 'ok' AND sha256 NOT IN (SELECT sha256 FROM stored)
   GROUP BY sha256)"""


@query(_PROMOTE + """ SELECT j.session, j.sha256, j.object_key, CASE WHEN j.verdict <> 'ok' THEN j.verdict
    WHEN f.session IS NOT NULL THEN 'inserted' ELSE 'duplicate' END AS verdict
  FROM checked j LEFT JOIN firsts f ON f.session = j.session""")
def promote_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return _promoted(spark, sf)[1]


@query(_PROMOTE + " SELECT * FROM stored UNION ALL SELECT sha256, 'obj-' || session FROM firsts")
def promote_uploads_table(spark: SparkSession, sf: str) -> DataFrame:
    return _promoted(spark, sf)[0]


@query(f"SELECT cache_key, status FROM (SELECT o_orderkey AS cache_key, CASE o_orderstatus WHEN 'P' THEN 'building' ELSE 'ready' END "
       f"AS status, o_orderdate + to_days(30) AS lease_until FROM orders) WHERE NOT (status = 'building' AND lease_until <= {AS_OF})")
def expire_memo(spark: SparkSession, sf: str) -> DataFrame:
    memo = fx.image_builds(spark, sf).select(
        F.col("id").alias("cache_key"),
        F.when(F.col("status") == "building", "building").otherwise("ready").alias("status"), "lease_until",
    )
    return tables.expire_memo(memo, fx.as_of()).drop("lease_until")


@query("""SELECT session, CASE WHEN size = 0 THEN 0 ELSE (size + 8388607) // 8388608 END AS parts FROM uploads""")
def part_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.uploads(spark, sf).select("session", X.part_count(F.col("size")).alias("parts"))


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_size::BIGINT * 1048576 WHEN p_type = 'STANDARD' THEN p_size::BIGINT * 1000000000
    END::VARCHAR AS memory, CASE WHEN p_size % 2 = 0 AND p_size > 0 THEN p_size::BIGINT * 5 END AS cpu FROM part""")
def resource_quantities(spark: SparkSession, sf: str) -> DataFrame:
    """Memory as `<size>Mi`, `<size>G` or a malformed text; cores as a decimal text, some not whole thousandths."""
    unit = F.when(F.col("p_type") == "ECONOMY", "Mi").when(F.col("p_type") == "STANDARD", "G").otherwise("MB")
    cores = F.when(F.col("p_size") % 2 == 0, (F.col("p_size") * 5 / 1000).cast("decimal(10,4)").cast("string")).otherwise("0.0005")
    return source_table(spark, sf, "part").select(
        "p_partkey", X.memory_bytes(F.concat(F.col("p_size").cast("string"), unit)).cast("string").alias("memory"),
        X.cpu_millis(cores).alias("cpu"),
    )


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'invalid retry mode' WHEN p_size % 10 > 0 AND p_size * 3 > 100
    THEN 'attempts out of range' WHEN p_type = 'ECONOMY' AND p_size % 10 > 0 AND p_size * 3 <> 1 THEN 'one attempt only' ELSE 'ok' END
  AS verdict FROM part""")
def retry_policy(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_type")
    declared = source_table(spark, sf, "part").select(
        "p_partkey", F.when(kind == "PROMO", "always").when(kind == "ECONOMY", "none").otherwise("idempotent").alias("retry"),
        F.when(F.col("p_size") % 10 > 0, F.col("p_size") * 3).alias("max_attempts"),
    )
    return ops.retry_policy(declared).select("p_partkey", "verdict")
