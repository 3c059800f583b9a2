"""Queries over the action tree, the prerequisites and the environment dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.operators import graph as ops
from taskledger.plans.registry import query
from taskledger.plans.relations import AS_OF, TERMINAL
from taskledger.session import discard, packed, written
from taskledger.sources import fixtures as fx


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return written(
        fx.actions(spark, sf).select("run_id", "id", "caller_action_id", "status", "next_attempt_at", "pos"), "nodes"
    )


def _prereqs(nodes: DataFrame) -> DataFrame:
    return nodes.filter("pos >= 3").select("run_id", "id", (F.col("id") - 2).alias("prerequisite_id"))


@query("""WITH RECURSIVE tree AS (
    SELECT run_id, caller_action_id AS seed_id, id AS node_id, 1::BIGINT AS depth FROM actions
      WHERE caller_action_id IN (SELECT root_action_id FROM runs)
    UNION ALL SELECT t.run_id, t.seed_id, a.id, t.depth + 1 FROM tree t JOIN actions a ON a.caller_action_id = t.node_id)
  SELECT run_id, seed_id, node_id, depth FROM tree""", recursive=True)
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    with packed(spark):
        nodes = written(fx.actions(spark, sf).select("run_id", "id", "caller_action_id"), "nodes")
    found = ops.descendants(nodes, nodes.filter("caller_action_id IS NULL"))
    discard(nodes)
    return found


@query("""WITH RECURSIVE up AS (
    SELECT run_id, id AS node_id, caller_action_id AS ancestor_id, 1::BIGINT AS distance FROM actions
      WHERE status = 'queued' AND caller_action_id IS NOT NULL
    UNION ALL SELECT u.run_id, u.node_id, a.caller_action_id, u.distance + 1 FROM up u JOIN actions a ON a.id = u.ancestor_id
      WHERE a.caller_action_id IS NOT NULL)
  SELECT run_id, node_id, ancestor_id, distance FROM up""", recursive=True)
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return ops.ancestors(nodes, nodes.filter("status = 'queued'"))


@query(f"""WITH RECURSIVE up AS (
    SELECT id, caller_action_id AS above FROM actions WHERE caller_action_id IS NOT NULL
    UNION ALL SELECT u.id, a.caller_action_id FROM up u JOIN actions a ON a.id = u.above WHERE a.caller_action_id IS NOT NULL),
  labels AS (
    SELECT u.id, a.id AS closure, CASE a.status WHEN 'succeeded' THEN 'parent action completed'
      WHEN 'failed' THEN 'parent action failed' ELSE 'ancestor canceled' END AS reason
    FROM up u JOIN actions a ON a.id = u.above WHERE a.status IN {TERMINAL}
    UNION ALL SELECT a.id, a.run_id * 1000000 + 2 * (CASE WHEN o.status = 'failed' THEN 1 ELSE 0 END), CASE o.status WHEN 'failed'
      THEN 'run canceled' ELSE 'root action completed' END
    FROM actions a JOIN runs r ON r.id = a.run_id JOIN actions o ON o.id = r.root_action_id WHERE o.status IN ('succeeded', 'failed')),
  firsts AS (SELECT id, arg_min(reason, closure) AS reason, min(closure) AS closure FROM labels GROUP BY id)
  SELECT a.id, CASE WHEN a.status NOT IN {TERMINAL} AND f.id IS NOT NULL THEN 'canceled' ELSE a.status END AS status,
    CASE WHEN a.status NOT IN {TERMINAL} AND f.id IS NOT NULL THEN f.reason ELSE '' END AS error,
    CASE WHEN a.status NOT IN {TERMINAL} THEN f.closure END AS closed_by
  FROM actions a LEFT JOIN firsts f ON f.id = a.id""", recursive=True)
def close_subtree(spark: SparkSession, sf: str) -> DataFrame:
    """Each closed node closes what is below it; a closed root its run. Lower numbers come first."""
    nodes = _nodes(spark, sf)
    closed = nodes.filter(F.col("status").isin("succeeded", "failed", "canceled"))
    kind = F.when(F.col("status") == "succeeded", "node_done").when(F.col("status") == "failed", "image_failed").otherwise(
        "node_canceled"
    )
    on_nodes = closed.select(
        F.col("id").alias("closure"), kind.alias("kind"), "run_id", F.col("id").alias("action_id")
    )
    on_runs = closed.filter("pos = 1 AND status <> 'canceled'").select(
        (F.col("run_id") * fx.NODES_PER_RUN + F.when(F.col("status") == "failed", 2).otherwise(0)).alias("closure"),
        F.when(F.col("status") == "failed", "run_canceled").otherwise("root_done").alias("kind"), "run_id",
        F.lit(None).cast("long").alias("action_id"),
    )
    return ops.close_subtree(nodes, on_nodes.unionByName(on_runs)).select("id", "status", "error", "closed_by")


@query("""WITH RECURSIVE needs AS (SELECT d.id, p.prerequisite_id, n.status FROM due d JOIN prereqs p ON p.id = d.id
    LEFT JOIN actions n ON n.id = p.prerequisite_id),
  failing AS (SELECT id FROM needs WHERE status IS NULL OR status IN ('failed', 'canceled')
    UNION SELECT n.id FROM needs n JOIN failing f ON f.id = n.prerequisite_id)
  SELECT a.id, CASE WHEN f.id IS NOT NULL THEN 'failed' ELSE a.status END AS status,
    CASE WHEN f.id IS NOT NULL THEN 'prerequisite failed' ELSE '' END AS error
  FROM actions a LEFT JOIN failing f ON f.id = a.id""", recursive=True)
def propagate_failures(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return ops.propagate_failures(nodes, _prereqs(nodes), fx.as_of()).select("id", "status", "error")


@query("""SELECT d.id, d.run_id FROM due d WHERE NOT EXISTS (SELECT 1 FROM prereqs p LEFT JOIN actions n ON n.id = p.prerequisite_id
  WHERE p.id = d.id AND (n.status IS NULL OR n.status <> 'succeeded'))""")
def ready_frontier(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    return ops.ready_frontier(nodes, _prereqs(nodes), fx.as_of()).select("id", "run_id")


@query("""WITH RECURSIVE sizes AS (SELECT run_id, max(pos) AS top FROM actions GROUP BY run_id),
  base AS (SELECT a.run_id, a.id, a.pos, a.status, s.top, CASE WHEN a.pos = 4 AND a.status = 'canceled' THEN -a.caller_action_id
    WHEN a.pos = 1 AND a.run_id % 13 = 0 AND s.top >= 2 THEN a.id + 1 WHEN a.pos = 3 AND a.run_id % 11 = 0 THEN NULL
    ELSE a.caller_action_id END AS up FROM actions a JOIN sizes s USING (run_id)),
  climb AS (SELECT run_id, id, up, 1 AS n FROM base WHERE up IS NOT NULL
    UNION ALL SELECT c.run_id, c.id, p.up, n + 1 FROM climb c JOIN base p ON p.run_id = c.run_id AND p.id = c.up
    WHERE p.up IS NOT NULL AND n <= 40),
  roots AS (SELECT run_id, count(*) FILTER (up IS NULL) AS n FROM base GROUP BY run_id)
  SELECT run_id, 'duplicate node' AS rule, id AS node_id FROM base WHERE run_id % 7 = 0 AND pos = 2
  UNION ALL SELECT run_id, 'missing parent', id FROM base WHERE pos = 4 AND status = 'canceled'
  UNION ALL SELECT run_id, 'missing prerequisite', id FROM base WHERE pos = 5 AND status = 'canceled'
  UNION ALL SELECT run_id, 'prerequisite cycle', id FROM base WHERE run_id % 5 = 0 AND top >= 3 AND pos IN (1, 3)
  UNION ALL SELECT run_id, 'prerequisite cycle', id FROM base WHERE run_id % 10 = 0 AND top >= 7 AND pos IN (5, 7)
  UNION ALL SELECT run_id, 'no root', NULL FROM roots WHERE n = 0
  UNION ALL SELECT run_id, 'several roots', NULL FROM roots WHERE n > 1
  UNION ALL SELECT run_id, 'parent cycle', id FROM climb WHERE n > 40""", recursive=True)
def validate_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Faults made in the columns of some runs: a repeated node, parents and prerequisites that are not there, a second
    root, a prerequisite cycle of nodes 1 and 3, one of nodes 5 and 7 with nodes 4 and 2 between them, a root under its
    own child."""
    nodes = _nodes(spark, sf)
    top = nodes.groupBy("run_id").agg(F.max("pos").alias("top"))
    nodes = nodes.join(top, "run_id")
    run, pos, canceled = F.col("run_id"), F.col("pos"), F.col("status") == "canceled"
    caller = (
        F.when((pos == 4) & canceled, -F.col("caller_action_id"))
        .when((pos == 1) & (run % 13 == 0) & (F.col("top") >= 2), F.col("id") + 1)
        .when((pos == 3) & (run % 11 == 0), F.lit(None))
        .otherwise(F.col("caller_action_id"))
    )
    needs = nodes.filter("pos >= 3").select(
        "run_id", "id", F.when((pos == 5) & canceled, -F.col("id")).otherwise(F.col("id") - 2).alias("prerequisite_id")
    )

    def added(where: str, *, ahead: int) -> DataFrame:
        return nodes.filter(where).select("run_id", "id", (F.col("id") + ahead).alias("prerequisite_id"))

    long = "top >= 7 AND run_id % 10 = 0"
    needs = reduce(DataFrame.unionByName, [
        needs, added("pos = 1 AND top >= 3 AND run_id % 5 = 0", ahead=2), added(f"pos = 5 AND {long}", ahead=2),
        added(f"pos = 5 AND {long}", ahead=-1), added(f"pos = 2 AND {long}", ahead=-1),
    ])
    changed = nodes.withColumn("caller_action_id", caller)
    changed = changed.unionByName(changed.filter((run % 7 == 0) & (pos == 2)))
    return ops.validate_graph(changed, needs)


@query("""WITH RECURSIVE envs AS (SELECT submission, id, CASE WHEN submission % 5 = 1 AND id % 10 = 9 THEN 'env-' || ((id - 1) % 40) ELSE name END AS name
      FROM environments UNION ALL SELECT -1, id, 'all-' || id FROM environments),
  deps AS (SELECT * FROM environment_deps UNION ALL SELECT submission, id, id + 3 FROM environments WHERE submission % 7 = 3 AND id % 10 = 2
    UNION ALL SELECT -1, a.id, b.id FROM environments a JOIN environments b ON b.id = a.id - 1),
  above AS (SELECT submission, id, dependency_id AS below FROM deps
    UNION SELECT a.submission, a.id, d.dependency_id FROM above a JOIN deps d ON d.submission = a.submission AND d.id = a.below),
  looping AS (SELECT DISTINCT a.submission, a.id FROM above a JOIN above c ON c.submission = a.submission AND c.id = a.below AND c.id = c.below
    UNION SELECT submission, id FROM above WHERE id = below),
  sound AS (SELECT * FROM deps d WHERE NOT EXISTS (SELECT 1 FROM looping l WHERE l.submission = d.submission AND l.id = d.id)),
  reach AS (SELECT submission, id, 0::BIGINT AS level FROM envs
    UNION SELECT d.submission, d.id, r.level + 1 FROM reach r JOIN sound d ON d.submission = r.submission AND d.dependency_id = r.id),
  names AS (SELECT DISTINCT submission FROM (SELECT submission, name FROM envs GROUP BY ALL HAVING count(DISTINCT id) > 1))
  SELECT e.submission, e.id, CASE WHEN any_value(l.id) IS NULL THEN max(r.level) END AS level, CASE WHEN any_value(l.id) IS NOT NULL THEN 'cycle'
    WHEN any_value(n.submission) IS NOT NULL THEN 'ambiguous name' ELSE 'ok' END AS verdict
  FROM envs e JOIN reach r ON r.submission = e.submission AND r.id = e.id LEFT JOIN looping l ON l.submission = e.submission AND l.id = e.id
    LEFT JOIN names n ON n.submission = e.submission GROUP BY e.submission, e.id""", recursive=True)
def environment_order(spark: SparkSession, sf: str) -> DataFrame:
    """The given submissions, some with a cycle or with one name twice, and one more in which each environment needs the one
    before it."""
    given, deps = fx.environments(spark, sf), fx.environment_deps(spark, sf)
    twice = (F.col("submission") % 5 == 1) & (F.col("id") % 10 == 9)
    name = F.when(twice, F.concat(F.lit("env-"), (F.col("id") - 1) % 40)).otherwise(F.col("name"))
    every = given.select(F.lit(-1).cast("long").alias("submission"), "id", F.concat(F.lit("all-"), "id").alias("name"))
    envs = given.select("submission", "id", name.alias("name")).unionByName(every)
    back = given.filter("submission % 7 = 3 AND id % 10 = 2").select("submission", "id", (F.col("id") + 3).alias("dependency_id"))
    before = every.select((F.col("id") + 1).alias("id"), F.col("id").alias("dependency_id"))
    chain = every.select("submission", "id").join(before, "id").select("submission", "id", "dependency_id")
    return ops.environment_order(envs, reduce(DataFrame.unionByName, [deps, back, chain]))
