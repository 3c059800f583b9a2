"""Run and action tables: detail joins, listings, backlog reports, request checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators.scale import first_rows, read_after, running
from taskledger.session import written



def terminal_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_terminal", X.is_terminal(F.col("status")))


def _environment_columns(envs: DataFrame) -> DataFrame:
    return envs.select(
        F.col("id").alias("environment_id"), F.col("namespace_id"), F.col("name").alias("environment_name"),
        "version",
    )


def run_detail(runs: DataFrame, actions: DataFrame, envs: DataFrame) -> DataFrame:
    """Run, its root action and that action's environment. Runs without a root have no row.

    No join is hinted: Spark broadcasts the environments only when their measured size allows it.
    """
    roots = runs.filter("root_action_id IS NOT NULL").select(
        F.col("id").alias("run_id"), "root_action_id", F.col("created_at").alias("run_created_at")
    )
    first = actions.select(
        "run_id", F.col("id").alias("root_action_id"), "status", "updated_at", "entrypoint_id", "environment_id"
    )
    return roots.join(first, ["run_id", "root_action_id"]).join(_environment_columns(envs), "environment_id")


def action_detail(actions: DataFrame, envs: DataFrame) -> DataFrame:
    return actions.join(_environment_columns(envs), "environment_id")


def actions_with_upstreams(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per source of each action, in the order of their ids: `position` from 1 and `upstream_id`.

    An action without sources has one row with null in both. No array grows with an action's share of the edges.
    """
    placed = running(
        edges.select(F.col("dependent_action_id").alias("id"), F.col("source_action_id").alias("upstream_id")).distinct(),
        ["id"], ["upstream_id"], count="position",
    )
    return actions.join(placed, "id", "left")


def active_callers(actions: DataFrame, envs: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Running or waiting actions of runs that are claimed under a lease still valid at `as_of`."""
    held = runs.filter(F.col("claim_token").isNotNull() & (F.col("lease_until") > as_of)).select(
        F.col("id").alias("run_id"), "claim_token"
    )
    busy = actions.filter(F.col("status").isin(*X.INFLIGHT)).select(
        "id", "run_id", "status", "attempts", "environment_id"
    )
    return busy.join(held, "run_id").join(
        envs.select(F.col("id").alias("environment_id"), F.col("name").alias("environment_name")), "environment_id"
    )


def dependency_check(actions: DataFrame, envs: DataFrame, deps: DataFrame) -> DataFrame:
    """Whether each child action's environment is its caller's or one the caller's declares.

    `deps`: id, dependency_id. Verdicts: same, declared, undeclared, other namespace.
    """
    child = actions.filter("caller_action_id IS NOT NULL").select(
        "run_id", F.col("id").alias("action_id"), "caller_action_id", F.col("environment_id").alias("_child")
    )
    caller = actions.select(
        "run_id", F.col("id").alias("caller_action_id"), F.col("environment_id").alias("_caller")
    )
    spaces = envs.select(F.col("id"), F.col("namespace_id"))
    declared = deps.select(
        F.col("id").alias("_caller"), F.col("dependency_id").alias("_child"), F.lit(True).alias("_declared")
    ).distinct()
    return (
        child.join(caller, ["run_id", "caller_action_id"])
        .join(spaces.select(F.col("id").alias("_child"), F.col("namespace_id").alias("_child_space")), "_child")
        .join(spaces.select(F.col("id").alias("_caller"), F.col("namespace_id").alias("_caller_space")), "_caller")
        .join(declared, ["_caller", "_child"], "left")
        .select(
            "action_id",
            F.when(F.col("_child_space") != F.col("_caller_space"), "other namespace")
            .when(F.col("_child") == F.col("_caller"), "same")
            .when(F.col("_declared"), "declared")
            .otherwise("undeclared").alias("verdict"),
        )
    )


def idempotency_reconcile(
    requests: DataFrame, existing: DataFrame | None, scope: Sequence[str] = ("scope",)
) -> DataFrame:
    """Each request against the first one with its (scope, key): new, replay or conflict.

    `requests`: scope columns, key (null: always new), payload, arrival (unique). `existing`: scope
    columns, key, payload. The first request of a key is found with map-side combine.
    """
    on = [*scope, "key"]
    first = requests.filter("key IS NOT NULL").groupBy(*on).agg(
        F.min("arrival").alias("_first"), F.min_by("payload", "arrival").alias("_payload")
    )
    # Requests without a key are new whatever else there is; in the joins they would all share one null key.
    keyed = requests.filter(F.col("key").isNotNull())
    unkeyed = requests.filter(F.col("key").isNull()).select(
        *requests.columns, F.lit("new").alias("outcome"), F.col("arrival").alias("first_arrival")
    )
    marked = keyed.join(first, on, "left")
    stored = F.lit(False)
    if existing is not None:
        known = existing.filter("key IS NOT NULL").select(
            *on, F.col("payload").alias("_stored"), F.lit(True).alias("_is_stored")
        )
        marked = marked.join(known, on, "left")
        stored = F.coalesce("_is_stored", F.lit(False))
        same = F.col("payload").eqNullSafe(F.when(stored, F.col("_stored")).otherwise(F.col("_payload")))
    else:
        same = F.col("payload").eqNullSafe(F.col("_payload"))
    return marked.select(
        *requests.columns,
        F.when(~stored & (F.col("arrival") == F.col("_first")), "new").when(same, "replay").otherwise("conflict").alias("outcome"),
        F.when(~stored, F.col("_first")).alias("first_arrival"),
    ).unionByName(unkeyed)


def resolve_namespace(requests: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Slug to id; `found` is false for an unknown slug."""
    known = namespaces.select("slug", F.col("id").alias("namespace_id"))
    return requests.join(known, "slug", "left").withColumn("found", F.col("namespace_id").isNotNull())


def claimable_runs(runs: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Runs a worker could take at `as_of`; oldest first is the order (created_at, id)."""
    open_work = actions.filter(~X.is_terminal(F.col("status"))).select(F.col("run_id").alias("id"))
    free = F.col("claim_token").isNull() | (F.col("lease_until") <= as_of)
    return runs.filter(free & F.col("root_action_id").isNotNull()).join(open_work, "id", "left_semi")


def oldest_claimable(
    runs: DataFrame, actions: DataFrame, as_of: Column, per: Sequence[str] | None = None
) -> DataFrame:
    found = claimable_runs(runs, actions, as_of)
    if not per:
        return found.orderBy("created_at", "id").limit(1)
    return first_rows(found, per, ["created_at", "id"])


def page_size(size: Column) -> Column:
    return F.when((size <= 0) | (size > 1000), 100).otherwise(size)


def keyset_page(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """The page of actions after each request's cursor, with a token where more remain.

    `requests`: request_id, run_id, created_at and id (the cursor; null for the first page), size. Use
    `with_page_tokens` for requests that carry tokens.
    """
    asked = written(requests.withColumn("size", page_size(F.col("size"))), "asked")
    page = read_after(
        actions, asked, keys=["run_id"], order=["created_at", "id"], request_id="request_id", limit="size"
    )
    sizes = asked.select("request_id", "size")
    return page.join(sizes, "request_id").withColumn(
        "next_page_token",
        F.when(
            F.col("more") & (F.col("position") == F.col("size")), X.page_token(F.col("created_at"), F.col("id"))
        ),
    ).drop("size", "more")


def with_page_tokens(requests: DataFrame, id_type: str = "string") -> DataFrame:
    """Turn `page_token` into cursor columns; `bad_token` marks a malformed one."""
    read = X.read_page_token(F.col("page_token"))
    given = F.coalesce("page_token", F.lit("")) != ""
    return requests.withColumns({
        "created_at": F.when(given, read["created_at"]),
        "id": F.when(given, read["id"]).try_cast(id_type),
        "bad_token": given & read.isNull(),
    }).drop("page_token")


def all_pages(actions: DataFrame, size: int = 100) -> DataFrame:
    """Every action with the number of its page in its run."""
    return running(actions, ["run_id"], ["created_at", "id"], count="_nth").withColumn(
        "page", F.floor((F.col("_nth") - 1) / size) + 1
    ).drop("_nth")


def child_keys(calls: DataFrame, order: Sequence[str]) -> DataFrame:
    """Idempotency key of each call: its caller and its number in call order."""
    made = calls.filter("caller_action_id IS NOT NULL")
    return running(made, ["caller_action_id"], order, count="_nth").withColumn(
        "idempotency_key", F.concat_ws(":", F.col("caller_action_id").cast("string"), F.col("_nth").cast("string"))
    ).drop("_nth")


def number_entrypoints(envs: DataFrame, entrypoints: str = "entrypoints") -> DataFrame:
    """One row per declared entrypoint with its one-based id."""
    return envs.select("*", F.posexplode(entrypoints).alias("_at", "entrypoint")).withColumn(
        "entrypoint_id", F.col("_at").cast("long") + 1
    ).drop("_at", entrypoints)


def distinct_dependencies(envs: DataFrame, dependencies: str = "dependencies") -> DataFrame:
    """Declared dependencies without repeats, in order, and the same sorted by name."""
    once = F.array_distinct(dependencies)
    return envs.withColumns({"distinct_dependencies": once, "sorted_dependencies": F.array_sort(once)})


def retry_plan(attempts: DataFrame, at: str = "at") -> DataFrame:
    """What follows a failed attempt: queued again after a back-off, or failed for good.

    `attempts`: failures (before this one), max_attempts, cacheable (a deterministic error) and the time
    column `at`.
    """
    failures = F.col("failures") + 1
    again = ~F.col("cacheable") & (failures < F.greatest(F.col("max_attempts"), F.lit(1)))
    wait = F.make_dt_interval(secs=X.backoff_seconds(failures).cast("decimal(18,6)"))
    return attempts.withColumns({
        "next_status": F.when(again, "queued").otherwise("failed"),
        "failures": failures,
        "next_attempt_at": F.when(again, F.col(at) + wait),
    })


def retry_policy(declared: DataFrame) -> DataFrame:
    """Attempts allowed by a declared `retry` (none or idempotent) and `max_attempts` (null: the default)."""
    mode, given = F.col("retry"), F.col("max_attempts")
    attempts = F.coalesce(given, F.when(mode == "none", 1).otherwise(3))
    return declared.withColumns({
        "verdict": F.when(~F.coalesce(mode.isin("none", "idempotent"), F.lit(False)), "invalid retry mode")
        .when(~attempts.between(1, 100), "attempts out of range")
        .when((mode == "none") & (attempts != 1), "one attempt only")
        .otherwise("ok"),
        "attempts": attempts,
    })
