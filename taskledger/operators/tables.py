"""Snapshot maintenance: a table and change rows in, the new table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators.scale import first_rows, running
from taskledger.session import written


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_rows(df, keys, [F.col(c).desc() for c in order])


def insert_if_absent(
    table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Add unseen keys, the first arrival of each. Returns the new table and a report of `new`."""
    keys = list(keys)
    fresh = first_rows(new.join(table.select(*keys), keys, "left_anti"), keys, list(order))
    known = table.select(*keys).distinct().withColumn("_known", F.lit(True))
    firsts = fresh.select(*keys, *[F.col(c).alias(f"_first_{c}") for c in order])
    is_first = F.lit(True)
    for c in order:
        is_first = is_first & F.col(c).eqNullSafe(F.col(f"_first_{c}"))
    report = new.join(known, keys, "left").join(firsts, keys, "left").select(
        *new.columns,
        F.when(F.col("_known").isNull() & is_first, "inserted").otherwise("duplicate").alias("outcome"),
    )
    return table.unionByName(fresh.select(*table.columns)), report


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The last write per key wins; any change beats the stored row."""
    both = table.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    return latest_per_key(both, keys, ["_change", version]).drop("_change")


def upsert_settings(settings: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    return upsert(settings, changes, ["namespace_id", "path"], version)


def delete_settings(settings: DataFrame, keys: DataFrame) -> DataFrame:
    on = ["namespace_id", "path"]
    return settings.join(keys.select(*on), on, "left_anti")


def settings_list(settings: DataFrame, namespaces: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All settings of the named namespaces; with `paths`, only those. Sort by (namespace_id, path)."""
    found = settings.join(namespaces.select(F.col("id").alias("namespace_id")), "namespace_id", "left_semi")
    return found if paths is None else found.join(paths.select("path"), "path", "left_semi")


def latest_build(builds: DataFrame) -> DataFrame:
    return latest_per_key(builds, ["image_key"], ["created_at", "id"])


def latest_ready_build(builds: DataFrame) -> DataFrame:
    return latest_build(builds.filter(F.col("status") == "ready"))


def expired_leases(builds: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Building rows whose lease has ended, and the table with those rows failed."""
    expired = (F.col("status") == "building") & (F.col("lease_until") <= as_of)
    swept = builds.withColumn("status", F.when(expired, "failed").otherwise(F.col("status")))
    return builds.filter(expired), swept


def expire_memo(cache: DataFrame, as_of: Column) -> DataFrame:
    """The memo table without building rows whose lease has ended."""
    return cache.filter(~((F.col("status") == "building") & (F.col("lease_until") <= as_of)))


def expired_uploads(uploads: DataFrame, as_of: Column) -> DataFrame:
    """All upload sessions past their end."""
    return uploads.filter(F.col("expires_at") <= as_of)


def active_uploads(uploads: DataFrame, as_of: Column) -> DataFrame:
    return uploads.filter(F.col("expires_at") > as_of)


def _stamped(df: DataFrame, hit: Column, as_of: Column | None) -> dict[str, Column]:
    """The change time of the rows that are hit, where the table keeps one."""
    if as_of is None or "updated_at" not in df.columns:
        return {}
    return {"updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}


def cancel_active(
    actions: DataFrame, runs: DataFrame, ids: DataFrame, as_of: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cancel the open actions of the given runs while the root is open; clear the claim either way.

    `ids` has a column run_id. Returns the new actions, changed at `as_of`, and runs.
    """
    asked = ids.select("run_id").distinct()
    roots = runs.join(asked.withColumnRenamed("run_id", "id"), "id", "left_semi").select(
        F.col("id").alias("run_id"), F.col("root_action_id").alias("id")
    )
    open_roots = actions.filter(~X.is_terminal(F.col("status"))).join(roots, ["run_id", "id"], "left_semi")
    closing = open_roots.select("run_id").withColumn("_closing", F.lit(True))
    hit = F.col("_closing").isNotNull() & ~X.is_terminal(F.col("status"))
    new_actions = actions.join(closing, "run_id", "left").withColumns({
        "error": F.when(hit, "run canceled").otherwise(F.col("error") if "error" in actions.columns else F.lit("")),
        "status": F.when(hit, "canceled").otherwise(F.col("status")),
    } | _stamped(actions, hit, as_of)).drop("_closing")
    cleared = asked.select(F.col("run_id").alias("id"), F.lit(True).alias("_asked"))
    new_runs = runs.join(cleared, "id", "left").withColumns({
        "claim_token": F.when(F.col("_asked").isNull(), F.col("claim_token")),
        "lease_until": F.when(F.col("_asked").isNull(), F.col("lease_until")),
    }).drop("_asked")
    return new_actions, new_runs


def reset_inflight(actions: DataFrame, runs: DataFrame, claims: DataFrame, as_of: Column) -> DataFrame:
    """Running and waiting actions go back to queued where the claim (run_id, claim_token) still holds."""
    held = (
        runs.filter(F.col("lease_until") > as_of).select(F.col("id").alias("run_id"), "claim_token")
        .join(claims.select("run_id", "claim_token"), ["run_id", "claim_token"], "left_semi")
        .select("run_id", F.lit(True).alias("_held"))
    )
    hit = F.col("_held").isNotNull() & F.col("status").isin(*X.INFLIGHT)
    return actions.join(held, "run_id", "left").withColumns(
        {"status": F.when(hit, "queued").otherwise(F.col("status"))} | _stamped(actions, hit, as_of)
    ).drop("_held")


def fold_transitions(
    actions: DataFrame, transitions: DataFrame, runs: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Apply ordered transitions to actions; returns the new actions and a verdict per transition.

    `transitions`: action_id, seq (order), claim_token, expected_attempt, attempt, failures, status, and if there are
    any output, error, next_attempt_at. The last applied one is written with all its columns and `as_of` as the
    time of change. One is applied only while its token holds the run's lease, the action's attempt number is the expected one and
    the action is open; otherwise its verdict is `lease lost`. Verdicts of one action follow from each other,
    so they are settled in rounds: every transition looks up the next one its outcome lets in, and the path
    from the stored state is followed with doubling steps. All work is joins over (action, attempt) keys.
    """
    from taskledger.operators.graph import reachable_by_doubling

    lease = runs.filter(F.col("lease_until") > as_of).select(F.col("id").alias("run_id"), "claim_token")
    stored = actions.select(
        F.col("id").alias("action_id"), "run_id", F.col("attempts").alias("_attempts"),
        X.is_terminal(F.col("status")).alias("_closed"),
    )
    held = written(
        transitions.join(stored.select("action_id", "run_id"), "action_id")
        .join(lease, ["run_id", "claim_token"], "left_semi")
        .select("action_id", "seq", "expected_attempt", "attempt", X.is_terminal(F.col("status")).alias("_ends")),
        "held",
    )
    # Seek rows: from the stored state (seq 0 side) and from each transition that leaves the action open.
    # Descending position: the nearest candidate after a seek row is the previous row in that order.
    candidate = held.select(
        "action_id", F.col("expected_attempt").alias("_attempt"), (-F.col("seq")).alias("_at"),
        F.lit(1).alias("_kind"), F.col("seq").alias("_target"),
    )
    no_target = F.lit(None).cast(candidate.schema["_target"].dataType)
    seek = held.filter(~F.col("_ends")).select(
        "action_id", F.col("attempt").alias("_attempt"), (-F.col("seq")).alias("_at"),
        F.lit(0).alias("_kind"), no_target.alias("_target"),
    )
    start = stored.filter(~F.col("_closed")).join(held.select("action_id").distinct(), "action_id", "left_semi").select(
        "action_id", F.col("_attempts").alias("_attempt"),
        F.lit(2**62).cast(candidate.schema["_at"].dataType).alias("_at"),
        F.lit(2).alias("_kind"), no_target.alias("_target"),
    )
    # One number per candidate seen so far picks out the nearest one before each seek row. At equal
    # position the seek row (kind 0) stands before its own candidate (kind 1), so it cannot find itself.
    events = candidate.unionByName(seek).unionByName(start).withColumn(
        "_one", F.when(F.col("_kind") == 1, 1).otherwise(0).cast("long")
    )
    ranked = written(
        running(events, ["action_id", "_attempt"], ["_at", "_kind"], sums={"_nth": "_one"}), "ranked"
    )
    targets = ranked.filter("_kind = 1").select("action_id", "_attempt", "_nth", F.col("_target").alias("next_seq"))
    links = ranked.filter("_kind <> 1").select("action_id", "_attempt", "_nth", "_at", "_kind").join(
        targets, ["action_id", "_attempt", "_nth"]
    )
    heads = links.filter("_kind = 2").select("action_id", F.col("next_seq").alias("seq"))
    steps = links.filter("_kind = 0").select("action_id", (-F.col("_at")).alias("seq"), "next_seq")
    applied = reachable_by_doubling(heads, steps, key="action_id", node="seq", successor="next_seq")
    verdicts = transitions.join(
        applied.withColumn("_applied", F.lit(True)), ["action_id", "seq"], "left"
    ).withColumn("verdict", F.when(F.col("_applied"), "applied").otherwise("lease lost")).drop("_applied")
    written_columns = {"status": "status", "attempts": "attempt", "failures": "failures"} | {
        c: c for c in ("output", "error", "next_attempt_at") if c in transitions.columns and c in actions.columns
    }
    last = verdicts.filter("verdict = 'applied'").groupBy("action_id").agg(
        F.max_by(F.struct(*written_columns.values()), "seq").alias("_new")
    )
    changed = actions.join(last.withColumnRenamed("action_id", "id"), "id", "left")
    hit = F.col("_new").isNotNull()
    new_actions = changed.withColumns({
        mine: F.when(hit, F.col("_new").getField(theirs)).otherwise(F.col(mine)) for mine, theirs in written_columns.items()
    } | _stamped(actions, hit, as_of)).select(*actions.columns)
    return new_actions, verdicts


def transition_events(actions: DataFrame, verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """What each applied transition puts in the run's log: its action's new status, and the run's if it is the root.

    Columns run_id, action_id (null for an event of the run), seq, status.
    """
    applied = verdicts.filter("verdict = 'applied'").select("action_id", "seq", "status").join(
        actions.select(F.col("id").alias("action_id"), "run_id"), "action_id"
    )
    roots = runs.select(F.col("id").alias("run_id"), F.col("root_action_id").alias("action_id"))
    of_runs = applied.join(roots, ["run_id", "action_id"], "left_semi").withColumn(
        "action_id", F.lit(None).cast(applied.schema["action_id"].dataType)
    )
    columns = ["run_id", "action_id", "seq", "status"]
    return applied.select(*columns).unionByName(of_runs.select(*columns))


def promote_uploads(
    uploads: DataFrame, objects: DataFrame, parts: DataFrame | None, blobs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Finished uploads become blobs. Returns the new blobs and a verdict per upload.

    `uploads`: session, sha256, object_key, size, multipart_id, arrival. `objects`: object_key, stored_size,
    stored_sha256. `parts`: session, number, etag. `blobs`: sha256, object_key. An upload of content that is
    already stored is `duplicate`; its object can be removed.
    """
    if "multipart_id" not in uploads.columns:
        uploads = uploads.withColumn("multipart_id", F.lit(None).cast("string"))
    seen = uploads.join(objects, "object_key", "left")
    zero = F.lit(0).cast("long")
    if parts is not None:
        per_session = parts.groupBy("session").agg(
            F.count(F.lit(1)).alias("_parts"),
            F.min("number").alias("_low"), F.max("number").alias("_high"),
            F.sum((F.coalesce(F.trim("etag"), F.lit("")) == "").cast("int")).alias("_no_etag"),
        )
        # Numbers 1..n each once: n distinct values in that range.
        counted = parts.select("session", "number").distinct().groupBy("session").agg(
            F.count(F.lit(1)).alias("_distinct")
        )
        seen = seen.join(per_session, "session", "left").join(counted, "session", "left")
    else:
        seen = seen.withColumns({c: zero for c in ("_parts", "_low", "_high", "_no_etag", "_distinct")})
    count = F.coalesce("_parts", zero)
    single = F.col("multipart_id").isNull()
    sequence_ok = (F.col("_low") == 1) & (F.col("_high") == count) & (F.col("_distinct") == count)
    judged = seen.withColumn(
        "verdict",
        F.when(single & (count > 0), "single upload takes no parts")
        .when(~single & (count != X.part_count(F.col("size"))), "incorrect part count")
        .when(~single & (count > 0) & ~(sequence_ok & (F.col("_no_etag") == 0)), "invalid part list")
        .when(F.col("stored_size").isNull(), "not uploaded")
        .when(F.col("stored_size") != F.col("size"), "size mismatch")
        .when(single & ~F.col("stored_sha256").eqNullSafe(F.col("sha256")), "digest mismatch")
        .otherwise("ok"),
    )
    good = judged.filter("verdict = 'ok'").select("sha256", "object_key", "arrival")
    table, report = insert_if_absent(blobs.select("sha256", "object_key"), good, ["sha256"], ["arrival"])
    outcome = report.select("object_key", F.col("outcome").alias("_outcome"))
    verdicts = judged.join(outcome, "object_key", "left").select(
        "session", "sha256", "object_key", F.coalesce("_outcome", "verdict").alias("verdict")
    )
    return table, verdicts

