"""The relations of taskledger.sources.fixtures once more, as SQL over the given tables."""

AS_OF = "TIMESTAMP '1999-06-01 00:00:00'"
TERMINAL = "('succeeded', 'failed', 'canceled')"
STATUS = """CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'canceled'
  WHEN l_linestatus = 'F' THEN 'succeeded' WHEN l_partkey % 3 = 0 THEN 'running'
  WHEN l_partkey % 3 = 1 THEN 'waiting' ELSE 'queued' END"""


def frame(expr: str) -> str:
    """Length-framed hex of a text."""
    return f"printf('%016x', octet_length(encode({expr}))) || hex(encode({expr}))"


RELATIONS: dict[str, str] = {
    "namespaces": "SELECT n_nationkey::BIGINT AS id, lower(replace(n_name, '_', '-')) AS slug, n_name AS name FROM nation",
    "setting_rows": """SELECT c_nationkey::BIGINT AS namespace_id, lower(c_mktsegment) || '/k' || (c_custkey % 20) AS path,
        c_acctbal AS value, c_custkey AS version FROM customer""",
    "settings": """SELECT * FROM setting_rows WHERE value >= 0
        QUALIFY row_number() OVER (PARTITION BY namespace_id, path ORDER BY version DESC) = 1""",
    "setting_changes": "SELECT * FROM setting_rows WHERE value < 0",
    "environments": """SELECT s_suppkey AS id, s_nationkey::BIGINT AS namespace_id, 'env-' || (s_suppkey % 40) AS name,
        sha256(s_name || '|' || s_nationkey) AS version, ['local', 'docker', 'e2b'][s_suppkey % 3 + 1] AS provider,
        s_suppkey // 10 AS submission FROM supplier""",
    "environment_deps": """SELECT submission, id, id - 1 AS dependency_id FROM environments WHERE id % 10 >= 1
        UNION ALL SELECT submission, id, id - 2 FROM environments WHERE id % 10 >= 2""",
    "lines": f"""SELECT *, {STATUS} AS status, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem""",
    "actions": """SELECT l_orderkey * 1000000 + pos AS id, l_orderkey AS run_id,
        CASE WHEN pos > 1 THEN l_orderkey * 1000000 + pos // 2 END AS caller_action_id, l_suppkey AS environment_id,
        l_linenumber::BIGINT AS entrypoint_id, status, l_linenumber::BIGINT AS attempts, l_partkey % 4 AS failures,
        1 + l_partkey % 3 AS max_attempts,
        CASE WHEN status = 'queued' AND l_partkey % 2 = 0 THEN l_shipdate + to_days(l_linenumber) END AS next_attempt_at,
        l_shipdate AS created_at, l_shipdate + to_hours(l_quantity::INTEGER) AS updated_at, pos FROM lines""",
    "runs": """SELECT o_orderkey AS id, o_custkey % 25 AS namespace_id,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'w' || (o_orderkey % 7) END AS claim_token,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days((o_orderkey % 61)::INTEGER) END AS lease_until,
        o_orderdate AS created_at,
        CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN o_orderkey * 1000000 + 1 END AS root_action_id
        FROM orders""",
    "edges": """SELECT run_id, id AS source_action_id, caller_action_id AS dependent_action_id FROM actions
        WHERE caller_action_id IS NOT NULL""",
    "prereqs": "SELECT run_id, id, id - 2 AS prerequisite_id FROM actions WHERE pos >= 3",
    "status_events": f"""SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS action, {STATUS} AS status, l_shipdate AS ts,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem""",
    "log_entries": """SELECT user_id AS run_id, event_type AS stream, ts AS arrival, event_id AS ord,
        'k/' || regexp_extract(props, '"k": *([0-9]+)', 1) AS key, event_id::VARCHAR AS value FROM events""",
    "log_records": """SELECT run_id, stream, row_number() OVER (PARTITION BY run_id, stream ORDER BY arrival, ord) AS seq,
        key, value, arrival AS created_at FROM log_entries""",
    "log_batches_in": """SELECT *, (isoyear(arrival) * 100 + weekofyear(arrival))::VARCHAR AS append_id, 1::BIGINT AS attempt
        FROM log_entries
        UNION ALL
        SELECT run_id, stream, arrival, ord, key, CASE WHEN stream = 'error' THEN value || '+' ELSE value END,
        (isoyear(arrival) * 100 + weekofyear(arrival))::VARCHAR, 2 FROM log_entries WHERE stream IN ('purchase', 'error')""",
    "batches": f"""SELECT run_id, stream, append_id, attempt, count(*) AS n,
        sha256(unhex(string_agg({frame('key')} || {frame('value')}, '' ORDER BY ord))) AS digest, min(ord) AS low
        FROM log_batches_in GROUP BY ALL""",
    "arrived": """SELECT *, row_number() OVER (PARTITION BY run_id, stream ORDER BY attempt, low, append_id) AS arrival
        FROM batches""",
    "judged": """SELECT a.*, f.digest AS first_digest, f.arrival AS first_arrival,
        CASE WHEN a.arrival = f.arrival THEN 'appended' WHEN a.digest = f.digest THEN 'replay' ELSE 'conflict' END AS outcome
        FROM arrived a JOIN (SELECT run_id, stream, append_id, arg_min(digest, arrival) AS digest, min(arrival) AS arrival
          FROM arrived GROUP BY ALL) f USING (run_id, stream, append_id)""",
    "placed": """SELECT *, sum(n) OVER (PARTITION BY run_id, stream ORDER BY arrival) - n + 1 AS first_seq,
        sum(n) OVER (PARTITION BY run_id, stream ORDER BY arrival) AS last_seq FROM judged WHERE outcome = 'appended'""",
    "decided": """SELECT j.run_id, j.stream, j.append_id, j.attempt, j.arrival, j.n, j.digest, j.outcome,
        p.first_seq::BIGINT AS first_seq, p.last_seq::BIGINT AS last_seq
        FROM judged j LEFT JOIN placed p ON p.run_id = j.run_id AND p.stream = j.stream
          AND p.arrival = j.first_arrival AND j.outcome <> 'conflict'""",
    "checkpoints": """SELECT conv_id AS run_id, role AS name, turn + 1 AS seq, text AS value FROM conversations""",
    "task_lines": """SELECT conv_id AS run_id, turn AS action, 1::BIGINT AS attempt,
        unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord
        FROM conversations""",
    "image_builds": """SELECT o_orderkey AS id, o_custkey AS image_key,
        CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'failed' ELSE 'building' END AS status,
        o_orderdate AS created_at, o_orderdate + to_days(30) AS lease_until,
        CASE WHEN o_orderstatus = 'F' THEN 'image:' || o_orderkey ELSE '' END AS artifact_uri FROM orders""",
    "uploads": """SELECT o_orderkey AS session, sha256(o_custkey::VARCHAR) AS sha256, 'obj-' || o_orderkey AS object_key,
        o_custkey * 100000 AS size, o_orderdate AS created_at, o_orderdate + to_hours(24) AS expires_at FROM orders""",
    "requests": """SELECT o_custkey % 25 AS scope, o_custkey || '@' || year(o_orderdate) AS key, o_orderpriority AS payload,
        o_orderkey AS arrival FROM orders""",
    "contents": """SELECT doc_id AS arrival, text AS content, sha256(text) AS digest,
        octet_length(encode(text)) AS size FROM documents""",
    "known_blobs": """SELECT digest, 'blobs/' || min(arrival) AS object_key FROM contents
        WHERE arrival IN (SELECT doc_id FROM labels) GROUP BY digest""",
    "uris": """SELECT arrival AS doc_id, digest, CASE WHEN arrival % 13 = 0 THEN 'data:' ELSE 'blob:' END || 'text/plain'
        || CASE WHEN arrival % 7 = 0 THEN ';resolve' ELSE '' END || ','
        || CASE WHEN arrival % 11 = 0 THEN substr(to_base64(unhex(digest)), 1, 43) ELSE to_base64(unhex(digest)) END AS uri
        FROM contents""",
    "sized": """SELECT source AS archive, doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha,
        sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS "end" FROM documents""",
    "manifest": """SELECT archive, doc_id, CASE WHEN doc_id % 89 = 0 THEN '../' ELSE 'docs/' END || doc_id AS name,
        size, "end" - size - CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS start, "end" FROM sized""",
    "overlap_rows": """SELECT * FROM (SELECT *, lag("end") OVER (PARTITION BY archive ORDER BY start, "end", doc_id) AS previous_end
        FROM manifest WHERE size > 0 AND start >= 0) WHERE start < coalesce(previous_end, 0)""",
    "memo_inputs": "SELECT p_partkey, p_brand AS brand, p_size::BIGINT AS size FROM part",
    "claimable": f"""SELECT * FROM runs r WHERE (claim_token IS NULL OR lease_until <= {AS_OF}) AND root_action_id IS NOT NULL
        AND EXISTS (SELECT 1 FROM actions a WHERE a.run_id = r.id AND a.status NOT IN {TERMINAL})""",
    "due": f"""SELECT * FROM actions WHERE status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= {AS_OF})""",
}
