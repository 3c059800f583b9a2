"""Queries over logs and their streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators import blobs, logs
from taskledger.plans.registry import query
from taskledger.plans.relations import frame
from taskledger.session import fresh_path, written
from taskledger.sources import fixtures as fx
from taskledger.sources.tables import log_source_batch, log_source_stream, source_table
from taskledger.streaming import logs as live


def _text_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.decode("key", "UTF-8"))


@query("SELECT run_id, stream, ord, key, value FROM log_entries WHERE stream IN ('click', 'view')", name="log_source_batch")
def log_source_batch_streams(spark: SparkSession, sf: str) -> DataFrame:
    found = log_source_batch(fx.log_entries(spark, sf), streams=["click", "view"])
    return _text_key(found.select("run_id", "stream", "ord", "key", "value"))


@query("SELECT run_id, stream, ord, seq, key, value FROM (SELECT *, row_number() OVER "
       "(PARTITION BY run_id, stream ORDER BY arrival, ord) AS seq FROM log_entries)")
def assign_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _text_key(logs.assign_sequence(fx.log_entries(spark, sf)).select(
        "run_id", "stream", "ord", "seq", "key", "value"
    ))


_NAMES = "['view', 'click', 'error', 'purchase', 'signup', 'audit']"


@query(f"""SELECT u.run_id, s.stream, coalesce(max(r.seq), 0)::BIGINT AS end_seq
  FROM (SELECT DISTINCT run_id FROM log_records) u CROSS JOIN (SELECT unnest({_NAMES}) AS stream) s
  LEFT JOIN log_records r ON r.run_id = u.run_id AND r.stream = s.stream GROUP BY ALL""")
def stream_end(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("view", "click", "error", "purchase", "signup", "audit")])
    records = fx.log_records(spark, sf)
    return logs.stream_end(records, records.select("run_id").distinct().withColumn("stream", F.explode(names)))


@query("SELECT run_id, stream, ord, key FROM log_entries WHERE starts_with(key, 'k/1')")
def key_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _text_key(logs.key_prefix_scan(fx.log_entries(spark, sf), b"k/1").select("run_id", "stream", "ord", "key"))


def _reads(records: DataFrame) -> DataFrame:
    """Per stream: the second half, three at a time; everything under the key of the first record; two refused ones."""
    ends = logs.stream_end(records)
    halves = ends.select(
        F.concat_ws("/", F.col("run_id").cast("string"), "stream", F.lit("half")).alias("request_id"),
        "run_id", "stream", F.floor(F.col("end_seq") / 2).alias("after_seq"),
        F.lit(None).cast("binary").alias("key"), F.lit(3).alias("limit"),
    )
    keyed = records.filter("seq = 1").select(
        F.concat_ws("/", F.col("run_id").cast("string"), "stream", F.lit("key")).alias("request_id"),
        "run_id", "stream", F.lit(0).cast("long").alias("after_seq"), "key", F.lit(0).alias("limit"),
    )
    place = F.regexp_replace("request_id", "key$", "")
    wide = keyed.withColumns({"request_id": F.concat(place, F.lit("wide")), "limit": F.lit(1001)})
    back = keyed.withColumns({"request_id": F.concat(place, F.lit("back")), "after_seq": F.lit(-1).cast("long")})
    return halves.unionByName(keyed).unionByName(wide).unionByName(back)


@query("""WITH reads AS (
  SELECT run_id || '/' || stream || '/half' AS request_id, run_id, stream, max(seq) // 2 AS after_seq,
    NULL AS key, 3 AS lim FROM log_records GROUP BY run_id, stream
  UNION ALL SELECT run_id || '/' || stream || '/key', run_id, stream, 0, key, 100 FROM log_records WHERE seq = 1
  UNION ALL SELECT run_id || '/' || stream || '/wide', run_id, stream, 0, key, 1001 FROM log_records WHERE seq = 1
  UNION ALL SELECT run_id || '/' || stream || '/back', run_id, stream, -1, key, 100 FROM log_records WHERE seq = 1),
 hits AS (SELECT q.request_id, r.run_id, r.stream, r.seq, r.key, r.value, q.lim,
    row_number() OVER (PARTITION BY q.request_id ORDER BY r.seq) AS position,
    count(*) OVER (PARTITION BY q.request_id) AS total
  FROM reads q JOIN log_records r ON r.run_id = q.run_id AND r.stream = q.stream AND r.seq > q.after_seq
    AND (q.key IS NULL OR r.key = q.key) WHERE q.lim <= 1000 AND q.after_seq >= 0)
 SELECT q.request_id, q.run_id, q.stream, h.seq, h.key, h.value, h.position, h.total > h.lim AS truncated,
   CASE WHEN q.lim > 1000 THEN 'invalid limit' WHEN q.after_seq < 0 THEN 'invalid cursor' ELSE 'ok' END AS verdict
 FROM reads q LEFT JOIN hits h ON h.request_id = q.request_id AND h.position <= h.lim""")
def cursor_read(spark: SparkSession, sf: str) -> DataFrame:
    records = written(fx.log_records(spark, sf), "records")
    return _text_key(logs.cursor_read(records, _reads(records))).select(
        "request_id", "run_id", "stream", "seq", "key", "value", "position", "truncated", "verdict"
    )


@query("""WITH asked AS (SELECT DISTINCT run_id, stream, CASE WHEN stream = 'signup' THEN '' ELSE 'k/1' END AS prefix
    FROM log_records),
 hits AS (SELECT q.run_id, q.stream, r.seq, r.key,
    row_number() OVER (PARTITION BY q.run_id, q.stream ORDER BY r.seq) AS position
  FROM asked q JOIN log_records r ON r.run_id = q.run_id AND r.stream = q.stream AND r.seq > 1
    AND starts_with(r.key, q.prefix)),
 firsts AS (SELECT *, count(*) OVER (PARTITION BY run_id, stream) AS n, max(seq) OVER (PARTITION BY run_id, stream) AS top
   FROM hits WHERE position <= 2),
 ends AS (SELECT run_id, stream, max(seq) AS end_seq FROM log_records GROUP BY ALL)
 SELECT q.run_id, q.stream, f.seq, f.key, CASE WHEN f.n = 2 THEN f.top ELSE e.end_seq END AS inspect_seq
 FROM asked q JOIN ends e USING (run_id, stream) LEFT JOIN firsts f ON f.run_id = q.run_id AND f.stream = q.stream""")
def filtered_batch(spark: SparkSession, sf: str) -> DataFrame:
    records = written(fx.log_records(spark, sf), "records")
    asked = records.select("run_id", "stream").distinct().select(
        F.concat_ws("/", F.col("run_id").cast("string"), "stream").alias("request_id"), "run_id", "stream",
        F.lit(1).cast("long").alias("after_seq"),
        F.when(F.col("stream") != "signup", F.lit(b"k/1")).alias("prefix"), F.lit(2).alias("batch"),
    )
    return _text_key(logs.filtered_batch(records, asked)).select("run_id", "stream", "seq", "key", "inspect_seq")


_BY = ["run_id", "stream", "append_id", "attempt"]


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    from taskledger.operators.scale import running

    entries = fx.log_batches_in(spark, sf)
    heads = entries.groupBy(*_BY).agg(F.min("ord").alias("_low"))
    arrivals = running(heads, ["run_id", "stream"], ["attempt", "_low", "append_id"], count="arrival").drop("_low")
    return logs.batch_digest(entries, _BY, ["ord"]).join(arrivals, _BY)


@query("SELECT run_id, stream, append_id, attempt, n, digest FROM batches")
def batch_digest(spark: SparkSession, sf: str) -> DataFrame:
    return logs.batch_digest(fx.log_batches_in(spark, sf), _BY, ["ord"])


@query("SELECT run_id, stream, append_id, arrival, n, digest, outcome, first_seq, last_seq FROM decided")
def append_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return logs.append_reconcile(_batches(spark, sf).drop("attempt"))


@query("""WITH measured AS (SELECT run_id, stream, append_id, attempt, ord, octet_length(encode(key)) AS ks,
    octet_length(encode(value)) AS vs FROM log_batches_in),
 totals AS (SELECT *, sum(ks + vs) OVER (PARTITION BY run_id, stream, append_id, attempt ORDER BY ord) AS so_far FROM measured),
 faults AS (SELECT *, CASE WHEN ks > 3 THEN 'key too large' WHEN vs = 0 OR ks + vs > 6 THEN 'record too large or empty'
   WHEN so_far > 20 THEN 'batch too large' END AS fault FROM totals)
 SELECT run_id, stream, append_id, attempt, count(*) AS entries, sum(ks + vs)::BIGINT AS bytes,
   coalesce(arg_min(fault, ord) FILTER (fault IS NOT NULL), 'ok') AS verdict FROM faults GROUP BY ALL""")
def batch_limits(spark: SparkSession, sf: str) -> DataFrame:
    return logs.batch_limits(
        fx.log_batches_in(spark, sf), ["run_id", "stream", "append_id", "attempt"], max_key=3, max_record=6, max_batch=20
    )


@query("SELECT run_id, name, arg_max(value, seq) AS value, max(seq) AS seq FROM checkpoints GROUP BY ALL")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return logs.latest_state(fx.checkpoints(spark, sf))


@query("""SELECT c.run_id, w.name, l.value IS NOT NULL AS found, coalesce(l.value, 'none') AS value
  FROM (SELECT DISTINCT run_id FROM checkpoints) c CROSS JOIN (SELECT unnest(['user', 'assistant', 'system']) AS name) w
  LEFT JOIN (SELECT run_id, name, arg_max(value, seq) AS value FROM checkpoints GROUP BY ALL) l
    ON l.run_id = c.run_id AND l.name = w.name""")
def latest_state_or_default(spark: SparkSession, sf: str) -> DataFrame:
    saved = fx.checkpoints(spark, sf)
    names = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    wanted = saved.select("run_id").distinct().withColumn("name", F.explode(names))
    return logs.latest_state(saved, wanted, default="none")


@query("SELECT run_id, count(*) AS records FROM log_entries WHERE starts_with(key, 'k/1') GROUP BY run_id")
def record_counts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.record_counts(fx.log_entries(spark, sf), b"k/1")


@query("""SELECT run_id, action, attempt, ord, batch, 'task-log:' || action || ':' || attempt || ':' || batch AS append_id
  FROM (SELECT *, (row_number() OVER (PARTITION BY run_id, action, attempt ORDER BY ord) - 1) // 2 + 1 AS batch
        FROM task_lines)""")
def log_batches(spark: SparkSession, sf: str) -> DataFrame:
    return logs.log_batches(fx.task_lines(spark, sf), size=2).select(
        "run_id", "action", "attempt", F.col("ord").cast("long").alias("ord"), "batch", "append_id"
    )


def _spilled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return logs.spill_large_values(fx.values(spark, sf), "content", fx.SPILL_OVER, "text/plain")


@query("""SELECT arrival, size, CASE WHEN size <= 4096 THEN digest END AS inline_sha,
  CASE WHEN size > 4096 THEN 'blob:text/plain,' || to_base64(unhex(digest)) END AS value_uri FROM contents""")
def spill_large_values(spark: SparkSession, sf: str) -> DataFrame:
    inline, _ = _spilled(spark, sf)
    return inline.select("arrival", "size", F.sha2("content", 256).alias("inline_sha"), "value_uri")


@query("SELECT DISTINCT digest, size FROM contents WHERE size > 4096")
def spill_large_values_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return _spilled(spark, sf)[1].select("digest", "size")


@query("""SELECT c.arrival, CASE WHEN c.size <= 4096 THEN 'inline' WHEN k.digest IS NOT NULL THEN 'stored'
    ELSE 'unavailable' END AS availability, k.object_key
  FROM contents c LEFT JOIN known_blobs k ON k.digest = c.digest AND c.size > 4096""")
def resolve_blobs(spark: SparkSession, sf: str) -> DataFrame:
    inline, _ = _spilled(spark, sf)
    records = inline.select("arrival", "value_uri")
    return blobs.resolve_blobs(records, fx.known_blobs(spark, sf), ["object_key"]).select(
        "arrival", "availability", "object_key"
    )


@query("""WITH asked AS (SELECT c.arrival, c.content, c.digest, c.digest IN (SELECT digest FROM known_blobs) AS there,
    'blob:text/plain;resolve,' || to_base64(unhex(CASE c.arrival % 4 WHEN 0 THEN c.digest WHEN 1 THEN sha256('blob:text/plain;resolve,' || to_base64(unhex(c.digest)))
      ELSE sha256('blob:text/plain;resolve,' || to_base64(unhex(sha256('blob:text/plain;resolve,' || to_base64(unhex(c.digest)))))) END)) AS uri FROM contents c)
  SELECT arrival AS id, sha256(CASE WHEN arrival % 4 = 3 THEN content WHEN arrival % 5 = 0 AND arrival % 4 <> 3 THEN 'blob:text/plain;resolve,' || to_base64(unhex(sha256('ring' || arrival % 7)))
      WHEN there THEN content ELSE uri END) AS value_digest,
    CASE WHEN arrival % 4 = 3 THEN 'plain' WHEN arrival % 5 = 0 THEN 'cycle' WHEN there THEN 'resolved' ELSE 'missing' END AS outcome FROM asked""")
def resolve_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Texts themselves, and by one, two or three references one behind the other. Some of the texts are not stored; every
    fifth value leads to a ring of seven references. Stored rows are there twice."""
    contents, doc = fx.values(spark, sf), F.col("arrival")
    named = F.lit("text/plain;resolve")

    def reference(digest: Column) -> Column:
        return X.blob_uri(named, digest)

    once = F.sha2(reference(F.col("digest")), 256)
    twice = F.sha2(reference(once), 256)
    ring = F.sha2(F.concat(F.lit("ring"), (doc % 7).cast("string")), 256)
    uri = F.when(doc % 5 == 0, reference(ring)).when(doc % 4 == 0, reference(F.col("digest"))).when(doc % 4 == 1, reference(once)).otherwise(reference(twice))
    asked = contents.select(doc.alias("id"), F.when(doc % 4 == 3, F.col("content")).otherwise(uri).alias("value"))
    base = contents.join(fx.known_blobs(spark, sf), "digest", "left_semi").groupBy("digest").agg(F.min("content").alias("content"))
    first = contents.select(once.alias("digest"), reference(F.col("digest")).alias("content"))
    second = contents.select(twice.alias("digest"), reference(once).alias("content"))
    rings = contents.select(
        ring.alias("digest"), reference(F.sha2(F.concat(F.lit("ring"), ((doc + 1) % 7).cast("string")), 256)).alias("content")
    )
    stored = reduce(DataFrame.unionByName, [base, base, first, second, rings])
    return blobs.resolve_nested(asked, stored).select("id", F.sha2("value", 256).alias("value_digest"), "outcome")


@query("""SELECT doc_id, replace(uri, ';resolve', '') AS base, contains(uri, ';resolve') AS resolve, 'text/plain' AS mime_type FROM uris""")
def uri_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.uris(spark, sf).select("doc_id", X.uri_attributes(F.col("uri")).alias("_uri")).select("doc_id", "_uri.*")


@query("SELECT arrival, digest FROM contents WHERE digest NOT IN (SELECT digest FROM known_blobs)")
def missing_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return blobs.missing_blobs(fx.values(spark, sf).select("arrival", "digest"), fx.known_blobs(spark, sf))


@query("""SELECT run_id, action, seq, lag(status) OVER (PARTITION BY run_id, action ORDER BY seq) AS from_status,
  status AS to_status FROM status_events""")
def status_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return logs.status_transitions(fx.status_events(spark, sf)).select(
        "run_id", "action", "seq", "from_status", "to_status"
    )


@query("""SELECT r.id AS run_id, a.updated_at AS ts, 'run' AS stream, 0::BIGINT AS seq, a.status, NULL::VARCHAR AS key,
    NULL::BIGINT AS action, NULL::VARCHAR AS message FROM runs r JOIN actions a ON a.id = r.root_action_id
  UNION ALL SELECT run_id, ts, 'status', seq, status, 'action/' || action, action, NULL FROM status_events WHERE action > 1
  UNION ALL SELECT run_id, arrival, 'task_log', row_number() OVER (PARTITION BY run_id ORDER BY arrival, ord), NULL,
    key, NULL, value FROM log_entries""")
def run_timeline(spark: SparkSession, sf: str) -> DataFrame:
    roots = fx.actions(spark, sf).select(F.col("id").alias("root_action_id"), "status", F.col("updated_at").alias("ts"))
    state = fx.runs(spark, sf).select(F.col("id").alias("run_id"), "root_action_id").join(roots, "root_action_id")
    events = fx.status_events(spark, sf).withColumn(
        "key", F.when(F.col("action") == 1, "status").otherwise(F.concat(F.lit("action/"), F.col("action").cast("string")))
    )
    lines = logs.assign_sequence(fx.log_entries(spark, sf), keys=["run_id"]).select(
        "run_id", F.col("arrival").alias("ts"), "seq", F.decode("key", "UTF-8").alias("key"),
        F.col("value").alias("message"),
    )
    return logs.run_timeline(state, events, lines)


_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@query(f"""WITH whole AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'error' ELSE role END AS source,
    string_split_regex(regexp_replace(text, '({_BREAK})$', ''), '{_BREAK}') AS parts FROM conversations)
 SELECT conv_id AS run_id, seq, line_no, CASE WHEN source = 'error' THEN 'warning' ELSE 'info' END AS level,
   rpad(source, 12, ' ') || '  ' || line AS line
 FROM (SELECT conv_id, turn AS seq, source, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM whole)""")
def render_run_log(spark: SparkSession, sf: str) -> DataFrame:
    said = source_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", "error").otherwise(F.col("role")).alias("source"),
        F.col("text").alias("message"),
    )
    return logs.render_run_log(said).select("run_id", "seq", "line_no", "level", "line")


@query("""WITH told AS (SELECT id AS action_id, run_id, caller_action_id, entrypoint_id, status, attempts,
    entrypoint_id = 3 AS hit FROM actions)
 SELECT run_id, action_id AS seq, p::BIGINT AS part, CASE source WHEN 'error' THEN 'warning' ELSE 'info' END AS level,
   rpad(source, 12, ' ') || '  ' || message AS line FROM (
  SELECT *, 0 AS p, 'cache' AS source, 'hit entrypoint=' || entrypoint_id || ' action=' || action_id AS message FROM told WHERE hit
  UNION ALL SELECT *, CASE WHEN hit THEN 1 ELSE 0 END, 'task', 'entrypoint=' || entrypoint_id || ' ' || status || ' action=' || action_id
    || ' parent=' || coalesce(caller_action_id::VARCHAR, '') || ' attempt=' || attempts FROM told
  UNION ALL SELECT *, CASE WHEN hit THEN 2 ELSE 1 END, 'error', 'entrypoint=' || entrypoint_id || ' action=' || action_id
    || ' attempt=' || attempts || ' | stopped' FROM told WHERE status IN ('queued', 'failed', 'canceled'))""")
def render_action_events(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.actions(spark, sf).select(
        "run_id", F.col("updated_at").alias("ts"), F.col("id").alias("seq"), F.col("id").alias("action_id"), "caller_action_id",
        "entrypoint_id", "status", F.col("attempts").alias("attempt"), F.lit("stopped").alias("error"),
        (F.col("entrypoint_id") == 3).alias("cache_hit"),
    )
    return logs.render_run_log(logs.action_messages(events)).select("run_id", "seq", "part", "level", "line")


@query("""WITH told AS (SELECT r.id AS run_id, r.root_action_id, a.entrypoint_id, e.namespace_id, e.version, a.status,
    printf('%.3f', (epoch_us(a.updated_at) - epoch_us(r.created_at)) / 1000000.0) AS elapsed
  FROM runs r JOIN actions a ON a.id = r.root_action_id JOIN environments e ON e.id = a.environment_id)
 SELECT run_id, 'info' AS level, rpad('deployment', 12, ' ') || '  entrypoint=' || entrypoint_id || ' namespace_id=' || namespace_id
   || ' version=' || version AS line FROM told
 UNION ALL SELECT run_id, 'info', rpad('root', 12, ' ') || '  action=' || root_action_id FROM told
 UNION ALL SELECT run_id, 'info', rpad('status', 12, ' ') || '  ' || status || ' elapsed=' || elapsed || 's' FROM told
 UNION ALL SELECT run_id, 'warning', rpad('error', 12, ' ') || '  root failed' FROM told WHERE status = 'failed'""")
def render_run_states(spark: SparkSession, sf: str) -> DataFrame:
    from taskledger.operators.runs import run_detail

    states = run_detail(fx.runs(spark, sf), fx.actions(spark, sf), fx.environments(spark, sf)).select(
        "run_id", F.col("updated_at").alias("ts"), F.lit(1).cast("long").alias("seq"), "entrypoint_id", "namespace_id", "version",
        "root_action_id", "status", F.when(F.col("status") == "failed", "root failed").alias("error"),
        F.col("run_created_at").alias("created_at"), "updated_at",
    )
    return logs.render_run_log(logs.run_messages(states)).select("run_id", "level", "line")


@query(f"""WITH named AS (SELECT conv_id AS run_id, turn, turn || '/state/' || role AS key FROM conversations)
  SELECT run_id, turn, key, turn || ':' || sha256(unhex({frame('key')} || {frame("run_id::VARCHAR")})) AS append_id FROM named""")
def checkpoint_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = X.checkpoint_key(F.col("turn"), "state", F.col("role"))
    return source_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), "turn", key.alias("key"),
        X.event_append_id(F.col("turn"), key, F.col("conv_id").cast("string")).alias("append_id"),
    )


@query("""WITH timed AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (epoch_us(ts) * 1000 + event_id % 1000) AS nanos FROM events)
  SELECT event_id, (nanos - (nanos % 1000 + 1000) % 1000) // 1000 AS micros FROM timed""")
def event_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of nanoseconds, some of them before 1970."""
    number = F.col("event_id")
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + number % 1000
    time = X.nanos_to_time(F.when(number % 3 == 0, -nanos).otherwise(nanos))
    return source_table(spark, sf, "events").select("event_id", F.unix_micros(time).alias("micros"))


# Streams ---------------------------------------------------------------------------------------------


def _live(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A file stream over one given table; the bracket makes it a glob, for a file as for a folder."""
    schema = source_table(spark, sf, table).schema
    return log_source_stream(spark, f"{sf}/{table}.parque[t]", schema)


def _places(spark: SparkSession, label: str) -> tuple[str, str]:
    return fresh_path(spark, label), fresh_path(spark, f"{label}-state")


def _live_records(spark: SparkSession, sf: str) -> DataFrame:
    """Committed records; the event id serves as the sequence number."""
    return fx.shape_log_entries(_live(spark, sf, "events")).select(
        "run_id", "stream", (F.col("ord") + 1).alias("seq"), "key", "value"
    )


@query("SELECT run_id, stream, ord, key, value FROM log_entries", name="log_source_stream")
def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    entries = fx.shape_log_entries(_live(spark, sf, "events")).select("run_id", "stream", "ord", "key", "value")
    return _text_key(live.run_to_end(entries, *_places(spark, "source")))


_CURSORS = """cursors AS (SELECT run_id, stream, min(ord) + 1 AS after_seq,
    CASE WHEN stream = 'signup' THEN '' ELSE 'k/1' END AS prefix FROM log_entries GROUP BY run_id, stream)"""


def _cursors(spark: SparkSession, sf: str) -> DataFrame:
    return fx.log_entries(spark, sf).groupBy("run_id", "stream").agg((F.min("ord") + 1).alias("after_seq")).withColumn(
        "prefix", F.when(F.col("stream") != "signup", F.lit(b"k/1"))
    )


@query(f"""WITH {_CURSORS} SELECT e.run_id, e.stream, e.ord + 1 AS seq, e.key, e.value FROM log_entries e
  JOIN cursors c USING (run_id, stream) WHERE e.ord + 1 > c.after_seq AND starts_with(e.key, c.prefix)""")
def tail_filtered(spark: SparkSession, sf: str) -> DataFrame:
    tail = live.tail_filtered(_live_records(spark, sf), _cursors(spark, sf))
    return _text_key(live.run_to_end(tail, *_places(spark, "tail")))


@query(f"""WITH {_CURSORS} SELECT e.run_id, e.stream, e.ord + 1 AS seq, e.key, e.value FROM log_entries e
  JOIN cursors c USING (run_id, stream) WHERE e.ord + 1 > c.after_seq AND starts_with(e.key, c.prefix)""")
def resume_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the events are there in a first run, the others arrive before the second, which goes on."""
    (path, checkpoint), source = _places(spark, "resume"), fresh_path(spark, "arriving")
    cursors, events = _cursors(spark, sf), source_table(spark, sf, "events")
    for half in (0, 1):
        events.filter(F.col("event_id") % 2 == half).write.parquet(f"{source}/half={half}")
        arriving = fx.shape_log_entries(log_source_stream(spark, f"{source}/*", events.schema))
        tail = arriving.select("run_id", "stream", (F.col("ord") + 1).alias("seq"), "key", "value")
        seen = live.resume_tail(tail, cursors, path, checkpoint)
    return _text_key(seen)


@query("""WITH ends AS (SELECT run_id, stream, (min(ord) + max(ord)) // 2 AS end_seq FROM log_entries GROUP BY ALL)
  SELECT e.run_id, e.stream, e.ord + 1 AS seq, e.key, e.value FROM log_entries e JOIN ends USING (run_id, stream)
  WHERE e.ord + 1 <= end_seq""")
def bounded_drain(spark: SparkSession, sf: str) -> DataFrame:
    ends = fx.log_entries(spark, sf).groupBy("run_id", "stream").agg(
        F.floor((F.min("ord") + F.max("ord")) / 2).alias("end_seq")
    )
    return _text_key(live.bounded_drain(_live_records(spark, sf), ends, *_places(spark, "drain")))


@query("""SELECT run_id, stream, ord, row_number() OVER (PARTITION BY run_id, stream ORDER BY arrival, ord) AS seq
  FROM log_entries""")
def stream_assign_sequence(spark: SparkSession, sf: str) -> DataFrame:
    target, checkpoint = _places(spark, "numbered")
    live.stream_assign_sequence(fx.shape_log_entries(_live(spark, sf, "events")), target, checkpoint).awaitTermination()
    return spark.read.parquet(f"{target}/records").select("run_id", "stream", "ord", "seq")


def _append(spark: SparkSession, sf: str, sink=live.append_log_sink) -> str:
    """Append the events attempt by attempt, so replays come after the first. All entries of a batch are in one file."""
    source, (target, checkpoint) = fresh_path(spark, "arriving"), _places(spark, "append")
    entries = fx.log_batches_in(spark, sf)
    schema = entries.schema
    parts = [r[0] for r in entries.select("attempt").distinct().orderBy("attempt").collect()]
    for part in parts:  # a handful of attempts
        entries.filter(F.col("attempt") == part).repartition("run_id", "stream", "append_id").write.parquet(f"{source}/part={part}")
        sink(log_source_stream(spark, f"{source}/*", schema), target, checkpoint).awaitTermination()
    return target


@query("""SELECT b.run_id, b.stream, d.first_seq + row_number() OVER
    (PARTITION BY b.run_id, b.stream, b.append_id ORDER BY b.ord) - 1 AS seq, b.key, b.value
  FROM log_batches_in b JOIN decided d USING (run_id, stream, append_id, attempt) WHERE d.outcome = 'appended'""")
def append_log_sink(spark: SparkSession, sf: str) -> DataFrame:
    records = spark.read.parquet(f"{_append(spark, sf)}/records")
    return _text_key(records.select("run_id", "stream", "seq", "key", "value"))


@query("SELECT run_id, stream, append_id, attempt - 1 AS epoch, outcome, first_seq, last_seq FROM decided")
def stream_append_dedup(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = spark.read.parquet(f"{_append(spark, sf, live.stream_append_dedup)}/outcomes")
    return outcomes.select("run_id", "stream", "append_id", F.col("epoch").cast("long"), "outcome", "first_seq", "last_seq")


@query("SELECT DISTINCT run_id, stream, append_id, ord FROM log_batches_in")
def drop_replays_within(spark: SparkSession, sf: str) -> DataFrame:
    entries = fx.shape_log_batches(fx.shape_log_entries(_live(spark, sf, "events"))).withColumn("at", F.col("arrival").cast("timestamp"))
    fresh = live.drop_replays_within(entries, "at", "400 days")
    return live.run_to_end(fresh.select("run_id", "stream", "append_id", "ord"), *_places(spark, "fresh"))


@query("""WITH closed AS (SELECT run_id, action, arg_min(status, seq) AS status, min(seq) AS seq FROM status_events
    WHERE status IN ('succeeded', 'failed', 'canceled') GROUP BY ALL),
 newest AS (SELECT run_id, action, arg_max(status, seq) AS status FROM status_events GROUP BY ALL)
 SELECT n.run_id, n.action, coalesce(c.status, n.status) AS status FROM newest n LEFT JOIN closed c USING (run_id, action)""")
def stream_run_status(spark: SparkSession, sf: str) -> DataFrame:
    target, checkpoint = _places(spark, "status")
    lines = _live(spark, sf, "lineitem")
    # A stream has no row numbers, so the order is spelled out as one sortable text.
    order = F.concat_ws(
        "/", F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_partkey").cast("string"), 19, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 19, "0"), F.format_string("%020.2f", "l_extendedprice"),
    )
    events = lines.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("action"), order.alias("seq"),
        fx._status().alias("status"),
    )
    live.stream_run_status(events, target, checkpoint).awaitTermination()
    return live.read_current(
        spark, target, "run_id bigint, action bigint, status string, seq string", ["run_id", "action"]
    ).drop("seq")


@query("SELECT run_id, name, arg_max(value, seq) AS value, max(seq) AS seq FROM checkpoints GROUP BY ALL")
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    target, checkpoint = _places(spark, "state")
    saved = _live(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("role").alias("name"), (F.col("turn") + 1).alias("seq"),
        F.col("text").alias("value"),
    )
    live.stream_latest_state(saved, target, checkpoint).awaitTermination()
    return live.read_current(
        spark, target, "run_id bigint, name string, value string, seq bigint", ["run_id", "name"]
    )
