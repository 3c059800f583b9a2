"""Validation queries; the given tables are read as rows with some faults in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators import blobs
from taskledger.operators import quality as ops
from taskledger.plans.registry import query
from taskledger.plans.relations import frame
from taskledger.session import fresh_path, written
from taskledger.sources import fixtures as fx
from taskledger.sources.tables import blob_source, source_table


def rules_sql(source: str, keys: str, rules: dict[str, str]) -> str:
    """One branch per rule: the rows of `source` that break it."""
    return "\nUNION ALL ".join(
        f"SELECT {keys}, '{name}' AS rule, '' AS detail FROM {source} WHERE {bad}" for name, bad in rules.items()
    )


@query(rules_sql("log_batches_in", "ord, attempt", {
    "key size": "octet_length(encode(key)) > 4", "record size": "octet_length(encode(key)) + octet_length(encode(value)) > 7",
    "batch size": "(run_id, stream, append_id) IN (SELECT (run_id, stream, append_id) FROM log_batches_in GROUP BY run_id, "
    "stream, append_id HAVING sum(octet_length(encode(key)) + octet_length(encode(value))) > 60)",
    "stream name": "NOT regexp_full_match(stream, '[a-zA-Z_][a-zA-Z0-9_.-]{0,127}')",
}))
def validate_log_entries(spark: SparkSession, sf: str) -> DataFrame:
    return ops.validate_log_entries(
        fx.log_batches_in(spark, sf), ["ord", "attempt"], max_key=4, max_record=7, max_batch=60
    )


def _uuid(number) -> object:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


_TASK_LOGS = """WITH events_in AS (SELECT conv_id, turn, role, turn + 25 AS day FROM conversations) """


@query(_TASK_LOGS + rules_sql("events_in", "conv_id, turn", {
    "source": "role <> 'assistant'", "action id": "role = 'system'", "attempt": "turn <= 0", "timestamp": "day > 29",
}))
def validate_task_logs(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lpad((F.col("turn") + 25).cast("string"), 2, "0")
    said = source_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lit("task.log.v1").alias("type"),
        F.when(F.col("role") == "assistant", "stderr").otherwise("stdout").alias("source"),
        F.when(F.col("role") == "system", F.lit("system")).otherwise(_uuid(F.col("conv_id"))).alias("action_id"),
        F.col("turn").alias("attempt"),
        F.concat(F.lit("2024-02-"), day, F.lit("T08:00:00.123456789+01:00")).alias("timestamp"),
    )
    return ops.validate_task_logs(said, ["conv_id", "turn"])


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(rules_sql("lineitem", _LINE, {
    "status": "l_returnflag = 'N'", "action id": "l_linenumber = 7", "caller id": "l_linenumber = 6",
    "updated at": "l_linestatus = 'O' AND l_linenumber = 5", "type": "l_linenumber = 4",
}))
def validate_status_events(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    events = source_table(spark, sf, "lineitem").select(
        *_LINE.split(", "),
        F.when(line == 4, "task.status.v0").otherwise("task.status.v1").alias("type"),
        F.when(F.col("l_returnflag") == "N", "done").otherwise("failed").alias("status"),
        F.when(line == 7, F.lit("")).otherwise(_uuid(F.col("l_orderkey"))).alias("action_id"),
        F.when(line == 6, F.lit("caller")).otherwise("").alias("caller_action_id"),
        F.concat(
            F.date_format("l_shipdate", "yyyy-MM-dd"),
            F.when((F.col("l_linestatus") == "O") & (line == 5), " 25:00:00Z").otherwise("T00:00:00.5Z"),
        ).alias("updated_at"),
    )
    return ops.validate_status_events(events, _LINE.split(", "))


@query(rules_sql("part", "p_partkey", {
    "uncached with cache fields": "p_type NOT IN ('ECONOMY', 'STANDARD') AND p_size < 5",
    "cache fields": "p_type IN ('ECONOMY', 'STANDARD') AND (p_size < 10 OR p_brand = 'Brand#3')",
    "cache policy": "(p_type = 'STANDARD') OR (p_type NOT IN ('ECONOMY', 'STANDARD') AND p_size < 5)",
    "attempts": "p_partkey % 200 = 0 OR p_partkey % 200 > 100",
    "idempotency key missing": "p_brand = 'Brand#4'",
}))
def validate_actions(spark: SparkSession, sf: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size")
    cached = kind.isin("ECONOMY", "STANDARD")
    version = F.when(cached, F.concat(F.when(size < 10, "01.").otherwise("1."), size.cast("string"), F.lit(".0-rc.1"))).when(
        size < 5, "2.0.0"
    )
    asked = source_table(spark, sf, "part").select(
        "p_partkey", cached.alias("cache"), version.alias("task_version"),
        F.when(cached, F.when(F.col("p_brand") == "Brand#3", "ab").otherwise(F.sha2("p_name", 256))).alias("cache_key"),
        (kind == "ECONOMY").alias("entry_cache"), F.when(cached, version).alias("entry_version"),
        F.lit(0).alias("max_attempts"), (F.col("p_partkey") % 200).alias("entry_max_attempts"),
        F.when(F.col("p_brand") != "Brand#4", F.col("p_name")).alias("idempotency_key"), F.lit(True).alias("is_child"),
    )
    return ops.validate_actions(asked, ["p_partkey"])


@query("WITH declared AS (SELECT *, s_suppkey AS k, s_nationkey % 4 AS p FROM supplier) " + rules_sql("declared", "k", {
    "name": "s_acctbal < 0", "source": "k % 9 = 0", "provider": "p = 3", "local reference": "p = 0 AND s_acctbal >= 1000",
    "build context": "p = 0 AND k % 9 = 0", "workdir": "p = 0 AND k % 5 IN (0, 1, 3)",
    "reference missing": "p IN (1, 2) AND s_acctbal < 1000",
    "resources": "s_acctbal < 0 OR round(s_acctbal * 200) > 1000000 OR k > 64",
    "environment variable": "k % 6 = 0", "dependencies": "k % 10 >= 5",
    "entrypoint": "k = 0 OR k > 100 OR (k % 2 = 1 AND k % 7 = 0) OR (k % 2 = 0 AND k % 7 = 0)",
}))
def validate_environments(spark: SparkSession, sf: str) -> DataFrame:
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    provider = F.element_at(
        F.array(*[F.lit(p) for p in (*ops.PROVIDERS, "podman")]), (F.col("s_nationkey") % 4 + 1).cast("int")
    )
    digest = F.sha2("s_name", 256)
    source = X.blob_uri(F.when(k % 9 == 0, "text/plain").otherwise(ops.ARCHIVE_MIME), digest)
    workdir = F.element_at(F.array(*[F.lit(p) for p in ("../x", "a//b", "a/b", "", ".")]), (k % 5 + 1).cast("int"))
    space = F.col("s_nationkey").cast("string")
    dep = F.struct(space.alias("namespace_id"), F.lit("env-1").alias("name"), digest.alias("version"))
    no_deps = F.array().cast("array<struct<namespace_id:string,name:string,version:string>>")
    version = (
        F.when((k % 2 == 0) & (k % 7 == 0), "1.0").when(k % 2 == 0, F.concat(F.lit("1."), k.cast("string"), F.lit(".0")))
        .when(k % 7 == 0, "1.0.0").otherwise("")
    )
    declared = source_table(spark, sf, "supplier").select(
        k.alias("k"), space.alias("namespace_id"),
        F.when(balance < 0, F.col("s_name")).otherwise(F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))).alias("name"),
        source.alias("source_uri"), provider.alias("provider"),
        F.when(balance >= 1000, F.concat(F.lit("image:"), k.cast("string"))).alias("reference"),
        source.alias("build_context_uri"), F.array(F.lit("make"), F.lit("all")).alias("build_command"),
        workdir.alias("workdir"), F.round(balance * 200).cast("long").alias("cpu_millis"),
        (k * F.lit(2**44)).alias("memory_bytes"),
        F.when(k % 6 == 0, F.create_map(F.lit("PATH"), F.lit("/bin"))).otherwise(
            F.create_map(F.concat(F.lit("VAR_"), k.cast("string")), F.col("s_name"))
        ).alias("env_vars"),
        F.when(k % 10 >= 5, F.array(dep, dep)).when(k % 10 >= 1, F.array(dep)).otherwise(no_deps).alias("dependencies"),
        F.array(F.struct(
            F.array(F.lit("python"), F.col("s_name")).alias("command"), (k % 2 == 0).alias("cache"),
            version.alias("task_version"), k.alias("max_attempts"),
        )).alias("entrypoints"),
    )
    return ops.validate_environments(declared, ["k"])


def _f(expr: str) -> str:
    return frame(f"({expr})::VARCHAR")


_EMPTY = "''"
_CANONICAL = " || ".join([
    _f("s_nationkey"), _f("name"), _f("uri"), _f("'docker'"), _f("reference"), _f("cpu"), _f("memory"),
    _f("2"), _f("'A_' || k"), _f("s_name"), _f("'B'"), _f(_EMPTY), _f(_EMPTY), _f("0"), _f(_EMPTY),
    _f("2"), _f("'env-1'"), _f("s_nationkey"), _f("digest"), _f("'env-2'"), _f("s_nationkey"), _f("digest"),
    _f("1"), _f("2"), _f("'python'"), _f("s_name"), _f("k % 3"), _f("'false'"), _f(_EMPTY),
])


@query(f"""WITH declared AS (SELECT *, s_suppkey AS k, lower(s_name) AS name, sha256(s_name) AS digest,
    'blob:{ops.ARCHIVE_MIME},' || to_base64(unhex(sha256(s_name))) AS uri, CASE WHEN s_acctbal >= 0 THEN 'image:' || s_suppkey ELSE '' END AS reference,
    CASE WHEN s_suppkey % 4 = 0 THEN 1000 ELSE s_suppkey % 4 END AS cpu, CASE WHEN s_suppkey % 5 = 0 THEN 1073741824 ELSE s_suppkey % 5 END AS memory FROM supplier)
  SELECT k, sha256(unhex({_CANONICAL})) AS version, 1 AS versions, 2 AS spellings FROM declared""")
def canonical_environment(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier as an environment in two spellings: variables and dependencies in another order, defaults given or not."""
    k, space, digest = F.col("s_suppkey"), F.col("s_nationkey").cast("string"), F.sha2("s_name", 256)
    deps = [F.struct(space.alias("namespace_id"), F.lit(f"env-{i}").alias("name"), digest.alias("version")) for i in (1, 2)]
    a, b = (F.concat(F.lit("A_"), k.cast("string")), F.col("s_name")), (F.lit("B"), F.lit(""))
    entry = F.struct(F.array(F.lit("python"), F.col("s_name")).alias("command"), F.lit(None).cast("boolean").alias("cache"),
                     F.lit(None).cast("string").alias("task_version"), (k % 3).alias("max_attempts"))
    source = X.blob_uri(F.lit(ops.ARCHIVE_MIME), digest)

    def spelled(first: bool) -> DataFrame:
        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        reference = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("image:"), k.cast("string")))
        cpu, memory = k % 4, k % 5
        return source_table(spark, sf, "supplier").select(
            k.alias("k"), space.alias("namespace_id"), F.lower("s_name").alias("name"), source.alias("source_uri"), F.lit("docker").alias("provider"),
            (reference if first else F.coalesce(reference, F.lit(""))).alias("reference"), (none if first else F.lit("")).alias("build_context_uri"),
            (F.lit(None).cast("array<string>") if first else F.array().cast("array<string>")).alias("build_command"), (none if first else F.lit("")).alias("workdir"),
            (F.nullif(cpu, zero) if first else F.when(cpu == 0, ops.DEFAULT_CPU).otherwise(cpu)).alias("cpu_millis"),
            (memory if first else F.when(memory == 0, ops.DEFAULT_MEMORY).otherwise(memory)).cast("long").alias("memory_bytes"),
            (F.create_map(*a, *b) if first else F.create_map(*b, *a)).alias("env_vars"), F.array(*(deps if first else reversed(deps))).alias("dependencies"),
            F.array(entry).alias("entrypoints"),
        )

    both = spelled(True).unionByName(spelled(False))
    return ops.canonical_environment(both).groupBy("k").agg(
        F.min("version").alias("version"), F.count_distinct("version").cast("int").alias("versions"), F.count(F.lit(1)).cast("int").alias("spellings"),
    )


@query("""WITH listed AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer) """ + rules_sql("listed", "c_custkey", {
    "slug": "true", "path": "c_mktsegment = 'BUILDING'", "value size": "c_acctbal < 0", "name": "c_mktsegment = 'MACHINERY'",
}))
def validate_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Nation names are no slugs before their underscore is replaced."""
    segment = F.col("c_mktsegment")
    nations = source_table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("slug"))
    listed = source_table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "slug", F.when(segment == "MACHINERY", "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(segment == "BUILDING", F.concat(F.lower(segment), F.lit("//k"))).otherwise(
            F.concat(F.lower(segment), F.lit("/k_1/x-2"))
        ).alias("path"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).alias("value"),
    )
    return ops.validate_settings(listed, ["c_custkey"])


@query("""SELECT doc_id, uri, CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN digest END AS digest,
  CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN 'text/plain' END AS mime_type,
  CASE WHEN doc_id % 13 <> 0 AND doc_id % 11 <> 0 THEN doc_id % 7 = 0 END AS resolve,
  CASE WHEN doc_id % 13 = 0 THEN 'not a blob URI' WHEN doc_id % 11 = 0 THEN 'invalid digest' ELSE 'ok' END AS verdict
  FROM uris""")
def validate_blob_uris(spark: SparkSession, sf: str) -> DataFrame:
    return blobs.validate_blob_uris(fx.uris(spark, sf))


@query(rules_sql("documents", "doc_id", {
    "digest": "lang = 'de'", "size": "n_chars * 50000000 > 83886080000", "mime type": "lang = 'fr'",
    "metadata entry": "lang = 'es'", "metadata size": "false",
}))
def validate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    sent = source_table(spark, sf, "documents").select(
        "doc_id", F.when(lang == "de", F.substring(F.sha2("text", 256), 1, 63)).otherwise(F.sha2("text", 256)).alias("sha256"),
        (F.col("n_chars") * 50000000).alias("size"),
        F.when(lang == "fr", "text plain").otherwise("text/plain; charset=utf-8").alias("mime_type"),
        F.create_map(F.when(lang == "es", "Source").otherwise("source"), F.col("source")).alias("metadata"),
    )
    return ops.validate_uploads(sent, ["doc_id"])


@query("SELECT archive, doc_id, name, start, \"end\", previous_end FROM overlap_rows")
def range_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return ops.range_overlaps(fx.manifest(spark, sf)).select("archive", "doc_id", "name", "start", "end", "previous_end")


@query(rules_sql("manifest", "archive, doc_id", {
    "path": "doc_id % 89 = 0", "offset": "start < 0",
    "entry count": "archive IN (SELECT archive FROM manifest GROUP BY archive HAVING count(*) > 100000)",
    "archive size": "archive IN (SELECT archive FROM manifest GROUP BY archive HAVING sum(size) > 2147483648)",
}) + " UNION ALL SELECT archive, doc_id, 'overlap', '' FROM overlap_rows")
def validate_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return ops.validate_manifest(fx.manifest(spark, sf))


@query("""SELECT arrival, CASE WHEN size > 20000 THEN 'too large' WHEN lang = 'fr' AND lower(content) <> content THEN 'mismatch'
  ELSE 'ok' END AS verdict FROM contents JOIN documents ON doc_id = arrival""")
def verify_digests(spark: SparkSession, sf: str) -> DataFrame:
    """French texts have the digest of their lower-case form on record."""
    docs = source_table(spark, sf, "documents").select(
        F.col("doc_id").alias("arrival"), F.col("text").alias("content"),
        F.sha2(F.when(F.col("lang") == "fr", F.lower("text")).otherwise(F.col("text")), 256).alias("digest"),
    )
    return blobs.verify_digests(docs, max_size=20000).select("arrival", "verdict")


@query("""WITH bad AS (SELECT doc_id FROM manifest WHERE doc_id % 89 = 0 OR start < 0 UNION SELECT doc_id FROM overlap_rows
    UNION SELECT doc_id FROM manifest WHERE archive IN (SELECT archive FROM manifest GROUP BY archive HAVING count(*) > 100000 OR sum(size) > 2147483648))
  SELECT archive, count(*) FILTER (doc_id NOT IN (FROM bad)) AS good, count(*) FILTER (doc_id IN (FROM bad)) AS quarantined
  FROM manifest GROUP BY archive""")
def split_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each archive that pass and that are set aside."""
    entries = fx.manifest(spark, sf)
    found = ops.validate_manifest(entries)
    good, bad = ops.split_valid(entries, found, ["archive", "doc_id"])
    marked = good.select("archive", F.lit(1).alias("ok")).unionByName(bad.select("archive", F.lit(0).alias("ok")))
    return marked.groupBy("archive").agg(
        F.sum("ok").alias("good"), F.sum(1 - F.col("ok")).alias("quarantined")
    )


@query("""SELECT s_suppkey AS id, sha256(s_suppkey || ' ' || s_name || chr(10)) AS digest,
    octet_length(encode(s_suppkey || ' ' || s_name)) + 1 AS size, 'text/plain' AS mime_type FROM supplier
  UNION ALL SELECT NULL, sha256(''), 0, 'text/plain'""", name="blob_source")
def blob_source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers written as one text file each in one folder, and a file without content, read back as content-addressed
    rows."""
    folder = fresh_path(spark, "files")
    lines = source_table(spark, sf, "supplier").select(F.concat_ws(" ", "s_suppkey", "s_name").alias("line"))
    writers = 1 + lines.count() // 1000  # a file each is slow work for one task
    lines.repartition(writers).write.option("maxRecordsPerFile", 1).text(f"{folder}/names")
    lines.limit(0).write.text(f"{folder}/none")
    found = blob_source(spark, f"{folder}/*/*.txt")
    number = F.nullif(F.regexp_extract(F.col("content").cast("string"), "^([0-9]+) ", 1), F.lit(""))
    return found.select(number.cast("long").alias("id"), "digest", "size", "mime_type")
