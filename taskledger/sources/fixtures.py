"""The given tables seen as relations of a run platform (the mapping of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators.scale import running
from taskledger.sources.tables import source_table

AS_OF = "1999-06-01 00:00:00"
SPILL_OVER = 4096
NODES_PER_RUN = 1_000_000


def namespaces(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("slug"),
        F.col("n_name").alias("name"),
    )


def _setting_rows(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("namespace_id"),
        F.concat(F.lower("c_mktsegment"), F.lit("/k"), (F.col("c_custkey") % 20).cast("string")).alias("path"),
        F.col("c_acctbal").alias("value"),
        F.col("c_custkey").alias("version"),
    )


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (namespace, path): the highest customer key with a balance of zero or more."""
    from taskledger.operators.tables import latest_per_key

    return latest_per_key(
        _setting_rows(spark, sf).filter("value >= 0"), ["namespace_id", "path"], ["version"]
    )


def setting_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _setting_rows(spark, sf).filter("value < 0")


def environments(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").cast("long").alias("namespace_id"),
        F.concat(F.lit("env-"), (F.col("s_suppkey") % 40).cast("string")).alias("name"),
        F.sha2(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")), 256).alias("version"),
        F.element_at(F.array(F.lit("local"), F.lit("docker"), F.lit("e2b")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias(
            "provider"
        ),
        F.floor(F.col("s_suppkey") / 10).alias("submission"),
    )


def environment_deps(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.col("id") % 10
    near = F.when(rank >= 2, F.array(F.col("id") - 1, F.col("id") - 2)).when(
        rank >= 1, F.array(F.col("id") - 1)
    )
    return environments(spark, sf).select("submission", "id", F.explode(near).alias("dependency_id"))


def actions(spark: SparkSession, sf: str) -> DataFrame:
    lines = running(
        source_table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
            "l_quantity", "l_returnflag", "l_linestatus",
        ),
        ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
        count="pos",
    )
    base = F.col("l_orderkey") * NODES_PER_RUN
    hours = F.make_dt_interval(hours=F.col("l_quantity").cast("int"))
    days = F.make_dt_interval(days=F.col("l_linenumber"))
    return (
        lines.withColumn("status", _status())
        .select(
            (base + F.col("pos")).alias("id"),
            F.col("l_orderkey").alias("run_id"),
            F.when(F.col("pos") > 1, base + F.floor(F.col("pos") / 2)).alias("caller_action_id"),
            F.col("l_suppkey").alias("environment_id"),
            F.col("l_linenumber").cast("long").alias("entrypoint_id"),
            "status",
            F.col("l_linenumber").cast("long").alias("attempts"),
            (F.col("l_partkey") % 4).alias("failures"),
            (1 + F.col("l_partkey") % 3).alias("max_attempts"),
            F.when(
                (F.col("status") == "queued") & (F.col("l_partkey") % 2 == 0), F.col("l_shipdate") + days
            ).alias("next_attempt_at"),
            F.col("l_shipdate").alias("created_at"),
            (F.col("l_shipdate") + hours).alias("updated_at"),
            "pos",
        )
    )


def _status():
    open_status = F.element_at(
        F.array(F.lit("running"), F.lit("waiting"), F.lit("queued")), (F.col("l_partkey") % 3 + 1).cast("int")
    )
    return (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_returnflag") == "A", "canceled")
        .when(F.col("l_linestatus") == "F", "succeeded")
        .otherwise(open_status)
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    rooted = (
        source_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
        .withColumn("_has_lines", F.lit(True))
    )
    claimed = key % 3 != 0
    return (
        source_table(spark, sf, "orders").join(rooted, "o_orderkey", "left").select(
            key.alias("id"),
            (F.col("o_custkey") % 25).alias("namespace_id"),
            F.when(claimed, F.concat(F.lit("w"), (key % 7).cast("string"))).alias("claim_token"),
            F.when(
                claimed, F.col("o_orderdate") + F.make_dt_interval(days=(key % 61).cast("int"))
            ).alias("lease_until"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("_has_lines"), key * NODES_PER_RUN + 1).alias("root_action_id"),
        )
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return actions(spark, sf).filter("caller_action_id IS NOT NULL").select(
        "run_id", F.col("id").alias("source_action_id"), F.col("caller_action_id").alias("dependent_action_id")
    )


def prereqs(spark: SparkSession, sf: str) -> DataFrame:
    return actions(spark, sf).filter("pos >= 3").select(
        "run_id", "id", (F.col("id") - 2).alias("prerequisite_id")
    )


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    lines = source_table(spark, sf, "lineitem").withColumn("status", _status())
    return running(
        lines.select(
            F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("action"),
            "status", F.col("l_shipdate").alias("ts"), "l_partkey", "l_suppkey", "l_extendedprice",
        ),
        ["run_id", "action"],
        ["ts", "l_partkey", "l_suppkey", "l_extendedprice"],
        count="seq",
    ).select("run_id", "action", "seq", "status", "ts")


def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    return shape_log_entries(source_table(spark, sf, "events"))


def shape_log_entries(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stream"),
        F.col("ts").alias("arrival"),
        F.col("event_id").alias("ord"),
        F.encode(F.concat(F.lit("k/"), F.get_json_object("props", "$.k")), "UTF-8").alias("key"),
        F.col("event_id").cast("string").alias("value"),
    )


def log_records(spark: SparkSession, sf: str) -> DataFrame:
    from taskledger.operators.logs import assign_sequence

    return assign_sequence(log_entries(spark, sf)).select(
        "run_id", "stream", "seq", "key", "value", F.col("arrival").alias("created_at")
    )


def log_batches_in(spark: SparkSession, sf: str) -> DataFrame:
    """Batch entries by week; purchase batches are sent twice, error batches again with other values."""
    return shape_log_batches(log_entries(spark, sf))


def shape_log_batches(entries: DataFrame) -> DataFrame:
    week = F.extract(F.lit("YEAROFWEEK"), "arrival") * 100 + F.extract(F.lit("WEEK"), "arrival")
    base = entries.withColumn("append_id", week.cast("string"))
    again = base.filter(F.col("stream").isin("purchase", "error")).withColumn(
        "value", F.when(F.col("stream") == "error", F.concat("value", F.lit("+"))).otherwise(F.col("value"))
    )
    return base.withColumn("attempt", F.lit(1).cast("long")).unionByName(
        again.withColumn("attempt", F.lit(2).cast("long"))
    )


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("role").alias("name"),
        (F.col("turn") + 1).alias("seq"), F.col("text").alias("value"),
    )


def task_lines(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("action"), F.lit(1).cast("long").alias("attempt"),
        F.posexplode(F.split("text", "\n")).alias("ord", "line"),
    )


def image_builds(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return source_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("image_key"),
        F.when(status == "F", "ready").when(status == "O", "failed").otherwise("building").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(30))).alias("lease_until"),
        F.when(status == "F", F.concat(F.lit("image:"), F.col("o_orderkey").cast("string")))
        .otherwise("").alias("artifact_uri"),
    )


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return source_table(spark, sf, "orders").select(
        key.alias("session"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"),
        F.concat(F.lit("obj-"), key.cast("string")).alias("object_key"),
        (F.col("o_custkey") * 100000).alias("size"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(24))).alias("expires_at"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("scope"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("@"), F.year("o_orderdate").cast("string")).alias("key"),
        F.col("o_orderpriority").alias("payload"),
        F.col("o_orderkey").alias("arrival"),
    )


def values(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "documents").select(
        F.col("doc_id").alias("arrival"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("digest"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit("text/plain").alias("mime_type"),
    )


def known_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that have a label are stored; the object is named after the first of them."""
    labelled = source_table(spark, sf, "labels").select(F.col("doc_id").alias("arrival"))
    return (
        values(spark, sf).join(labelled, "arrival", "left_semi").groupBy("digest")
        .agg(F.min("arrival").alias("object_id"))
        .select("digest", F.concat(F.lit("blobs/"), F.col("object_id").cast("string")).alias("object_key"))
    )


def uris(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("arrival")
    name = F.base64(F.unhex("digest"))
    return values(spark, sf).select(
        doc.alias("doc_id"),
        F.concat(
            F.when(doc % 13 == 0, "data:").otherwise("blob:"),
            F.lit("text/plain"),
            F.when(doc % 7 == 0, ";resolve").otherwise(""),
            F.lit(","),
            F.when(doc % 11 == 0, F.substring(name, 1, 43)).otherwise(name),
        ).alias("uri"),
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = source_table(spark, sf, "documents").select(
        F.col("source").alias("archive"), "doc_id", F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("sha"),
    )
    doc = F.col("doc_id")
    return running(docs, ["archive"], ["doc_id"], sums={"_end": "size"}).select(
        "archive", "doc_id",
        F.concat(F.when(doc % 89 == 0, "../").otherwise("docs/"), doc.cast("string")).alias("name"),
        F.lit("reg").alias("kind"),
        "size",
        F.when(doc % 97 == 0, F.col("_end") - F.col("size") - 1)
        .otherwise(F.col("_end") - F.col("size")).alias("start"),
        F.col("_end").alias("end"),
        F.concat(F.lit("sha256:"), F.col("sha")).alias("digest"),
        F.lit("").alias("link"),
    )


def memo_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return source_table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size")
    )


def as_of():
    return X.as_ntz(AS_OF)
