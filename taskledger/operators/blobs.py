"""Content-addressed values: lookup, dangling references, digest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskledger.functions import expr as X
from taskledger.operators.graph import follow
from taskledger.session import written


def _stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def parse_blob_uri(uri: Column) -> Column:
    """Struct of digest (hex), mime_type, resolve and verdict for `blob:<mime>[;resolve],<base64>`."""
    after = F.substring(uri, 6, 2**31 - 1)
    has_comma = F.instr(after, ",") > 0
    head = F.substring_index(after, ",", 1)
    name = F.substring(after, F.length(head) + 2, F.lit(2**31 - 1))
    # the short flag goes first, then the long one: only one of each can stand there, in this order from the end
    short = F.regexp_replace(head, r";resolve\z", "")
    mime = F.regexp_replace(short, r";resolve=true\z", "")
    flag = mime != head
    raw = F.try_to_binary(name, F.lit("base64"))
    canonical = F.coalesce((F.octet_length(raw) == 32) & (F.base64(raw) == name), F.lit(False))
    verdict = (
        F.when(~F.coalesce(uri.startswith("blob:"), F.lit(False)), "not a blob URI")
        .when(~has_comma | (_stripped(head) == ""), "no mime type or digest")
        .when(~canonical, "invalid digest")
        .when(~X.matches(_stripped(mime), X.MIME_TYPE), "invalid mime type")
        .otherwise("ok")
    )
    ok = verdict == "ok"
    return F.struct(
        F.when(ok, F.lower(F.hex(raw))).alias("digest"),
        F.when(ok, mime).alias("mime_type"),
        F.when(ok, flag).alias("resolve"),
        verdict.alias("verdict"),
    )


def validate_blob_uris(df: DataFrame, uri: str = "uri") -> DataFrame:
    return df.withColumn("_uri", parse_blob_uri(F.col(uri))).select(*df.columns, "_uri.*")


def missing_blobs(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """References whose digest is not stored."""
    return refs.join(blobs.select("digest"), "digest", "left_anti")


def resolve_blobs(records: DataFrame, blobs: DataFrame, wanted: list[str]) -> DataFrame:
    """Fill `wanted` blob columns for records with a value_uri; `availability` tells inline, stored or
    unavailable (dangling or malformed)."""
    linked = records.withColumn("_uri", parse_blob_uri(F.col("value_uri"))).withColumn(
        "digest", F.col("_uri.digest")
    ).drop("_uri")
    stored = blobs.select("digest", *wanted, F.lit(True).alias("_stored"))
    # rows without a digest have nothing to look up; in the join they would all share one null key
    found = linked.filter(F.col("digest").isNotNull()).join(stored, "digest", "left")
    kinds = {name: blobs.schema[name].dataType for name in wanted}
    unlinked = linked.filter(F.col("digest").isNull()).withColumns(
        {name: F.lit(None).cast(kind) for name, kind in kinds.items()} | {"_stored": F.lit(None).cast("boolean")}
    )
    return found.unionByName(unlinked).withColumn(
        "availability",
        F.when(F.col("value_uri").isNull(), "inline").when(F.col("_stored"), "stored").otherwise("unavailable"),
    ).drop("_stored")


def resolve_nested(values: DataFrame, blobs: DataFrame) -> DataFrame:
    """Follow values that are references to content, which may be a reference itself, to any depth.

    `values`: id, value. `blobs`: digest, content; a digest that is there more than once counts once. A reference is a
    blob URI with the resolve flag. Chains are followed between distinct digests by pointer doubling, so each is looked at
    once however many values lead to it, and rounds grow with the logarithm of the longest chain. `outcome` is `plain`,
    `resolved`, `missing` (a digest on the way is not stored) or `cycle`; the last two keep their value.
    """
    def target(value: str) -> Column:
        uri = parse_blob_uri(F.col(value))
        return F.when(F.startswith(F.col(value).cast("string"), F.lit("blob:")) & uri["resolve"], uri["digest"])

    stored = written(blobs.select("digest", target("content").alias("up")).dropDuplicates(["digest"]), "references")
    ends = follow(stored.filter("up IS NOT NULL").select(F.lit(0).alias("run_id"), F.col("digest").alias("id"), "up")).select(
        F.col("id").alias("digest"), "top", F.lit(True).alias("_onward")
    )
    asked = values.withColumn("digest", target("value"))
    # plain values have nothing to look up; in the join they would all share one null key
    plain = asked.filter("digest IS NULL").withColumn("outcome", F.lit("plain")).drop("digest")
    led = asked.filter("digest IS NOT NULL").join(ends, "digest", "left").withColumn(
        "_end", F.when(F.col("_onward"), F.col("top")).otherwise(F.col("digest"))
    )
    endless = led.filter("_end IS NULL").select(*values.columns, F.lit("cycle").alias("outcome"))
    content = blobs.dropDuplicates(["digest"]).select(F.col("digest").alias("_end"), F.col("content").alias("_content"), F.lit(True).alias("_there"))
    found = led.filter("_end IS NOT NULL").join(content, "_end", "left")
    kept = [F.when(F.col("_there"), F.col("_content")).otherwise(F.col(c)).alias(c) if c == "value" else F.col(c) for c in values.columns]
    settled = found.select(*kept, F.when(F.col("_there"), "resolved").otherwise("missing").alias("outcome"))
    return plain.unionByName(endless).unionByName(settled)


def verify_digests(
    df: DataFrame, content: str = "content", digest: str = "digest", max_size: int = X.MAX_RECORD
) -> DataFrame:
    """Recompute SHA-256 and compare; `verdict` is ok, mismatch or too large."""
    return df.withColumn(
        "verdict",
        F.when(X.byte_length(F.col(content)) > max_size, "too large")
        .when(F.sha2(F.col(content).cast("binary"), 256) == F.lower(digest), "ok")
        .otherwise("mismatch"),
    )
