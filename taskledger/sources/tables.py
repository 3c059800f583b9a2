"""Typed relations of a run platform and the readers over them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names and types of the stored relations.
SCHEMAS: dict[str, str] = {
    "blobs": "sha256 string, object_key string",
    "blob_uploads": "session_id string, sha256 string, object_key string, size bigint, mime_type string, "
    "metadata map<string,string>, multipart_id string, created_at timestamp, expires_at timestamp",
    "namespaces": "id string, slug string, name string, created_at timestamp",
    "settings": "namespace_id string, path string, value string, updated_at timestamp",
    "task_environments": "id string, namespace_id string, name string, version string, provider string, "
    "spec struct<source_uri:string, image:struct<name:string, reference:string, cpu_millis:bigint, "
    "memory_bytes:decimal(20,0), env_vars:map<string,string>, build_context_uri:string, "
    "build_command:array<string>, workdir:string>, "
    "dependencies:array<struct<namespace_id:string, name:string, version:string>>, "
    "entrypoints:array<struct<command:array<string>, max_attempts:int, cache:boolean, "
    "task_version:string>>>, image_key string, created_at timestamp",
    "image_builds": "id string, image_key string, status string, claim_token string, "
    "lease_until timestamp, artifact_uri string, error string, created_at timestamp",
    "task_cache": "cache_key string, status string, claim_token string, lease_until timestamp, "
    "output string, error_code string, error_details string, created_at timestamp, updated_at timestamp",
    "runs": "id string, namespace_id string, root_idempotency_key string, claim_token string, "
    "lease_until timestamp, attempts int, created_at timestamp, root_action_id string",
    "task_actions": "id string, run_id string, caller_action_id string, environment_id string, "
    "entrypoint_id bigint, action_spec string, output string, status string, error string, attempts int, "
    "failures int, next_attempt_at timestamp, idempotency_key string, created_at timestamp, "
    "updated_at timestamp",
    "task_action_edges": "run_id string, source_action_id string, dependent_action_id string",
    "run_log_streams": "run_id string, stream string, next_seq bigint, created_at timestamp, "
    "updated_at timestamp",
    "run_log_appends": "run_id string, stream string, append_id string, batch_digest string, "
    "first_seq bigint, last_seq bigint, created_at timestamp",
    "run_log_records": "run_id string, stream string, seq bigint, key binary, value string, "
    "value_uri string, payload_size bigint, created_at timestamp",
}


def load_tables(
    spark: SparkSession, folder: str, names: Iterable[str] | None = None, views: bool = False
) -> dict[str, DataFrame]:
    """Each relation below `folder` (one Parquet folder or file per relation), without schema inference."""
    found = {}
    for name in names or SCHEMAS:
        schema = StructType.fromDDL(SCHEMAS[name])
        found[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
        if views:
            found[name].createOrReplaceTempView(name)
    return found


def source_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_source_batch(
    records: DataFrame, run_id: object = None, streams: Sequence[str] | None = None
) -> DataFrame:
    """Records of one run and/or some streams; both predicates reach the Parquet scan."""
    if run_id is not None:
        records = records.filter(F.col("run_id") == run_id)
    if streams is not None:
        records = records.filter(F.col("stream").isin(*streams))
    return records


def log_source_stream(
    spark: SparkSession, path: str, schema: StructType | str, *, files_per_trigger: int | None = None
) -> DataFrame:
    """Unbounded read of the same table; the query's checkpoint is the cursor."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _matches(spark: SparkSession, glob: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []


def empty_files(spark: SparkSession, glob: str) -> list[str]:
    """Paths of the files of zero length that a glob of files names, on whatever store."""
    return [f.getPath().toString() for f in _matches(spark, glob)
            if f.getLen() == 0 and f.isFile() and f.getPath().getName()[0] not in "._"]


def _load_files(spark: SparkSession, glob: str) -> DataFrame:
    """Files of a glob. Where their folders hold only files, the folders are listed, since every path Spark is given apart costs the
    driver time, more than in proportion to their number."""
    reader = spark.read.format("binaryFile")
    folder, _, name = glob.rpartition("/")
    if not folder or name.count("{") != name.count("}") or not len(_matches(spark, glob)) or len(_matches(spark, f"{folder}/*/*")):
        return reader.load(glob)
    return reader.option("pathGlobFilter", name).load(folder)


def blob_source(spark: SparkSession, glob: str) -> DataFrame:
    """Files as content-addressed rows. Small files share a task, and content stays in it.

    Spark's file source leaves out files of zero length; they are rows from the listing.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    # File name endings with a known type.
    known = {"txt": "text/plain", "json": "application/json", "html": "text/html", "csv": "text/csv",
             "png": "image/png", "cbor": "application/cbor"}
    types = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    files = _load_files(spark, glob).select("path", "length", "content")
    empty = spark.createDataFrame([(p,) for p in empty_files(spark, glob)], "path string").select(
        "path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")
    )
    return files.unionByName(empty).select(
        "path",
        F.sha2("content", 256).alias("digest"),
        F.col("length").alias("size"),
        F.coalesce(F.try_element_at(types, ext), F.lit("application/octet-stream")).alias("mime_type"),
        "content",
    )
