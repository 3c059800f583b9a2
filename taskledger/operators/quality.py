"""Validation jobs: rows in, (row key, rule, detail) out, and the split into good and quarantined rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from taskledger.functions import expr as X
from taskledger.operators.blobs import parse_blob_uri
from taskledger.operators.scale import running
from taskledger.session import written

Rule = tuple[str, Column]


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], detail: Column | None = None) -> DataFrame:
    """One row per row and broken rule, in one pass. A rule that evaluates to null counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])
    )
    return df.select(
        *keys, F.explode(broken).alias("rule"), (F.lit("") if detail is None else detail).alias("detail")
    )


def split_valid(df: DataFrame, found: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a violation, and the others."""
    bad = found.select(*keys).distinct()
    return df.join(bad, list(keys), "left_anti"), df.join(bad, list(keys), "left_semi")


def _longer(text: Column, size: int) -> Column:
    return X.byte_length(text) > size


def validate_log_entries(
    entries: DataFrame, keys: Sequence[str], *, max_key: int = X.MAX_KEY, max_record: int = X.MAX_RECORD,
    max_batch: int = X.MAX_BATCH, max_append_id: int = X.MAX_APPEND_ID,
) -> DataFrame:
    """Rules on stream, key, value and append id per entry, and on the size of each (run, stream, append id)."""
    by = ["run_id", "stream", "append_id"]
    size = X.byte_length(F.col("key")) + X.byte_length(F.col("value"))
    per_row = violations(entries, keys, [
        ("stream name", ~X.matches(F.col("stream"), X.STREAM_NAME)),
        ("key size", _longer(F.col("key"), max_key)),
        ("empty value", X.byte_length(F.col("value")) == 0),
        ("record size", size > max_record),
        ("append id size", _longer(F.col("append_id"), max_append_id)),
    ])
    totals = entries.groupBy(*by).agg(F.sum(size).alias("_bytes")).filter(F.col("_bytes") > max_batch)
    per_batch = entries.join(totals.select(*by), by, "left_semi").select(
        *keys, F.lit("batch size").alias("rule"), F.lit("").alias("detail")
    )
    return per_row.unionByName(per_batch)


def _uuid(text: Column) -> Column:
    return X.matches(text, X.UUID_TEXT)


def validate_task_logs(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns type, source, action_id, attempt, timestamp."""
    return violations(events, keys, [
        ("type", F.col("type") != "task.log.v1"),
        ("source", F.col("source") != "stderr"),
        ("action id", ~_uuid(F.col("action_id"))),
        ("attempt", F.col("attempt") <= 0),
        ("timestamp", ~X.parses_as_time(F.col("timestamp"))),
    ])


def validate_status_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns type, status, updated_at; for action events also action_id and caller_action_id."""
    of_action = F.col("type") == "task.status.v1"
    caller = F.coalesce("caller_action_id", F.lit(""))
    return violations(events, keys, [
        ("type", ~F.col("type").isin("run.status.v1", "task.status.v1")),
        ("status", ~F.col("status").isin(*X.STATUSES)),
        ("action id", F.coalesce(of_action, F.lit(False)) & ~_uuid(F.col("action_id"))),
        ("caller id", F.coalesce(of_action, F.lit(False)) & (caller != "") & ~_uuid(caller)),
        ("updated at", ~X.parses_as_time(F.col("updated_at"))),
    ])


def validate_actions(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cache fields, agreement with the entrypoint, attempts and idempotency key of action requests.

    Columns: cache, task_version, cache_key (hex), entry_cache, entry_version, max_attempts (0: the
    entrypoint's), entry_max_attempts, idempotency_key, is_child.
    """
    version = F.coalesce("task_version", F.lit(""))
    key = F.coalesce("cache_key", F.lit(""))
    attempts = F.when(F.col("max_attempts") != 0, F.col("max_attempts")).otherwise(F.col("entry_max_attempts"))
    idempotency = F.coalesce("idempotency_key", F.lit(""))
    good_version = ~_longer(version, 200) & X.matches(version, X.SEMVER)
    return violations(requests, keys, [
        ("uncached with cache fields", ~F.col("cache") & ((version != "") | (key != ""))),
        ("cache fields", F.col("cache") & (~good_version | ~X.matches(key, "^[0-9a-fA-F]{64}$"))),
        ("cache policy", (F.col("cache") != F.col("entry_cache"))
         | (version != F.coalesce("entry_version", F.lit("")))),
        ("attempts", ~attempts.between(1, 100)),
        ("idempotency key size", _longer(idempotency, 200)),
        ("idempotency key missing", F.col("is_child") & (idempotency == "")),
    ])


# Fixed values.
PROVIDERS = ("local-python", "docker", "e2b")
RESERVED_NAMES = ("PATH", "HOME", "PYTHONPATH")
RESERVED_PREFIXES = ("UV_",)
ARCHIVE_MIME = "application/x-tar+zstd"


def _bad_command(args: Column) -> Column:
    total = F.aggregate(args, F.lit(0).cast("long"), lambda n, a: n + X.byte_length(a).cast("long"))
    return F.coalesce(
        (F.size(args) < 1) | (F.size(args) > 128) | (F.coalesce(F.get(args, F.lit(0)), F.lit("")) == "")
        | F.exists(args, lambda a: a.contains("\0")) | (total > 64 * 1024),
        F.lit(True),
    )


def validate_environments(
    envs: DataFrame, keys: Sequence[str], *, archive_mime: str = ARCHIVE_MIME,
    reserved_prefixes: Sequence[str] = RESERVED_PREFIXES,
) -> DataFrame:
    """Rules on environment declarations. `reserved_prefixes` are variable names the platform keeps to itself.

    Columns: namespace_id, name, source_uri, provider, reference, build_context_uri, build_command
    (array), workdir, cpu_millis, memory_bytes, env_vars (map), dependencies (array of namespace_id, name,
    version), entrypoints (array of command, cache, task_version, max_attempts).
    """
    local = F.coalesce(F.col("provider") == PROVIDERS[0], F.lit(False))
    reference = F.coalesce("reference", F.lit(""))
    names, texts = F.map_keys("env_vars"), F.map_values("env_vars")
    size = F.aggregate(
        F.map_entries("env_vars"), F.lit(0).cast("long"),
        lambda n, e: n + X.byte_length(e["key"]) + X.byte_length(e["value"]),
    )

    def reserved(name: Column) -> Column:
        bad = ~X.matches(name, X.ENV_VAR_NAME) | name.isin(*RESERVED_NAMES)
        for prefix in reserved_prefixes:
            bad = bad | name.startswith(prefix)
        return bad

    def archive(uri: Column) -> Column:
        parsed = parse_blob_uri(uri)
        plain = uri == X.blob_uri(F.lit(archive_mime), parsed["digest"])
        return F.coalesce((parsed["mime_type"] == archive_mime) & plain, F.lit(False))

    workdir = F.coalesce("workdir", F.lit(""))
    clean = (workdir == X.normal_path(workdir)) | (workdir == ".")
    bad_workdir = (
        (workdir == "") | ~clean | workdir.startswith("/") | (workdir == "..") | workdir.startswith("../")
        | workdir.contains("\0")
    )
    deps = F.col("dependencies")
    dep_names = F.transform(deps, lambda d: d["name"])
    space = F.col("namespace_id")
    bad_dep = F.exists(
        deps,
        lambda d: ~X.matches(d["name"], X.SLUG) | ~X.matches(d["version"], X.HEX_DIGEST)
        | ~d["namespace_id"].eqNullSafe(space),
    )
    entries = F.col("entrypoints")

    def bad_entry(e: Column) -> Column:
        version = F.coalesce(e["task_version"], F.lit(""))
        cached = F.coalesce(e["cache"], F.lit(False))
        good_version = ~_longer(version, 200) & X.matches(version, X.SEMVER)
        return (
            F.when(cached, ~good_version).otherwise(version != "")
            | ~F.coalesce(e["max_attempts"].between(1, 100), F.lit(False)) | _bad_command(e["command"])
        )

    memory = F.when(F.coalesce("memory_bytes", F.lit(0)) == 0, F.lit(2**30)).otherwise(F.col("memory_bytes"))
    cpu = F.when(F.coalesce("cpu_millis", F.lit(0)) == 0, F.lit(1000)).otherwise(F.col("cpu_millis"))
    return violations(envs, keys, [
        ("name", ~X.matches(F.col("name"), X.SLUG)),
        ("source", ~archive(F.col("source_uri"))),
        ("provider", ~F.col("provider").isin(*PROVIDERS)),
        ("local reference", local & (reference != "")),
        ("build context", local & ~archive(F.col("build_context_uri"))),
        ("build command", local & _bad_command(F.col("build_command"))),
        ("workdir", local & bad_workdir),
        ("reference missing", F.coalesce(F.col("provider").isin("docker", "e2b"), F.lit(False)) & (reference == "")),
        ("reference", _longer(reference, 2048) | reference.contains("\0")),
        ("resources", (cpu > 1_000_000) | (memory > 2**50) | (cpu < 0) | (memory < 0)),
        ("environment variable", F.exists(names, reserved) | F.exists(texts, lambda v: v.contains("\0"))),
        ("environment size", (F.size(names) > 128) | (size > 64 * 1024)),
        ("dependency count", F.size(deps) > 128),
        ("dependencies", bad_dep | F.array_contains(dep_names, F.col("name"))
         | (F.size(F.array_distinct(dep_names)) < F.size(dep_names))),
        ("entrypoint count", ~F.size(entries).between(1, 1000)),
        ("entrypoint", F.exists(entries, bad_entry)),
    ])


DEFAULT_CPU, DEFAULT_MEMORY = 1000, 2**30  # fixed values


def canonical_environment(envs: DataFrame, *, archive_mime: str = ARCHIVE_MIME) -> DataFrame:
    """`envs` (columns as for validate_environments) with `canonical`, one text for all spellings of an environment, and its
    SHA-256 `version`.

    Absent resources become their defaults, absent texts empty ones; archives are named by their digest; variables are
    sorted by name, dependencies too, entrypoints keep their order. Every field is framed by its size and every list by its
    length, so different environments never share a text. All of it is one projection in the JVM.
    """
    def text(value: Column) -> Column:
        return X.framed_hex(F.coalesce(value.cast("string"), F.lit("")))

    def many(values: Column, kind: str, each: Callable[[Column], Column]) -> Column:
        items = F.coalesce(values, F.array().cast(kind))
        return F.concat(text(F.size(items)), F.array_join(F.transform(items, each), ""))

    def archive(uri: str) -> Column:
        digest = parse_blob_uri(F.col(uri))["digest"]
        return F.when(digest.isNotNull(), X.blob_uri(F.lit(archive_mime), digest)).otherwise(F.coalesce(F.col(uri), F.lit("")))

    def number(column: str, default: int) -> Column:
        given = F.coalesce(F.col(column).cast("decimal(20,0)"), F.lit(0))
        return F.when(given == 0, F.lit(default).cast("decimal(20,0)")).otherwise(given)

    kinds = {f.name: f.dataType.simpleString() for f in envs.schema}
    variables = F.array_sort(F.map_entries("env_vars"))
    dependencies = F.array_sort(F.transform("dependencies", lambda d: F.struct(
        d["name"].alias("name"), d["namespace_id"].alias("namespace_id"), d["version"].alias("version"))))
    parts = [
        *[text(F.col(c)) for c in ("namespace_id", "name")], text(archive("source_uri")), *[text(F.col(c)) for c in ("provider", "reference")],
        text(number("cpu_millis", DEFAULT_CPU)), text(number("memory_bytes", DEFAULT_MEMORY)),
        many(variables, "array<struct<key:string,value:string>>", lambda e: F.concat(text(e["key"]), text(e["value"]))),
        text(archive("build_context_uri")), many(F.col("build_command"), "array<string>", text), text(F.col("workdir")),
        many(dependencies, "array<struct<name:string,namespace_id:string,version:string>>",
             lambda d: F.concat(text(d["name"]), text(d["namespace_id"]), text(d["version"]))),
        many(F.col("entrypoints"), kinds["entrypoints"], lambda e: F.concat(
            text(F.size(e["command"])), F.array_join(F.transform(e["command"], text), ""), text(F.coalesce(e["max_attempts"], F.lit(0))),
            text(F.coalesce(e["cache"], F.lit(False))), text(e["task_version"]))),
    ]
    canonical = F.concat(*parts)
    return envs.withColumns({"canonical": canonical, "version": F.sha2(F.unhex(canonical), 256)})


def validate_settings(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns slug and name of the namespace, path and value of the setting."""
    name_size = X.byte_length(F.trim("name"))
    value_size = X.byte_length(F.col("value"))
    return violations(settings, keys, [
        ("slug", ~X.matches(F.col("slug"), X.SLUG)),
        ("name", (name_size == 0) | (name_size > 200)),
        ("path", ~X.matches(F.col("path"), X.SETTING_PATH) | _longer(F.col("path"), 512)),
        ("value size", (value_size == 0) | (value_size > 65536)),
    ])


def validate_uploads(uploads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns sha256 (hex), size, mime_type, metadata (map)."""
    names, texts = F.map_keys("metadata"), F.map_values("metadata")
    mime = F.coalesce("mime_type", F.lit(""))
    bad_name = F.exists(names, lambda n: (n == "") | _longer(n, 64) | (F.lower(n) != n))
    return violations(uploads, keys, [
        ("digest", ~X.matches(F.col("sha256"), "^[0-9a-fA-F]{64}$")),
        ("size", ~F.col("size").between(0, X.MAX_UPLOAD)),
        ("mime type", (F.trim(mime) == "") | _longer(mime, 255) | ~X.matches(F.trim(mime), X.MIME_TYPE)),
        ("metadata count", F.size(names) > 32),
        ("metadata entry", bad_name | F.exists(texts, lambda v: _longer(v, 1024))),
        ("metadata size", _longer(F.to_json("metadata"), 16 * 1024)),
    ])


def range_overlaps(entries: DataFrame) -> DataFrame:
    """Ranges of an archive that start before the previous one, in (start, end) order, has ended.

    Columns archive, size, start, end and doc_id as the tie-breaker. Empty ranges and negative offsets, which
    have a rule of their own, do not count.
    """
    filled = entries.filter((F.col("size") > 0) & (F.col("start") >= 0))
    return running(filled, ["archive"], ["start", "end", "doc_id"], previous={"previous_end": "end"}).filter(
        F.col("start") < F.coalesce("previous_end", F.lit(0))
    )


MAX_ENTRIES = 100_000
MAX_ARCHIVE = 2 * 1024**3


def validate_manifest(entries: DataFrame, keys: Sequence[str] = ("archive", "doc_id")) -> DataFrame:
    """Columns archive, name, kind, size, start, end, digest, link. Per entry, then per archive."""
    regular = (F.col("kind") == "reg") & (F.col("size") != 0)
    empty = (F.col("size") == 0) & (F.col("start") == 0) & (F.col("end") == 0) & (F.col("digest") == "")
    link = F.coalesce("link", F.lit(""))
    per_entry = violations(entries, keys, [
        ("path", ~X.safe_path(F.col("name"))),
        ("type", ~F.col("kind").isin("reg", "dir", "symlink")
         | ((F.col("kind") != "dir") & F.col("name").endswith("/"))),
        ("offset", (F.col("size") < 0) | (F.col("start") < 0) | (F.col("end") < 0)
         | (F.col("size") > MAX_ARCHIVE) | (F.col("end") > MAX_ARCHIVE)),
        ("range", regular & (F.col("end") <= F.col("start"))),
        ("digest", regular & ~X.matches(F.col("digest"), "^sha256:[0-9a-f]{64}$")),
        ("no content", ~regular & ~empty),
        ("link", F.when(F.col("kind") == "symlink", ~X.safe_link(F.col("name"), link)).otherwise(link != "")),
    ])

    def marked(df: DataFrame, rule: str) -> DataFrame:
        return df.select(*keys, F.lit(rule).alias("rule"), F.lit("").alias("detail"))

    path = F.regexp_replace("name", "/$", "")
    repeated = entries.groupBy("archive", path.alias("_path")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = entries.withColumn("_path", path).join(repeated, ["archive", "_path"], "left_semi")
    totals = entries.groupBy("archive").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"))
    too_many = entries.join(totals.filter(F.col("_n") > MAX_ENTRIES).select("archive"), "archive", "left_semi")
    too_big = entries.join(totals.filter(F.col("_bytes") > MAX_ARCHIVE).select("archive"), "archive", "left_semi")
    found = per_entry
    for part in (
        marked(twice, "duplicate path"), marked(too_many, "entry count"), marked(too_big, "archive size"),
        marked(range_overlaps(entries), "overlap"),
    ):
        found = found.unionByName(part)
    return found


ACTION_STATUS = "'queued', 'running', 'waiting', 'succeeded', 'failed', 'canceled'"


class _Constraints:
    """Rules of the relations in `tables`, turned into tags: (space, key, side) of keys, owners and references.

    A space is one unique rule, or the columns of a parent that references point to. Rules on columns a table lacks are
    left out.
    """

    KEY, OWNER, REFERENCE = range(3)

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.spaces: list[tuple[str, str]] = []
        self.tags: dict[str, list[tuple[int, list[str], int, Column]]] = {}
        self.whole: dict[int, bool] = {}
        self.references: list[tuple[str, list[str], list[str], int, str]] = []
        self.rows: list[DataFrame] = []
        self.owners: dict[tuple[str, ...], int] = {}

    def has(self, table: str, *columns: str) -> bool:
        return table in self.tables and {*columns} <= {*self.tables[table].columns}

    @staticmethod
    def shown(keys: Sequence[str]) -> Column:
        return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])

    def key(self, space: int, columns: Sequence[str]) -> list[Column]:
        """numbers, texts: the values of the columns, as numbers where all that meet in the space are whole ones, else as
        texts; the other is null. Numbers are a third of the bytes of their texts."""
        long, text = "array<bigint>", "array<string>"
        values = F.array(*[F.col(c) for c in columns]).cast(long) if self.whole[space] else F.array(*[F.col(c).cast("string") for c in columns])
        return [(values if whole == self.whole[space] else F.lit(None).cast(kind)).alias(name)
                for name, kind, whole in (("numbers", long, True), ("texts", text, False))]

    def _space(self, table: str, rule: str) -> int:
        self.spaces.append((table, rule))
        return len(self.spaces) - 1

    def _tag(self, table: str, space: int, columns: list[str], side: int, where: Column) -> None:
        types = [self.tables[table].schema[c].dataType for c in columns]
        self.whole[space] = self.whole.get(space, True) and all(isinstance(t, IntegralType) for t in types)
        self.tags.setdefault(table, []).append((space, columns, side, where))

    def unique(self, table: str, keys: list[str], rule: str = "primary key", where: str = "true", needs: Sequence[str] = ()) -> None:
        if self.has(table, *keys, *needs):
            self._tag(table, self._space(table, rule), keys, self.KEY, F.expr(where))

    def refers(self, table: str, keys: list[str], parent: str, on: dict[str, str], rule: str) -> None:
        """`on`: child column to parent column. A null in a child column refers to nothing."""
        if not (self.has(table, *keys, *on) and self.has(parent, *on.values())):
            return
        pairs = sorted(on.items(), key=lambda x: x[1])
        mine, theirs = [m for m, _ in pairs], [t for _, t in pairs]
        place = (parent, *theirs)
        if place not in self.owners:
            self.owners[place] = self._space(parent, "")
            self._tag(parent, self.owners[place], theirs, self.OWNER, F.lit(True))
        set_ = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in mine])
        self._tag(table, self.owners[place], mine, self.REFERENCE, set_)
        self.references.append((table, keys, mine, self.owners[place], rule))

    def check(self, table: str, keys: list[str], rules: dict[str, tuple[str, ...]]) -> None:
        """`rules`: what is broken, by rule, and the columns that are looked at. One pass over the table."""
        own = {rule: bad for rule, (bad, *columns) in rules.items() if self.has(table, *keys, *columns)}
        if own:
            marks = F.array(*[F.when(F.expr(bad), F.lit(rule)) for rule, bad in own.items()])
            broken = self.tables[table].filter(" OR ".join(f"({bad})" for bad in own.values()))
            self.rows.append(broken.select(
                F.lit(table).alias("table_name"), F.explode(F.array_compact(marks)).alias("rule"), self.shown(keys).alias("row_key")
            ))

    def met(self) -> DataFrame:
        """space, numbers, texts, keys, owners, references: all tags of all relations in one shuffle, summed before it.

        However many rows refer to one key, a task sends one row for it. Only numbers are summed: with the smallest of some
        texts beside them Spark would sort all tags instead of hashing them.
        """
        def tag(space: int, columns: list[str], side: int, where: Column) -> Column:
            return F.when(where, F.struct(F.lit(space).alias("space"), *self.key(space, columns), F.lit(side).alias("side")))

        tagged = [self.tables[t].select(F.explode(F.array(*[tag(*x) for x in tags])).alias("t")).filter("t IS NOT NULL").select("t.*")
                  for t, tags in self.tags.items()]
        return reduce(DataFrame.unionByName, tagged).groupBy("space", "numbers", "texts").agg(
            F.count_if(F.col("side") == self.KEY).alias("keys"), F.count_if(F.col("side") == self.OWNER).alias("owners"),
            F.count_if(F.col("side") == self.REFERENCE).alias("references"),
        ).filter("keys > 1 OR (references > 0 AND owners = 0)")

    def violations(self) -> DataFrame:
        bad = written(self.met(), "broken-keys")
        names = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(r).alias("rule")) for t, r in self.spaces])
        name = F.get(names, F.col("space"))
        shown = F.coalesce(F.col("numbers").cast("array<string>"), "texts")
        found = [*self.rows, bad.filter("keys > 1").select(name["table_name"].alias("table_name"), name["rule"].alias("rule"), F.concat_ws("|", shown).alias("row_key"))]
        lost = bad.filter("keys = 0")
        # only the relations that have such references are looked at again, for the rows they are in
        spaces = {r["space"] for r in lost.select("space").distinct().collect()}
        for table, keys, mine, space, rule in self.references:
            if space in spaces:
                kind, values = ("bigint", "numbers") if self.whole[space] else ("string", "texts")
                at = [f"_{i}" for i in range(len(mine))]
                rows = self.tables[table].select(*keys, *[F.col(c).cast(kind).alias(a) for a, c in zip(at, mine, strict=True)])
                gone = lost.filter(F.col("space") == space).select(*[F.col(values)[i].alias(a) for i, a in enumerate(at)])
                found.append(rows.join(gone, at, "left_semi").select(
                    F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), self.shown(keys).alias("row_key")))
        return reduce(DataFrame.unionByName, found)


def check_table_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Key, reference and row constraints of the stored relations, for those present in `tables`.

    A rule on a column that a table lacks is left out. All row rules of a table are taken in one pass; keys and references
    of all tables meet in one shuffle.
    """
    rules = _Constraints(tables)
    unique, refers, check = rules.unique, rules.refers, rules.check
    unique("namespaces", ["id"])
    unique("namespaces", ["slug"], "unique slug")
    unique("settings", ["namespace_id", "path"])
    refers("settings", ["namespace_id", "path"], "namespaces", {"namespace_id": "id"}, "namespace exists")
    unique("task_environments", ["id"])
    unique("task_environments", ["namespace_id", "name", "version"], "unique version")
    refers("task_environments", ["id"], "namespaces", {"namespace_id": "id"}, "namespace exists")
    unique("image_builds", ["id"])
    unique("image_builds", ["image_key"], "one build in progress", "status = 'building'", ["status"])
    check("image_builds", ["id"], {
        "ready has artifact": ("status = 'ready' AND artifact_uri = ''", "status", "artifact_uri"),
        "status": ("status NOT IN ('building', 'ready', 'failed')", "status"),
    })
    unique("task_cache", ["cache_key"])
    check("task_cache", ["cache_key"], {
        "key length": ("NOT cache_key RLIKE '^[0-9a-f]{64}$'",),
        "status": ("status NOT IN ('building', 'ready')", "status"),
        "ready has result": ("status = 'ready' AND output IS NULL AND error_code = ''", "status", "output", "error_code"),
    })
    unique("runs", ["id"])
    unique("runs", ["namespace_id", "root_idempotency_key"], "unique idempotency key", "root_idempotency_key IS NOT NULL")
    refers("runs", ["id"], "namespaces", {"namespace_id": "id"}, "namespace exists")
    refers("runs", ["id"], "task_actions", {"id": "run_id", "root_action_id": "id"}, "root exists")
    unique("task_actions", ["id"])
    unique("task_actions", ["run_id"], "one root", "caller_action_id IS NULL", ["caller_action_id"])
    unique("task_actions", ["run_id", "idempotency_key"], "unique idempotency key", "idempotency_key IS NOT NULL")
    check("task_actions", ["id"], {
        "entrypoint range": ("NOT entrypoint_id BETWEEN 1 AND 4294967295", "entrypoint_id"),
        "status": (f"status NOT IN ({ACTION_STATUS})", "status"),
    })
    refers("task_actions", ["id"], "runs", {"run_id": "id"}, "run exists")
    refers("task_actions", ["id"], "task_environments", {"environment_id": "id"}, "environment exists")
    refers("task_actions", ["id"], "task_actions", {"run_id": "run_id", "caller_action_id": "id"}, "caller exists")
    edge = ["run_id", "source_action_id", "dependent_action_id"]
    unique("task_action_edges", edge)
    check("task_action_edges", edge, {"no self edge": ("source_action_id = dependent_action_id",)})
    refers("task_action_edges", edge, "runs", {"run_id": "id"}, "run exists")
    for end in ("source", "dependent"):
        refers("task_action_edges", edge, "task_actions", {"run_id": "run_id", f"{end}_action_id": "id"}, f"{end} exists")
    stream = ["run_id", "stream"]
    unique("run_log_streams", stream)
    check("run_log_streams", stream, {
        "stream name": (f"NOT stream RLIKE '{X.STREAM_NAME[:-1]}\\\\z'",), "next number": ("next_seq < 1", "next_seq"),
    })
    refers("run_log_streams", stream, "runs", {"run_id": "id"}, "run exists")
    record = [*stream, "seq"]
    unique("run_log_records", record)
    check("run_log_records", record, {
        "inline or stored": ("(value IS NOT NULL) = (value_uri IS NOT NULL)", "value", "value_uri"),
        "sequence starts at 1": ("seq < 1",), "key length": (f"octet_length(key) > {X.MAX_KEY}", "key"),
        "payload size": ("payload_size <= 0", "payload_size"),
    })
    refers("run_log_records", record, "run_log_streams", {c: c for c in stream}, "stream exists")
    append = [*stream, "append_id"]
    unique("run_log_appends", append)
    check("run_log_appends", append, {
        "range": ("first_seq < 1 OR last_seq < first_seq", "first_seq", "last_seq"),
        "append id length": (f"length(append_id) NOT BETWEEN 1 AND {X.MAX_APPEND_ID}",),
        "digest length": ("NOT batch_digest RLIKE '^[0-9a-f]{64}$'", "batch_digest"),
    })
    refers("run_log_appends", append, "run_log_streams", {c: c for c in stream}, "stream exists")
    unique("blobs", ["sha256"])
    check("blobs", ["sha256"], {"digest length": ("NOT sha256 RLIKE '^[0-9a-f]{64}$'",)})
    unique("blob_uploads", ["session_id"])
    unique("blob_uploads", ["object_key"], "unique object")
    return rules.violations()
