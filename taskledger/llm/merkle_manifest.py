"""Merkle manifest of a table by butterfly exchange.

Every row is a leaf: the SHA-256 of its fields, framed by their sizes. The leaves of a group (a source) are ordered and
dealt to partitions of fanout ** LOCAL_LEVELS consecutive ones, so a partition is a whole subtree. Each hashes its own
subtree; then aligned runs of fanout partitions swap subtree roots, next runs of fanout such runs, and so on. In
round r a partition gets the roots of its fanout - 1 siblings at that height, each from the partition of the sibling run
that stands at its own place there (a shorter run is gone round again), and hashes the common ancestor itself, like all
others below it. After log(partitions) rounds every partition knows the root of its group and the upper part of its
leaves' proofs; nothing is sent down. The roots of the groups form a tree of the same kind above.

An exchange is a join of narrow rows: partition, place asked, digest. A partition in memory is at most 4,096 leaves
(about 0.4 MB); a group of any size is many partitions. Rows are numbered by range partitions, not by a window.

Null fields are marked as such, the null group comes first. Rows with equal ids are ordered by their leaves; repeated
rows are leaves of their own. An empty table gives no rows. Columns other than the fields are not read.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from taskledger.llm.common import documents, remainder
from taskledger.llm.registry import query
from taskledger.session import ship_package, written

FANOUT = 16
LOCAL_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_IN_RANGE = 1_000_000
_LEVELS = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each its UTF-8 size, a colon and its text, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]), 256)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """`df`, stored, with the 0-based place of each row in ascending `order` (nulls first) as a long column `name`."""
    stored = written(df.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, math.ceil(stored.count() / ROWS_IN_RANGE))
    at = F.monotonically_increasing_id()
    ordered = written(
        stored.repartitionByRange(ranges, *order, "_tie").sortWithinPartitions(*order, "_tie").select(
            *df.columns, F.shiftright(at, 33).alias("_range_of_row"), at.bitwiseAND((1 << 33) - 1).alias("_in_range")
        ), "ordered",
    )
    before = Window.orderBy("_range_of_row").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = ordered.groupBy("_range_of_row").count().select("_range_of_row", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before_range"))
    return ordered.join(F.broadcast(starts), "_range_of_row").select(*df.columns, (F.col("_before_range") + F.col("_in_range")).alias(name))


def parent(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def subtree(leaves: list[str], steps: int | None, fanout: int) -> list[list[str]]:
    """The digests of each level from the leaves up: `steps` levels above them, or up to a single node if None."""
    levels = [leaves]
    while len(levels[-1]) > 1 if steps is None else len(levels) <= steps:
        below = levels[-1]
        levels.append([parent("".join(below[i: i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    """Digests left and right of a leaf's ancestor in its run, level by level."""
    found = []
    for level in levels[:-1]:
        first = place - place % fanout
        found.append(("".join(level[first:place]), "".join(level[place + 1: first + fanout])))
        place //= fanout
    return found


def held(rows: DataFrame, *, fanout: int = FANOUT, local_levels: int = LOCAL_LEVELS) -> DataFrame:
    """One stored row for each partition: _group, _part, _parts, rows (an array in order) and the root of its subtree.

    `rows`: _group, _place and _size (place in and size of the group), digest, and whatever else the array shall hold.
    """
    ship_package(rows.sparkSession)
    most = fanout**local_levels
    kept = [f for f in rows.schema if f.name not in ("_group", "_place", "_size")]
    cut = rows.withColumns({
        "_part": F.floor(F.col("_place") / most), "_parts": F.ceil(F.col("_size") / most).cast("long"),
    }).drop("_size")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("_place").combine_chunks()
        parts = table.column("_parts")[0].as_py()
        levels = subtree(table.column("digest").to_pylist(), local_levels if parts > 1 else None, fanout)
        own = pa.StructArray.from_arrays([table.column(f.name).combine_chunks() for f in kept], [f.name for f in kept])
        return pa.table({
            "_group": pa.array([key[0].as_py()], pa.int64()), "_part": pa.array([key[1].as_py()], pa.int64()),
            "_parts": pa.array([parts], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
            "root": [levels[-1][0]],
        })

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept)
    return written(
        cut.groupBy("_group", "_part").applyInArrow(build, f"_group long, _part long, _parts long, rows array<struct<{fields}>>, root string"),
        "held",
    )


def butterfly(tops: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """_group, _part, top (root of the group) and levels (digests left and right at each height) for every partition.

    `tops`: _group, _part, _parts, root.
    """
    state = tops.select("_group", "_part", "_parts", F.col("root").alias("top"), F.array().cast(_LEVELS).alias("levels"))
    most, span = tops.agg(F.max("_parts")).first()[0] or 0, 1
    while span < most:
        part, parts = F.col("_part"), F.col("_parts")
        first = part - F.pmod(part, F.lit(span * fanout))
        there = F.least(F.lit(fanout).cast("long"), F.ceil((parts - first) / span))
        asked = state.filter(parts > span).select(
            "_group", "_part", "_parts", F.explode(F.sequence(F.lit(0).cast("long"), there - 1)).alias("_child"),
        )
        start = first + F.col("_child") * span
        width = F.least(F.lit(span).cast("long"), parts - start)
        asked = asked.select("_group", "_part", "_child", (start + F.pmod(F.pmod(part, F.lit(span)), width)).alias("_from"))
        given = state.select("_group", F.col("_part").alias("_from"), F.col("top").alias("_digest"))
        met = asked.join(given, ["_group", "_from"]).groupBy("_group", "_part").agg(
            F.array_sort(F.collect_list(F.struct("_child", "_digest"))).alias("_run")  # fanout digests at most
        )
        own = F.pmod(F.floor(part / span), F.lit(fanout))

        def joined(which, own=own) -> Column:
            return F.array_join(F.transform(F.filter("_run", lambda x: which(x["_child"], own)), lambda x: x["_digest"]), "")

        level = F.struct(joined(lambda c, o: c < o).alias("left"), joined(lambda c, o: c > o).alias("right"))
        state = written(
            state.join(met, ["_group", "_part"], "left").select(
                "_group", "_part", "_parts",
                F.when(F.col("_run").isNull(), F.col("top")).otherwise(F.sha2(joined(lambda c, o: c >= 0), 256)).alias("top"),
                F.when(F.col("_run").isNull(), F.col("levels")).otherwise(F.concat("levels", F.array(level))).alias("levels"),
            ), "exchanged",
        )
        span *= fanout
    return state.drop("_parts")


def prove(
    docs: DataFrame, *, doc_id: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS,
    claimed: Column | None = None, claims: dict[str, Column] | None = None,
    fanout: int = FANOUT, local_levels: int = LOCAL_LEVELS, proofs: bool = True,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified for every row.

    `proof` is the array of the sibling digests from the leaf to the root (null unless `proofs`). Where `claimed` holds, what is folded is the
    leaf that the row would have with the columns `claims` in place of its own: it verifies only if nothing differs.
    """
    columns = {f: F.col(f"`{f}`") for f in fields}
    other = F.lit(None).cast("string")
    if claimed is not None:
        other = F.when(claimed, leaf([(claims or {}).get(f, c) for f, c in columns.items()]))
    rows = numbered(
        docs.select(
            F.col(f"`{group}`").alias("source"), F.col(f"`{doc_id}`").alias("doc_id"),
            leaf(list(columns.values())).alias("digest"), other.alias("other"),
        ), ["source", "doc_id", "digest"], "_at",
    )
    sources = numbered(
        rows.groupBy("source").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_size")), ["source"], "_group"
    )
    sources = written(sources, "groups")
    same = rows["source"].eqNullSafe(sources["source"])
    placed = rows.join(sources, same).select(
        "_group", (F.col("_at") - F.col("_start")).alias("_place"), "_size", "digest", "doc_id", "other"
    )
    leaves = held(placed, fanout=fanout, local_levels=local_levels)
    below = butterfly(leaves, fanout=fanout)
    subroots = below.filter("_part = 0").select(
        F.lit(0).cast("long").alias("_group"), F.col("_group").alias("_place"), F.lit(sources.count()).cast("long").alias("_size"),
        F.col("top").alias("digest"), F.col("_group").alias("number"),
    )
    heads = held(subroots, fanout=fanout, local_levels=local_levels)
    above = butterfly(heads, fanout=fanout)
    tops = _open_heads(heads.join(above, ["_group", "_part"]), fanout, local_levels)
    whole = leaves.join(below, ["_group", "_part"]).join(tops, "_group")
    return _open_leaves(
        whole.select("rows", "_parts", "top", "levels", "root_of_all", "levels_above"), docs.schema[doc_id].dataType,
        fanout, local_levels, proofs,
    )


def _open_heads(heads: DataFrame, fanout: int, local_levels: int) -> DataFrame:
    """_group, root_of_all, levels_above for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = subtree([r["digest"] for r in row["rows"]], local_levels if row["_parts"] > 1 else None, fanout)
                made = [
                    {"_group": r["number"], "root_of_all": row["top"], "levels_above": [
                        *({"left": a, "right": b} for a, b in siblings(levels, i, fanout)), *row["levels"]
                    ]} for i, r in enumerate(row["rows"])
                ]
                for at in range(0, len(made), 256):
                    yield pa.RecordBatch.from_pylist(made[at: at + 256], schema=schema)

    level = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    schema = pa.schema([("_group", pa.int64()), ("root_of_all", pa.string()), ("levels_above", level)])
    return heads.select("rows", "_parts", "top", "levels").mapInArrow(run, f"_group long, root_of_all string, levels_above {_LEVELS}")


def _open_leaves(whole: DataFrame, id_type: DataType, fanout: int, local_levels: int, with_proofs: bool) -> DataFrame:
    """The result for every row of the partitions."""

    def fold(digest: str, levels: list[tuple[str, str]]) -> str:
        for left, right in levels:
            digest = parent(left + digest + right)
        return digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own = row.column(0).flatten()
                digests, ids, others = (own.field(name) for name in ("digest", "doc_id", "other"))
                _, parts, subroot, levels, root, above = (c[0].as_py() for c in row.columns)
                local = subtree(digests.to_pylist(), local_levels if parts > 1 else None, fanout)
                upper = [(x["left"], x["right"]) for x in (*levels, *above)]
                rest, known = "".join(a + b for a, b in upper), {}
                proofs, folded = [], []
                for place, (digest, other) in enumerate(zip(local[0], others.to_pylist(), strict=True)):
                    near = siblings(local, place, fanout)
                    proofs.append("".join(a + b for a, b in near) + rest)
                    mine = fold(other or digest, near)
                    if mine not in known:
                        known[mine] = fold(mine, upper)
                    folded.append(known[mine])
                n = len(folded)
                for at in range(0, n, 512):
                    part = slice(at, min(n, at + 512))
                    size = part.stop - at
                    yield pa.RecordBatch.from_arrays(
                        [ids[part], digests[part], pa.array([subroot] * size), pa.array([root] * size),
                         pa.array([[p[i: i + 64] for i in range(0, len(p), 64)] for p in proofs[part]], pa.list_(pa.string()))
                         if with_proofs else pa.nulls(size, pa.list_(pa.string())),
                         pa.array([parent(p) for p in proofs[part]]), pa.array(folded[part]),
                         pa.array([f == root for f in folded[part]])],
                        names=names,
                    )

    names = ["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    kinds = [id_type.simpleString(), "string", "string", "string", "array<string>", "string", "string", "boolean"]
    return whole.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def _check(levels: int = 6) -> str:
    """The query in SQL, for up to FANOUT ** levels leaves of a source and sources."""
    bits = "[" + ", ".join(["0::UBIGINT"] * 8) + "]"
    crc = f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), {bits}), lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1)))), 4294967295::UBIGINT)"""

    def digest(text: str) -> str:
        plain = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(plain)})"

    small = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = [f"""leaves AS (SELECT doc_id, source, {digest('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(small)} END AS other FROM documents)""",
             """n0 AS (SELECT source AS g, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS d, doc_id, coalesce(other, leaf) AS fold
      FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf))"""]

    def climb(name: str, path: str, extra: str) -> None:
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS (SELECT g, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d
      FROM {name}{k} WHERE n > 1 GROUP BY g, pos // {FANOUT}, n)""")
            steps.append(f"{name}_run{k} AS (SELECT g, pos // {FANOUT} AS run, list(d ORDER BY pos) AS ds FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
            left, right = (f"coalesce(array_to_string({part}, ''), '')" for part in (f"ds[:pos % {FANOUT}]", f"ds[pos % {FANOUT} + 2:]"))
            steps.append(f"""{path}{k + 1} AS (SELECT p.g, {extra}, CASE WHEN ds IS NULL THEN pos ELSE pos // {FANOUT} END AS pos,
      CASE WHEN ds IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
      CASE WHEN ds IS NULL THEN proof ELSE proof || {left} || {right} END AS proof
      FROM {path}{k} p LEFT JOIN {name}_run{k} r ON r.g IS NOT DISTINCT FROM p.g AND r.run = p.pos // {FANOUT})""")
        steps.append(f"{name}_top AS (" + " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    steps.append("p0 AS (SELECT g, doc_id, d AS leaf, pos, fold, '' AS proof FROM n0)")
    climb("n", "p", "doc_id, leaf")
    steps.append("s0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, d, g AS source FROM n_top)")
    steps.append(f"""q0 AS (SELECT 0 AS g, p.doc_id, p.leaf, s.d AS subroot, s.pos, p.fold, p.proof
      FROM p{levels} p JOIN s0 s ON s.source IS NOT DISTINCT FROM p.g)""")
    climb("s", "q", "doc_id, leaf, subroot")
    return "WITH " + ",\n  ".join(steps) + f"""
  SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM q{levels}, s_top"""


@query(_check())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents; of a fifth of them, the text with small letters is what is held against the root."""
    docs = documents(spark, folder)
    small = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return prove(docs, claimed=remainder("doc_id", 5) == 0, claims={"text": small}, proofs=False).drop("proof")
