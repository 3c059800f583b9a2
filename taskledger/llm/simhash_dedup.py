"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant that differs from each in at most r. So every distinct
fingerprint emits all its variants within r bits, equal variants meet, and the fingerprints that met are verified by
counting differing bits. With r = 2 a fingerprint has 2,081 variants. They are dealt out by their leading bits: a
fingerprint is sent once to each prefix that one of its variants can have (37 for 8 bits), and the task of that prefix
makes the variants with this prefix, in parts of bounded size, and joins those that meet. Instead of all pairs a task
returns one link from each fingerprint to the smallest one it is connected with there; every link is a chain of verified
pairs, so components stay whole. Components are then found over all links by alternating star contraction.

Exact copies have one fingerprint and take part once. Texts without a word have fingerprint zero. Rows with a null id
are linked like others but name no component; a component of such rows only has a null component_id. Texts are read in
full, however long; an empty table has no components, and columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from taskledger.llm.common import documents, per_text
from taskledger.llm.registry import query
from taskledger.session import ship_package, written

SHINGLE = 4
RADIUS = 2  # half of the 4 differing bits
SEED = 42
MOST_VARIANTS = 1 << 20  # that a task holds at a time
LEAST_PREFIX_BITS = 4


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the lower-cased text, in parts of bounded size."""
    found = text.lower().split() if text else []
    if not found:
        return
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), dtype=np.int64, count=len(found))) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(found) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(found)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        yield np.array(
            [digest(joined[a:b], SEED) for a, b in zip(first[at: at + (1 << 15)], last[at: at + (1 << 15)], strict=True)],
            dtype=np.uint64,
        )


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for part in shingle_hashes(text, size):
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    if not n:
        return 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) for every row."""
    return per_text(
        docs, lambda texts: [pa.array([fingerprint(t, size) for t in texts], pa.int64())], "fp long",
        doc_id=doc_id, text=text,
    )


def masks(bits: int, most: int) -> list[int]:
    """All numbers of `bits` bits with at most `most` of them set."""
    return [sum(1 << b for b in chosen) for k in range(min(bits, most) + 1) for chosen in itertools.combinations(range(bits), k)]


def ball_links(prints: DataFrame, *, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """Links (a, b) with a > b between distinct fingerprints of `prints` that differ in at most 2 * radius bits,
    reduced as described above: the components of the links are those of all such pairs."""
    spark = prints.sparkSession
    ship_package(spark)
    distinct = prints.select(F.col(fp).alias("fp")).filter("fp is not null").distinct()
    per_print = sum(math.comb(64, k) for k in range(radius + 1))
    wanted = distinct.count() * per_print / MOST_VARIANTS
    prefix_bits = min(32, max(LEAST_PREFIX_BITS, math.ceil(math.log2(max(1, wanted)))))
    flips = F.array(*[F.lit(m).cast("long") for m in masks(prefix_bits, radius)])
    prefix = F.shiftrightunsigned("fp", 64 - prefix_bits)
    sent = distinct.select("fp", F.explode(F.transform(flips, lambda m: prefix.bitwiseXOR(m))).alias("prefix"))

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        a, b = local_links(found, key[0].as_py(), prefix_bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("prefix").applyInArrow(meet, "a long, b long").distinct()


def local_links(found: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smaller one it is connected with) through variants that begin with this prefix."""
    parent = np.arange(len(found))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    low = 64 - prefix_bits
    shift = np.uint64(low)
    away = np.bitwise_count((found >> shift if low < 64 else np.zeros_like(found)) ^ np.uint64(prefix)).astype(np.int64)
    todo = [(np.flatnonzero(away <= radius), radius - away[away <= radius], low)]
    while todo:
        rows, left, low = todo.pop()
        if len(rows) < 2:
            continue
        sizes = [sum(math.comb(low, k) for k in range(r + 1)) for r in range(radius + 1)]
        if low > 4 and sum(sizes[r] * int((left == r).sum()) for r in range(radius + 1)) > MOST_VARIANTS:
            low -= 4  # too many variants at once: one part for each value of the next four bits
            part = (found[rows] >> np.uint64(low)) & np.uint64(15)
            for value in range(16):
                rest = left - np.bitwise_count(part ^ np.uint64(value)).astype(np.int64)
                todo.append((rows[rest >= 0], rest[rest >= 0], low))
            continue
        lower = found[rows] & np.uint64((1 << low) - 1)
        made, owner = [], []
        for r in range(radius + 1):
            own = np.flatnonzero(left == r)
            flips = np.array(masks(low, r), dtype=np.uint64)
            made.append((lower[own][:, None] ^ flips[None, :]).ravel())
            owner.append(np.repeat(rows[own], len(flips)))
        variants, owners = np.concatenate(made), np.concatenate(owner)
        order = np.argsort(variants, kind="stable")
        variants, owners = variants[order], owners[order]
        starts = np.flatnonzero(np.append(True, variants[1:] != variants[:-1]))
        several = np.diff(np.append(starts, len(variants))) > 1
        if not several.any():
            continue
        smallest = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(variants))))
        met = owners != smallest
        pairs = np.unique(owners[met].astype(np.int64) * len(found) + smallest[met])
        a, b = pairs // len(found), pairs % len(found)
        near = np.bitwise_count(found[a] ^ found[b]) <= 2 * radius
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(found))], dtype=np.int64)
    linked = np.flatnonzero(roots != np.arange(len(found)))
    return found[linked], found[roots[linked]]


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node each node of `links` (a, b) is connected with, by star contraction.

    Each round points larger neighbours, then smaller ones, to the smallest neighbour; the number of rounds grows with
    the logarithm of the nodes. Minima are combined before they are sent, and a node with very many neighbours only
    meets its one minimum in a join that Spark can split. Every round is written, so no lineage grows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node whose smallest neighbour is itself keeps its edges: its larger neighbours point to it
        large = large.filter("a > b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        edges = written(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _classes(prints: DataFrame, first: Column) -> DataFrame:
    """fp, root, first (smallest value of `first`) of every distinct fingerprint; equal roots are one component."""
    smallest = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct-prints")
    roots = components(ball_links(smallest))
    return smallest.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def dedup_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id connected, itself included) for every row."""
    prints = written(fingerprints(docs, doc_id=doc_id, text=text), "prints")
    placed = _classes(prints, F.col("doc_id"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def row_hashes(row: Column, schema: StructType, text: str) -> tuple[Column, Column]:
    """Hash of the text, and hash of all fields of a row with which of them are null: together the key of its content."""
    fields = [(row.getField(f.name), isinstance(f.dataType, (ArrayType, MapType, StructType))) for f in schema]
    plain = [F.to_json(F.struct(c.alias("v"))) if deep else c for c, deep in fields]
    return F.xxhash64(row.getField(text)), F.xxhash64(*[c.isNull() for c, _ in fields], *plain)


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, and of several with that id the
    one with the smallest hashes of its text and of its columns. A null id comes after all others.

    Rows travel as one struct, so their columns may have any names. An empty table stays one.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = F.col("row")
    by_text, by_row = row_hashes(whole, docs.schema, text)
    keyed = packed.select("row", by_text.alias("by_text"), by_row.alias("by_row"))
    prints = written(
        per_text(
            keyed.select(whole.getField(doc_id).alias("doc_id"), whole.getField(text).alias("text"), "by_text", "by_row"),
            lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())], "fp long",
            carry={"by_text": F.col("by_text"), "by_row": F.col("by_row")},
        ).groupBy("fp", "doc_id", "by_text", "by_row").agg(F.count(F.lit(1)).alias("n")), "prints",
    )
    least = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "by_text", "by_row", "n")
    keys = ["by_text", "by_row"]
    first = written(
        _classes(prints, least).groupBy("root").agg(F.min("first").alias("first")).select(
            F.col("first.by_text").alias("by_text"), F.col("first.by_row").alias("by_row"), F.col("first.n").alias("n")
        ), "first-of-groups",
    )
    several = written(first.filter("n > 1").select(*keys), "first-of-copies")
    # one way of joining at every size: the keys of a small table would be broadcast, those of a large one not
    once = keyed.join(first.filter("n = 1").select(*keys).hint("merge"), keys, "left_semi").select("row")
    # equal rows: grouped by one value of both keys, so that they are combined before they are sent
    copies = keyed.join(several, keys, "left_semi").groupBy(F.struct(*keys).alias("key")).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(copies).select(*[whole.getField(c).alias(c) for c in docs.columns])


@query()
def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_groups(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
