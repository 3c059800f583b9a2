"""Repeated passages: Rabin-Karp hashes of every window of `window` consecutive words, counted in Spark.

Rows are dealt into blocks by a hash, each of about `BLOCK_BYTES` of text. A block hashes all its windows and sends each
distinct hash once, with the smallest document id it has there, to the bucket of the hash's leading bits. As columns of
sorted hashes these take about a third of what rows would. A bucket finds for every hash the smallest id of all blocks
and tells each block whose own smallest id is larger which of its hashes occur earlier elsewhere. A block then knows for
each of its windows whether its word sequence also starts in a document with a smaller id; overlapping windows merge
into maximal intervals, and the words in them are removed.

A very frequent window is one entry for each block, however often it occurs. Hashes have 64 bits of a polynomial over
64-bit word hashes; two different windows among n collide with probability of about n^2 / 2^65.

Null texts have no words. Texts shorter than a window lose nothing. Rows with the same id do not remove each other's
windows. A null id counts as larger than all ids. Ids of any type that Spark orders will do; those that are no whole numbers
are numbered first, which joins the texts with the numbers once. An empty table gives no rows; columns other than id and
text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from taskledger.llm.common import binary, documents
from taskledger.llm.merkle_manifest import numbered
from taskledger.llm.registry import query
from taskledger.session import ship_package

WINDOW = 13
BLOCK_BYTES = 8 << 20
BUCKET_WINDOWS = 1 << 21
GROWS_FROM, MOST_GROWTH = 10 << 30, 4.0
BYTES_PER_WORD = 6  # only to choose the number of buckets
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def window_hashes(found: list[bytes], size: int = WINDOW) -> np.ndarray:
    """Hash of every window of `size` words, in order."""
    if len(found) < size:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w) for w in found), dtype=np.uint64, count=len(found))
    n = len(found) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + one[i: i + n]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _block_windows(ids: np.ndarray, texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a block, sorted, and the smallest id each has in it."""
    order = np.argsort(ids, kind="stable")
    parts = [window_hashes(texts[i].split() if texts[i] else [], size) for i in order]
    hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
    owners = np.repeat(ids[order], [len(p) for p in parts])
    del parts
    distinct, first = np.unique(hashes, return_index=True)  # the first of equal ones, so the smallest id
    return distinct, owners[first]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy().astype(np.int64)


def _texts(column: pa.ChunkedArray) -> list[bytes | None]:
    return [t for chunk in column.chunks for t in binary(chunk)]


def layout(total: int) -> tuple[int, int]:
    """Number of blocks for so many bytes of text, and leading bits that choose a bucket.

    A block sends an entry to each bucket. Both grow with the root of the input, to four times their size, so entries
    stay long: beyond `GROWS_FROM` bytes their number grows with the input, not with its square, up to 16 times that.
    """
    factor = min(MOST_GROWTH, max(1.0, math.sqrt(total / GROWS_FROM)))
    blocks = max(1, math.ceil(total / (BLOCK_BYTES * factor)))
    return blocks, max(0, math.ceil(math.log2(max(1, total / BYTES_PER_WORD / (BUCKET_WINDOWS * factor)))))


def _placed(narrow: DataFrame) -> DataFrame:
    """id, doc_id (the id as a number, or its place among all ids in ascending order), _text."""
    if isinstance(narrow.schema["id"].dataType, IntegralType):
        return narrow.withColumn("doc_id", F.col("id").cast("long"))
    ids = numbered(narrow.select("id").filter("id IS NOT NULL").distinct(), ["id"], "doc_id")
    return narrow.join(ids, "id", "left")


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, with_text: bool = False
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, removed (intervals of word positions, end
    exclusive) and, if asked for, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    ship_package(spark)
    narrow = _placed(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("_text")))
    total = narrow.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_blocks, bits = layout(total)
    dealt = narrow.withColumn("_block", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(n_blocks)).cast("long"))

    def send(table: pa.Table) -> pa.Table:
        distinct, smallest = _block_windows(_ids(table.column("doc_id")), _texts(table.column("_text")), size)
        block = table.column("_block")[0].as_py() if table.num_rows else 0
        if not len(distinct):
            return pa.table({"bucket": [], "block": [], "floor": [], "hashes": [], "ids": []}, schema=sent_schema)
        bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), dtype=np.int64)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(starts[1:], len(bucket))
        floor = int(smallest.min())
        above = (smallest - floor).astype(np.uint64)
        return pa.table({
            "bucket": bucket[starts], "block": [block] * len(starts), "floor": [floor] * len(starts),
            "hashes": [pack_sorted(distinct[a:b]) for a, b in zip(starts, ends, strict=True)],
            "ids": [pack(above[a:b]) for a, b in zip(starts, ends, strict=True)],
        }, schema=sent_schema)

    sent_schema = pa.schema([
        ("bucket", pa.int64()), ("block", pa.int64()), ("floor", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary())
    ])

    def compare(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        hashes = [unpack_sorted(h) for h in table.column("hashes").to_pylist()]
        ids = [
            unpack(i).astype(np.int64) + floor
            for i, floor in zip(table.column("ids").to_pylist(), table.column("floor").to_pylist(), strict=True)
        ]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        lowest = np.full(len(distinct), NO_ID, dtype=np.int64)
        np.minimum.at(lowest, place, np.concatenate(ids))
        out, at = [], 0
        for block, own, own_ids in zip(blocks, hashes, ids, strict=True):
            earlier = lowest[place[at: at + len(own)]] < own_ids
            at += len(own)
            if earlier.any():
                out.append((block, pack_sorted(own[earlier])))
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "earlier": pa.array([o[1] for o in out], pa.binary())})

    def settle(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts = _ids(table.column("doc_id")), _texts(table.column("_text"))
        distinct, smallest = _block_windows(ids, texts, size)
        known = [unpack_sorted(e) for e in told.column("earlier").to_pylist()]
        elsewhere = np.zeros(len(distinct), dtype=bool)
        if known:
            elsewhere[np.searchsorted(distinct, np.concatenate(known))] = True
        rows = [_row(own, t, distinct, smallest, elsewhere, size, with_text) for own, t in zip(ids.tolist(), texts, strict=True)]
        columns = [table.column("id").combine_chunks()]
        for i, kind in enumerate(_KINDS if with_text else _KINDS[:-1]):
            columns.append(pa.array([r[i] for r in rows], kind))
        return pa.Table.from_arrays(columns, names=_NAMES if with_text else _NAMES[:-1])

    flags = dealt.groupBy("_block").applyInArrow(
        send, "bucket long, block long, floor long, hashes binary, ids binary"
    ).groupBy("bucket").applyInArrow(compare, "block long, earlier binary")
    kind = narrow.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:long,last:long>>"
    return dealt.groupBy("_block").cogroup(flags.groupBy("block")).applyInArrow(
        settle, schema + (", kept_text string" if with_text else "")
    )


_INTERVALS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_KINDS = [pa.int64(), pa.int64(), pa.string(), _INTERVALS, pa.string()]
_NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"]


def _row(own: int, text: bytes | None, distinct, smallest, elsewhere, size: int, with_text: bool) -> tuple:
    found = text.split() if text else []
    hashes = window_hashes(found, size)
    kept, intervals = found, []
    if len(hashes):
        place = np.searchsorted(distinct, hashes)
        repeated = np.flatnonzero(elsewhere[place] | (smallest[place] < own))
        intervals = list(merged(repeated, size))
        if intervals:
            kept, at = [], 0
            for first, last in intervals:
                kept += found[at:first]
                at = last
            kept += found[at:]
    joined = b" ".join(kept)
    return (
        len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(),
        [{"first": a, "last": b} for a, b in intervals], joined.decode() if with_text else None,
    )


def merged(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Maximal intervals (end exclusive) covered by windows of `size` words that begin at `starts` (ascending)."""
    if not len(starts):
        return
    breaks = np.flatnonzero(np.diff(starts) > size)
    first = np.append(starts[:1], starts[breaks + 1])
    last = np.append(starts[breaks], starts[-1:]) + size
    yield from zip(first.tolist(), last.tolist(), strict=True)


@query("""
WITH tokens AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM tokens WHERE len(w) >= 13)
), firsts AS (
    SELECT key, min(doc_id) AS first FROM windows GROUP BY key
), removed AS (
    SELECT DISTINCT doc_id, p FROM (
        SELECT w.doc_id, unnest(range(w.i, w.i + 13)) AS p
        FROM windows w JOIN firsts f ON w.key = f.key WHERE f.first < w.doc_id)
), gone AS (
    SELECT doc_id, list(p) AS ps, count(*) AS n FROM removed GROUP BY doc_id
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM tokens
), kept AS (
    SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS text
    FROM words a LEFT JOIN removed r ON a.doc_id = r.doc_id AND a.p = r.p WHERE r.p IS NULL GROUP BY a.doc_id
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM tokens t LEFT JOIN gone g ON g.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
""")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder)).drop("removed")
