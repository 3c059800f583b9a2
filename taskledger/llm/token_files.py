"""Token ids in files: canonical length-limited Huffman codes from global counts, decoded by table.

The ids of a document and one end id are counted over the whole table in Spark; the counts give an optimal code of at most
`LIMIT` bits (package-merge), of which only the lengths are stored. Documents are range-partitioned by id and written in
ascending order as blocks of whole documents. A block stands for itself: ids of its documents, their sizes, the codes in
one bit stream, and a checkpoint with the bit offset of every `INTERVAL`th token. All tokens behind checkpoints are decoded
side by side, and a span of tokens can be read from the checkpoint before it. Blocks are rows of Parquet files, so Spark
commits, splits and reads them on any store. The place of a token in the whole is its place in its range of documents
plus the tokens of the ranges before.

Null and empty texts are the end id alone. Rows with a null id come first, equal ids are ordered by a hash of their
tokens, repeated rows are written each. An empty table makes files without blocks. A block has about `BLOCK_TOKENS` tokens; a
longer document is alone in one, and is coded and decoded in slices. Other columns than id and text are not read.
"""

from __future__ import annotations

import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskledger.llm.common import blocks, documents, give_back_memory
from taskledger.llm.packing import vocabulary_path
from taskledger.llm.registry import query
from taskledger.session import fresh_path, ship_package, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
LIMIT = 18
INTERVAL = 256
BLOCK_TOKENS = 1 << 18
SLICE = 1 << 20
RANGE_TOKENS = 1 << 25
CACHED_PARTS = 500_000
TEXT_BYTES = 3 << 20  # encoded together
#: Before a space and such a character every text can be cut: byte-level pre-tokenization begins anew there.
CUT = re.compile(r" (?=[!-~\w])")
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts with none of these can be cut at every space and around every line end: a space or line end beside other white
#: space or at the end of the text, the mark of first parts.
ODD = rf"\x00|[ \n](?:{_WHITE}|\z)|{_WHITE}\n"
FIRST = "\x00"
BATCH_PARTS = 2000


class PartIds:
    """Ids of texts by way of a store of the ids of their parts, cut at spaces before words and around line ends.

    A part stands for itself after a space. The first of a text or line, which has none, is stored behind a mark.
    """

    def __init__(self, path: str, end: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # a byte-level token has a character for each byte; an added token is text
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.flat, self.begin, self.size, self.met = (np.zeros(0, dtype=t) for t in (np.uint32, np.int64, np.int64, np.int64))

    def _forget(self) -> None:
        """Keep the parts met more than once, if they are not too many."""
        kept = np.flatnonzero(self.met > 1)
        kept = kept if len(kept) <= CACHED_PARTS // 2 else kept[:0]
        size = self.size[kept]
        at = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.begin[kept] - at, size) + np.arange(int(size.sum()))]
        self.keys = self.keys.take(pa.array(kept))
        self.begin, self.size, self.met = at, size, np.zeros(len(kept), dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: pa.Array) -> None:
        """Store the ids of new parts."""
        before = len(self.keys)
        # pre-tokenization parts a letter from a mark behind it
        marked = pc.match_substring_regex(fresh, r"\pL[.,]\z") if all(len(i) == 1 for i in self.marks.values()) else pa.array([False] * len(fresh))
        plain, ends = fresh.filter(pc.invert(marked)), fresh.filter(marked)
        stems = pc.utf8_slice_codeunits(ends, 0, -1).dictionary_encode()
        stored = pc.index_in(stems.dictionary, value_set=self.keys)
        more = stems.dictionary.filter(pc.and_(pc.is_null(stored), pc.invert(pc.is_in(stems.dictionary, value_set=plain))))
        plain = pa.concat_arrays([plain, more])
        first = pc.match_substring_regex(plain, r"\A\x00[!-~\pL]+\z")
        alone = pc.and_(pc.starts_with(plain, FIRST), pc.invert(first))
        made: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        single = [plain.filter(alone)]
        for chosen, between in ((pc.invert(pc.or_(first, alone)), " "), (first, "\n")):
            own = plain.filter(chosen)
            for at in range(0, len(own), BATCH_PARTS):
                part = own[at: at + BATCH_PARTS]
                joined = self._joined(part, between)
                if joined:
                    made.append((part, *joined))
                else:
                    single.append(part)
        for part in single:
            texts = [p[1:] if p[:1] == FIRST else " " + p for p in part.to_pylist()]
            ids = self._encode(texts)
            made.append((part, np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate([np.zeros(0, np.uint32), *ids])))
        keys, sizes = pa.concat_arrays([k for k, _, _ in made]), np.concatenate([n for _, n, _ in made])
        self._add(keys, sizes, [i for _, _, i in made])
        if len(ends):
            found = pc.coalesce(stored.cast(pa.int64()), pc.add(pc.index_in(stems.dictionary, value_set=keys), before).cast(pa.int64()))
            at = found.to_numpy()[stems.indices.to_numpy()]
            n = self.size[at]
            whole = np.empty(int(n.sum()) + len(n), dtype=np.uint32)
            place = np.arange(int(n.sum()))
            whole[place + np.repeat(np.arange(len(n)), n)] = self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + place]
            stop = pc.ends_with(ends, ".").to_numpy(zero_copy_only=False)
            whole[np.cumsum(n + 1) - 1] = np.where(stop, self.marks["."][0], self.marks[","][0])
            self._add(ends, n + 1, [whole])

    def _add(self, keys: pa.Array, sizes: np.ndarray, ids: list[np.ndarray]) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.begin = np.concatenate([self.begin, np.cumsum(sizes) - sizes + len(self.flat)])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, *ids])
        self.met = np.concatenate([self.met, np.zeros(len(sizes), dtype=np.int64)])

    def _joined(self, parts: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The number of ids of each part, and the ids: parts one after the other, each behind a space or a line end, are a text whose tokens keep to their borders."""
        texts = pc.utf8_slice_codeunits(parts, 1) if between == "\n" else parts
        ids = self._encode([between + between.join(texts.to_pylist())])[0]
        ends = np.cumsum(pc.binary_length(texts).to_numpy() + 1)
        upto = np.cumsum(self.bytes[ids])
        last = np.searchsorted(upto, ends)
        if last[-1] >= len(ids) or (upto[last] != ends).any():
            return None
        before = np.append(-1, last[:-1])
        if between == "\n":  # the line ends have tokens of their own
            before += 1
            if (ids[before] != ids[0]).any() or (upto[before] != np.append(0, ends[:-1]) + 1).any():
                return None
            ids = np.delete(ids, before)
        return last - before, ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's with its end id, and the number of ids of each."""
        if len(self.keys) > CACHED_PARTS:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD)
        plain = texts.filter(pc.invert(odd))
        mark, nothing = pa.scalar(FIRST, pa.large_string()), pa.scalar("", pa.large_string())
        split = [CUT.split(t) for t in texts.filter(odd).to_pylist()]
        for own in split:
            own[0] = FIRST + own[0]
        plain = pc.replace_substring(pc.binary_join_element_wise(mark, plain, nothing), "\n", f" {FIRST}\n {FIRST}")
        lists = pc.split_pattern(plain, " ")
        per_row = np.concatenate([pc.list_value_length(lists).to_numpy(), np.fromiter(map(len, split), np.int64, len(split))]).astype(np.int64)
        rest = pa.array(list(itertools.chain.from_iterable(split)), pa.large_string())
        coded = pa.concat_arrays([lists.flatten(), rest]).dictionary_encode()
        met = pc.index_in(coded.dictionary, value_set=self.keys)
        if met.null_count:
            before, fresh = len(self.keys), coded.dictionary.filter(pc.is_null(met))
            self._learn(fresh)
            learned = pc.add(pc.index_in(fresh, value_set=self.keys[before:]), before)
            met = pc.replace_with_mask(met.cast(pa.int64()), pc.is_null(met), learned.cast(pa.int64()))
        known = met.to_numpy()
        self.met[known] += 1
        # back to the order of the texts
        is_odd = odd.to_numpy(zero_copy_only=False)
        place = np.empty(len(is_odd), dtype=np.int64)
        place[np.append(np.flatnonzero(~is_odd), np.flatnonzero(is_odd))] = np.arange(len(is_odd))
        begin = (np.cumsum(per_row) - per_row)[place]
        per_row = per_row[place]
        moved = np.repeat(begin - (np.cumsum(per_row) - per_row), per_row) + np.arange(int(per_row.sum()))
        rows = known[coded.indices.to_numpy()[moved]]
        size = self.size[rows]
        last = np.cumsum(size)
        per_text = np.diff(np.append(0, last)[np.append(0, np.cumsum(per_row))])
        ids = np.full(int(size.sum()) + len(per_row), self.end, dtype=np.uint32)
        place = np.arange(int(size.sum()))
        ids[place + np.repeat(np.arange(len(per_row)), per_text)] = self.flat[np.repeat(self.begin[rows] - (last - size), size) + place]
        return ids, per_text + 1


_stores: dict[str, PartIds] = {}


def part_ids(path: str) -> PartIds:
    """One store for each worker process, so that its tasks share the tokenizer."""
    if path not in _stores:
        _stores[path] = PartIds(path)
    return _stores[path]


def release() -> None:
    """Clear the stores of this worker and give their memory back to the system."""
    for store in _stores.values():
        store.clear()
    give_back_memory()


def token_ids(docs: DataFrame, *, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, unsigned), width (their bytes: two if the vocabulary allows) for every row, and a row with the
    counts of all ids for every task."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = part_ids(path), np.zeros(0, dtype=np.int64)
        for block in blocks(batches, "_text", TEXT_BYTES):
            ids, sizes = encode(block.column(1))
            n = block.num_rows
            own = np.bincount(ids, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
            offsets = np.append(0, np.cumsum(sizes) * encode.width).astype(np.int64)
            stored = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{encode.width}"))])
            yield pa.RecordBatch.from_arrays(
                [block.column(0), stored.cast(pa.binary()), pa.array([encode.width] * n, pa.int32()), pa.nulls(n, counted)], schema=schema,
            )
        there = np.flatnonzero(counts)
        if len(there):
            both = pa.StructArray.from_arrays([pa.array(there), pa.array(counts[there])], ["id", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, schema.field(0).type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), both)], schema=schema,
            )
        release()  # the store serves one task: what a worker keeps between tasks is the tokenizer

    counted = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("doc_id", _arrow(narrow, "doc_id")), ("ids", pa.binary()), ("width", pa.int32()), ("counts", counted)])
    return narrow.mapInArrow(run, f"doc_id {kind}, ids binary, width int, counts array<struct<id:bigint,n:bigint>>")


def count_ids(tokens: DataFrame) -> list[tuple[int, int]]:
    """(id, how often it occurs) for all ids: at most one for each entry of the vocabulary comes to the driver."""
    summed = tokens.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    return sorted((r["id"], r["n"]) for r in summed.collect())


def code_lengths(counts: list[int], limit: int = LIMIT) -> list[int]:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge."""
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} symbols do not fit in codes of {limit} bits")
    if len(counts) < 2:
        return [1] * len(counts)
    order = np.argsort(np.array(counts), kind="stable")
    leaves = np.array(counts, dtype=np.float64)[order]
    n, packages, chosen = len(leaves), np.zeros(0), []
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        by_weight = np.argsort(weights, kind="stable")
        chosen.append(by_weight < n)  # which items of this level are leaves, lightest first
        sums = weights[by_weight]
        packages = sums[0: len(sums) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(chosen):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1  # leaves of one level are taken from the rarest on
        take = 2 * (take - own)
    made = np.zeros(n, dtype=np.int64)
    made[order] = lengths
    return made.tolist()


class Code:
    """The canonical code of symbols (ids ascending) with these lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.limit = int(lengths.max(initial=1))
        by_length = np.lexsort((symbols, lengths))
        n = lengths[by_length].astype(np.int64)
        share = np.int64(1) << (self.limit - n)  # entries of the table that begin with a code
        first = np.cumsum(share) - share
        most = int(symbols.max(initial=0)) + 1
        self.codes, self.sizes = np.zeros(most, dtype=np.uint64), np.zeros(most, dtype=np.int64)
        self.codes[symbols[by_length]] = first >> (self.limit - n)
        self.sizes[symbols[by_length]] = n
        self.symbol = np.repeat(symbols[by_length], share).astype(np.uint32)
        self.size = np.repeat(n, share)
        rest = (1 << self.limit) - len(self.symbol)  # a single symbol has a code of one bit
        self.symbol, self.size = np.append(self.symbol, np.zeros(rest, np.uint32)), np.append(self.size, np.ones(rest, np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, first bit highest, and the bit offset of every INTERVALth id."""
        parts, offsets, done = [], [], 0
        for at in range(0, len(ids), SLICE):
            own = ids[at: at + SLICE]
            n = self.sizes[own]
            start = np.cumsum(n) - n
            offsets.append(done + start[::INTERVAL])
            parts.append(_bits(self.codes[own], n, start))
            done += 8 * len(parts[-1])
        return b"".join(parts), np.concatenate(offsets) if offsets else np.zeros(0, dtype=np.int64)

    def decode(self, stream: bytes, offsets: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from place `first` up to `last` (all: to `n`), read from the checkpoints before them."""
        last = n if last is None else min(last, n)
        data = np.frombuffer(stream + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        begin, end = first // INTERVAL, -(-last // INTERVAL)
        out = np.zeros((end - begin) * INTERVAL, dtype=np.uint32)
        shift, mask = 32 - self.limit, (1 << self.limit) - 1
        for at in range(begin, end, SLICE // INTERVAL):
            bit = offsets[at: min(end, at + SLICE // INTERVAL)].astype(np.int64)
            made = np.empty((INTERVAL, len(bit)), dtype=np.uint32)
            most = 8 * (len(window) - 1)
            for k in range(INTERVAL):
                entry = (window[bit >> 3] >> (shift - (bit & 7)).astype(np.uint32)) & mask
                made[k] = self.symbol[entry]
                bit = np.minimum(bit + self.size[entry], most)  # what lies behind the last id is not returned
            rows = made.T.reshape(-1)
            out[(at - begin) * INTERVAL: (at - begin) * INTERVAL + len(rows)] = rows
        return out[first - begin * INTERVAL: last - begin * INTERVAL]


def _bits(codes: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> bytes:
    """Codes written one after the other into 64-bit words; a code that crosses a border leaves its end in the next word."""
    total = int(start[-1] + sizes[-1])
    word, room = start >> 6, 64 - (start & 63) - sizes
    over = room < 0
    high = np.where(over, codes >> (-np.minimum(room, 0)).astype(np.uint64), codes << np.maximum(room, 0).astype(np.uint64))
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[begins]] = np.bitwise_or.reduceat(high, begins)
    words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: -(-total // 8)]


def write_ids(tokens: DataFrame, folder: str, *, limit: int = LIMIT, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the rows of `token_ids` below `folder`: `code` (id and length of each code) and `blocks`."""
    spark = tokens.sparkSession
    ship_package(spark)
    stored = written(tokens, "token-ids")
    counts = count_ids(stored)
    lengths = code_lengths([n for _, n in counts], limit)
    spark.createDataFrame(
        [(i, n) for (i, _), n in zip(counts, lengths, strict=True)], "id long, size int"
    ).coalesce(1).write.parquet(f"{folder}/code")
    table = (np.array([i for i, _ in counts], dtype=np.int64), np.array(lengths, dtype=np.int64))
    kind = stored.schema["doc_id"].dataType.simpleString()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sum(n for _, n in counts) / RANGE_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, place, number = Code(*table), 0, 0
        for piece, doc_ids, sizes, ids in _in_blocks(batches, block_tokens):
            stream, offsets = code.encode(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([number], pa.int64()), pa.array([place], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                 pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes)),
                 pa.array([stream], pa.binary()), pa.array([offsets.astype("<i8").tobytes()], pa.binary())], names=names,
            )
            place, number = place + len(ids), number + 1

    names = ["piece", "number", "place", "n_tokens", "doc_ids", "sizes", "stream", "checkpoints"]
    order = ["doc_id", "_hash", "_row"]
    stored.filter("counts IS NULL").withColumns({"_hash": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()}).repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "doc_id", "ids", F.spark_partition_id().alias("piece"), "width"
    ).mapInArrow(
        run, f"piece int, number long, place long, n_tokens long, doc_ids array<{kind}>, sizes array<bigint>, stream binary, checkpoints binary"
    ).write.parquet(f"{folder}/blocks")


def _in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """piece, document ids, sizes and ids of runs of whole documents with at most `most` ids (a longer one is alone)."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    waiting, piece = 0, 0

    def block() -> tuple[int, pa.Array, np.ndarray, np.ndarray]:
        docs, sizes, ids = zip(*held, strict=True)
        held.clear()
        return piece, pa.concat_arrays(docs), np.concatenate(sizes), np.concatenate(ids)

    for batch in batches:
        if not batch.num_rows:
            continue
        piece = batch.column(2)[0].as_py()
        widths = batch.column(3).to_numpy()
        lengths = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
        # rows of one width follow each other as one stretch of bytes
        for first, last in _runs(widths):
            part = batch.slice(first, last - first)
            column = part.column(1)
            begin = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
            width, size = int(widths[first]), lengths[first:last] // int(widths[first])
            whole = np.frombuffer(column.buffers()[2], dtype=f"<u{width}", count=int(size.sum()), offset=int(begin))
            at, upto = 0, np.cumsum(size)
            while at < len(size):
                done = int(upto[at - 1]) if at else 0
                end = max(int(np.searchsorted(upto, done + most - waiting, side="right")), at if held else at + 1)
                if end > at:
                    held.append((part.column(0).slice(at, end - at), size[at:end], whole[done: int(upto[end - 1])]))
                    waiting += int(upto[end - 1]) - done
                at = end
                if at < len(size):  # the next document does not fit in
                    yield block()
                    waiting = 0
    if held:
        yield block()


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def read_ids(spark: SparkSession, folder: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32 bit) of every document in the files."""
    ship_package(spark)
    listed = spark.read.parquet(f"{folder}/code").orderBy("id").toArrow()  # one row for each entry of the vocabulary at most
    table = (listed.column("id").to_numpy(), listed.column("size").to_numpy())
    stored = spark.read.parquet(f"{folder}/blocks")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = stored.groupBy("piece").agg(F.sum("n_tokens").alias("n")).select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*table)
        for batch in batches:
            for k in range(batch.num_rows):
                first, n, ids, sizes, stream, offsets = (c[k] for c in batch.columns)
                sizes = sizes.values.to_numpy()
                whole = code.decode(stream.as_py(), np.frombuffer(offsets.as_py(), dtype="<i8"), n.as_py())
                data = memoryview(whole.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                start = ends - sizes
                for at in range(0, len(sizes), 1024):
                    spans = list(zip((4 * start[at: at + 1024]).tolist(), (4 * ends[at: at + 1024]).tolist(), strict=True))
                    columns = [
                        ids.values[at: at + 1024], pa.array(first.as_py() + start[at: at + 1024]), pa.array(sizes[at: at + 1024]),
                        pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([data[a:b] for a, b in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored.join(F.broadcast(starts), "piece").select(
        (F.col("first") + F.col("place")).alias("first"), "n_tokens", "doc_ids", "sizes", "stream", "checkpoints"
    ).mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


@query()
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written below the shared folder and read back."""
    target = fresh_path(spark, "token-files")
    write_ids(token_ids(documents(spark, folder), path=vocabulary_path(VOCABULARY)), target)
    return read_ids(spark, target, with_ids=False)
