"""Best-fit packing: documents as token ids, cut only where longer than a sequence, packed best-fit decreasing.

Pieces are sorted by falling length. A segment tree over remaining capacities finds the tightest open bin that still
takes a piece in logarithmic time. Pieces are dealt at random into groups of about `GROUP_PIECES`, each packed in one
task, so no task holds the corpus; a group ends with at most a few bins that are not full. Those are what lies above the
lower bound of tokens / sequence length.

The tokenizer works on words between white space, so a word's ids are computed once and kept by the worker process. A document is its ids and
one end id (0). Null and empty texts are the end id alone. Repeated rows are packed once each, also with a null id; pieces
of equal length are taken in any order. An empty table gives no pieces, other columns than id and text are not read.
"""

from __future__ import annotations

import importlib
import itertools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.llm.common import binary, blocks, documents
from taskledger.llm.registry import query
from taskledger.session import ship_package, written

SEQUENCE = 2048
GROUP_PIECES = 200_000
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    return importlib.import_module("public_tokenizers").path(name)


class Index(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _byte_characters() -> dict[int, int]:
    """Byte-level models write printable Latin-1 bytes as themselves and number the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()


class WordIds:
    """Token ids of texts by way of a store of the ids of each word.

    The tokenizer puts letters in lower case and separates them from what follows. So words are stored in lower case
    (A-Z), and the ids of a word that ends in a letter and one full stop or comma are those of both parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # these are matched before anything is put in lower case
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = {mark: self.tokenizer.encode(mark.decode(), add_special_tokens=False).ids for mark in (b".", b",")}
        self.plain_letters = self._same_letters()
        self.index = Index()
        self.flat, self.begin, self.size = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int64)

    def _letters(self, word: bytes) -> str | None:
        """A word of small Latin letters as the model's byte characters: nothing before the model changes or cuts it.

        None for other words, and for all if this tokenizer treats such words in another way.
        """
        if not self.plain_letters:
            return None
        if word.isalpha():
            return word.decode()
        if word.isascii():
            return None
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and text == text.lower():
            return word.decode("latin-1").translate(_BYTE_CHARACTERS)
        return None

    def _same_letters(self) -> bool:
        self.plain_letters = True
        samples = (b"token", b"stra\xc3\x9fe", b"\xc3\xb1and\xc3\xba", b"\xc3\xa0\xc4\x8d")
        return all(
            [t.id for t in self.tokenizer.model.tokenize(self._letters(w))]
            == self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in samples
        )

    def _forget(self) -> None:
        """Keep the words that have been met again, if they are not too many."""
        kept = np.flatnonzero(self.met > 1)
        kept = kept if len(kept) <= CACHED_WORDS // 2 else kept[:0]
        words = list(self.index)
        size = self.size[kept]
        at = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.begin[kept] - at, size) + np.arange(int(size.sum()))]
        self.index = Index((words[k], i) for i, k in enumerate(kept.tolist()))
        self.begin, self.size, self.met = at, size, np.zeros(len(kept), dtype=np.int64)

    def _learn(self, before: int) -> None:
        """Store the ids of the words numbered from `before` on, and of stems they bring along."""
        index = self.index
        stems = {}
        for w in list(itertools.islice(index, before, None)):
            if w[-1:] in self.ends and len(w) > 1 and 97 <= w[-2] <= 122:
                stems[w] = index[w[:-1]]
        fresh = list(itertools.islice(index, before, None))
        tokenize = self.tokenizer.model.tokenize
        letters = [self._letters(w) if w not in stems else None for w in fresh]
        whole = [w.decode() for w, own in zip(fresh, letters, strict=True) if own is None and w not in stems]
        encoded = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))
        made: list[list[int]] = [
            [token.id for token in tokenize(own)] if own is not None else [] if w in stems else next(encoded).ids
            for w, own in zip(fresh, letters, strict=True)
        ]
        for i, w in enumerate(fresh):
            if w in stems:
                k = stems[w]
                stem = made[k - before] if k >= before else self.flat[self.begin[k]: self.begin[k] + self.size[k]].tolist()
                made[i] = stem + self.ends[w[-1:]]
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        flat = np.fromiter(itertools.chain.from_iterable(made), dtype=np.uint32, count=int(size.sum()))
        self.begin = np.concatenate([self.begin, np.cumsum(size) - size + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.met = np.concatenate([self.met, np.zeros(len(size), dtype=np.int64)])

    def _words(self, text: bytes) -> list[bytes]:
        """Words in lower case; those with an added token, in whatever case, as they are."""
        small = text.lower()
        if not any(a in small for a in self.added):
            return small.split()
        return [
            word if any(a in low for a in self.added) else low
            for word, low in zip(text.split(), small.split(), strict=True)
        ]

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words one after the other, and how many each text has."""
        plain = pc.fill_null(texts if pa.types.is_large_string(texts.type) else texts.cast(pa.string()).cast(pa.large_string()), "")
        # copied first: the kernel misplaces the characters of an array that is a slice of another
        small = pc.ascii_lower(pa.concat_arrays([plain, pa.array([], pa.large_string())]))
        if any(pc.any(pc.match_substring(small, a.decode())).as_py() for a in self.added):
            split = [self._words(t) if t else [] for t in binary(texts)]
            flat = list(itertools.chain.from_iterable(split))
            rows = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
            return rows, np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        # each distinct word of the block is looked up once; white space beside other makes empty words, which have no ids
        for white in "\t\n\x0b\x0c\r":
            small = pc.replace_substring(small, white, " ")
        lists = pc.split_pattern(small, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        known = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        return known[coded.indices.to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64)

    def __call__(self, texts: pa.Array | list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with its end id, and the number of ids of each."""
        if len(self.index) > CACHED_WORDS:
            self._forget()
        before = len(self.index)
        rows, n_words = self._numbered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        if len(self.index) > before:
            self._learn(before)
        self.met += np.bincount(rows, minlength=len(self.met))
        size = self.size[rows]
        last = np.cumsum(size)
        ends = np.append(0, np.cumsum(n_words))
        per_text = np.diff(np.append(0, last)[ends])
        # every id moves on by the end ids of the texts before it
        shift = np.repeat(np.arange(len(n_words)), per_text)
        ids = np.full(int(size.sum()) + len(n_words), END_ID, dtype=np.uint32)
        at = np.arange(len(shift))
        ids[at + shift] = self.flat[np.repeat(self.begin[rows] - (last - size), size) + at]
        return ids, per_text + 1


_stores: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One store for each worker process, so that tasks share it."""
    if path not in _stores:
        _stores[path] = WordIds(path)
    return _stores[path]


def pieces(
    docs: DataFrame, *, path: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every row."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for block in blocks(batches, "_text", 2 << 20):
            ids, sizes = encode(block.column(1))
            data = memoryview(ids.astype("<u4").tobytes())
            counts = -(-sizes // sequence)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * sequence
            length = np.minimum(sequence, sizes[row] - start)
            at = (np.cumsum(sizes) - sizes)[row] + start
            crc = [zlib.crc32(data[4 * a: 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Capacities:
    """Segment tree over remaining capacities 0..most: which of them an open bin has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, bin_id: int) -> None:
        self.bins[capacity].append(bin_id)
        self._count(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out a bin with the smallest capacity of at least `need`: (capacity, bin)."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._count(capacity, -1)
        return capacity, self.bins[capacity].pop()

    def _count(self, capacity: int, change: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += change
            at >>= 1


def best_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins, n = Capacities(sequence), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_bins.tightest(need)
        capacity, at = found or (sequence, n)
        n += found is None
        bins[i], offsets[i] = at, sequence - capacity
        if capacity > need:
            open_bins.add(capacity - need, at)
    return bins, offsets


def pack(cut: DataFrame, *, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset."""
    stored = written(cut, "pieces")
    groups = max(1, math.ceil(stored.count() / group_pieces))
    dealt = stored.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bins, offsets = best_fit(table.column("length").to_numpy(), sequence)
        own = table.drop_columns(["_group"])
        return own.append_column("sequence_id", pa.array(bins * groups + key[0].as_py())).append_column("offset", pa.array(offsets))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return dealt.groupBy("_group").applyInArrow(fill, f"{kinds}, sequence_id long, offset long")


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(pieces(documents(spark, folder), path=vocabulary_path()))
