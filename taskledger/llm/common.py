"""What the operators on texts share: bounded blocks of rows, the word rule, splits by id, a small logistic fit."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.session import ship_package

BLOCK_BYTES = 4 << 20
BATCH_ROWS = 1000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: exactly what bytes.split() takes for words. Null has none."""
    return text.split() if text else []


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of text (a longer text is alone in its slice)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(
            pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64
        )
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, column  # not held while the next one is read


def groups(parts: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """The same batches in lists of at most `limit` bytes of text (a larger one is alone in its list)."""
    group, held = [], 0
    for part in parts:
        size = pc.sum(pc.binary_length(part.column(part.schema.get_field_index(text)))).as_py() or 0
        if group and held + size > limit:
            yield group
            group, held = [], 0
        group.append(part)
        held += size
        del part
    if group:
        yield group


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is run inside sends Python workers at most `rows` rows at once: 10,000 long texts, as is usual, are tens of MB that
    the JVM and the worker both hold beside the block in work."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    usual = int(spark.conf.get(name, "10000"))
    spark.conf.set(name, str(min(usual, rows) if usual > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def binary(column: pa.Array) -> list[bytes | None]:
    """Texts of a block as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def per_text(
    docs: DataFrame,
    judge: Callable[[list[bytes | None]], list[pa.Array]],
    schema: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: dict[str, Column] | None = None,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: its id, the `carry` columns, then the columns that `judge` makes of a block of texts.

    Columns of `docs` other than the id and the text are not read, so their names cannot clash.
    """
    ship_package(docs.sparkSession)
    carry = carry or {}
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), *[c.alias(name) for name, c in carry.items()], F.col(text).alias("_text")
    )
    head = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text", limit):
            made = judge(binary(block.column(len(head))))
            names = [*head, *[f"_{i}" for i in range(len(made))]]
            yield pa.RecordBatch.from_arrays([*block.columns[: len(head)], *made], names=names)

    kinds = [f"{name} {narrow.schema[name].dataType.simpleString()}" for name in head]
    made = [part.strip().split(" ") for part in schema.split(",")]
    out = narrow.mapInArrow(run, ", ".join([*kinds, *[f"_{i} {kind}" for i, (_, kind) in enumerate(made)]]))
    return out.select(*head, *[F.col(f"_{i}").alias(name) for i, (name, _) in enumerate(made)])


def keep_rows(docs: DataFrame, keep: Callable[[list[bytes | None]], list[bool]], text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text `keep` accepts. Columns go by number, so they may have any names."""
    ship_package(docs.sparkSession)
    at = docs.columns.index(text)
    numbered = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, f"_{at}"):
            yield block.filter(pa.array(keep(binary(block.column(at))), pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def give_back_memory(*, cycles: bool = True) -> None:
    """At the end of a task: what it has freed goes back to the system, so that idle workers hold little. Without `cycles`,
    objects that refer to each other stay; looking for them takes some 50 ms, within a task too."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, which gives back its memory when it is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back_memory()

    return wrapped


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    weight = np.ones(len(y)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = logistic(x @ beta)
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x.T * (weight * p * (1 - p))) @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
