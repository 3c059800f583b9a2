"""Compression classifier: zstandard dictionaries of good and of bad texts; compressed sizes become a score.

A text close to the good samples is compressed better with their dictionary than with that of the bad ones. The
difference of both sizes, normalised by the larger one and by the text's length, goes with the plain compressed size
through a logistic calibration, which is fitted on labelled texts that no dictionary has seen.

Fitting uses a bounded sample: at most `per_class` labelled rows of each class (the smallest hashes of the ids), of
texts of at most `max_sample_chars` characters. Scoring takes every whole text. Null and empty texts get the score of
an empty text. Rows with a null label are not learned from; a label table with several rows for a document counts each.
Without labels of both classes every score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.llm.common import documents, fit_logistic, keep_rows, logistic, per_text, remainder
from taskledger.llm.registry import query

PER_CLASS = 4000
MAX_SAMPLE_CHARS = 50_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    """Both dictionaries as bytes, the calibration's weights, and the score to give if there are none."""

    good: bytes
    bad: bytes
    beta: list[float]
    prior: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.beta:
            return np.full(len(texts), self.prior)
        return logistic(_features(texts, *self._compressors()) @ np.array(self.beta))

    def _compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        found = self.__dict__.get("_made")
        if found is None:
            found = self.__dict__["_made"] = _compressors(self.good, self.bad)
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, ...]:
    form = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
    made = []
    for content in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, **form))
    return (*made, zstandard.ZstdCompressor(**form))


def _features(texts: list[bytes | None], good, bad, plain) -> np.ndarray:
    rows = []
    for text in texts:
        text = text or b""
        size = len(text) + 1
        g, b, p = len(good.compress(text)), len(bad.compress(text)), len(plain.compress(text))
        difference, length = (g - b) / max(g, b), math.log(size) / 10
        rows.append((1.0, difference, length, g / size, (g - b) / size, p / size, difference * length))
    return np.array(rows, dtype=float).reshape(-1, 7)


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their raw content serves as well
        return b"\n".join(texts)[:DICTIONARY_BYTES].ljust(8, b"\n")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", per_class: int = PER_CLASS, max_sample_chars: int = MAX_SAMPLE_CHARS,
) -> Model:
    """Fit from the rows of `docs` where `learn` holds and `labels` has 1 (good) or 0 (bad)."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)")
    texts = docs.filter(learn).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    counted = {r[0]: r[1] for r in known.join(texts.select("_id"), "_id").groupBy("_label").count().collect()}
    total = sum(counted.values())
    prior = counted.get(1, 0) / total if total else 0.5
    if len(counted) < 2:
        return Model(b"", b"", [], prior)
    fits = texts.filter(f"length(_text) between 1 and {max_sample_chars}")
    hashed = fits.withColumn("_hash", F.xxhash64("_text"))
    ids = known.join(hashed.select("_id", "_hash"), "_id")
    order = (F.xxhash64("_id", F.lit("sample")), F.col("_id"), F.col("_hash"))
    chosen = ids.filter("_label = 1").orderBy(*order).limit(per_class).unionByName(
        ids.filter("_label = 0").orderBy(*order).limit(per_class)
    ).distinct()
    # at most 2 * per_class narrow rows, so a broadcast has a fixed bound and no text is shuffled
    sample = hashed.join(F.broadcast(chosen), ["_id", "_hash"]).select("_label", "_id", "_text")
    half: dict[tuple[int, int], list[bytes]] = {(a, b): [] for a in (0, 1) for b in (0, 1)}
    for i, row in enumerate(sorted(sample.collect(), key=lambda r: (r[0], str(r[1]), r[2]))):
        half[row[0], i % 2].append(row[2].encode())
    if not (half[1, 1] and half[0, 1]):
        return Model(b"", b"", [], prior)
    good, bad = _dictionary(half[1, 1]), _dictionary(half[0, 1])
    x = _features(half[1, 0] + half[0, 0], *_compressors(good, bad))
    y = np.repeat([1.0, 0.0], [len(half[1, 0]), len(half[0, 0])])
    if len(set(y)) < 2:
        return Model(b"", b"", [], prior)
    share = {1.0: counted[1] / (y == 1).sum(), 0.0: counted[0] / (y == 0).sum()}
    weight = np.array([share[v] for v in y])
    return Model(good, bad, fit_logistic(x, y, weight / weight.mean()).tolist(), prior)


def score(
    docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """doc_id, the `carry` columns, score, predicted (1 at `threshold` or more) for every row."""

    def judge(texts: list[bytes | None]) -> list[pa.Array]:
        found = model.scores(texts)
        return [pa.array(found), pa.array((found >= threshold).astype(np.int32))]

    return per_text(docs, judge, "score double, predicted int", doc_id=doc_id, text=text, carry=carry)


def keep_good(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores `threshold` or more, with all their columns."""
    return keep_rows(docs, lambda texts: (model.scores(texts) >= threshold).tolist(), text)


def learned_rows(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 5) != 0


@query()
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), learned_rows())
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model, carry={"held_out": held_out})
