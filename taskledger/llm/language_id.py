"""Linear-chain conditional random field that labels every word of a text with a language.

A word's features are its anchored byte n-grams (prefixes and suffixes), its inner n-grams and itself (the lexicon),
hashed into a weight table. A word of over LONG_WORD bytes is read in full; its n-grams count in the mean over its parts
of that size, so that in texts without spaces a sentence weighs as much as other words. Emissions and the transitions between neighbouring labels are learned together by gradient
steps on the exact likelihood. Forward-backward gives each word's label probabilities, so a text may switch languages;
a document's language is the one with the largest mean probability over its words with letters.

Every label is learned, so weights grow with the labels. Fitting uses a bounded sample: for each label up to
`per_language` rows, by the smallest hashes of their ids, of which the first `max_sample_chars` characters each are read
and together a share that shrinks with the square of the labels, as a step costs so much (LEAST_CHARS at least). Runs of words from different
texts are put one after the other, so that transitions see switches. Labelling takes every whole text.

Null texts and texts without a letter are `und` with score 0; so is every text if nothing could be learned. Null
labels are not learned from. Equal probabilities go to the first label in alphabetical order.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskledger.llm.common import binary, blocks, documents, per_text, remainder
from taskledger.llm.registry import query
from taskledger.session import ship_package, written

PER_LANGUAGE = 250
MAX_SAMPLE_CHARS = 50_000
SAMPLE_CHARS, LEAST_CHARS = 800_000_000, 2_000
TABLE_BITS = 17
ROUNDS = 20
NGRAMS = (2, 3, 4, 5)
RUN_WORDS, SEQUENCE_WORDS = 25, 100
LONG_WORD = 64  # the n-grams of a longer word weigh as much as those of this many bytes
BYTES_AT_ONCE = 1 << 20  # whose n-grams are looked up at a time
CACHED_WORDS = 300_000
FEW_LABELS = 8  # with more, blocks and kept words are fewer in proportion
TRAINED_AT_ONCE = 1 << 22  # words times labels of a step of training
LETTER = re.compile(rb"[A-Za-z]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # hashed features x labels
    transitions: np.ndarray  # log weights, from label x to label


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode()))


class Index(dict):
    """Numbers words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _hashed(text: np.ndarray) -> list[np.ndarray]:
    """Row of the weight table for each n-gram of the bytes, one array per length."""
    rolling, out = text, []
    for n in range(2, max(NGRAMS) + 1):
        rolling = rolling[:-1] * np.uint64(257) + text[n - 1:]
        if n in NGRAMS:
            out.append((((rolling + np.uint64(n)) * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    return out


def _shares(sizes: np.ndarray) -> np.ndarray:
    """What an n-gram of each word counts: one over the word's parts of LONG_WORD bytes."""
    return (1 / np.maximum(1, -(-sizes // LONG_WORD))).astype(np.float32)


def _lexicon(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w, 7) for w in found), dtype=np.uint64, count=len(found))
    return (hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams at each byte position of the words (one row per length), where each word begins, hashed words,
    and what an n-gram of each word counts.

    A position where an n-gram would leave its word has the last row of the weight table, which stays zero.
    """
    text = np.frombuffer(b"\x02" + b"\x03\x02".join(found) + b"\x03", dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(text))  # bytes of the word from here on
    grams = np.full((len(NGRAMS), len(text)), 1 << TABLE_BITS, dtype=np.int64)
    for row, n, hashed in zip(grams, NGRAMS, _hashed(text), strict=True):
        row[: len(hashed)] = np.where(left[: len(hashed)] >= n, hashed, 1 << TABLE_BITS)
    return grams, starts, _lexicon(found), _shares(sizes - 2)


def emissions(made: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    grams, starts, lexicon, shares = made
    total = weights[grams[0]]
    for row in grams[1:]:
        total += weights[row]
    return np.add.reduceat(total, starts, axis=0) * shares[:, None] + weights[lexicon]


def word_emissions(found: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Emissions of words of any number and length, of which a bounded number of bytes is taken at a time."""
    limit = max(1 << 12, BYTES_AT_ONCE * 4 // max(4, weights.shape[1]))
    parts, start, held = [], 0, 0
    for i, word in enumerate(found):
        size = len(word) + 2
        if i > start and held + size > limit:
            parts.append(emissions(features(found[start:i]), weights))
            start, held = i, 0
        if size > limit:
            parts.append(_long_emission(word, weights, limit))
            start, held = i + 1, 0
        else:
            held += size
    if start < len(found):
        parts.append(emissions(features(found[start:]), weights))
    return np.concatenate(parts) if parts else np.zeros((0, weights.shape[1]), dtype=weights.dtype)


def _long_emission(word: bytes, weights: np.ndarray, limit: int) -> np.ndarray:
    text = np.frombuffer(b"\x02" + word + b"\x03", dtype=np.uint8)
    total = np.zeros(weights.shape[1])
    for at in range(0, len(text), limit):
        for n, hashed in zip(NGRAMS, _hashed(text[at: at + limit + max(NGRAMS) - 1].astype(np.uint64)), strict=True):
            # those that begin here; the bytes after them only complete them
            total += weights[hashed[: min(limit, len(text) - at - n + 1)]].sum(axis=0, dtype=np.float64)
    return (total * _shares(np.array([len(word)])) + weights[_lexicon([word])]).astype(weights.dtype)


def marginals(emitted: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of texts that lie one after the other, by forward-backward."""
    return _forward_backward(emitted, lengths, transitions)[0]


def _forward_backward(emitted: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Label probabilities, and the expected number of each transition if `pairs`.

    All texts advance together, the longest first: words are laid out by position, so a step works on one slice.
    """
    n_labels = emitted.shape[1]
    lengths = np.asarray(lengths, dtype=np.int64)
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, longest + 1), side="left")
    offset = np.append(0, np.cumsum(active))
    starts = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    layout = offset[np.arange(len(emitted)) - starts[text]] + rank[text]
    del text
    local = np.empty((len(emitted), n_labels))
    local[layout] = np.exp(emitted - emitted.max(axis=1, keepdims=True)) if len(emitted) else emitted
    step = np.exp(transitions - transitions.max())
    forward = np.empty_like(local)
    bounds = offset.tolist()
    for t in range(longest):
        a, b = bounds[t], bounds[t + 1]
        now = forward[a:b]
        if t:
            np.matmul(forward[a - active[t - 1]: a - active[t - 1] + b - a], step, out=now)
            now *= local[a:b]
        else:
            now[:] = local[a:b]
        if t % 4 == 0 or pairs:
            now /= now.sum(axis=1, keepdims=True)
    expected = np.zeros((n_labels, n_labels))
    back = np.ones((len(lengths), n_labels))
    turned = np.ascontiguousarray(step.T)
    for t in range(longest - 1, -1, -1):
        a, b = bounds[t], bounds[t + 1]
        own = back[: b - a]
        if t:
            carried = local[a:b] * own
            before = bounds[t - 1]
            if pairs:
                joint = forward[before: before + b - a]
                norm = ((joint @ step) * carried).sum(axis=1, keepdims=True)
                expected += step * ((joint / norm).T @ carried)
        forward[a:b] *= own
        if t:
            np.matmul(carried, turned, out=own)
            if t % 4 == 0:
                own /= own.sum(axis=1, keepdims=True)
    forward /= forward.sum(axis=1, keepdims=True)
    return forward[layout], expected


def train(runs: list[tuple[int, list[bytes]]], labels: list[str], rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Learn from runs of words of one language each: (label index, words)."""
    n_labels = len(labels)
    rng = np.random.default_rng(seed)
    runs = [runs[i] for i in rng.permutation(len(runs))]
    index = Index()
    ids = np.fromiter((index[w] for _, found in runs for w in found), dtype=np.int64)
    gold = np.repeat([k for k, _ in runs], [len(found) for _, found in runs])
    lengths = np.full(-(-len(ids) // SEQUENCE_WORDS), SEQUENCE_WORDS)
    lengths[-1] = len(ids) - SEQUENCE_WORDS * (len(lengths) - 1)
    first = np.arange(len(ids)) % SEQUENCE_WORDS == 0
    made = grams, starts, lexicon, shares = features(list(index))
    per_word = np.diff(np.append(starts, grams.shape[1]))
    weights, transitions = np.zeros(((1 << TABLE_BITS) + 1, n_labels), dtype=np.float32), np.zeros((n_labels, n_labels))
    seen, seen_t = np.full(weights.shape, 1e-6, dtype=np.float32), np.full(transitions.shape, 1e-6)
    held = np.zeros_like(transitions)
    np.add.at(held, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    balance = np.bincount(gold, minlength=n_labels).astype(float)
    balance = (balance.sum() / n_labels / np.maximum(balance, 1))[gold]  # each language weighs the same
    at_once = max(1, TRAINED_AT_ONCE // (n_labels * SEQUENCE_WORDS))  # sequences
    for _ in range(rounds):
        of_words, expected = np.zeros((n_labels, len(index))), np.zeros_like(held)
        emitted = emissions(made, weights)
        for part in range(0, len(lengths), at_once):
            rows = slice(part * SEQUENCE_WORDS, (part + at_once) * SEQUENCE_WORDS)
            found, passed = _forward_backward(emitted[ids[rows]], lengths[part: part + at_once], transitions, pairs=True)
            off = -found
            off[np.arange(len(off)), gold[rows]] += 1
            off *= balance[rows, None]
            expected += passed
            for k in range(n_labels):
                of_words[k] += np.bincount(ids[rows], weights=off[:, k], minlength=len(index))
        for k, of_word in enumerate(of_words):
            slope = np.bincount(lexicon, weights=of_word, minlength=len(weights))
            at_byte = np.repeat(of_word * shares, per_word)
            for row in grams:
                slope += np.bincount(row, weights=at_byte, minlength=len(weights))
            slope /= len(ids)
            slope -= 1e-7 * weights[:, k]
            seen[:, k] += slope.astype(np.float32) ** 2
            weights[:, k] += 0.1 * slope / np.sqrt(seen[:, k])
        weights[-1] = 0
        slope = (held - expected) / len(ids)
        seen_t += slope**2
        transitions += 0.2 * slope / np.sqrt(seen_t)
    return Model(labels, weights.astype(np.float32), transitions)


def fit(
    docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", language: str = "lang",
    per_language: int = PER_LANGUAGE, max_sample_chars: int = MAX_SAMPLE_CHARS,
) -> Model:
    """Fit from the rows where `learn` holds and the language is known."""
    known = docs.filter(learn).select(
        F.col(doc_id).alias("_id"), F.col(language).cast("string").alias("_lang"), F.col(text).alias("_text")
    ).filter("_lang is not null and _text is not null")
    fits = known.filter("length(_text) > 0").withColumn("_hash", F.xxhash64("_text"))
    order = (F.xxhash64("_id", F.lit("sample")), F.col("_id"), F.col("_hash"))
    hashed = fits.select(
        "_id", "_lang", "_hash", F.least(F.length("_text"), F.lit(max_sample_chars)).cast("long").alias("_size")
    )
    chosen = written(
        hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*order)))
        .filter(F.col("_rank") <= per_language), "sample-of-languages",
    )
    labels = sorted(r[0] for r in chosen.select("_lang").distinct().collect())
    share = max(LEAST_CHARS, SAMPLE_CHARS // max(1, len(labels)) ** 2)
    before = F.sum("_size").over(Window.partitionBy("_lang").orderBy("_rank")) - F.col("_size")
    read = chosen.withColumn("_read", F.least("_size", F.lit(share) - before)).filter("_read > 0").groupBy(
        "_id", "_lang", "_hash").agg(F.max("_read").cast("int").alias("_read"))
    sample = fits.join(read, ["_id", "_lang", "_hash"]).select(
        "_lang", "_id", F.substring("_text", F.lit(1), F.col("_read")).alias("_text")
    ).distinct()
    number, runs = {label: k for k, label in enumerate(labels)}, []
    for row in sorted(sample.collect(), key=lambda r: (r[0], str(r[1]), r[2])):
        found = row[2].encode().lower().split()
        runs += [(number[row[0]], found[i: i + RUN_WORDS]) for i in range(0, len(found), RUN_WORDS)]
    if not runs:
        return Model([], np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0)))
    return train(runs, labels)


class Tagger:
    """Label probabilities of the words of a block of texts; words met before keep their emissions."""

    def __init__(self, model: Model):
        self.model = model
        self.index = Index()
        self.table = np.zeros((0, len(model.labels)), dtype=np.float32)
        self.lettered = np.zeros(0, dtype=bool)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of all words, whether each has a letter, and the number of words of each text."""
        if len(self.index) > CACHED_WORDS * FEW_LABELS // max(FEW_LABELS, len(self.model.labels)):
            self.index, self.table, self.lettered = Index(), self.table[:0], self.lettered[:0]
        index, split = self.index, [t.lower().split() if t else [] for t in texts]
        before, flat = len(index), list(itertools.chain.from_iterable(split))
        ids = np.fromiter(map(index.__getitem__, flat), dtype=np.int64, count=len(flat))
        del flat
        if len(index) > before:
            fresh = list(itertools.islice(index, before, None))
            made = word_emissions(fresh, self.model.weights)
            wordy = np.fromiter((bool(LETTER.search(w)) or not w.isascii() for w in fresh), dtype=bool, count=len(fresh))
            made[~wordy] = 0
            self.table = np.concatenate([self.table, made])
            self.lettered = np.concatenate([self.lettered, wordy])
        lengths = np.array([len(found) for found in split], dtype=np.int64)
        if not len(ids):
            return np.zeros((0, len(self.model.labels))), np.zeros(0, dtype=bool), lengths
        return marginals(self.table[ids], lengths, self.model.transitions), self.lettered[ids], lengths


def block_bytes(model: Model) -> int:
    return (8 << 20) * FEW_LABELS // max(FEW_LABELS, len(model.labels))


def predict(
    docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """doc_id, the `carry` columns, lang_pred, score (mean probability of that language) for every row."""
    labels = np.array([*model.labels, "und"])

    tagger = Tagger(model)  # a task unpickles its own copy

    def judge(texts: list[bytes | None]) -> list[pa.Array]:
        if not model.labels:
            return [pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
        found, counts, lengths = tagger(texts)
        row = np.repeat(np.arange(len(texts)), lengths)
        sums = np.stack([
            np.bincount(row[counts], weights=found[counts, k], minlength=len(texts)) for k in range(len(model.labels))
        ], axis=1)
        total = sums.sum(axis=1)
        lettered = np.array([has_letter(t) for t in texts], dtype=bool) & (total > 0)
        shares = sums / np.where(total > 0, total, 1)[:, None]
        best = np.where(lettered, shares.argmax(axis=1), len(model.labels))
        score = np.where(lettered, shares.max(axis=1), 0.0)
        return [pa.array(labels[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))]

    return per_text(docs, judge, "lang_pred string, score double", doc_id=doc_id, text=text, carry=carry, limit=block_bytes(model))


def spans(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of words with the same likeliest label: doc_id, first_word, last_word (from 0), lang."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tagger = Tagger(model)
        for block in blocks(batches, "_text", block_bytes(model) // 2):
            found, _, lengths = tagger(binary(block.column(1)))
            if not len(found) or not model.labels:
                continue
            best = found.argmax(axis=1)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(best)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            begins = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (row[1:] != row[:-1])))
            ends = np.append(begins[1:], len(best)) - 1
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(row[begins])), pa.array(place[begins]), pa.array(place[ends]),
                 pa.array([model.labels[k] for k in best[begins]], pa.string())],
                names=["doc_id", "first_word", "last_word", "lang"],
            )

    return narrow.mapInArrow(run, f"doc_id {kind}, first_word long, last_word long, lang string")


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, remainder("doc_id", 4) != 2)
    return predict(docs, model, carry={"held_out": held_out})
