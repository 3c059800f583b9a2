"""Distribution divergence: character classes and common words of a text against language references.

A reference holds, for one language, the counts of character classes and of the language's most frequent words over all
its documents. A language with fewer than `MIN_DOCUMENTS` documents or `MIN_REFERENCE_CHARS` characters has none. A text is
compared with every reference by the Jensen-Shannon distance (base 2, so 0 to 1), its own counts taken out of the reference
of its language, and takes its nearest one (of equally near ones the one of the larger language). It fails if the distance
of either histogram to that reference is above its limit; a histogram is only judged from a minimum length on (`MIN_CHARS`,
`MIN_WORDS`), since short texts diverge by chance. The limits are fitted: what nearly all texts labelled good keep.

Rows of a language without a reference are judged by the base rules alone; rows without a language by the nearest
reference. Null and empty texts have no words and fail the base rules. Repeated rows count in the references as often as
they are there. An empty table gives no rows; without any reference only the base rules decide.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskledger.llm.common import binary, blocks, documents, tidy, words
from taskledger.llm.registry import query
from taskledger.session import ship_package, written

COMMON_WORDS = 60
MIN_CHARS, MIN_WORDS = 200, 50
MIN_DOCUMENTS, MIN_REFERENCE_CHARS = 20, 5_000
#: Limits where there are too few labelled texts to fit them.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.5
LEAST_GOOD = 200
RANGES, FEW_VALUES = 4_096, 10_000
KEPT_SHARE, MARGIN = 0.999, 1.2
CELLS = 1 << 22
#: Different words, over all languages, that a task counts before it sends them.
COUNTED_AT_ONCE = 400_000
SYMBOLS = re.compile(rb"[#*$%&|<>]")
CLASSES = ("vowel", "consonant", "upper", "other letter", "digit", "space", "end mark", "punctuation", "symbol", "rest")
_RULES = [  # the class of a character is the first of these that has it; the patterns of Spark and Python agree
    ("vowel", "aeiou"), ("consonant", "bcdfghjklmnpqrstvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", "0123456789"), ("space", " \t\n\r\x0b\x0c"), ("end mark", ".!?"), ("punctuation", ",;:'\"()-"),
    ("symbol", "#*$%&|<>=+/\\_~^@[]{}`"),
]
_CLASS_OF_BYTE = np.full(256, CLASSES.index("rest"), dtype=np.uint8)
for _name, _chars in _RULES:
    _CLASS_OF_BYTE[list(_chars.encode())] = CLASSES.index(_name)
_CLASS_OF_BYTE[0xC2:0xF5] = CLASSES.index("other letter")  # the first byte of a longer UTF-8 sequence
_CONTINUED = 0xFF
_CLASS_OF_BYTE[0x80:0xC0] = _CONTINUED


@dataclass
class References:
    """Per language: counts of the character classes, and of its common words with all others at the end.

    `columns` says where the common words of a language stand in `index`, the words of all languages.
    """

    languages: list[str]
    classes: np.ndarray
    index: dict[bytes, int]
    columns: list[np.ndarray]
    words: list[np.ndarray]


def class_counts(text: bytes) -> np.ndarray:
    """Characters of each class, in code points."""
    kinds = _CLASS_OF_BYTE[np.frombuffer(text, dtype=np.uint8)]
    return np.bincount(kinds, minlength=256)[: len(CLASSES)]


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (root of the divergence, base 2) of the last axis of two arrays of shares."""
    middle = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(middle > 0, middle, 1)), 0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def references(
    docs: DataFrame, *, language: str = "lang", text: str = "text", common: int = COMMON_WORDS
) -> References:
    """References from all rows with a language, for the languages with enough text."""
    known = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    counted = written(_counted(known, language, text).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "counts")
    sizes = counted.groupBy("lang").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("chars"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("documents")
    ).filter((F.col("chars") >= MIN_REFERENCE_CHARS) & (F.col("documents") >= MIN_DOCUMENTS))
    rank = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    total = counted.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    top = (
        counted.filter("kind < 2").withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= max(common, len(CLASSES))).join(total, ["lang", "kind"]).join(sizes.select("lang"), "lang", "left_semi")
    )
    of_language: dict[str, list] = {}
    for r in top.collect():
        of_language.setdefault(r["lang"], []).append(r)
    chars = {lang: sum(r["n"] for r in own if r["kind"] == 0) for lang, own in of_language.items()}
    languages = sorted(of_language, key=lambda lang: (-chars[lang], lang))
    refs = References(languages, np.zeros((len(languages), len(CLASSES))), {}, [], [])
    for k, lang in enumerate(languages):
        for r in of_language[lang]:
            if r["kind"] == 0:
                refs.classes[k, int(r["item"])] = r["n"]
        listed = sorted((r["rank"], bytes(r["item"]), r["n"], r["total"]) for r in of_language[lang] if r["kind"] == 1)[:common]
        refs.columns.append(np.array([refs.index.setdefault(item, len(refs.index)) for _, item, _, _ in listed], dtype=np.int64))
        found = np.array([n for _, _, n, _ in listed], dtype=float)
        refs.words.append(np.append(found, listed[0][3] - found.sum() if listed else 0))
    return refs


def _counted(docs: DataFrame, language: str, text: str) -> DataFrame:
    """lang, kind (0 class, 1 word, 2 document), item, n: counts of each task, summed by language before they are sent."""
    ship_package(docs.sparkSession)

    def run(batches):
        counts: dict[str, Counter] = {}
        kinds: dict[str, np.ndarray] = {}
        texts: Counter = Counter()
        for block in blocks(batches, "_text"):
            langs = block.column(0).to_pylist()
            texts.update(langs)
            for lang, raw in zip(langs, binary(block.column(1)), strict=True):
                counts.setdefault(lang, Counter()).update(words(raw.lower()))
                kinds[lang] = kinds.get(lang, 0) + class_counts(raw)
            if sum(map(len, counts.values())) > COUNTED_AT_ONCE:
                yield from sent((lang, 1, item, n) for lang, found in counts.items() for item, n in found.items())
                counts.clear()
        yield from sent((lang, 0, b"%d" % i, int(n)) for lang, all_n in kinds.items() for i, n in enumerate(all_n) if n)
        yield from sent((lang, 2, b"", n) for lang, n in texts.items())
        yield from sent((lang, 1, item, n) for lang, found in counts.items() for item, n in found.items())
        counts.clear()

    def sent(rows):
        while part := list(itertools.islice(rows, 20_000)):  # never all rows of a task beside its counts
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int32()),
                 pa.array([r[2] for r in part], pa.binary()), pa.array([r[3] for r in part], pa.int64())],
                names=["lang", "kind", "item", "n"],
            )

    narrow = docs.select(F.col(language).cast("string").alias("_lang"), F.col(text).alias("_text"))
    return narrow.mapInArrow(tidy(run), "lang string, kind int, item binary, n long")


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    found = words(text)
    chars = sum(map(len, found)) - (0 if text.isascii() else _continued(found))
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(found), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(found)


def _continued(found: list[bytes]) -> int:
    joined = np.frombuffer(b"".join(found), dtype=np.uint8)
    return int(((joined & 0xC0) == 0x80).sum())


def repeat_words(found: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that occur at least twice in the text."""
    if len(found) <= size:
        return 0
    windows = list(zip(*(found[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    hit = np.fromiter((times[w] > 1 for w in windows), dtype=np.int8, count=len(windows))
    covered = np.zeros(len(found) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def divergences(texts: list[bytes], langs: list[str | None], refs: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: index of the nearest reference, distance of the classes and of the words to it (nan: not judged)."""
    n, number = len(texts), {lang: k for k, lang in enumerate(refs.languages)}
    own = np.array([number.get(lang, -1) for lang in langs], dtype=np.int64)
    kinds, times, n_words = np.zeros((n, len(CLASSES))), np.zeros((n, len(refs.index))), np.zeros(n)
    for i, text in enumerate(texts):
        kinds[i] = class_counts(text)
        found = words(text.lower())
        n_words[i] = len(found)
        if len(found) >= MIN_WORDS:
            all_times = Counter(found)
            for item in all_times.keys() & refs.index.keys():
                times[i, refs.index[item]] = all_times[item]
    n_chars = kinds.sum(axis=1)
    by_class, by_word = np.full((n, len(refs.languages)), np.nan), np.full((n, len(refs.languages)), np.nan)
    long, wordy = np.flatnonzero(n_chars >= MIN_CHARS), np.flatnonzero(n_words >= MIN_WORDS)
    for k in range(len(refs.languages)):
        by_class[long, k] = _distance(refs.classes[k], kinds[long], own[long] == k)
        listed = times[np.ix_(wordy, refs.columns[k])]
        listed = np.column_stack([listed, n_words[wordy] - listed.sum(axis=1)])
        by_word[wordy, k] = _distance(refs.words[k], listed, own[wordy] == k)
    nearest = (np.nan_to_num(by_class) + np.nan_to_num(by_word)).argmin(axis=1)
    rows = np.arange(n)
    return nearest, by_class[rows, nearest], by_word[rows, nearest]


def _distance(reference: np.ndarray, counts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Distance of each row of counts to the reference, without the row itself where it is counted inside."""
    rest = np.where(inside[:, None], np.maximum(reference - counts, 0), reference)
    rest = rest / np.maximum(rest.sum(axis=1, keepdims=True), 1)
    return jensen_shannon(rest, counts / counts.sum(axis=1, keepdims=True))


def judge(
    docs: DataFrame, refs: References, *, doc_id: str = "doc_id", text: str = "text", language: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per document: base counts, base_failed, kept, nearest language and both distances (null: not judged)."""
    most = max(1, CELLS // max(1, len(refs.index)))
    lang = F.col(f"`{language}`").cast("string") if language in docs.columns else F.lit(None).cast("string")
    packed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), lang.alias("lang"), F.col(f"`{text}`").alias("text"))
    ship_package(docs.sparkSession)
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            for at in range(0, block.num_rows, most):
                part = block.slice(at, most)
                texts, langs = [t or b"" for t in binary(part.column(2))], part.column(1).to_pylist()
                base = [base_counts(t) for t in texts]
                failed = [n < 10 or 100 * repeats > 20 * n for n, _, _, _, repeats in base]
                judged = [bool(refs.languages) and b[0] > 0 and (g is None or g in refs.languages) for b, g in zip(base, langs, strict=True)]
                chosen = [i for i, j in enumerate(judged) if j]
                near: list[str | None] = [None] * len(texts)
                by_class, by_word = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
                if chosen:
                    k, by_class[chosen], by_word[chosen] = divergences([texts[i] for i in chosen], [langs[i] for i in chosen], refs)
                    for i, own in zip(chosen, k.tolist(), strict=True):
                        near[i] = refs.languages[own]
                far = (np.nan_to_num(by_class) > max_class_distance) | (np.nan_to_num(by_word) > max_word_distance)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[pa.array([b[i] for b in base], pa.int64()) for i in range(5)], pa.array(failed, pa.bool_()),
                    pa.array(~np.array(failed, dtype=bool) & ~far), pa.array(near, pa.string()),
                    pa.array(by_class, from_pandas=True), pa.array(by_word, from_pandas=True),
                ], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "nearest_language", "class_distance", "word_distance"]
    kinds = [kind, *["long"] * 5, *["boolean"] * 2, "string", "double", "double"]
    return packed.mapInArrow(tidy(run), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def quantile(rows: DataFrame, column: str, share: float) -> tuple[int, float]:
    """How many values a column has (nulls are none), and their quantile as numpy has it, exactly.

    Counts in ever narrower ranges say where the wanted values lie, so no task and no driver holds all of them.
    """
    x = F.col(column)
    n, least, most = rows.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return 0, float("nan")

    def ranked(place: int) -> float:
        low, high, held = least, most, n
        while low < high:
            inside = rows.filter(x.between(low, high)).select(x.alias("x"))
            if held <= FEW_VALUES:
                return sorted(r["x"] for r in inside.collect())[place]
            part = F.least(F.floor((F.col("x") - low) * F.lit(RANGES / (high - low))), F.lit(RANGES - 1))
            counted = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            for r in sorted(counted.collect()):  # RANGES rows at most
                if place < r["n"]:
                    low, high, held = r["low"], r["high"], r["n"]
                    break
                place -= r["n"]
        return low

    whole, rest = divmod((n - 1) * share, 1)
    below = ranked(int(whole))
    return n, below + (ranked(int(whole) + 1) - below) * rest if rest else below


def fit_limits(docs: DataFrame, refs: References, labels: DataFrame, *, judged: DataFrame | None = None) -> tuple[float, float]:
    """Both limits: what `KEPT_SHARE` of all texts labelled good stay below, and a margin.

    `judged`: rows of `judge` for all of `docs`, if they have been made.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    if judged is None:
        judged = judge(docs.join(good, "doc_id", "left_semi"), refs)
    else:
        judged = judged.join(good, "doc_id", "left_semi")
    rows = written(judged.filter("NOT base_failed").select("class_distance", "word_distance"), "distances")
    limits = []
    for column, default in (("class_distance", MAX_CLASS_DISTANCE), ("word_distance", MAX_WORD_DISTANCE)):
        n, kept = quantile(rows, column, KEPT_SHARE)
        limits.append(kept * MARGIN if n >= LEAST_GOOD else default)
    return limits[0], limits[1]


def within(judged: DataFrame, max_class_distance: float, max_word_distance: float) -> DataFrame:
    """Rows of `judge` with the verdict for other limits."""
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    refs = references(docs)
    judged = written(judge(docs, refs), "judged")
    return within(judged, *fit_limits(docs, refs, spark.read.parquet(f"{folder}/labels.parquet"), judged=judged))
