"""Spelling variants: words one edit apart, and the more frequent form each leads to.

Words are the runs of Latin letters of all texts, counted in each task and then in Spark. Two words are near if exactly
one code point is inserted, deleted or replaced. Near words are found by asymmetric q-chunks: a word contributes two
disjoint chunks, its halves; one edit touches one of them only, so the other stands in every near word, at most one place
away. The other word contributes the positional grams of the size of those halves, and both meet on (length of the first
word, half, place, gram). Grams that stand more than one place from where a chunk of such a word can be are not sent. Each
candidate pair is verified by its edit distance.

A chunk that very many words share (over `MOST_PAIRS` candidates) would make a pair of each two of them. Its words are
joined by what is left when one code point is taken away instead: that makes verified pairs only, so no link is lost.

Null texts have no words. Texts count as often as they occur. With a null id no code point is dropped by
`dropped_letters`. An empty table gives no rows; columns other than id and text are not read. Of near words with equal
counts the first in code-point order is the form.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.llm.common import binary, blocks, documents
from taskledger.llm.registry import query
from taskledger.session import ship_package, written

#: [A-Za-zÀ-ÿ]+ in UTF-8, after A-Z have been lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
DROPS = 97
MOST_PAIRS = 1_000_000
WORDS_AT_ONCE = 200_000


def dropped_letter(word: bytes, before: int, drops: int) -> bytes:
    """The word, or the word without code point h % length where `drops` divides h, the CRC-32 carried on from `before`."""
    h = zlib.crc32(word, before)
    if h % drops:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def long_enough(word: bytes, least: int) -> bool:
    return len(word) >= least and len(word) - word.count(b"\xc3") >= least


def count_words(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, drops: int | None = None,
) -> DataFrame:
    """word, n of all words of the texts; with `drops`, dropped_letter is applied to each run of each document."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("_text"))

    def flush(counts: Counter) -> Iterator[pa.RecordBatch]:
        kept = [w for w in counts if long_enough(w, least_length)]
        for at in range(0, len(kept), 50_000):
            part = kept[at: at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in part], pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for block in blocks(batches, "_text"):
            for own, body in zip(block.column(0).to_pylist(), binary(block.column(1)), strict=True):
                found = RUN.findall(body.lower()) if body else ()
                if drops is None or own is None:
                    counts.update(found)
                    continue
                before = zlib.crc32(f"{own}:".encode())
                for word, n in Counter(found).items():
                    if len(word) >= least_length:
                        counts[dropped_letter(word, before, drops)] += n
            if len(counts) > WORDS_AT_ONCE:
                yield from flush(counts)
                counts = Counter()
        yield from flush(counts)

    found = narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


def _halves(length: Column) -> tuple[tuple[int, Column, Column], ...]:
    """Number, place and size of both chunks of a word of this length."""
    first = F.floor(length / 2).cast("int")
    return (0, F.lit(0), first), (1, first, length - first)


def _gram(length: Column, half: int, place: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(half), F.substr("word", place + 1, size))


def chunks(words: DataFrame) -> DataFrame:
    """key, word: the two chunks of each word."""
    length = F.length("word")
    keys = [_gram(length, half, start, size) for half, start, size in _halves(length)]
    return words.select(F.explode(F.array(*keys)).alias("key"), "word")


def grams(words: DataFrame) -> DataFrame:
    """key, word: the positional grams at most one place from a chunk of a word of the same or the next length."""
    own, keys = F.length("word"), []
    for longer in (0, 1):
        length = own + longer
        for half, start, size in _halves(length):
            for place in (start - 1, start, start + 1):
                keys.append(F.when((place >= 0) & (place + size <= own), _gram(length, half, place, size)))
    return words.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"), F.col("word").alias("near"))


def near_pairs(words: DataFrame, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, near: every pair of different words with edit distance one, once in each direction. `words`: column word."""
    words = written(words.select("word").distinct(), "words")
    # The longer word of a pair, of equally long ones the first, sends chunks and the other grams.
    ours, theirs = written(chunks(words), "chunks"), written(grams(words), "grams")
    load = ours.groupBy("key").agg(F.count(F.lit(1)).alias("a")).join(theirs.groupBy("key").agg(F.count(F.lit(1)).alias("b")), "key")
    heavy = written(load.filter(F.col("a") * F.col("b") > most_pairs).select("key"), "frequent-chunks")
    longer = F.length("word") > F.length("near")
    pairs = ours.join(heavy, "key", "left_anti").join(theirs, "key").filter(
        (longer | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1)
    ).select("word", "near")
    if not heavy.isEmpty():
        shared = ours.unionByName(theirs.withColumnRenamed("near", "word")).join(heavy, "key", "left_semi")
        pairs = pairs.unionByName(pairs_by_deletion(shared.select("word").distinct()))
    once = written(pairs.select(F.least("word", "near").alias("word"), F.greatest("word", "near").alias("near")).distinct(), "near")
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("word").alias("near")))


def pairs_by_deletion(words: DataFrame) -> DataFrame:
    """word, near (word < near): all pairs at distance one. Equal rest and place: a replacement; rest and word: a deletion."""
    less = written(words.select(
        "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"),
    ).select("word", "at", F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)")).alias("rest")), "deletions")
    others = less.select(F.col("word").alias("near"), "at", "rest")
    replaced = less.join(others, ["rest", "at"]).filter(F.col("word") < F.col("near")).select("word", "near")
    shorter = words.select(F.col("word").alias("rest"))
    deleted = less.join(shorter, "rest").select(F.least("word", "rest").alias("word"), F.greatest("word", "rest").alias("near"))
    return replaced.unionByName(deleted)


def variants(words: DataFrame, *, ratio: int = 2, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of `words` (word, n; words once each)."""
    words = written(words.select("word", "n"), "counted")
    pairs = near_pairs(words, most_pairs=most_pairs).join(words.select(F.col("word").alias("near"), "n"), "near")
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("n").alias("_most"),
        F.min_by("near", F.struct(-F.col("n"), "near")).alias("_form"),
    )
    enough = F.col("_most") >= ratio * F.col("n")
    formed = written(
        words.join(best, "word", "left").select(
            "word", F.when(enough, F.col("_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("_most")).alias("form_n"),
        ), "forms",
    )
    roots = follow(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def follow(steps: DataFrame) -> DataFrame:
    """word, root: where the steps (word, form) end, by pointer doubling. Counts at least double along a step, so none turns back."""
    state = written(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(state.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        ), "roots")
        state = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return state


def _check() -> str:
    zeros = "[" + ", ".join(["0::UBIGINT"] * 8) + "]"
    return f"""WITH RECURSIVE bytes AS (SELECT i AS b, list_reduce(list_prepend(i::UBIGINT, {zeros}), lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1))) AS v
      FROM range(256) r(i)),
    tab AS (SELECT list(v ORDER BY b) AS vs FROM bytes),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\u00C0-\u00FF]+')) AS run
      FROM documents),
    per AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::UBIGINT)),
      lambda c, b: xor(c >> 8, vs[xor(c & 255, b)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM per, tab),
    changed AS (SELECT n, CASE WHEN h % {DROPS} = 0 THEN run[:h % length(run)] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    less AS (SELECT word, n, k, word[:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, a.n, w.word, w.n FROM less a JOIN words w ON w.word = a.rest
      UNION SELECT w.word, w.n, a.word, a.n FROM less a JOIN words w ON w.word = a.rest),
    best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS most, first(other ORDER BY other_n DESC, encode(other)) AS top FROM near GROUP BY word, n),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN top END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n
      FROM words w LEFT JOIN best b ON b.word = w.word),
    chain AS (SELECT word, word AS reached FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.reached AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.reached AND e.form IS NULL"""


@query(_check())
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants(count_words(documents(spark, folder), drops=DROPS))
