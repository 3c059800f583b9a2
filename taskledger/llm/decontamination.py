"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in one form: A-Z in lower case, words joined by one space. An item of m characters may
differ in k = floor(m * error_rate) of them. Split into k + 1 pieces, at least one piece of it must then occur
unchanged, so an automaton over all pieces finds every place where the item can be; each such place, with k characters
around it, is verified with Myers' bit-parallel distance. What is reported is the best place of each item in each text.

Test items are a stated query set. They are taken in blocks of at most `BLOCK_CHARS` characters, one pass over the texts
for each block, so the automaton a task holds has a fixed bound. Items with fewer than `min_chars` characters in that
form have to occur unchanged, and in scripts that write spaces between words they have to begin and end with a word;
those without a letter or digit have to stand between spaces. Null and blank items are not looked for. Null and empty texts match nothing. Repeated rows are reported
each; items with the same text are reported each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.llm.common import binary, blocks, documents, keep_rows
from taskledger.llm.registry import query
from taskledger.session import ship_package

ERROR_RATE = 0.08
MIN_CHARS = 20
BLOCK_CHARS = 1_000_000
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han: words are written without spaces.
UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uaa60-\uaa7f"
    "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]"
)


def plain(text: bytes | str | None) -> str:
    """The form in which texts are compared."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return b" ".join(raw.lower().split()).decode()


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance of `pattern` to any substring of `text` and where the first such one ends; None if over `most`."""
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = (size, 0) if size <= most else (most + 1, -1)
    for at, c in enumerate(text):
        equal = places.get(c, 0)
        same = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(same | up)), up & same
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return None if end < 0 else (best, end)


def _in_word(c: str) -> bool:
    return (c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not UNSPACED.match(c)


def within_words(text: str, first: int, last: int) -> bool:
    """Whether a word of a script with spaces goes on over an end of text[first:last]."""
    if not any(map(str.isalnum, text[first:last])):
        return (first > 0 and text[first - 1] != " ") or (last < len(text) and text[last] != " ")
    return (first > 0 and _in_word(text[first - 1]) and _in_word(text[first])) or (
        last < len(text) and _in_word(text[last - 1]) and _in_word(text[last])
    )


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[str], error_rate: float, min_chars: int = MIN_CHARS):
        self.items, self.error_rate, self.min_chars, self.automaton = items, error_rate, min_chars, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def short(self, item: str) -> bool:
        return len(item) < self.min_chars

    def budget(self, item: str) -> int:
        return 0 if self.short(item) else int(len(item) * self.error_rate)

    def _build(self):
        import ahocorasick

        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            parts = self.budget(item) + 1
            cuts = [len(item) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(item[a:b], []).append((number, b))
        automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            automaton.add_word(piece, where)
        automaton.make_automaton()
        return automaton

    def places(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a piece in `text` the stretches to verify, overlapping ones joined; of a short item its
        first place."""
        if self.automaton is None:
            self.automaton = self._build()
        found: dict[int, list[list[int]]] = {}
        for last, where in self.automaton.iter(text):
            for number, end in where:
                item = self.items[number]
                if self.short(item):
                    first = last + 1 - len(item)
                    if number not in found and not within_words(text, first, last + 1):
                        found[number] = [[first, last + 1]]
                    continue
                k = self.budget(item)
                first = max(0, last + 1 - end - k)
                until = last + 1 - end + len(item) + k
                stretches = found.setdefault(number, [])
                if stretches and first <= stretches[-1][1]:
                    # pieces come by their ends, so a later one can begin a little earlier
                    stretches[-1][0] = min(stretches[-1][0], first)
                    stretches[-1][1] = max(stretches[-1][1], until)
                else:
                    stretches.append([first, until])
        return found

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, distance, first, last) of each item's best place; positions in the plain form, end exclusive."""
        for number, stretches in self.places(text).items():
            item, best = self.items[number], None
            if self.short(item):
                yield number, 0, *stretches[0]
                continue
            for first, until in stretches:
                found = myers(item, text[first:until], self.budget(item) if best is None else best[0] - 1)
                if found:
                    best = (found[0], first + found[1])
                if best and not best[0]:
                    break
            if best:
                distance, last = best
                back = text[max(0, last - len(item) - distance): last][::-1]
                yield number, distance, last - myers(item[::-1], back, distance)[1], last

    def hit(self, text: str) -> bool:
        return next(self.matches(text), None) is not None


def item_blocks(
    items: DataFrame, *, item_id: str = "item_id", text: str = "text", error_rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> Iterator[tuple[list, Searcher]]:
    """Searchers for blocks of items with the ids of each item's text, read from Spark partition by partition."""
    names: dict[str, list] = {}
    size = 0
    for row in items.select(F.col(item_id), F.col(text)).filter(F.col(text).isNotNull()).toLocalIterator():
        form = plain(row[1])
        if not form:
            continue
        if form not in names:
            if names and size + len(form) > block_chars:
                yield list(names.values()), Searcher(list(names), error_rate, min_chars)
                names, size = {}, 0
            size += len(form)
        names.setdefault(form, []).append(row[0])
    if names:
        yield list(names.values()), Searcher(list(names), error_rate, min_chars)


def find_items(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, distance, first, last for every item found in a row of `docs`."""
    spark = docs.sparkSession
    ship_package(spark)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    schema = (
        f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()},"
        " distance int, first long, last long"
    )
    out = spark.createDataFrame([], schema)
    chosen = item_blocks(
        items, item_id=item_id, text=item_text, error_rate=error_rate, min_chars=min_chars, block_chars=block_chars
    )
    for ids, searcher in chosen:

        def run(batches, ids=ids, searcher=searcher):
            for block in blocks(batches, "_text"):
                rows = [
                    (row, name, distance, first, last)
                    for row, raw in enumerate(binary(block.column(1))) if raw
                    for number, distance, first, last in searcher.matches(plain(raw))
                    for name in ids[number]
                ]
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows]),
                     pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()),
                     pa.array([r[4] for r in rows], pa.int64())],
                    names=["doc_id", "item_id", "distance", "first", "last"],
                )

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def keep_clean(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows, with all their columns, in whose text no item is found."""
    chosen = item_blocks(
        items, item_id=item_id, text=item_text, error_rate=error_rate, min_chars=min_chars, block_chars=block_chars
    )
    for _, searcher in chosen:
        docs = keep_rows(docs, lambda texts, s=searcher: [not (t and s.hit(plain(t))) for t in texts], text)
    return docs


@query()
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_items(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
