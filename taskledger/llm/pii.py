"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Four kinds of entities with a fixed form (email, ip, card, phone) are the seeds. A candidate is a word with a digit or an
at sign, or a run of words of digits, without the marks around it. Its lexical patterns are the word before it, the word
after it, and both. Patterns and the values they extract form a graph, which is scored in rounds:

* a pattern's confidence is the sum of its distinct values' scores (seeds have 1) over their number; it is chosen if that
  sum reaches `min_seeds` and the confidence `min_confidence`;
* a value's score is the highest confidence of the chosen patterns that extract it, times their share of weight against
  generic patterns: those with at least `GENERIC_VALUES` values of which hardly any is known.

A value whose score reaches `min_confidence` is discovered. It counts for all patterns that extract it in the next round,
so these find more; in the end it is a span of kind `context` wherever it stands as a candidate.

Positions are code points. A match never starts inside a run that an earlier start of the same run already failed on, so
the patterns below begin only at the beginning of such a run and give up no characters: they find what the plain
patterns find, in linear time and without recursion. Texts are looked through in full, however long; null texts are empty.
Repeated rows have the same spans; in the graph a value counts once. Ties cannot change a result: spans of a kind do not
overlap, scores are sums and maxima. An empty table has no spans; columns other than id and text are not read by `find`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.llm.common import documents
from taskledger.llm.registry import query
from taskledger.session import written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text needs for a match to be possible.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_SPACE = r"\x20\x09-\x0D"
_NUMBER = rf"[(+]?+[0-9][0-9().,/:+-]*+(?![^{_SPACE}])"
CANDIDATE = rf"(?<![^{_SPACE}])(?:{_NUMBER}(?: {_NUMBER})*+|[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+)"
CONTEXT_CHARS = 40
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.6
GENERIC_VALUES = 25
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_SPANS = "array<struct<first:int,last:int,value:string,left:string,right:string>>"
_FOUND = f"struct<pos:int,out:{_SPANS}>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str, needs: str, valid: Callable[[Column], Column]) -> Column:
    """array<struct<first,last,value,left,right>>: valid matches in order, end exclusive, and the characters on each side.

    The pieces between matches and the matches alternate, so a fold over both keeps the position.
    """
    nothing = F.lit(None).cast(_FOUND)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out"))
    pieces = F.split(text, pattern, -1)
    paired = F.zip_with(
        pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, match: F.struct(
            F.length(piece).alias("gap"), match.alias("value"), F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS).alias("left")
        ),
    )
    steps = F.zip_with(
        paired, F.slice(pieces, 2, F.size(pieces)),
        lambda x, piece: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), x["left"].alias("left"), F.substring(piece, 1, CONTEXT_CHARS).alias("right")),
    )

    def step(state: Column, x: Column) -> Column:
        first = state["pos"] + x["gap"]
        last = first + F.coalesce(F.length(x["value"]), F.lit(0))
        found = F.array(F.struct(
            first.alias("first"), last.alias("last"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")
        ))
        return F.struct(
            last.alias("pos"),
            F.when(x["value"].isNotNull() & valid(x["value"]), F.concat(state["out"], found)).otherwise(state["out"]).alias("out"),
        )

    folded = F.when(text.rlike(needs), F.aggregate(steps, start, step)).otherwise(nothing)
    return F.coalesce(folded["out"], F.array().cast(_SPANS))


def _base(text: Column) -> dict[str, Column]:
    return {k: located(text, PATTERNS[k], NEEDS[k], lambda v, k=k: _valid(k, v)) for k in KINDS}


def _candidates(text: Column) -> Column:
    """Candidates without the marks around them, in order."""
    lead, value = r"^[^\p{L}0-9+]+", r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$"
    trimmed = F.transform(
        located(text, CANDIDATE, "[0-9@]", lambda v: F.lit(True)),
        lambda s: F.struct(
            (s["first"] + F.length(F.regexp_extract(s["value"], lead, 0))).alias("first"), F.regexp_replace(s["value"], value, "").alias("value"),
            s["left"].alias("left"), s["right"].alias("right"),
        ),
    )
    return F.filter(trimmed, lambda s: s["value"] != "")


def _end(span: Column) -> Column:
    return span["first"] + F.length(span["value"])


def _side(text: Column, pattern: str) -> Column:
    """The word beside a candidate in small letters, without the marks around it unless it is only marks; null if none."""
    word = F.lower(F.regexp_extract(F.trim(text), pattern, 1))
    plain = F.regexp_replace(word, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")
    return F.nullif(F.when(plain == "", word).otherwise(plain), F.lit(""))


def patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a candidate with these characters on its sides."""
    before, after = _side(left, rf"([^{_SPACE}]*)$"), _side(right, rf"^([^{_SPACE}]*)")
    return F.array_compact(F.array(
        F.concat(F.lit("L "), before), F.concat(F.lit("R "), after), F.concat(F.lit("B "), before, F.lit(" "), after)
    ))


def find(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per row of `docs`: doc_id, a column of spans for each kind, and `context` spans, each an array of
    struct(first, last, value)."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    spanned = written(
        plain.select("doc_id", "_row", *[c.alias(k) for k, c in _base(F.col("_text")).items()], _candidates(F.col("_text")).alias("_words")),
        "spans",
    )
    seeds = F.concat(*[F.col(k) for k in KINDS])
    word = F.col("w")
    one = written(
        spanned.select("_row", F.explode("_words").alias("w"), seeds.alias("seeds")).select(
            "_row", "w.first", _end(word).alias("last"), "w.value", patterns(word["left"], word["right"]).alias("patterns"),
            F.exists("seeds", lambda s: (s["first"] < _end(word)) & (s["last"] > word["first"])).alias("seed"),
        ), "candidates",
    )
    discovered = discover(one, rounds, min_seeds, min_confidence)
    found = (
        one.filter(~F.col("seed")).join(discovered, "value", "left_semi")
        .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("first", "last", "value"))).alias(CONTEXT))
    )
    empty = F.array().cast("array<struct<first:int,last:int,value:string>>")
    short = [F.transform(k, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["value"].alias("value"))).alias(k) for k in KINDS]
    return spanned.join(found, "_row", "left").select("doc_id", *short, F.coalesce(CONTEXT, empty).alias(CONTEXT))


def discover(one: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """Values that are no seeds whose score reaches `min_confidence` after the last round. `one`: value, seed, patterns."""
    values = written(one.groupBy("value").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double")), "values")
    edges = written(one.select("value", F.explode("patterns").alias("pattern")).distinct(), "graph")
    for _ in range(rounds):
        counted = F.when(F.col("score") >= min_confidence, F.col("score")).otherwise(0.0)
        judged = edges.join(values, "value").groupBy("pattern").agg(F.sum(counted).alias("support"), F.count(F.lit(1)).alias("n"))
        confidence = F.col("support") / F.col("n")
        chosen = (F.col("support") >= min_seeds) & (confidence >= min_confidence)
        generic = (confidence <= 1 - min_confidence) & (F.col("n") >= GENERIC_VALUES)
        voting = judged.filter(chosen | generic).select("pattern", F.when(chosen, confidence).alias("confidence"), F.col("n").alias("weight"))
        reached = edges.join(voting, "pattern").groupBy("value").agg(
            F.max("confidence").alias("best"), F.sum(F.when(F.col("confidence").isNotNull(), F.col("weight"))).alias("for"), F.sum("weight").alias("all")
        )
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce(F.col("best") * F.col("for") / F.col("all"), F.lit(0.0)))
        values = written(values.join(reached, "value", "left").select("value", "seed", score.alias("score")), "values")
    return values.filter(~F.col("seed") & (F.col("score") >= min_confidence)).select("value")


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed and then start, joined by commas."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["first"], s["last"]))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256, spans."""
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(KINDS), 256).alias("base_sha256"), span_text((*KINDS, CONTEXT)).alias("spans"),
    )


def mask(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every span that was found replaced by its kind in angle brackets; all other columns unchanged.

    Spans with a fixed form are masked where the row is read. Only rows with another candidate are joined with what the
    contexts discovered; they are told apart by id and text, so equal rows are masked alike. Null texts stay null.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    row = F.col("row")
    body = row.getField(text)
    key = F.struct(row.getField(doc_id).alias("id"), F.xxhash64(body).alias("hash"), F.length(body).alias("size"))
    found = find(packed.select(key.alias("key"), body.alias("text")), doc_id="key", text="text")
    contexts = written(
        found.filter(F.size(CONTEXT) > 0).select(F.col("doc_id").alias("key"), _tagged(F.col(CONTEXT), CONTEXT).alias("contexts")).dropDuplicates(["key"]), "contexts"
    )
    seeds = F.concat(*[_tagged(spans, kind) for kind, spans in _base(F.coalesce(body, F.lit(""))).items()])
    marked = packed.select("row", seeds.alias("seeds"))
    # a candidate that no seed covers may be a context: only texts with one are sent to a join
    open_ = F.exists(_candidates(F.coalesce(body, F.lit(""))), lambda w: ~F.exists("seeds", lambda s: (s["first"] < _end(w)) & (s["last"] > w["first"])))
    plain = marked.filter(~open_).withColumn("contexts", F.array().cast("array<struct<first:int,last:int,kind:string>>"))
    asked = marked.filter(open_).withColumn("key", key).join(contexts, "key", "left").select(
        "row", "seeds", F.coalesce("contexts", F.array().cast("array<struct<first:int,last:int,kind:string>>")).alias("contexts")
    )
    everything = F.array_sort(F.concat("seeds", "contexts"))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("text"))

    def step(state: Column, s: Column) -> Column:
        # a span that begins inside the one before only lengthens it
        gap = F.when(s["first"] >= state["pos"], F.concat(
            F.substr(body, state["pos"] + 1, s["first"] - state["pos"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(state["pos"], s["last"]).alias("pos"), F.concat(state["text"], gap).alias("text"))

    masked = F.when(
        body.isNotNull(), F.aggregate(everything, start, step, lambda state: F.concat(state["text"], F.substr(body, state["pos"] + 1)))
    )
    whole = plain.unionByName(asked).select("row", masked.alias("masked"))
    return whole.select(*[(F.col("masked") if c == text else row.getField(c)).alias(c) for c in columns])


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.lit(kind).alias("kind")))


@query()
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return digest(find(documents(spark, folder)))
