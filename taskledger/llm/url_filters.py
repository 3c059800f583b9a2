"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of 256 bits in four longs. A listed URL's hash names its block, eight groups of
further hash bits name its bits there, so a test reads one block. URLs whose bits are all set are possible hits and go to an exact
hash join with the list, which removes false positives; all others never reach that join. The blocks are broadcast only
while their measured number stays below `most_blocks`; beyond it they are joined by shuffle.

Only DataFrame functions are used. Null URLs and URLs without `://` have empty host and path, fit no rule, and are never
listed. Of rules that fit the longest wins (host and path together), of equal ones the blocking one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskledger.llm.registry import query
from taskledger.session import written

BITS_PER_URL = 16
BLOCK_WORDS = 4
HASHES = 8
MOST_BROADCAST_BLOCKS = 250_000  # of 40 bytes: 10 MB
MOST_RULES = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without a file ending or slashes at its end; null without a host."""
    short = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _bit_words(key: Column) -> list[Column]:
    """The four words of a key's bits within its block."""
    bits = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(255)) for i in range(HASHES)]
    one, words = F.lit(1).cast("long"), []
    for w in range(BLOCK_WORDS):
        own = [
            F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)).cast("int")))
            .otherwise(F.lit(0).cast("long"))
            for p in places
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), own))
    return words


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """block, w0..w3: the filter of the non-null values of `key`."""
    words = _bit_words(F.col(key))
    return (
        listed.filter(F.col(key).isNotNull())
        .select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
        .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    )


def in_list(rows: DataFrame, listed: DataFrame, key: str, *, most_blocks: int = MOST_BROADCAST_BLOCKS) -> DataFrame:
    """`rows` with a boolean column `listed`: whether the value of `key` is one of `listed`'s (null never is)."""
    names = written(listed.select(F.col(key)).filter(F.col(key).isNotNull()).distinct(), "listed")
    n_blocks = max(1, math.ceil(names.count() * BITS_PER_URL / (64 * BLOCK_WORDS)))
    blocks = written(bloom_blocks(names, key, n_blocks), "bloom")
    blocks = F.broadcast(blocks) if n_blocks <= most_blocks else blocks
    probed = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n_blocks))).join(
        blocks.withColumnRenamed("block", "_block"), "_block", "left"
    )
    tests = [F.col(f"w{i}").bitwiseAND(w) == w for i, w in enumerate(_bit_words(F.col(key)))]
    possible = F.coalesce(F.col(key).isNotNull() & reduce(lambda a, b: a & b, tests), F.lit(False))
    hits = probed.filter(possible).select(*rows.columns).join(
        names.withColumn("listed", F.lit(True)), key, "left"
    ).select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return hits.unionByName(probed.filter(~possible).select(*rows.columns, F.lit(False).alias("listed")))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, *, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row; `listed` has canonical URLs in a column `canonical`."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select(
        "*", name.alias("rule"), verdict.alias("_verdict"), canonical(F.col("host"), F.col("path")).alias("canonical")
    )
    settled = ruled.filter(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("_verdict").alias("verdict"))
    rest = in_list(ruled.filter(F.col("rule").isNull()).drop("_verdict"), listed, "canonical")
    return settled.unionByName(
        rest.select("page_id", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    )


def repeated_urls(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """Canonical URLs that several rows of `pages` have: addresses that were crawled more than once."""
    name = canonical(*host_and_path(F.col(url)))
    return pages.select(name.alias("canonical")).filter("canonical is not null").groupBy("canonical").count().filter(
        "count > 1").select("canonical")


@query("""
WITH rests AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
), named AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\\.', '') || regexp_replace(path, '(?:\\.html)?/*$', '') END AS canonical
    FROM parts
), listed AS (
    SELECT canonical FROM named WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1
), rules(rhost, rpath, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fitting AS (
    SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM named JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT n.page_id, host, path, f.rule,
       coalesce(f.verdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fitting f ON f.page_id = n.page_id
""")
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return judge_urls(pages, repeated_urls(pages))
