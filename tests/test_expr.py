from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from taskledger.functions import expr as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_prefix_end():
    cases = {b"": None, b"a": b"b", b"a\xff": b"b", b"\xff": None, b"\xff\xff": None}
    assert {p: X.prefix_end(p) for p in cases} == cases


def test_prefix_range(spark):
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"", b"a", b"a\xff", b"ab", b"b", b"\xff", b"\xff\xff")], "key binary")
    for prefix in (b"", b"a", b"a\xff", b"\xff", b"\xff\xff"):
        got = sorted(bytes(r.key) for r in keys.filter(X.has_prefix(F.col("key"), prefix)).collect())
        assert got == sorted(bytes(r.key) for r in keys.collect() if bytes(r.key).startswith(prefix))


def test_quantities(spark):
    sizes = {"512Mi": 2**29, "1G": 10**9, "7": 7, "0": None, "1.5G": None, "": None, "18446744073709551616": None,
             "18446744073709551615": 2**64 - 1, "1KiB": None}
    for text, size in sizes.items():
        got = one(spark, X.memory_bytes(F.lit(text)))
        assert (got is None and size is None) or int(got) == size
    for cores, millis in {"0.5": 500, "2": 2000, "0.0005": None, "0": None, "-1": None, "x": None, "5000000": None}.items():
        assert one(spark, X.cpu_millis(F.lit(cores))) == millis


def test_times_and_tokens(spark):
    stamp = X.as_ntz("2024-02-29 01:02:03.120000")
    assert one(spark, X.time_text(stamp)) == "2024-02-29T01:02:03.12Z"
    assert one(spark, X.time_text(X.as_ntz("2024-02-29 01:02:03"))) == "2024-02-29T01:02:03Z"
    token = X.page_token(stamp, F.lit("id-1"))
    back = one(spark, X.read_page_token(token))
    assert (str(back.created_at), back.id) == ("2024-02-29 01:02:03.120000", "id-1")
    assert one(spark, X.read_page_token(F.lit("bm90IGEgdG9rZW4"))) is None
    for text, ok in {"2024-01-01T00:00:00Z": True, "2024-01-01T00:00:00.123456789+02:00": True, "2024-01-01 00:00:00Z": False,
                     "2024-13-01T00:00:00Z": False, "2024-01-01T00:00:00": False, "2024-01-01T00:00:00.1234567890Z": False}.items():
        assert one(spark, X.parses_as_time(F.lit(text))) is ok
    assert [one(spark, X.backoff_seconds(F.lit(n))) for n in (0, 1, 2, 7, 8, 50)] == [1, 1, 2, 64, 64, 64]
    assert [one(spark, X.part_count(F.lit(n))) for n in (0, 1, 8 << 20, (8 << 20) + 1)] == [0, 1, 1, 2]


def test_paths_and_links(spark):
    for name, ok in {"a/b": True, "a/b/": True, "": False, "/a": False, "a//b": False, "../a": False, "a/./b": False, "a\\b": False}.items():
        assert one(spark, X.safe_path(F.lit(name))) is ok, name
    links = {("a/b", "c"): True, ("a", "../outside"): False, ("a/b", "../x"): True, ("a", "/outside"): False,
             ("a", "/usr/../../outside"): False, ("a", "/usr/lib/x"): True, ("a", "/nix/store/x"): True, ("a", ""): False}
    for (name, target), ok in links.items():
        assert one(spark, X.safe_link(F.lit(name), F.lit(target))) is ok, (name, target)


def test_lines_match_splitlines(spark):
    for text in ("", "a", "a\n", "a\nb", "a\r\nb\r", "\n\n", "x\x0by\x0cz", "p\x85q r ", "tab\there"):
        assert one(spark, X.text_lines(F.lit(text))) == (text.splitlines() or [""])


def test_framed_digest(spark):
    frame = b"".join(len(p).to_bytes(8, "big") + p for p in (b"ab", b"c"))
    assert one(spark, X.framed_sha256(F.lit("ab"), F.lit("c"))) == hashlib.sha256(frame).hexdigest()
    assert one(spark, X.framed_sha256(F.lit("a"), F.lit("bc"))) != hashlib.sha256(frame).hexdigest()


def test_reference_attributes(spark):
    got = one(spark, X.uri_attributes(F.lit("s3://b/k;mime=a%2Fb;resolve=true")))
    assert (got.base, got.resolve, got.mime_type) == ("s3://b/k", True, "a/b")
    got = one(spark, X.uri_attributes(F.lit("blob:text/plain; charset=utf-8;resolve,abc")))
    assert (got.base, got.resolve, got.mime_type) == ("blob:text/plain; charset=utf-8,abc", True, "text/plain")
