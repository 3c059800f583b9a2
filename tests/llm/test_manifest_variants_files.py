"""Merkle manifest, spelling variants and token files against plain versions of their rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskledger.llm import merkle_manifest, spelling_variants, token_files
from taskledger.llm.common import remainder
from taskledger.llm.packing import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _group long, root string, `meta.src` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "r", "m") for r in rows], SCHEMA).repartition(3)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and for each leaf its siblings left and right on every level."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, at in enumerate(places):
            first = at - at % fanout
            paths[leaf].append((level[first:at], level[at + 1: first + fanout]))
        places = [at // fanout for at in places]
        level = [sha("".join(level[i: i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_proofs(rows: list[tuple], fanout: int) -> list[tuple]:
    sources: dict = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees, subroots = {}, []
    for s in ordered:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = own, *plain_tree([leaf_of(r) for r in own], fanout)
        subroots.append(trees[s][1])
    root, tops = plain_tree(subroots, fanout)
    made = []
    for s, top in zip(ordered, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            whole = path + top
            proof = [d for left, right in whole for d in (*left, *right)]
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                changed = (r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            folded = leaf_of(changed)
            for left, right in whole:
                folded = sha("".join([*left, folded, *right]))
            made.append((r[0], leaf_of(r), subroot, root, proof, sha("".join(proof)), folded, folded == root))
    return made


def leaf_of(r: tuple) -> str:
    return plain_leaf((r[0], r[3], r[2], r[4], r[1]))


def manifest_rows() -> list[tuple]:
    rng = random.Random(8)
    rows = [(i, f"Text {i} É" if i % 3 else f"text {i}", rng.choice(["en", None]), "hot" if i % 3 == 0 else rng.choice(["a", "b", "É", "Z"]), i) for i in range(190)]
    rows += [(1000 + i, f"Own {i}", "x", f"s{i:02d}", None) for i in range(40)]
    rows += [(500, None, None, None, None), (None, "No id", "en", None, 3), (None, None, None, "a", None), (501, "", "", "", 0), rows[3], rows[3]]
    return rows + [(502, "Long " * 60_000, "en", "lone", 300_000)]


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (2, 1), (3, 1), (4, 2)])
def test_manifest_equals_plain_tree(spark, fanout, levels):
    rows = manifest_rows()
    docs = table(spark, rows)
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle_manifest.prove(docs, claimed=remainder("doc_id", 5) == 0, claims={"text": small}, fanout=fanout, local_levels=levels)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, plain_proofs(rows, fanout)))


def test_manifest_of_an_empty_table_and_without_claims(spark):
    rows = manifest_rows()[:20]
    assert merkle_manifest.prove(table(spark, [])).count() == 0
    got = merkle_manifest.prove(table(spark, rows), proofs=False)
    assert all(r["verified"] and r["proof"] is None for r in got.collect())


def plain_variants(rows: list[tuple], drops: int) -> dict:
    counts: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % drops == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 5
    words = {w: n for w, n in counts.items() if n >= 3}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    made = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        made[w] = (form[w], root, n, len(beside[w]), words[form[w]] if form[w] else None)
    return made


def variant_rows() -> list[tuple]:
    rng = random.Random(4)
    base = ["colour", "color", "colours", "Übergröße", "übergrößen", "naïvely", "naively", "aaaaa", "aaaaaa", "aaaaab", "straße", "strasse"]
    base += ["shared" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(60)]
    base += ["".join(rng.choice("ab") for _ in range(6)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(60)) + " Ã×x1 tiny", "en", "s", 1) for i in range(60)]
    rows += [(None, "colour color " * 3, None, None, None), (7, None, None, None, None), (8, "", None, None, None), rows[2], rows[2]]
    return rows + [(900 + i, ("verylongword" * 3000 + ("" if i % 2 else "x")) + " ok", "en", "s", 1) for i in range(8)]


@pytest.mark.parametrize("most_pairs", [spelling_variants.MOST_PAIRS, 5, 0])
def test_variants_equal_plain_version(spark, most_pairs):
    rows = variant_rows()
    words = spelling_variants.count_words(table(spark, rows), drops=7)
    if most_pairs < 1000:  # by deletion a long word has as many rests as letters
        words = words.filter(F.length("word") < 100)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants.variants(words, most_pairs=most_pairs).collect()}
    expected = plain_variants([r for r in rows if most_pairs > 1000 or not (r[1] or "").startswith("very")], 7)
    if most_pairs < 1000:
        got = {w: v for w, v in got.items() if len(w) < 100}
        expected = {w: v for w, v in expected.items() if len(w) < 100}
    assert got == expected
    assert any(v[0] and v[1] != v[0] for v in got.values()) or most_pairs < 1000


def test_variants_of_an_empty_table(spark):
    assert spelling_variants.variants(spelling_variants.count_words(table(spark, []))).count() == 0


ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "中文", "'s", "'ll", "1", "<|endoftext|>", "\x1c", "\x85", "-", "_", "🙂", "\r\n", " word", " "]


def token_rows() -> list[tuple]:
    rng = random.Random(6)
    rows = [(rng.randint(-50, 10**6), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))), "en", "s", 1) for _ in range(250)]
    rows += [(5, None, None, None, None), (6, "", None, None, None), (None, "No id", None, None, None), (None, None, None, None, None), rows[3], rows[3]]
    return rows + [(10**7, "Long text, with words. " * 20_000, "en", "s", 1), (10**7 + 1, "x" * 30_000, "en", "s", 1)]


def test_files_give_back_all_ids_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = token_rows()
    tokenizer = Tokenizer.from_file(vocabulary_path(token_files.VOCABULARY))
    wanted = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    path = str(tmp_path / "ids")
    token_files.write_ids(token_files.token_ids(table(spark, rows), path=vocabulary_path(token_files.VOCABULARY)), path, block_tokens=300)
    assert spark.read.parquet(f"{path}/blocks").count() > 10
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_files.read_ids(spark, path).collect())
    assert sorted(((i is not None, i or 0), ids) for _, i, _, _, ids in got) == sorted(((i is not None, i or 0), ids) for i, ids in wanted)
    place, last = 0, None
    for start, doc_id, n, crc, ids in got:
        assert start == place and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert last is None or doc_id >= last
        place, last = place + n, doc_id


def test_part_ids_of_slices():
    from tokenizers import Tokenizer

    path = vocabulary_path(token_files.VOCABULARY)
    tokenizer, texts = Tokenizer.from_file(path), [r[1] for r in token_rows()[:250]]
    column = pa.array(texts)
    for first, n in ((0, 250), (13, 60), (240, 10)):
        ids, _ = token_files.PartIds(path)(column.slice(first, n))
        assert ids.tolist() == [i for t in texts[first: first + n] for i in (*tokenizer.encode(t, add_special_tokens=False).ids, 0)]


def test_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_ids(token_files.token_ids(table(spark, []), path=vocabulary_path(token_files.VOCABULARY)), path)
    assert token_files.read_ids(spark, path).count() == 0


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(2)
    for n, limit in ((1, 18), (2, 18), (3, 2), (40, 6), (300, 18), (500, 9)):
        counts = (rng.pareto(0.4, n) * 10 + 1).astype(np.int64)
        lengths = np.array(token_files.code_lengths(counts.tolist(), limit))
        assert lengths.max() <= limit and (0.5 ** lengths.astype(float)).sum() <= 1
        code = token_files.Code(np.arange(n) * 3, lengths)
        ids = rng.choice(np.arange(n) * 3, 2000).astype(np.uint32)
        stream, offsets = code.encode(ids)
        assert (code.decode(stream, offsets, len(ids)) == ids).all()
        assert (code.decode(stream, offsets, len(ids), 700, 1300) == ids[700:1300]).all()
    # against all codes of four symbols with at most three bits
    best = min(sum(c * x for c, x in zip((9, 5, 2, 1), s, strict=True)) for s in np.ndindex(3, 3, 3, 3) if sum(0.5 ** (x + 1) for x in s) <= 1)
    assert sum(c * (x - 1) for c, x in zip((9, 5, 2, 1), token_files.code_lengths([9, 5, 2, 1], 3), strict=True)) == best
    with pytest.raises(ValueError):
        token_files.code_lengths([1] * 9, 3)
