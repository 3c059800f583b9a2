"""Each operator against a plain version of its rules, on small tables with nulls, empty, long and repeated texts."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from taskledger.llm import (
    decontamination, language_id, lm_scoring, packing, pii, quality_classifier, quality_rules, simhash_dedup,
    substring_dedup, url_filters,
)
from taskledger.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, _row long, `prefix` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENGLISH = "the of and to in that was with for on is be it as by this from which have not are but had or".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "ly", "en"]) for _ in range(n))


def made_texts() -> list[tuple]:
    rng = random.Random(3)
    texts = [sentence(rng, ENGLISH if i % 2 else GERMAN, rng.randint(5, 120)) for i in range(60)]
    passage = sentence(rng, ENGLISH, 40)
    texts += [passage + " " + sentence(rng, ENGLISH, 30), sentence(rng, ENGLISH, 20) + " " + passage, passage.upper()]
    texts += [texts[5], texts[5] + " end", texts[7]]
    texts += ["", None, " \t\n", "x", "ÉÉ ßß ñ\u00a0ñ \u2028 z", "a b c", "12 34 !!", "To " * 400, "long" * 5000]
    texts += [" ".join(itertools.chain.from_iterable([f"w{i}", "the"] for i in range(3000)))]
    texts += ["mail a.b@c.de, x@y and b@c.d.e_f@g.h or 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 555-1234 4539 1488 0343 6467 4539148803436468"]
    texts += [f"id {i} of 7086638319846{i:03d} and 4539148803436467 by mail u{i}@x.org" for i in range(8)]
    return [(i, t, "de" if i % 2 == 0 and i < 60 else "en", "s", None, 0.5, 7, "p") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    made = made_texts()
    return made + [(None, "no id here at all", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), made[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- language labels


def test_marginals_are_those_of_all_label_sequences():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 4])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    expected = np.zeros((8, 3))
    at = 0
    for n in lengths:
        total = 0.0
        part = np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=int(n)):
            value = sum(scores[at + i, k] for i, k in enumerate(labels))
            value = math.exp(value + sum(moves[a, b] for a, b in itertools.pairwise(labels)))
            total += value
            for i, k in enumerate(labels):
                part[i, k] += value
        expected[at: at + n] = part / total
        at += n
    assert np.allclose(language_id.marginals(scores, lengths, moves), expected)


def test_languages_are_learned_and_switch_within_a_text(spark, docs):
    model = language_id.fit(docs, remainder("doc_id", 4) != 2)
    assert model.labels == ["de", "en"]
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == ("de" if i % 2 == 0 else "en") for i in range(60)) >= 58
    made = made_texts()
    for i, text, *_ in made:
        letters = bool(text) and any(c.isalpha() for c in text)
        assert (got[i]["lang_pred"] == "und") == (not letters)
        assert 0 <= got[i]["score"] <= 1
    mixed = spark.createDataFrame([(1, " ".join(ENGLISH + GERMAN))], "doc_id long, text string")
    spans = language_id.spans(mixed, model).orderBy("first_word").collect()
    assert (spans[0]["lang"], spans[-1]["lang"]) == ("en", "de") and spans[-1]["last_word"] == len(ENGLISH + GERMAN) - 1


def test_languages_without_anything_to_learn(docs, nothing):
    model = language_id.fit(nothing, remainder("doc_id", 4) != 2)
    assert {r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


# --- SimHash


def plain_fingerprint(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i: i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes: list[int], linked) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash_groups(docs, rows, nothing):
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    group = groups_of(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            smallest[group[p]] = min(i, smallest.get(group[p], i))
    expected = [(r[0], p - (1 << 64) if p >> 63 else p, smallest.get(group[p])) for r, p in zip(rows, prints, strict=True)]
    assert found(simhash_dedup.dedup_groups(docs), "doc_id", "fp", "component_id") == sorted(expected, key=repr)
    assert simhash_dedup.dedup_groups(nothing).count() == 0
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted(smallest.values())


@pytest.mark.parametrize("most", [1 << 6, 1 << 21])
def test_ball_links_keep_every_component(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "MOST_VARIANTS", most)
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:20]:
        for _ in range(4):
            p ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 5))})
            prints.append(p)
    prints = sorted(set(prints))
    expected = groups_of(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    bits = 4
    links = [
        (int(a), int(b))
        for prefix in range(1 << bits)
        for a, b in zip(*simhash_dedup.local_links(np.array(prints, dtype=np.uint64), prefix, bits, 2), strict=True)
    ] if most < 1 << 20 else [
        (r["a"] % (1 << 64), r["b"] % (1 << 64))
        for r in simhash_dedup.ball_links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")).collect()
    ]
    pairs = {frozenset(x) for x in links}
    assert groups_of(prints, lambda a, b: frozenset((a, b)) in pairs) == expected


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i + 1, i) for i in range(300)] + [(1000 + i, 999) for i in range(300)] + [(5000, 4999)]
    links = spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long")
    got = {r["node"]: r["root"] for r in simhash_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 999 for i in range(300)} | {5000: 4999}


# --- repeated passages


def test_repeats_are_removed_as_defined(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 1_000)
    ids = [substring_dedup.NO_ID if r[0] is None else r[0] for r in rows]
    texts = [WORD.findall(r[1] or "") for r in rows]
    first: dict[tuple, int] = {}
    for i, w in zip(ids, texts, strict=True):
        for a in range(len(w) - 12):
            first[tuple(w[a: a + 13])] = min(i, first.get(tuple(w[a: a + 13]), i))
    expected = []
    for row, i, w in zip(rows, ids, texts, strict=True):
        gone = {p for a in range(len(w) - 12) if first[tuple(w[a: a + 13])] < i for p in range(a, a + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        expected.append((row[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup.remove_repeats(docs, with_text=True)
    assert found(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == sorted(expected, key=repr)
    assert any(e[2] for e in expected)
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_repeats_with_text_ids(docs, rows):
    named = docs.selectExpr("'n' || lpad(doc_id, 9, '0') AS doc_id", "text", "lang AS `meta.lang`")
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(named).collect()}
    plain = substring_dedup.remove_repeats(docs).collect()
    assert got == {(None if r["doc_id"] is None else f"n{r['doc_id']:09d}", r["n_words"], r["n_removed"], r["kept_sha256"]) for r in plain}


def test_blocks_and_buckets_grow_with_the_root_of_the_input():
    entries = []
    for total in (1 << 30, 30 << 30, 160 << 30):
        blocks, bits = substring_dedup.layout(total)
        entries.append(blocks * 2**bits / total)
    assert entries[2] < 12 * entries[1] and substring_dedup.layout(0) == (1, 0)


# --- test items


def distance_within(pattern: str, text: str) -> int:
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_items_are_found_within_the_error_budget(spark, nothing):
    rng = random.Random(4)
    items = [sentence(rng, ENGLISH, 12) for _ in range(6)] + ["short one", None, ""]
    items.append(items[0].upper().replace(" ", "\n"))
    texts = []
    for n in range(40):
        base = list(items[n % 6])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(base))
            base[at: at + rng.randint(0, 1)] = rng.choice("xyz")
        texts.append(sentence(rng, ENGLISH, 15) + " " + "".join(base) + "  " + sentence(rng, ENGLISH, 5))
    texts += [None, "", items[2] * 3]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = []
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            form = decontamination.plain(item)
            if t and len(form) >= 20 and (d := distance_within(form, decontamination.plain(t))) <= int(len(form) * 0.08):
                expected.append((i, k, d))
    got = decontamination.find_items(docs, table, block_chars=150)
    assert found(got, "doc_id", "item_id", "distance") == sorted(expected, key=repr)
    assert 10 < len(expected) < 60
    hit = {e[0] for e in expected}
    clean = decontamination.keep_clean(docs, table, block_chars=150)
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(len(texts)) if i not in hit]
    assert decontamination.find_items(nothing, table).count() == 0
    assert decontamination.find_items(docs, table.limit(0)).count() == 0


# --- quality


def test_quality_scores_tell_junk_from_prose(spark, nothing):
    rng = random.Random(8)
    prose = [sentence(rng, ENGLISH + GERMAN, rng.randint(30, 90)) for _ in range(150)]
    junk = [" ".join(rng.choice(["buy", "$$$", "###", "now", "click"]) for _ in range(rng.randint(20, 80))) for _ in range(100)]
    texts = prose + junk + [None, ""]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(250)] + [(3, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, quality_classifier.learned_rows())
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, model).collect()}
    held = [i for i in range(250) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i < 150) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert quality_classifier.score(nothing, model).count() == 0
    none = quality_classifier.fit(docs, labels.limit(0), quality_classifier.learned_rows())
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}


# --- packing


def test_packing_places_every_piece_once_and_tightly(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    expected = []
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece in range(-(-len(ids) // 2048)):
            part = ids[2048 * piece: 2048 * (piece + 1)]
            expected.append((i, piece, 2048 * piece, len(part), zlib.crc32(part.tobytes())))
    packed = packing.pack(packing.pieces(docs, path=packing.vocabulary_path()), group_pieces=30)
    assert found(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(expected, key=repr)
    places: dict[int, list] = {}
    for r in packed.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(e[3] for e in expected) // 2048) + 4
    assert packing.pack(packing.pieces(nothing, path=packing.vocabulary_path())).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, size=500)
    bins, offsets = packing.best_fit(lengths, 64)
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        open_bins = [(c, b) for b, c in enumerate(left) if c >= lengths[i]]
        capacity = min(open_bins)[0] if open_bins else 64
        if not open_bins:
            left.append(64)
        assert offsets[i] == 64 - capacity
        left[bins[i]] -= lengths[i]
    assert min(left) >= 0


# --- URLs


def test_url_parts_rules_and_list(spark):
    urls = [
        "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/",
        "ftp://b.com/fr/", "x://com/de/9", "http://example.net/p/?q", "http://www.example.net/p", "http://m.example.net/p.html#t",
        "http://org?x", "http://other.net/z", "nothing", "", None, "://", "http://EXAMPLE.net", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge_urls(pages, url_filters.repeated_urls(pages)).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3] == ("notexample.org", "/es/", "org/", "allow")
    assert got[4] == ("b.com", "/fr/", "com/fr/", "allow")
    assert got[5] == ("com", "/de/9", "com/de/", "block")
    assert [got[i] for i in (6, 7, 8)] == [
        ("example.net", "/p/", None, "block"), ("www.example.net", "/p", None, "block"), ("m.example.net", "/p.html", None, "block")
    ]
    assert got[9] == ("org", "", None, "allow")
    assert got[10] == ("other.net", "/z", None, "allow")
    assert [got[i] for i in (11, 12, 13, 14)] == [("", "", None, "allow")] * 4
    assert got[16] == ("b:", "//c/d", None, "allow")
    assert url_filters.judge_urls(pages.limit(0), url_filters.repeated_urls(pages)).count() == 0


@pytest.mark.parametrize("most", [0, 1_000])
def test_the_filter_misses_nothing_and_the_join_removes_the_rest(spark, most):
    listed = spark.range(0, 4000, 2).selectExpr("concat('u', id) AS u")
    rows = spark.range(0, 6000).selectExpr("id", "concat('u', id) AS u").unionByName(spark.createDataFrame([(-1, None)], "id long, u string"))
    got = {r["id"]: r["listed"] for r in url_filters.in_list(rows, listed, "u", most_blocks=most).collect()}
    assert got == {i: i % 2 == 0 and i < 4000 for i in range(6000)} | {-1: False}
    blocks = url_filters.bloom_blocks(listed, "u", 50)
    assert blocks.count() == 50 and min(r["w0"] != 0 for r in blocks.collect())


# --- language-model scores


def test_base_scores_and_counts_are_exact(docs, rows, nothing):
    chosen = remainder("doc_id", 5) != 1
    counts, n = Counter(), 0
    for i, text, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*WORD.findall(lower(text or "")), "\n"])
    n, v = sum(counts.values()), len(counts)
    counted = lm_scoring.learn(docs, chosen, frequent_words=20)  # most words take the way through the join
    expected = []
    for i, text, *_ in rows:
        tokens = [*WORD.findall(lower(text or "")), "\n"]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        expected.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    got = [(*r[:4], round(r[4], 6)) for r in lm_scoring.score(docs, counted).select(
        "doc_id", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert lm_scoring.score(nothing, counted).count() == 0
    empty = lm_scoring.learn(nothing, chosen)
    assert all(r["score"] < 0 and r["n_known"] == 0 for r in lm_scoring.score(docs, empty).collect())


def plain_repeats(tokens, prior):
    """log10 cost of the repeat bits, and which tokens are spelled, token by token."""
    last, tried, right, state, cost, spelled = {}, Counter(), Counter(), (0, 0), 0.0, []
    for i, token in enumerate(tokens):
        at = last.get(tokens[i - 1]) if i else None
        bit = 0
        if at is not None:
            agree = 1
            while agree < lm_scoring.MATCHES and i > agree and at > agree and tokens[i - agree - 1] == tokens[at - agree - 1]:
                agree += 1
            cell = (agree - 1) * 4 + state[0] * 2 + state[1]
            p = (lm_scoring.OWN_WEIGHT * prior[cell] + right[cell]) / (lm_scoring.OWN_WEIGHT + tried[cell])
            bit = int(tokens[at] == token)
            cost += math.log10(p if bit else 1 - p)
            tried[cell] += 1
            right[cell] += bit
        if not bit:
            spelled.append(i)
        if i:
            last[tokens[i - 1]] = i
        state = (bit, state[0])
    return cost, spelled


def test_repeat_bits_against_a_plain_version():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 40, 0, 300, 2, 90])
    ids = rng.integers(0, 7, lengths.sum())
    prior = rng.uniform(0.05, 0.9, lm_scoring.REPEAT_CELLS)
    there, hit, cell = lm_scoring.repeats(ids, lengths)
    chance = lm_scoring.repeat_chances(there, hit, cell, lengths, prior)
    cut = list(lm_scoring.text_parts(lengths, 60))
    assert [t for texts, _ in cut for t in range(texts.start, texts.stop)] == list(range(6)) and len(cut) > 2
    for texts, tokens in cut:
        part = lm_scoring.repeats(ids[tokens], lengths[texts])
        assert all((p == whole[tokens]).all() for p, whole in zip(part, (there, hit, cell), strict=True))
    ends = np.cumsum(lengths)
    for a, b in zip(ends - lengths, ends, strict=True):
        cost, spelled = plain_repeats(ids[a:b].tolist(), prior)
        own = np.where(there[a:b], np.log10(np.where(hit[a:b], chance[a:b], 1 - chance[a:b])), 0).sum()
        assert abs(own - cost) < 1e-9
        assert np.flatnonzero(~hit[a:b]).tolist() == spelled


def test_the_order_of_words_counts(spark):
    rng = random.Random(30)
    phrase = [f"w{i}" for i in range(12)]
    texts = [" ".join(phrase * 4), " ".join(rng.sample(phrase * 4, 48)), " ".join(f"z{i}" for i in range(48))]
    learned = [(100 + i, sentence(rng, ENGLISH, 40)) for i in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), *learned], "doc_id long, text string")
    counted = lm_scoring.learn(docs, F.col("doc_id") >= 100)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, counted).collect()}
    assert got[0]["score"] > got[1]["score"] + 5
    for i, text in enumerate(texts):
        size = sum(len(w) + 1 for w in text.split()) + 1
        assert abs(got[i]["bits_per_byte"] * size + got[i]["score"] * math.log2(10)) < 1e-6


def test_mixing_is_fitted_to_all_pairs(spark):
    rng = random.Random(31)
    rows = {(bytes(rng.choices(b"abcd", k=rng.randint(1, 6))), rng.randint(0, 2)): rng.randint(1, 30) for _ in range(300)}
    rows |= {("größe".encode(), 0): 1, (b"\n", 0): 40, (b"\n", 2): 5}
    pairs = spark.createDataFrame([(w, c, n, n > 5) for (w, c), n in rows.items()], "word binary, class int, n long, frequent boolean")
    code = lm_scoring.bit_code(np.arange(256))
    made = lm_scoring.tables(pairs.repartition(3), code)
    words, classes = [w for w, _ in rows], np.array([c for _, c in rows])
    hashed, text, starts = lm_scoring.contexts(words, classes)
    place, node, y, _ = lm_scoring.bits(text, code)
    n = np.repeat(np.array([*rows.values()]), np.diff(np.append(starts, len(text))))[place]
    _, _, counts = lm_scoring._lookups()
    x, seen = [], {}
    for name, size in lm_scoring.TABLES.items():
        kept = made[name][lm_scoring.slots(hashed[name][place], node, size)]
        own = n > 5 if name in ("word", "class_word") else True
        zeros, ones = np.maximum(counts[0][kept] - own * (y == 0), 0), np.maximum(counts[1][kept] - own * (y == 1), 0)
        x.append(np.log((ones + 0.4) / (zeros + 0.4)))
        seen[name] = np.minimum(np.ceil(np.log2(1 + zeros + ones) / 2), 7).astype(int)
    x, gate = np.stack([*x, np.ones(len(y))], axis=1), seen["word"] * 8 + seen["last5"]
    start = lm_scoring.Model(made).weights.astype(float)
    weights = start.copy()
    for _ in range(lm_scoring.ROUNDS):
        p = 1 / (1 + np.exp(-(weights[gate] * x).sum(axis=1)))
        for g in range(lm_scoring.GATES):
            own = gate == g
            curve = (x[own].T * (n * p * (1 - p))[own]) @ x[own] + lm_scoring.RIDGE * np.eye(x.shape[1])
            step = np.linalg.solve(curve, x[own].T @ (n * (y - p))[own] - lm_scoring.RIDGE * (weights - start)[g])
            weights[g] += step / max(1, np.abs(step).max() / lm_scoring.MOST_STEP)
    for parts in (1, 4):
        model = lm_scoring.fit_mixing(pairs.repartition(parts), made, code)
        assert np.abs(model.weights - weights).max() < 1e-3
        cell = lm_scoring._cell(gate, (model.weights[gate] * x).sum(axis=1))
        every = np.bincount(cell, weights=n, minlength=model.refined.size)
        prior = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, lm_scoring.REFINE_STEPS), lm_scoring.GATES)))
        share = (np.bincount(cell, weights=n * y, minlength=len(every)) + 20 * prior) / (every + 20)
        near = np.isclose(model.refined.reshape(-1), np.log(share / (1 - share)), atol=1e-3)
        assert near.mean() > 0.99  # a logit on the border of two cells may fall to either
    apart = np.add.reduceat(model.log10_bytes(hashed, text), starts)
    assert np.abs(model.log10(words, classes) - apart).max() < 1e-5  # as without bytes taken together


def test_codes_come_from_the_bytes_of_all_words(spark):
    docs = spark.createDataFrame([(1, "a a a bc bc zebra"), (2, None)], "doc_id long, text string")
    counted = lm_scoring.learn(docs, F.lit(True), frequent_words=1)
    every = Counter(b"a a a bc bc zebra \n \n ")
    assert lm_scoring.byte_counts(counted.words).tolist() == [every[b] for b in range(256)]
    expected = lm_scoring.bit_code(np.array([every[b] for b in range(256)]))
    assert all((have == want).all() for have, want in zip(counted.model.code, expected, strict=True))


@pytest.mark.parametrize("frequent_words", [1, 150_000])
def test_pairs_met_once_teach_the_whole_word_contexts(spark, frequent_words):
    docs = spark.createDataFrame([(1, "often often often bc bc zebra"), (2, "über quagga"), (3, None)], "doc_id long, text string")
    model = lm_scoring.learn(docs, F.lit(True), frequent_words=frequent_words).model
    pairs = [(b"zebra", 0), (b"bc", 0), ("über".encode(), 0), (b"quagga", lm_scoring.word_class("über".encode()))]
    hashed, text, _ = lm_scoring.contexts([w for w, _ in pairs], np.array([c for _, c in pairs]))
    place, node, y, _ = lm_scoring.bits(text, model.code)
    _, _, counts = lm_scoring._lookups()
    for name, size in lm_scoring.TABLES.items():
        kept = model.tables[name][lm_scoring.slots(hashed[name][place], node, size)]
        assert (counts[y, kept] > 0.9).all(), name  # the count of what each bit was


def test_bytes_share_a_probability_of_one():
    rng = np.random.default_rng(3)
    tables = {name: rng.integers(0, 1 << 16, 1 << bits, dtype=np.uint16) for name, bits in lm_scoring.TABLES.items()}
    weights = rng.normal(size=(lm_scoring.GATES, len(tables) + 1)).astype(np.float32)
    refined = rng.normal(size=(lm_scoring.GATES, lm_scoring.REFINE_STEPS)).astype(np.float32)
    model = lm_scoring.Model(tables, weights, refined, lm_scoring.bit_code(rng.integers(0, 5000, 256)))
    hashed, text, starts = lm_scoring.contexts([b"th" + bytes([b]) for b in range(256)], np.full(256, 3))
    third = model.log10_bytes(hashed, text)[starts + 2]
    assert abs((10**third).sum() - 1) < 1e-4


def test_context_classes_follow_the_last_marked_word():
    marks = np.array([0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 7, 0, 0, 3, 0])
    got = lm_scoring.token_classes(marks, np.array([13, 3])).tolist()
    assert got == [0, 0, 5, 5, 5, 5, 5, 5, 5, 5, 0, 0, 7, 0, 0, 3]


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[str]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_those_of_the_plain_patterns(spark, docs, rows, nothing):
    rng = random.Random(6)
    parts = ["1", "25", "4539148803436467", ".", "..", "@", "a", "b-c", "_x", "+1", "+44 ", "(0)", " ", "-", "é", "😀", "\n", "300", "0001"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["+1 (382) 555-0822 Ünd 😀 4539-1488-0343-6467, me@x.y", "9" * 20_000, "a." * 20_000 + "@b.c", "1.2." * 5_000]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for table, all_texts in ((made, texts), (docs, [r[1] for r in rows])):
        got = sorted((r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in pii.digest(pii.find(table)).collect())
        spans = [plain_spans(t or "") for t in all_texts]
        assert got == sorted((hashlib.sha256(",".join(s).encode()).hexdigest(), len(s)) for s in spans)
    assert pii.digest(pii.find(nothing)).count() == 0


def test_contexts_of_seeds_discover_more_and_all_spans_are_masked(docs):
    spans = {r["doc_id"]: r for r in pii.find(docs).collect()}
    last = [r for r in made_texts() if r[1] and r[1].startswith("id ")]
    assert len(last) == 8
    assert all(len(spans[r[0]]["email"]) == 1 and len(spans[r[0]]["card"]) >= 1 for r in last)
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    by_id = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert by_id[last[0][0]].endswith("by mail <email>") and "4539148803436467" not in by_id[last[0][0]]
    assert by_id[3] == made_texts()[3][1]


def plain_discovery(texts, rounds=pii.ROUNDS, min_seeds=pii.MIN_SEEDS, sure=pii.MIN_CONFIDENCE):
    """(text number, start, end) of the context spans, by the rules in plain Python."""
    space, number = r"\x20\x09-\x0D", r"[(+]?[0-9][0-9().,/:+-]*(?![^\x20\x09-\x0D])"
    form = re.compile(rf"(?<![^{space}])(?:{number}(?: {number})*|[^{space}0-9@]*[0-9@][^{space}]*)")
    kinds = {}
    for t, text in enumerate(texts):
        for span in plain_spans(text):
            kinds.setdefault(t, []).append(tuple(map(int, span.split(":")[1:])))

    def side(word):
        bare = re.sub(r"^[^a-z0-9äöüß]+|[^a-z0-9äöüß]+$", "", word.lower())
        return bare or word.lower()

    places, seed, edges = [], {}, set()
    for t, text in enumerate(texts):
        found = list(form.finditer(text))
        for i, m in enumerate(found):
            value = re.sub(r"^[^A-Za-z0-9+äöüß]+|[^A-Za-z0-9äöüß]+$", "", m.group())
            if not value:
                continue
            first = m.start() + len(re.match(r"[^A-Za-z0-9+äöüß]*", m.group()).group())
            last = first + len(value)
            before = text[found[i - 1].end() if i else 0: m.start()][-40:].split(" ")
            after = text[m.end(): found[i + 1].start() if i + 1 < len(found) else len(text)][:40].strip(" ").split(" ")
            left = next((w for w in reversed(before) if w), "")
            left, right = side(left) if left else None, side(after[0]) if after[0] else None
            own = any(a < last and b > first for a, b in kinds.get(t, ()))
            seed[value] = seed.get(value, False) or own
            places.append((t, first, last, value, own))
            edges |= {(p, value) for p in (left and f"L {left}", right and f"R {right}", left and right and f"B {left} {right}") if p}
    score = {v: float(s) for v, s in seed.items()}
    for _ in range(rounds):
        by_pattern, by_value = {}, {}
        for p, v in edges:
            by_pattern.setdefault(p, []).append(v)
            by_value.setdefault(v, []).append(p)
        votes = {}
        for p, own in by_pattern.items():
            support = sum(score[v] for v in own if score[v] >= sure)
            if support >= min_seeds and support / len(own) >= sure:
                votes[p] = (support / len(own), len(own))
            elif support / len(own) <= 1 - sure and len(own) >= pii.GENERIC_VALUES:
                votes[p] = (None, len(own))
        score = {v: 1.0 if seed[v] else 0.0 for v in seed}
        for v, own in by_value.items():
            given = [votes[p] for p in own if p in votes]
            for_ = [x for x in given if x[0] is not None]
            if not seed[v] and for_:
                score[v] = max(x[0] for x in for_) * sum(x[1] for x in for_) / sum(x[1] for x in given)
    return {(t, a, b) for t, a, b, v, own in places if not own and not seed[v] and score[v] >= sure}


def discovery_texts():
    rng = random.Random(14)
    texts = [f"der host mit ip 10.0.0.{i} war da" for i in range(20)]  # seeds after "ip"
    texts += [f"noch ein ip 10.0.999.{i} hier" for i in range(6)]  # of the same pattern, but no address
    texts += [f"am host 10.0.999.{i} lief es" for i in range(6)]  # what was found also stands after "host"
    texts += [f"am host node-{i}x lief es" for i in range(2)]  # which finds these in the next round
    texts += ["später auf node-1x allein"]  # and they are found wherever they stand
    texts += [f"seite {i} von {i + 40} im buch" for i in range(60)]  # generic contexts
    texts += ["ip 7 kam", "seite 7 von 9", "+49 (30) 123-4567, konto 12 345 678 9!", "(konto) 44 55 66 77.", "@ @@ 1", ""]
    return texts + [" ".join(rng.choice(["und", "9", "a1", "oder", "10.0.999.2", "x@y.de", "+1"]) for _ in range(12)) for _ in range(20)]


def test_discovery_by_contexts_with_the_production_parameters(docs):
    texts = discovery_texts()
    made = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], s["first"], s["last"]) for r in pii.find(made).collect() for s in r["context"]}
    assert got == plain_discovery(texts)
    found = {texts[t][a:b] for t, a, b in got}
    assert {f"10.0.999.{i}" for i in range(6)} | {"node-0x", "node-1x"} <= found and "7" not in found
    assert any(texts[t].startswith("später") for t, _, _ in got)
    masked = {r["doc_id"]: r["text"] for r in pii.mask(made).collect()}
    assert masked[texts.index("später auf node-1x allein")] == "später auf <context> allein"


# --- quality rules


def test_base_counts_of_rules(docs, rows, nothing):
    refs = quality_rules.references(docs)
    assert sorted(refs.languages) == ["de", "en"]
    expected = []
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[a: a + 5]) for a in range(len(words) - 4))
        covered = {p for a in range(len(words) - 4) if windows[tuple(words[a: a + 5])] > 1 for p in range(a, a + 5)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        expected.append((
            i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words),
        ))
    got = quality_rules.judge(docs, refs)
    assert found(got, *got.columns[:7]) == sorted(expected, key=repr)
    assert not got.filter("base_failed AND kept").count()
    assert quality_rules.judge(nothing, refs).count() == 0
    assert quality_rules.judge(docs, quality_rules.references(nothing)).filter("kept = base_failed").count() == 0


def test_jensen_shannon_bounds():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality_rules.jensen_shannon(p, p) == 0 and quality_rules.jensen_shannon(p, q) == 1


def plain_distances(rows, least_documents):
    """doc number -> {language: (class distance, word distance)}, counted without the document itself."""
    vowels, consonants = "aeiou", "bcdfghjklmnpqrstvwxyz"

    def kind(c):
        for i, own in enumerate((vowels, consonants, vowels.upper() + consonants.upper())):
            if c in own:
                return i
        for name, own in (("digit", "0123456789"), ("space", " \t\n\r\x0b\x0c"), ("end mark", ".!?"), ("punctuation", ",;:'\"()-"),
                          ("symbol", "#*$%&|<>=+/\\_~^@[]{}`")):
            if c in own:
                return quality_rules.CLASSES.index(name)
        return quality_rules.CLASSES.index("other letter" if ord(c) > 127 else "rest")

    def distance(p, q):
        def part(a, b):
            return sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x > 0)
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    chars, found = {}, {}
    for i, text, lang, *_ in rows:
        chars[i] = Counter(map(kind, text))
        found[i] = Counter(WORD.findall(lower(text)))
    langs = {lang for _, _, lang, *_ in rows if lang}
    langs = {g for g in langs if sum(r[2] == g for r in rows) >= least_documents}
    made = {}
    for i, text, lang, *_ in rows:
        made[i] = {}
        for g in langs:
            of = [r[0] for r in rows if r[2] == g]
            all_chars, all_words = sum((chars[j] for j in of), Counter()), sum((found[j] for j in of), Counter())
            common = sorted(all_words, key=lambda w: (-all_words[w], w.encode()))[: quality_rules.COMMON_WORDS]
            out = lang == g
            c = [all_chars[k] - out * chars[i][k] for k in range(len(quality_rules.CLASSES))]
            w = [all_words[x] - out * found[i][x] for x in common]
            w.append(sum(all_words.values()) - out * sum(found[i].values()) - sum(w))
            own = [found[i][x] for x in common]
            by_word = distance(w, [*own, sum(found[i].values()) - sum(own)]) if sum(found[i].values()) >= quality_rules.MIN_WORDS else None
            by_class = distance(c, [chars[i][k] for k in range(len(quality_rules.CLASSES))]) if len(text) >= quality_rules.MIN_CHARS else None
            made[i][g] = (by_class, by_word)
    return made


def test_distances_to_references(spark):
    rng = random.Random(21)
    rows = [(i, sentence(rng, ENGLISH if i % 2 else GERMAN, rng.randint(20, 150)), "en" if i % 2 else "de") for i in range(80)]
    junk = "=+/ 0x7f %% {} qq zz" * 60
    rows += [(100, junk, "en"), (101, junk, "zz"), (102, "the fox " * 40, None), (103, rows[3][1], "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(docs)
    assert sorted(refs.languages) == ["de", "en"]
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, refs).collect()}
    for i, by_language in plain_distances(rows, quality_rules.MIN_DOCUMENTS).items():
        r = got[i]
        if i in (101, 103):  # a language without a reference: by the base rules alone
            assert r["nearest_language"] is None and r["class_distance"] is None and r["kept"] == (not r["base_failed"])
            continue
        near = min(by_language, key=lambda g: sum(x or 0 for x in by_language[g]))
        assert r["nearest_language"] == near or by_language[near] == by_language[r["nearest_language"]]
        for have, want in zip((r["class_distance"], r["word_distance"]), by_language[r["nearest_language"]], strict=True):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
    assert not got[100]["kept"]  # also with the same text as the only one of its language


def test_limits_are_fitted_to_good_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_GOOD", 20)
    rng = random.Random(22)
    rows = [(i, sentence(rng, ENGLISH, rng.randint(60, 150)), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, 1)], "doc_id long, quality int")
    refs = quality_rules.references(docs)
    good = [r for r in quality_rules.judge(docs, refs).collect() if r["doc_id"] % 2 and not r["base_failed"]]
    for fitted, column in zip(quality_rules.fit_limits(docs, refs, labels), ("class_distance", "word_distance"), strict=True):
        most = max(r[column] for r in good if r[column] is not None)
        assert 0.9 * most < fitted <= most * quality_rules.MARGIN
    assert quality_rules.fit_limits(docs, refs, labels.filter("quality = 0")) == (quality_rules.MAX_CLASS_DISTANCE, quality_rules.MAX_WORD_DISTANCE)


def test_limits_come_from_all_good_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "GOOD_SAMPLE", 5, raising=False)
    monkeypatch.setattr(quality_rules, "LEAST_GOOD", 20)
    monkeypatch.setattr(quality_rules, "FEW_VALUES", 3, raising=False)
    monkeypatch.setattr(quality_rules, "RANGES", 4, raising=False)
    rng = random.Random(23)
    rows = [(i, sentence(rng, ENGLISH, rng.randint(60, 150)), "en") for i in range(50)] + [(3, "too short", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(50)], "doc_id long, quality int")
    refs = quality_rules.references(docs)
    judged = quality_rules.judge(docs, refs)
    good = [r for r in judged.collect() if r["doc_id"] < 40 and not r["base_failed"]]
    expected = tuple(
        float(np.quantile([r[c] for r in good if r[c] is not None], quality_rules.KEPT_SHARE)) * quality_rules.MARGIN
        for c in ("class_distance", "word_distance")
    )
    assert quality_rules.fit_limits(docs, refs, labels) == pytest.approx(expected, rel=1e-12)
    assert quality_rules.fit_limits(docs, refs, labels, judged=judged) == pytest.approx(expected, rel=1e-12)
    limits = dict(zip(("max_class_distance", "max_word_distance"), (0.05, 0.3), strict=True))
    assert found(quality_rules.within(judged, *limits.values())) == found(quality_rules.judge(docs, refs, **limits))


@pytest.mark.parametrize("values", [[], [None, 1.0], [0.5] * 30, [0.0, 1.0], [i % 7 / 7 for i in range(40)] + [None] * 5])
def test_quantiles_are_exact(spark, monkeypatch, values):
    monkeypatch.setattr(quality_rules, "FEW_VALUES", 2)
    monkeypatch.setattr(quality_rules, "RANGES", 4)
    have = [v for v in values if v is not None]
    for share in (0.0, 0.6, 0.999):
        n, got = quality_rules.quantile(spark.createDataFrame([(v,) for v in values], "x double"), "x", share)
        assert n == len(have) and (math.isnan(got) if not have else got == pytest.approx(np.quantile(have, share)))


def test_word_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    tokenizer, store = Tokenizer.from_file(path), packing.WordIds(path)
    assert store.plain_letters
    rng = random.Random(12)
    parts = ["thing", "É", "é", "à", "\u0085", "Å\u00a0", "\t", "\n", "ß", "İ", "ſ", "ñ", "ª", "é", "中", "9", "42", ".", ",", "..", "'s", "'LL", "don't", "A", "|", "#", " ", "ŉ", "ǆ", "Σ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(30)) for _ in range(300)]
    column = pa.array(texts)
    for first, n in ((0, 300), (7, 41), (291, 9)):
        ids, sizes = packing.WordIds(path)(column.slice(first, n))
        assert ids.tolist() == [i for t in texts[first: first + n] for i in (*tokenizer.encode(t, add_special_tokens=False).ids, 0)]
    plain = pa.array([t.replace("<|", "<") for t in texts])  # without added tokens: words by columns
    for first, n in ((0, 300), (7, 41), (291, 9)):
        ids, sizes = packing.WordIds(path)(plain.slice(first, n))
        assert ids.tolist() == [i for t in plain.slice(first, n).to_pylist() for i in (*tokenizer.encode(t, add_special_tokens=False).ids, 0)]
    ids, sizes = store([t.encode() for t in texts])
    at = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert ids[at: at + size].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text
        at += size
