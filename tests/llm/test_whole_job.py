"""Cases that a limit or a shortcut once left out."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskledger.llm import common, decontamination, language_id, lm_scoring, quality_rules, simhash_dedup

TEXTS = {
    "a": " ".join(f"alpha{i}" for i in range(60)), "b": " ".join(f"beta{i}" for i in range(60)),
    "c": " ".join(f"gamma{i}" for i in range(60)), "d": " ".join(f"delta{i}" for i in range(60)),
}


def test_every_component_keeps_one_row_with_repeated_and_null_ids(spark):
    made = [
        (5, TEXTS["a"], "s1", {"k": 1}), (5, TEXTS["b"], "s2", None), (3, TEXTS["c"], "s3", None), (5, TEXTS["c"], "s4", None),
        (None, TEXTS["c"], "s5", None), (None, TEXTS["d"], "s6", None), (None, TEXTS["d"], "s7", None),
        (8, None, "s8", {"k": 2}), (8, None, "s8", {"k": 2}), (8, None, "s9", None),
        (5, TEXTS["a"], "s1", {"k": 1}),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, more map<string,int>").repartition(3)
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["source"], r["more"]) for r in kept.collect()]
    assert all(r in made for r in rows)
    assert sorted((str(r[0]), str(r[1])) for r in rows) == sorted(
        [("5", TEXTS["a"]), ("5", TEXTS["b"]), ("3", TEXTS["c"]), ("None", TEXTS["d"]), ("8", "None")]
    )


def test_short_items_are_found_unchanged_and_between_word_borders(spark):
    items = ["Blue whale", "7 km", "中国的首都是哪座城市", "?!", "", None, "été"]
    texts = [
        "The answer is: BLUE  whale.", "two blue whales", "about 17 km away", "about 7 km", "问题：中国的首都是哪座城市？", "中国的首都在哪座城市",
        "un été chaud", "what?!", "say ?! now", "", None, "de l'\u00e9t\u00e9", "étés",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.find_items(docs, table).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 0), (3, 1), (4, 2), (6, 6), (8, 3), (11, 6)]
    for r in got:
        form = decontamination.plain(texts[r["doc_id"]])
        assert form[r["first"]: r["last"]] == decontamination.plain(items[r["item_id"]]) and r["distance"] == 0
    clean = decontamination.keep_clean(docs, table)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 5, 7, 9, 10, 12]


@pytest.mark.parametrize("at_once", [1 << 20, 1])
def test_every_byte_of_a_long_word_is_read(monkeypatch, at_once):
    monkeypatch.setattr(language_id, "BYTES_AT_ONCE", at_once)
    weights = np.random.default_rng(1).normal(size=((1 << language_id.TABLE_BITS) + 1, 3)).astype(np.float32)
    weights[-1] = 0
    words = [b"short", ("文" * 3000 + "字" + "文" * 3000).encode(), ("文" * 6001).encode(), b"x" * 64, b"y" * 65, b"end"]
    got = language_id.word_emissions(words, weights)
    whole = language_id.emissions(language_id.features(words), weights)
    assert got.shape == (6, 3) and np.allclose(got, whole, atol=2e-2)
    alone = [language_id.emissions(language_id.features([w]), weights)[0] for w in words]
    assert np.allclose(whole, alone, atol=2e-2)
    # an edit in the middle changes the n-grams, not the word's own weight alone
    own = weights[language_id.features(words)[2]]
    assert np.abs((got - own)[1] - (got - own)[2]).max() > 1e-3


def test_a_text_without_spaces_is_judged_by_its_middle():
    chars = {"zh": "你我他是在有这那来去", "ja": "のはがをにでともへや"}
    runs = [(k, ["".join(c[(i * j + j) % 10] for j in range(1, 12)).encode()]) for k, c in enumerate(chars.values()) for i in range(60)]
    model = language_id.train(runs, list(chars))
    edge = "你我他是在有这那来去你我他"
    text = (edge + "のはがをにでともへや" * 40 + edge).encode()
    found, counts, _ = language_id.Tagger(model)([text])
    assert counts.all() and found[0].argmax() == 1


def many_languages(n: int) -> list[tuple]:
    """Texts of n languages with own words; the later ones have fewer and the last only a long text."""
    rng, rows = random.Random(2), []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüñø") for _ in range(rng.randint(3, 7))) for _ in range(25)]
        for i in range(3 if k > n // 2 else 4):
            length = 9000 if k == n - 1 else 80
            rows.append((100 * k + i, " ".join(rng.choice(words) for _ in range(length)), f"l{k:03d}"))
    return rows


def test_every_language_is_learned(spark):
    rows = many_languages(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 100 != 1)
    assert model.labels == sorted({r[2] for r in rows})
    held = docs.filter("doc_id % 100 = 1")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(held, model).collect()}
    assert got == {r[0]: r[2] for r in rows if r[0] % 100 == 1}


def test_steps_of_training_in_parts_are_those_of_one(monkeypatch):
    runs = [(k, [f"{c}{i}{j}".encode() for j in range(25)]) for k, c in enumerate("abc") for i in range(20)]
    whole = language_id.train(runs, list("abc"), rounds=3)
    monkeypatch.setattr(language_id, "TRAINED_AT_ONCE", 700)
    parts = language_id.train(runs, list("abc"), rounds=3)
    assert np.allclose(whole.weights, parts.weights, atol=1e-5) and np.allclose(whole.transitions, parts.transitions)


def test_every_language_has_a_reference_for_its_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MIN_DOCUMENTS", 3)
    monkeypatch.setattr(quality_rules, "MIN_REFERENCE_CHARS", 500)
    rows = many_languages(70)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.references(docs)
    assert sorted(refs.languages) == sorted({r[2] for r in rows})
    by_id = {r["doc_id"]: r for r in quality_rules.judge(docs, refs).collect()}
    assert all(by_id[i]["nearest_language"] == lang for i, _, lang in rows)
    assert all(r["kept"] for r in by_id.values() if not r["base_failed"])


def test_an_idle_worker_gives_back_its_scores(monkeypatch):
    monkeypatch.setattr(lm_scoring, "IDLE_SECONDS", 0.2)
    store = lm_scoring._store("model")
    lm_scoring.forget_when_idle()
    assert lm_scoring._store("model") is store  # the next task comes in time and keeps it
    time.sleep(0.5)
    assert lm_scoring._store("model") is store
    lm_scoring.forget_when_idle()
    for _ in range(100):
        if not lm_scoring._stores:
            break
        time.sleep(0.1)
    assert not lm_scoring._stores


class Rows:
    """Stands for a DataFrame and keeps the function that its tasks run."""

    sparkSession = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_counts_for_references_are_sent_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "ship_package", lambda session: None)
    monkeypatch.setattr(quality_rules, "COUNTED_AT_ONCE", 50_000, raising=False)
    rows = Rows()
    quality_rules._counted(rows, "lang", "text")
    texts = [" ".join(f"{i:02d}-{k:037d}" for k in range(60_000)) for i in range(8)]  # all words differ
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 4), pa.array(texts)], names=["_lang", "_text"])
    sums, many = Counter(), 0
    tracemalloc.start()
    try:
        for out in rows.run(iter([batch])):
            for lang, kind, n in zip(*(out.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                sums[lang, kind] += n
            many = max(many, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert sums == {(lang, kind): n for lang in ("en", "de") for kind, n in ((0, 4 * (60_000 * 41 - 1)), (1, 240_000), (2, 4))}
    assert many < 50 << 20


def test_bytes_of_the_same_beginning_are_coded_once():
    rng = random.Random(31)
    pairs = sorted({(rng.randrange(3), bytes(rng.choices(b"abc", k=rng.randint(1, 6)))) for _ in range(500)})
    for listed in (pairs, rng.sample(pairs, len(pairs)), pairs[:1]):
        text, starts = lm_scoring.coded([w for _, w in listed])
        first, same = lm_scoring.distinct_bytes(text, starts, np.array([k for k, _ in listed]))
        beginnings = [(k, (w + b" ")[: i + 1]) for k, w in listed for i in range(len(w) + 1)]
        assert [beginnings[i] for i in first[same]] == beginnings
        assert listed is not pairs or len(first) == len(set(beginnings))
    assert [len(x) for x in lm_scoring.distinct_bytes(*lm_scoring.coded([]), np.zeros(0))] == [0, 0]


def test_classes_and_numbers_of_words_in_blocks():
    found = ["plain", "über", "naïveté", "日本語", "слово", "mixed日x", "😀", "a😀é", "plain", "é"] * 3
    marked = [w.encode() for w in found if not w.isascii()]
    assert lm_scoring.word_classes(marked).tolist() == [lm_scoring.word_class(w) for w in marked]
    reader, texts = lm_scoring.Reader(), ["A b\t\tc", None, "", " b  über \n", "c a d 日本語"]
    for _ in range(2):  # the second time all words are known
        ids, _, lengths = reader(pa.array(texts))
        assert [reader.words[i].decode() for i in ids] == [*"abc", "\n", "\n", "\n", "b", "über", "\n", *"cad", "日本語", "\n"]
        assert lengths.tolist() == [4, 1, 1, 3, 5]
    assert reader.sizes.tolist() == [1, *(len(w) + 1 for w in reader.words[1:])]
    assert reader.marks.tolist() == [lm_scoring.word_class(w) for w in reader.words]


def test_repeats_of_words_with_large_numbers():
    rng = np.random.default_rng(32)
    ids, lengths = rng.integers(0, 5, 300), np.array([100, 1, 0, 150, 49])
    for plain, large in zip(lm_scoring.repeats(ids, lengths), lm_scoring.repeats(ids << 52, lengths), strict=True):
        assert plain.tolist() == large.tolist()


def test_frequent_words_keep_their_scores_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CACHED_WORDS", 12)
    asked = []
    model = lm_scoring.Model({name: np.zeros(1 << size, dtype=np.uint16) for name, size in lm_scoring.TABLES.items()})
    log10 = lm_scoring.Model.log10
    monkeypatch.setattr(lm_scoring.Model, "log10", lambda self, words, classes: asked.append(sorted(words)) or log10(self, words, classes))
    store, frequent = lm_scoring.Store(), {b"often": 9, b"more": 7}

    def meet(text):
        ids, classes, _ = store.reader(pa.array([text]))
        pairs = ids * lm_scoring.CLASSES + classes
        scores, counts, base = store.meet(frequent, model, [pairs])
        return [(store.reader.words[i], scores[p], counts[i], base[i]) for i, p in zip(ids, pairs, strict=True)]

    before = meet("rare often words more")
    store.shrink()
    after = meet("often new more")
    assert after[0] == before[1] and after[2:] == before[3:] and asked == [[b"\n", b"more", b"often", b"rare", b"words"], [b"new"]]
    assert [count for _, _, count, _ in after] == [9, 0, 7, 0] and after[1][3] == 0.0
    monkeypatch.setattr(lm_scoring, "CACHED_WORDS", 2)
    store.shrink()
    assert store.reader.words == [b"\n"] and not len(store.counts)


def test_a_batch_is_let_go_before_the_next_is_read():
    held = []

    def batches():
        for _ in range(4):
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 4000)], names=["_text"])

    begin = pa.total_allocated_bytes()
    for _ in common.blocks(batches(), "_text", 1 << 20):
        del _
    assert max(held) - begin < 4_000_000  # the four million letters of the batch before are gone


def test_blocks_are_scored_together_over_the_borders_of_batches():
    parts = [pa.RecordBatch.from_arrays([pa.array(["x" * n, None])], names=["t"]) for n in (3, 4, 3, 20, 0, 10, 1)]
    sizes = [[len(p.column(0)[0].as_py()) for p in g] for g in common.groups(iter(parts), "t", 10)]
    assert sizes == [[3, 4, 3], [20], [0, 10], [1]]
    assert list(common.groups(iter([]), "t", 10)) == []


@pytest.mark.parametrize(("usual", "inside"), [(None, "1000"), ("20", "20"), ("0", "1000")])
def test_texts_reach_the_language_model_in_small_batches(spark, monkeypatch, usual, inside):
    name, met, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, label: met.append((label, spark.conf.get(name))) or plain(df, label))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of"), F.col("id")).alias("text"))
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name) if usual is None else spark.conf.set(name, usual)
        found = lm_scoring.score(docs, lm_scoring.learn(docs, F.col("doc_id") % 2 == 0))
        assert dict(met)["pairs"] == dict(met)["scored"] == inside
        assert spark.conf.get(name, None) == (usual or before)
        assert found.count() == 60  # the model is not needed any more
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
