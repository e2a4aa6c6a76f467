"""Language identification: held-out accuracy, chunks, odd rows, and no use of forbidden columns."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import langid
from tallyline.llm.common import crc32_mod

WORDS = {"en": "the house is with through water would should think", "de": "das haus ist nicht durch wasser würde über schön", "es": "la casa está año niño señor corazón mañana agua", "fr": "la maison été être où déjà français l'eau garçon", "xx": "zzq qqz zqz qzq zzz qqq"}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(3, 30))), lang, 9) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(600, 1) + [(700, None, "en", 1), (701, "", "en", 1), (702, "123 -- !!", "de", 1), (703, "the house is with water", None, 1), (None, "das haus ist nicht", "de", 1), (5, "la maison été", "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(df, langid.trained(df, crc32_mod(F.col("doc_id"), 4) != 2)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 600 and r[0] != 5}
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[700] == by[701] == by[702] == "und" and by[703] == "en" and by[None] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.trained(df, F.lit(True)) is None
    assert langid.identify(df, None).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0), None).count() == 0


def test_one_language_only(spark):
    df = spark.createDataFrame([(i, "the house", "en") for i in range(5)], "doc_id long, text string, lang string")
    assert langid.identify(df, langid.trained(df, F.lit(True))).first()["lang_pred"] == "en"


def test_whole_texts_in_chunks(monkeypatch):
    x = np.stack([langid.frequencies(WORDS[lang]) for lang in ("en", "de", "es", "fr")])
    model = langid.fit(x, ["en", "de", "es", "fr"])
    texts = [" ".join([WORDS["de"]] * 40), WORDS["fr"], "a", "", WORDS["es"] * 3]
    whole = langid.margins_of(texts, model)
    monkeypatch.setattr(langid, "CHUNK", 17)
    assert np.allclose(langid.margins_of(texts, model), whole, atol=1e-4)
    for t, w in zip(texts, whole, strict=True):
        if t:
            assert np.allclose(langid.frequencies(t) @ (model.weights / 100) + model.bias, w, atol=1e-3)


def test_families_come_first():
    x = np.stack([langid.frequencies(WORDS[lang]) for lang in WORDS])
    model = langid.fit(x, list(WORDS))
    assert model.families == ["germanic", "romance", "xx"]
    assert ("germanic", "de", "en") in model.pairs and ("", "germanic", "romance") in model.pairs
    assert not any(k[1:] == ("de", "es") for k in model.pairs)


def test_query(spark, folder):
    got = langid.op4_langid(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_all_languages_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid.grouped, "__defaults__", (12,))
    monkeypatch.setattr(langid.svm, "__defaults__", (1e-3, 12))  # few steps, for time
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choices(letters, k=6)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(list(words) * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(df, F.lit(True))
    assert sorted(lang for f in model.languages.values() for lang in f) == sorted(words) and len(model.families) <= 12
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


def slow_prediction(text, model):
    """Family, then language, by plain loops over the trigrams of one text."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 1.0
    low = text.lower()
    raw = (" " + " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in low).split()) + " ").encode()
    counts = {}
    for i in range(len(raw) - 2):
        code = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32 >> 32 - langid.BITS
        counts[code] = counts.get(code, 0) + 1
    total = max(1, sum(counts.values()))

    def margin(group, a, b):
        k = model.pairs[group, a, b]
        return sum(n * float(model.weights[code, k]) for code, n in counts.items()) / total + float(model.bias[k])

    def winner(group, names):
        own = {n: [margin(group, a, b) if n == a else -margin(group, a, b) for i, a in enumerate(names) for b in names[i + 1 :] if n in (a, b)] for n in names}
        best = max(names, key=lambda n: (sum(m > 0 for m in own[n]), sum(own[n]), n))
        return best, 1.0 if len(names) == 1 else 1 / (1 + np.exp(-np.clip(3 * min(own[best]), -30, 30)))

    family, p = winner("", model.families)
    language, q = winner(family, model.languages[family])
    return language, p * q


def test_query_by_brute_force(spark, folder):
    """The whole table: every prediction of the query by plain loops, given the machines."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.trained(docs, crc32_mod(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r for r in langid.op4_langid(spark, folder).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        lang, score = slow_prediction(r["text"], model)
        mine = got[r["doc_id"]]
        assert mine["lang_pred"] == lang and abs(mine["score"] - score) < 1e-3
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_the_sample_is_bounded(spark, monkeypatch):
    """Rows that share an id, or lack one, are drawn apart, and repeated rows once."""
    rows = corpus(800, 5)
    shared = [(7, t + f" {i}", lang, 9) for i, t, lang, _ in rows] + [(None, t + f" {i}", lang, 9) for i, t, lang, _ in rows] + [rows[0]] * 500
    sizes = []
    monkeypatch.setattr(langid, "fit", lambda x, langs: sizes.append(len(langs)))
    langid.trained(spark.createDataFrame(shared, "doc_id long, text string, lang string, score int"), F.lit(True), sample=50)
    assert 100 < sizes[0] <= 2 * 50 * len(WORDS)


def test_one_id_for_all_rows(spark):
    df = spark.createDataFrame([(7, t + f" {i}", lang, 9) for i, t, lang, _ in corpus(600, 6)], "doc_id long, text string, lang string, score int")
    got = langid.identify(df, langid.trained(df, F.lit(True), sample=60)).collect()
    truth = {t: lang for _, t, lang, _ in (r for r in df.collect())}
    assert len(got) == 600 and len(truth) > 500 and {r["lang_pred"] for r in got} == set(WORDS)
