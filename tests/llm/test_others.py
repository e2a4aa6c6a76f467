"""URL filters, license scans and toxicity."""

import random
import zlib

import numpy as np
import pytest
from comparing import same
from pyspark.sql import functions as F

from tallyline.llm import licenses, toxicity, urlfilter
from tallyline.llm.common import crc32_mod
from tallyline.llm.urlfilter import Rule, host_rule, index

URLS = ["http://a.org/x", "https://A.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://b.com/fr/", "http://b.com/de/x?y=http://c.org/", "http://b.net/", "org/x", None, "", "http://org", "http://x.org:80/y", "http://notexample.org/es/", "ftp://u@example.org/es/#f", "x://y://example.org/es/", "http://b.com/fr?x", "http://b.com\n/fr/x"]


def slow(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0]), default=None)
    return host, path, best and best[0], best[1] if best else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "v"), (None, URLS[0], "h", "v")], "page_id long, url string, host string, verdict string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = (host_rule("block", "example.org/es/"), host_rule("block", "example.org/en/1"), Rule("any", "allow", ".*", ()))
    by, rest = index(rules, {"example": 90, "org": 100, "es": 3, "en": 95})
    assert by == {"es": [0], "example": [1]} and rest == [2]


def test_url_query_matches_its_sql(spark, folder, duck):
    same(urlfilter.op7_urlfilter(spark, folder), duck.sql(urlfilter.OP7_SQL))


def found_in(text, scanner=licenses.Scanner()):
    return [f.license for f in scanner.scan(text)[1]]


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_every_template_is_found(k):
    t = licenses.TEMPLATES[k]
    words = t.text.split()
    wrapped = "\n".join(" * " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    for text in (t.text, t.text.upper(), wrapped, f"some words before\n{t.text}\nsome words after", " ".join(["filler words around the notice"] * 200) + " " + t.text + " " + " ".join(["and more of them"] * 200)):
        assert found_in(text) == [t.license], text[:80]


@pytest.mark.parametrize("text", ["", "plain text\nwithout any notice", "the driving licence was lost under warrant", "licensed premises only", "Licensed under the GNU terms of another age", "Licensed under CC BY 3.0.", "copyright " * 500, "license\n" * 3000])
def test_clean_texts(text):
    assert found_in(text) == []


def test_licenses_beside_each_other():
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the BSD 3-Clause License.", "Licensed under CC BY 4.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This work is released under CC0 1.0 Universal, dedicated to the public domain.", "This library is licensed under the GNU Lesser General Public License, version 3."]
    want = ["Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0"]
    assert found_in("\n".join(notices)) == want
    assert found_in("\n".join([*notices, "words of another kind"] * 60)) == want
    rng = random.Random(3)
    for _ in range(150):
        some = rng.sample(licenses.TEMPLATES, rng.choice([2, 3]))
        text = rng.choice(["\n", " ", "\n\nwords between the notices\n"]).join(t.text for t in some)
        assert found_in(text) == sorted({t.license for t in some}), text


def test_license_wording_tells_variants_apart():
    assert found_in("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert found_in("This work is licensed under the GNU General Public License, version 2 or later") == ["GPL-2.0-or-later"]
    assert found_in("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert found_in("Licensed under CC BY-NC-ND 4.0.") == []


def test_license_differences():
    _, found = licenses.Scanner().scan("Permission to use, copy, modify and distribute this fine software for any purpose with or without fee is hereby granted")
    assert [(f.license, f.inserted, f.deleted) for f in found] == [("0BSD", ("fine",), ("or",))]


def slow_alignment(template, window):
    """The most of matches less deletions and insertions over all stretches of the window, by plain recursion."""
    best = -10**9
    for a in range(len(window) + 1):
        for b in range(a, len(window) + 1):
            table = [[0] * (b - a + 1) for _ in range(len(template) + 1)]
            for i in range(len(template) + 1):
                for j in range(b - a + 1):
                    if i or j:
                        table[i][j] = max([table[i - 1][j] - 1] * (i > 0) + [table[i][j - 1] - 1] * (j > 0) + [table[i - 1][j - 1] + 1] * (i > 0 and j > 0 and template[i - 1] == window[a + j - 1]))
            best = max(best, table[-1][-1])
    return best


def test_alignment_is_the_best():
    rng = random.Random(4)
    for _ in range(60):
        template, window = ([rng.randrange(4) for _ in range(rng.randint(1, 7))] for _ in range(2))
        pairs = licenses.aligned(np.array(template), np.array(window)) or []
        assert all(template[i] == window[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
        gaps = pairs[-1][1] - pairs[0][1] + 1 - len(pairs) if pairs else 0
        assert 2 * len(pairs) - len(template) - gaps == slow_alignment(template, window)


def test_license_rows(spark):
    long = "plain words " * 40_000 + "\nReleased under the MIT License.\n" + "more words " * 40_000
    rows = [(1, "x\nReleased under the MIT License.", "l"), (1, "x\nReleased under the MIT License.", "l"), (2, None, "l"), (3, "", "l"), (4, long, None), (None, "Licensed under CC BY-NC 4.0.", "l")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, found string")).collect()
    assert sorted((r["doc_id"] or 0, [f["license"] for f in r["found"]]) for r in got) == [(0, ["CC-BY-NC-4.0"]), (1, ["MIT"]), (1, ["MIT"]), (2, []), (3, []), (4, ["MIT"])]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_query_window_by_window(spark, folder):
    """The whole table against the scanner on the whole of each text as one block, window by window."""
    scanner = licenses.Scanner()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = licenses.op9_licenses(spark, folder).collect()
    assert len(got) == len(texts) and any(r["n_licenses"] for r in got)
    for r in got:
        words = licenses.words_of(texts[r["doc_id"]] or "")
        every = {f.license for w in licenses.windows_of(words) for f in scanner.licenses(w)}
        assert r["licenses"] == ",".join(sorted(every))


def test_wrapped_notices(spark):
    gpl = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    texts = [gpl, "words before\n\n" + gpl + "\n" + "words after\n" * 300, mpl, "filler\n" * 300 + mpl + "\nmore", "any later version\nof this licence\nis free software"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[f["license"] for f in r["found"]] for r in sorted(got, key=lambda r: r["doc_id"])] == [["GPL-3.0-or-later"]] * 2 + [["MPL-2.0"]] * 2 + [[]]


def test_license_query(spark, folder):
    got = {r["doc_id"]: r["licenses"] for r in licenses.op9_licenses(spark, folder).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        assert got[r["doc_id"]] == ",".join(sorted(v for k, v in lines.items() if k in r["text"]))


def labelled(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    bad = ["vilek" + x for x in "abcdefgh"] + ["scum", "moron"]
    rows = []
    for i in range(n):
        words = rng.choices(clean, k=rng.randint(5, 60))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = labelled(1200, 3)
    docs = spark.createDataFrame([(i, t, "l", 5) for i, t, _ in rows] + [(5000, None, "l", 5), (5001, "", "l", 5), (None, "scum moron", "l", 5), (7, rows[7][1], "l", 5)], "doc_id long, text string, labels string, score int")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(docs, labels, crc32_mod(F.col("_doc"), 5) != 0).collect()
    assert len(got) == len(rows) + 4
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 1200 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.95
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[5000] == by[5001] == 0 and by[None] == 1, [r for r in got if r["doc_id"] is None or r["doc_id"] >= 5000]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for rows, expected in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert {r["score"] for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()} == {expected}
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).count() == 0


def test_chunks_change_nothing(monkeypatch):
    rows = labelled(200, 4)
    v = toxicity.Vocabulary()
    texts = [v.encode(toxicity.words_of(t)) for _, t, _ in rows]
    model = toxicity.train(texts, v.table(), np.array([y for *_, y in rows]), epochs=2)
    table, votes = model.projected(v.table()), np.array(v.votes)
    long = [np.concatenate(texts), *texts[:20], np.zeros(0, dtype=np.int32)]
    whole = toxicity.logits_of(long, model, table, votes)
    monkeypatch.setattr(toxicity, "CHUNK", 13)
    assert toxicity.logits_of(long, model, table, votes) == pytest.approx(whole, abs=1e-4)


def test_a_full_vocabulary_starts_anew(monkeypatch):
    rows = labelled(100, 5)
    v = toxicity.Vocabulary()
    texts = [v.encode(toxicity.words_of(t)) for _, t, _ in rows]
    model = toxicity.train(texts, v.table(), np.array([y for *_, y in rows]), epochs=1)
    one = toxicity.Scorer(model).scores([t for _, t, _ in rows])
    monkeypatch.setattr(toxicity.Scorer, "LARGEST", 10)
    small = toxicity.Scorer(model)
    assert np.concatenate([small.scores([t]) for _, t, _ in rows]) == pytest.approx(one, abs=1e-5)


def slow_score(text, model):
    """One text's score by the definition: each window of words times each filter, one by one."""
    words = toxicity.words_of(text or "")
    vectors = [sum(model.embedding[f].astype(float) for f in toxicity.features_of(w)) for w in words]
    nothing = np.zeros(toxicity.DIM)
    pooled = []
    for f, bias in zip(model.filters, model.bias, strict=True):
        width = len(f)
        padded = vectors + [nothing] * max(toxicity.WIDTHS)
        windows = [sum(padded[i + j] @ f[j].astype(float) for j in range(width)) for i in range(len(words) + 1)]
        pooled.append(np.maximum(np.max(windows, axis=0) + bias, 0))
    votes, owners = {}, {}
    for k, known in enumerate(toxicity.FUNCTION_WORDS.values(), start=1):
        for w in known.split():
            owners.setdefault(w.encode(), []).append(k)
    for w in words:
        if len(owners.get(w, ())) == 1:
            votes[owners[w][0]] = votes.get(owners[w][0], 0) + 1
    shown = max(votes, key=lambda k: (votes[k], -k)) if votes else 0
    z = float(np.concatenate(pooled) @ model.out + model.out_bias - model.thresholds[shown])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_query_by_direct_convolution(spark, folder):
    """The whole table: every score of the query by the definition, given the network."""
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.trained(docs, labels, crc32_mod(F.col("_doc"), 5) != 0)
    got = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, folder).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        score, mine = slow_score(r["text"], model), got[r["doc_id"]]
        assert abs(mine["score"] - score) < 1e-3 and mine["predicted"] == int(mine["score"] >= 0.5)
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_sample_is_bounded(spark):
    """An id that all rows share brings no more of them than the bound; repeated rows train once."""
    rows = labelled(900, 8)
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(7 if y else 8, t + f" x{i}") for i, t, y in rows] + [(7, "scum moron")] * 400 + [(None, t) for _, t, _ in rows], "doc_id long, text string")
    got = toxicity.training_rows(docs, labels, F.lit(True), 60).collect()
    assert 60 < len(got) <= 240 and {r["toxic"] for r in got} == {0, 1}
    assert len({r["text"] for r in got}) == len(got)
    found = toxicity.toxicity(docs, labels, F.lit(True), 60).collect()
    assert len(found) == docs.count() and {r["score"] for r in found if r["doc_id"] is None} != {0.0}
