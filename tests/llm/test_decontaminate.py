"""Decontamination against windows compared one by one."""

import hashlib
import random
import re

import pytest
from comparing import same

from tallyline.llm import decontaminate
from tallyline.llm.decontaminate import automaton, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, item_id long, digest string, ranges int"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items, size):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        own = words(t)
        k = min(size, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(w) - k + 1 if own else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                ids.add(item)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("shard", [10**9, 120])
def test_against_brute_force(spark, shard):
    rng = random.Random(5)
    vocabulary = ["a", "B", "é", "10", "naïve", "x-y", "日本"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(0, 7))) for i in range(12)] + [(20, None), (3, "a B é")]
    docs = [(i, text(rng.randint(0, 40)), i, "z", 1) for i in range(60)] + [(100, None, 0, "z", 1), (101, "", 0, "z", 1), (5, text(9), 0, "z", 1), (None, text(9), 0, "z", 1)]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), 4, shard).collect()
    expected = sorted((d[0] or -1, *brute(d[1], [i for i in items if i[1]], 4)) for d in docs)
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["items"]) for r in found) == expected


def test_spans_are_of_the_original():
    text = "Über ALLES: one,  two - three four; fünf!"
    _, ranges, spans, items = scan(text.encode(), automaton([(7, "ONE two three")], 3))
    assert items == [7] and len(ranges) == 1
    assert text[spans[0][0] : spans[0][1]] == "one,  two - three"


def test_words_must_be_whole():
    assert scan(b"alpha betas", automaton([(1, "alpha beta")]))[1] == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, none).first()["n_hit"] == 0
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_query_matches_its_sql(spark, folder, duck):
    got = decontaminate.op2_decontaminate(spark, folder)
    same(got, duck.sql(decontaminate.OP2_SQL))
    clean = got.filter("not contaminated").first()
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest()
