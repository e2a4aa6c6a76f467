"""Packing: exact round trip of ids, sound sequences, and bins against an exhaustive search."""

import random
import zlib
from functools import lru_cache

import numpy as np

from tallyline.llm import packing
from tallyline.llm.packing import best_fit, cut_lengths, fillings, lower_bound, pieces_of, places, plan_bins

SCHEMA = "doc_id long, text string, sequence_id string, length string, _salt int"


def checked(rows, capacity):
    """No gaps, no overlaps, nothing over the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_round_trip(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary_paths()[0])
    texts = ["", None, "one two", "Ünïcode — text\n\n with  spaces ", "日本語 テキスト", "x " * 3000, "a" * 30_000, "the end", "the end", "<|endoftext|> plain", "hello <|endoftext|> x<|endoftext|><|endoftext",  "\t" * 50 + "123 456.789", "it's we'll I'd", "🙂🙂 mixed"]
    docs = spark.createDataFrame([(i, t, "s", "l", 0) for i, t in enumerate(texts)] + [(7, "the end", "s", "l", 0), (None, "no id", "s", "l", 0)], SCHEMA)
    rows = packing.pack(docs, 1024).collect()
    checked(rows, 1024)
    for doc, text in [*enumerate(texts), (None, "no id")]:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc})
        assert sum(p[2] for p in mine) == len(ids)
        assert [p[0] for p in mine] == list(range(len(mine)))
        for _, start, length, crc in mine:
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    assert sum(r["doc_id"] == 7 for r in rows) == 2


def test_cut_lengths():
    assert cut_lengths(5, 4) == [(0, 1), (1, 4)]
    assert cut_lengths(8, 4) == [(0, 4), (4, 4)]
    assert cut_lengths(3, 4) == [(0, 3)]


def optimum(sizes, capacity):
    sizes = sorted(sizes, reverse=True)

    @lru_cache(None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = 99

        def extend(room, at, taken):
            nonlocal best
            best = min(best, 1 + least(tuple(x for i, x in enumerate(rest) if i not in taken)))
            for i in range(at, len(rest)):
                if rest[i] <= room:
                    extend(room - rest[i], i + 1, taken | {i})

        extend(capacity - first, 0, frozenset())
        return best

    return least(tuple(sizes))


def test_small_instances_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(2, 14) for _ in range(rng.randint(1, 9))]
        h = {s: sizes.count(s) for s in sizes}
        plan, proven = plan_bins(h, 16, 100_000)
        assert proven
        used = {}
        for pattern, n in plan:
            assert sum(s * k for s, k in pattern) <= 16
            for s, k in pattern:
                used[s] = used.get(s, 0) + k * n
        assert used == h
        assert sum(n for _, n in plan) == optimum(sizes, 16)


def test_branching_beats_best_fit():
    rng = random.Random(1)
    gains = 0
    for _ in range(20):
        sizes = [rng.randint(200, 700) for _ in range(200)]
        h = {s: sizes.count(s) for s in sizes}
        fit, plan = sum(best_fit(h, 1024).values()), sum(n for _, n in plan_bins(h)[0])
        assert lower_bound(h, 1024) <= plan <= fit
        gains += fit - plan
    assert gains > 0


def every_filling(room, items):
    """All maximal sub-multisets that fit, as sorted tuples."""
    out = set()
    for mask in range(1 << len(items)):
        chosen = [x for i, x in enumerate(items) if mask >> i & 1]
        rest = [x for i, x in enumerate(items) if not mask >> i & 1]
        if sum(chosen) <= room and not any(x <= room - sum(chosen) for x in rest):
            out.add(tuple(sorted(chosen, reverse=True)))
    return out


def fits(inner, outer):
    if not inner:
        return True
    return any(o >= inner[0] and fits(inner[1:], [*outer[:i], o - inner[0], *outer[i + 1 :]]) for i, o in enumerate(outer))


def test_fillings_are_all_that_are_undominated():
    rng = random.Random(8)
    for _ in range(80):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 20)
        found = list(map(tuple, fillings(room, {s: items.count(s) for s in items})))
        every = every_filling(room, items)
        assert set(found) <= every and len(found) == len(set(found))
        assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)
        for left_out in every - set(found):  # each has another one that it fits inside
            assert any(fits(list(left_out), list(f)) for f in found)
    assert list(fillings(1, {2: 3})) == [[]]
    assert next(fillings(300, {s: 10**9 for s in range(1, 300)})) == [299, 1]


def test_bounds_hold():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 16) for _ in range(rng.randint(1, 8))]
        assert lower_bound({s: sizes.count(s) for s in sizes}, 16) <= optimum(sizes, 16)


def test_cost_follows_lengths_not_counts():
    rng = random.Random(2)
    h = {rng.randint(1, 1024): rng.randint(1, 10**9) for _ in range(500)}
    plan, _ = plan_bins(h, nodes=200)
    assert lower_bound(h, 1024) <= sum(n for _, n in plan) <= 1.01 * lower_bound(h, 1024)
    table = places(plan)
    assert set(table) == set(h)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pieces_of(docs).count() == 0
    assert packing.pack(docs).collect() == []


def test_query(spark, folder):
    """Against the plain library: every piece in its place, ids as the library gives them, and few sequences."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary_paths()[0])
    rows = packing.op1_packing(spark, folder).collect()
    h = {}
    for r in rows:
        h[r["length"]] = h.get(r["length"], 0) + 1
    assert checked(rows, 1024) <= lower_bound(h, 1024) + 1
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(of) == len(docs)
    for d in docs:
        ids = np.array([*exact.encode(d["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted(of[d["doc_id"]])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and (len(pieces) == 1 or all(p[2] == 1024 for p in pieces[1:]))
        at = 0
        for _, start, length, crc in pieces:
            assert start == at and zlib.crc32(ids[at : at + length].tobytes()) == crc
            at += length
        assert at == len(ids)
