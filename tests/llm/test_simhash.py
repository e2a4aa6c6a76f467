"""SimHash: fingerprints bit by bit, components against all pairs, and the pigeonhole plan."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import similar, simhash
from tallyline.llm.components import components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one TWO", "A b c d\x0be é", "x " * 500, "a b c d e f g a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("the quick brown")).alias("h")).first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"the quick brown", 42)


def union_find(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_keep_all_components(spark, bucket):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s for s in seeds}
    for s in seeds[:10]:
        x = s
        for _ in range(25):  # chains of near neighbours
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    plan = simhash.plan_partitions(np.array(fps, dtype=np.uint64), len(fps))
    root = {r["node"] % (1 << 64): r["root"] for r in components(simhash.links(df, plan, bucket=bucket)).collect()}
    expected = union_find(fps, 2)
    for i, a in enumerate(fps):
        for j, b in enumerate(fps):
            linked = a in root and b in root and root[a] == root[b]
            assert (expected[i] == expected[j]) == (i == j or linked)


def test_every_plan_covers_the_radius():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for total in (100, 10**6, 10**9, 10**12):
        plan = simhash.plan_partitions(sample, total)
        assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)
        for _ in range(200):
            flips = rng.choice(64, 2, replace=False)
            assert any(sum(f in bits for f in flips) <= t for bits, t in plan)
    assert any(t > 0 for _, t in simhash.plan_partitions(sample, 10**12))


def test_correlated_bits_go_together():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    low = base & np.uint64(0xFFFF)
    sample = low | (low << np.uint64(32)) | (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) & np.uint64(0xFFFF0000FFFF0000))
    groups = simhash.grouped_bits(sample, 4)
    together = sum(any(b in g and b + 32 in g for g in groups) for b in range(16))
    assert together >= 14


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(500, 500), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 200 for i in range(40)) and got[500] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    text = "the quick brown fox jumps over the lazy dog and runs into the dark green forest near the old mill " * 8
    rows = [(5, text, 1), (3, text, 1), (9, text.replace("mill", "mills", 1), 1), (7, None, 1), (8, "", 1), (2, "something else entirely here", 1), (2, "something else entirely here", 1), (None, None, 1), (None, "nobody knows this one", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by[5] == by[3] == 3 and by[7] == by[8] == 7 and by[2] == 2
    assert sorted((r["component_id"] or -1) for r in got if r["doc_id"] is None) == [-1, 7]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_all_pairs(spark, folder):
    got = {r["doc_id"]: r for r in simhash.op8_simhash(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    ids = sorted(r["doc_id"] for r in docs)
    fps = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in docs}
    assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" for i in ids)
    roots = union_find([fps[i] for i in ids], 2)
    assert [got[i]["component_id"] for i in ids] == [ids[r] for r in roots]


def slow_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = slow_shingles(a), slow_shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_documents(spark):
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for k in range(12):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        texts.append(" ".join(words))
        for _ in range(3 if k else 12):  # copies with one or two words changed, twelve of the first text
            copy = list(words)
            for _ in range(rng.randint(1, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "One  TWO", "unlike anything else here"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (3, texts[3], "c")], "doc_id long, text string, component_id string")
    got = simhash.similar_documents(df).collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    assert all(by[i] == by[j] for i, j in linked)
    root = list(range(len(texts)))
    for i, j in linked:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[i] == root[by[i]] for i in by)  # nothing else is joined
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_shingles_are_the_sets(spark):
    """Equal hashes for equal shingles only, and the bounds that prune pairs hold."""
    rng = random.Random(21)
    texts = [" ".join(rng.choices("abcd", k=rng.choice([0, 1, 3, 4, 5, 6, 40, 400]))) for _ in range(60)]
    for x in texts:
        slow = slow_shingles(x)
        own = similar.shingles_of(x.encode())
        assert len(own) == len(slow) and similar.sketch_of(own).sum() == len(own)
        for y in texts:
            both = len(np.intersect1d(own, similar.shingles_of(y.encode())))
            assert both == len(slow & slow_shingles(y))
            other = similar.shingles_of(y.encode())
            assert both <= similar.most_common(similar.sketch_of(own), similar.sketch_of(other))
            if len(own) and len(other) and both >= 0.8 * (len(own) + len(other) - both):
                assert both >= similar.least_common(len(own), len(other), 0.8)
    sets = [similar.shingles_of(t.encode()) for t in texts]
    sketches = [similar.sketch_of(x).tobytes() for x in sets]
    left, right = (np.array(x) for x in zip(*((i, j) for i in range(60) for j in range(60)), strict=True))
    bounds = similar.in_common(sketches, left, right)
    assert bounds.tolist() == [similar.most_common(*(np.frombuffer(sketches[k], dtype=np.uint8) for k in p)) for p in zip(left, right, strict=True)]
    assert len(similar.sketch_of(np.arange(0, 1 << 20, 64, dtype=np.uint64))) > 1 << 12  # more classes where one would overflow


def test_shared_shingles(spark):
    """The index holds the shingles that prefixes of several sets share, frequent or not."""
    rng = random.Random(22)
    words = ["w%d" % i for i in range(60)]
    texts = [" ".join(words[:30] + ["v%d" % rng.randrange(10**9) for _ in range(30)]) for _ in range(30)] + [" ".join(words)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {similar.key_of(s): s for s in (similar.shingles_of(t.encode()) for t in texts)}
    values, counts = np.unique(np.concatenate([*sets.values()]), return_counts=True)
    found = similar.frequent_shingles(df, int(counts.sum()), 5, often=6)
    assert sorted(found.counts.tolist()) == sorted(counts[counts >= 6].tolist()) and found.of(values).tolist() == np.where(counts >= 6, counts, 0).tolist()
    assert len(similar.frequent_shingles(df, 10**9, 5, frequent=3, often=2).codes) <= 3
    for frequent in (found, similar.Frequent(values[:0], counts[:0], 64)):
        rank = dict(zip(values.tolist(), frequent.of(values).tolist(), strict=True))
        prefix = {k: set(sorted(s.tolist(), key=lambda x: (rank.get(x, 0), x))[: similar.need_of(len(s), 0.8)]) for k, s in sets.items()}
        place = {k: sorted(s.tolist(), key=lambda x: (rank.get(x, 0), x)) for k, s in sets.items()}
        rest = lambda k, s: len(sets[k]) - place[k].index(s)
        expected = 0
        for s in set().union(*prefix.values()):
            who = [k for k in sets if s in prefix[k]]
            if len(who) > 2 or (len(who) == 2 and (rank[s] or min(rest(k, s) for k in who) >= similar.least_common(*(len(sets[k]) for k in who), 0.8))):
                expected += len(who)
        got = {}
        for r in similar.shared_shingles(df, frequent, 10**5, 0.8, 5).collect():
            got.setdefault(r["shingle"], set()).add(r["fp"])
            assert r["size"] == len(sets[r["fp"]]) and r["place"] < len(prefix[r["fp"]])
        assert sum(len(g) for g in got.values() if len(g) > 1) == expected


def groups(got):
    out = {}
    for r in got:
        out.setdefault(r["component_id"], set()).add(r["doc_id"])
    return sorted(map(sorted, out.values()))


def expected_groups(texts):
    """The components of all links, by brute force over all pairs."""
    sets = [slow_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(texts)):
        out.setdefault(find(i), []).append(i)
    return sorted(out.values())


def joined(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return groups(simhash.similar_documents(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"block": 50, "stars": 0}, {"frequent": 0}])
@pytest.mark.parametrize("crowd", [32, 2])
def test_links_of_a_template_group(spark, monkeypatch, more, crowd):
    monkeypatch.setattr(similar, "CROWD", crowd)
    rng = random.Random(11)
    template = ["t%d" % i for i in range(300)]
    texts = []
    for _ in range(150):
        words = list(template)
        for at in rng.sample(range(300), 9):
            words[at] = "v%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    texts += [t + " " + " ".join("a%d" % rng.randrange(10**6) for _ in range(60)) for t in texts[:40]]
    expected = expected_groups(texts)
    assert 10 < len(expected) < len(texts)
    assert joined(spark, texts, **more) == expected


def test_links_of_added_and_repeated_passages(spark):
    rng = random.Random(12)
    fresh = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    texts = []
    for k in range(100):
        words = fresh(40 if k % 2 else 100)
        texts += [" ".join(words), " ".join(words + fresh(len(words) * (12 + k % 12) // 100))]
        words = fresh(60)
        texts += [" ".join(words), " ".join(words + words[30:] * 5)]
    expected = expected_groups(texts)
    assert len(expected) < len(texts) / 2 + 20
    assert joined(spark, texts) == expected


def test_equal_fingerprints_are_no_links(spark):
    rng = random.Random(13)
    texts = ["- " * 200 + " ".join("w%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(6)]
    assert len({simhash.fingerprint(t.encode(), 2) for t in texts}) == 1
    texts += [texts[0] + " more", texts[0].upper()]
    assert joined(spark, texts) == expected_groups(texts) == [[0, 6, 7], [1], [2], [3], [4], [5]]


def test_parts_of_a_large_group_meet(spark):
    rng = random.Random(14)
    words = ["w%d" % i for i in range(120)]
    texts = [" ".join(words)]
    for k in range(39):  # a chain: each text is near its neighbours only
        words[3 * k] = "v%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[i] for i in order]
    df = spark.createDataFrame([(1, i, 100, 0, i, None, 40, 5, i / 100) for i in range(40)], "shingle long, fp long, size long, place long, label long, own binary, n long, h0 long, d0 double")
    pairs = [(r["a"], r["b"]) for r in similar.cross_pairs(df, 0, 0.8, 7).collect()]
    assert sorted(pairs) == sorted((i, j) for j in range(40) for i in range(j))
    pairs = [(r["a"], r["b"]) for r in similar.cross_pairs(df, 1, 0.8, 7).collect()]
    assert sorted(pairs) == sorted((i, j) for j in range(40) for i in range(j) if j - i <= 20)  # the rest by the triangle inequality
    df = spark.createDataFrame([(1, i, 100, i, i, None, 40) for i in range(40)], "shingle long, fp long, size long, place long, label long, own binary, n long")
    pairs = [(r["a"], r["b"]) for r in similar.cross_pairs(df, 0, 0.8, 7).collect()]
    assert sorted(pairs) == sorted((i, j) for j in range(12) for i in range(j))  # what is left must be 89 of 100
    assert joined(spark, texts, block=7, stars=0) == expected_groups(texts) == [list(range(40))]


def test_similar_documents_go_through_fingerprints(spark, monkeypatch):
    """Texts whose fingerprints link are what is compared first; links that fingerprints miss are found all the same."""
    rng = random.Random(15)
    texts = []
    for _ in range(25):
        words = ["w%d" % rng.randrange(10**6) for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:200], "other", *words[201:]]), " ".join(words + ["a%d" % rng.randrange(10**6) for _ in range(70)])]
    bits = {similar.key_of(similar.shingles_of(t.encode())): slow_fingerprint(t) for t in texts}
    apart = lambda a, b: (bits[a] ^ bits[b]).bit_count()
    calls, compared = [], similar.compared
    monkeypatch.setattr(similar, "compared", lambda pairs, *more: calls.append([(r["a"], r["b"]) for r in pairs.collect()]) or compared(pairs, *more))
    assert joined(spark, texts, stars=0) == expected_groups(texts) == [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(25)]
    assert len(calls[0]) > 5 and all(apart(a, b) <= simhash.RADIUS for a, b in calls[0])
    assert any(apart(a, b) > simhash.RADIUS for a, b in calls[-1])  # found by prefixes


def test_partners(spark):
    rows = [(1, 0b0000), (2, 0b0000), (3, 0b0011), (4, 0b1111), (5, 0b1111 << 40), (2, 0b1111 << 50)]
    pairs = simhash.partners(spark.createDataFrame(rows, "fp long, mark long")).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(2, 1), (3, 1), (4, 3)]
    assert simhash.partners(spark.createDataFrame([], "fp long, mark long")).count() == 0
