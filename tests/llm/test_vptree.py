"""Nearest neighbours against all distances."""

import math

import numpy as np
import pytest
from comparing import same
from pyspark.sql import functions as F

from tallyline.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, shard string, turn int, dim string, score int"


def brute(rows, k):
    ok = [(i, np.array(e, dtype=float)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    out = set()
    for q, v in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - e) ** 2).sum())), i) for i, e in ok if i != q and len(e) == len(v))[:k]
            out |= {(q, r, i, round(d, 6)) for r, (d, i) in enumerate(near, 1)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, e, "s", 1, "d", 2) for i, e in rows], SCHEMA).repartition(3)
    got = vptree.nearest(df, F.col("vec_id") % 100 == 0, **options).collect()
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got}


def test_exact_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 8) for i in range(300)]  # ties
    rows += [(3000, None), (3100, []), (3200, [0.0] * 8), (3300, [None, 1.0]), (3400, [float("nan")] * 8), (3500, [float("inf")] * 8), (None, [1.0] * 8), (3600, [1.0, 2.0]), (3700, [2.0, 2.0])]
    assert found(spark, rows, cells=200 * 8) == brute(rows, 10)
    assert found(spark, rows) == brute(rows, 10)


def test_shards_are_regions(spark):
    """Queries go on only to shards that the triangle inequality leaves open, and nothing is lost by that."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 5)) * 40
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + rng.normal(size=5)]) for i in range(1600)]
    rows += [(5000 + i, rows[0][1]) for i in range(700)]  # a hot vector
    assert found(spark, rows, cells=150 * 5) == brute(rows, 10)
    vectors = np.array([e for _, e in rows[:1600]])
    tree = vptree.regions(vectors[:128], 16)
    home = tree.homes(vectors)
    assert np.bincount(home, minlength=16).max() < 600
    bounds = tree.bounds(vectors[:50])
    for q in range(50):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        assert all(d[home == s].min() >= bounds[q, s] - 1e-9 for s in range(16) if (home == s).any()) and bounds[q, home[q]] == 0
    reach = np.sort(np.sqrt(((vectors[:50, None] - vectors[None]) ** 2).sum(axis=2)), axis=1)[:, 10]
    assert (bounds <= reach[:, None]).sum() < 0.5 * bounds.size


def test_distances_beyond_doubles(spark):
    huge = float(np.finfo(np.float32).max)
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1e300, 3.0]), (3, [1.0, 2.0]), (100, [1e-300, huge])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    assert [got[0, r][0] for r in (1, 2, 3, 4)] == [2, 1, 3, 100] and got[0, 1][1] == 2.0 and got[0, 2][1] == math.inf
    assert len(got) == 8


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])]
    assert found(spark, rows) == brute(rows, 10)
    assert found(spark, [(0, [1.0])]) == set()
    assert found(spark, []) == set()


def test_relaxed_search_recalls_most(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    dim = len(df.first()["embedding"])
    pairs = lambda relax: {(r["query_id"], r["vec_id"]) for r in vptree.nearest(df, F.col("vec_id") % 10 == 0, relax=relax, cells=100 * dim).collect()}
    exact = pairs(1.0)
    assert len(exact & pairs(1.15)) >= 0.9 * len(exact)


def test_pruning_leaves_branches_out():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(c, 0.1, (500, 4)) for c in (0, 50, 100)])
    ids = np.arange(len(vectors))
    best = vptree.Best(vectors[:1], ids[:1], 5)
    seen = []
    offer = best.offer
    best.offer = lambda which, v, s, i: (seen.append(len(i)), offer(which, v, s, i))
    vptree.search(vptree.build(vectors, leaf=64), vectors, ids, best)
    assert sum(seen) < len(vectors) / 2


def test_query_matches_its_sql(spark, folder, duck):
    same(vptree.op3_neighbours(spark, folder), duck.sql(vptree.OP3_SQL))


@pytest.mark.parametrize("n", [1, 64, 65, 300])
def test_equal_vectors_end_in_leaves(n):
    node = vptree.build(np.ones((n, 3)), leaf=64)
    assert node.rows is not None and len(node.rows) == n
