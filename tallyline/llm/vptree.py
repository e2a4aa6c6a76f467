"""Nearest neighbours by vantage-point trees, one a shard.

Of equal vectors the ``k + 1`` smallest ids are kept: no other can be among the k nearest of any query, so a vector that
a third of all rows share costs no more than others. Rows are dealt to shards by a small tree of vantage points from a
bounded sample, so a shard holds a region. A query first searches the shard that it falls in; then it goes to those
shards only that the triangle inequality leaves open, given the k-th distance found. Within a shard a vantage-point
tree splits at median distances, and a branch is left out if the triangle inequality puts all of it beyond ``relax``
times less than the current k-th distance. ``relax`` = 1 is exact, larger values search less.

A shard holds ``CELLS`` numbers at most on average, whatever the dimension. Its rows come first in its partition, then
the queries in batches: memory holds one shard and one batch. Queries go down the tree in groups, those nearer to the
inside first there, so distances are computed for whole blocks. Scores are Euclidean distances of the original vectors
in double precision, summed in order of the components. In data of many independent dimensions distances are all alike
and no exact search can leave shards out; then a query visits all of them.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor
as candidates; vectors of any length are searched whole, those of different length never meet; ties go to the smaller
id; a distance too large for a double is infinite and comes last; rows that repeat an id are candidates each by itself,
but never for their own id; without candidates a query has no rows; an empty table gives an empty result; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, sent, written

K = 10
#: Numbers that a shard holds on average: 64 MB.
CELLS = 8_000_000
#: Vectors at most that the tree of shards is made from, and of them for each shard.
SAMPLE = 65_536
EACH = 8
LEAF = 512
RELAX = 1.0
_SLACK = 1e-9


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: int = -1
    inner: Node | None = None
    outer: Node | None = None
    inner_range: tuple[float, float] = (0.0, 0.0)
    outer_range: tuple[float, float] = (0.0, 0.0)


def distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """In blocks, so that no second copy of the vectors is held."""
    out = np.empty(len(vectors))
    with np.errstate(over="ignore"):
        for at in range(0, len(vectors), 8192):
            out[at : at + 8192] = np.sqrt(((vectors[at : at + 8192] - point) ** 2).sum(axis=1))
    return out


def build(vectors: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF, seed: int = 5) -> Node:
    """The tree over ``rows``; vantage points are far from a random row, equal distances end in one leaf."""
    rng = np.random.default_rng(seed)
    rows = np.arange(len(vectors)) if rows is None else rows

    def grow(rows: np.ndarray) -> Node:
        if len(rows) <= leaf:
            return Node(rows=rows)
        own = vectors[rows]
        vantage = int(rows[np.argmax(distances(own, vectors[rows[rng.integers(len(rows))]]))])
        d = distances(own, vectors[vantage])
        del own
        middle = np.median(d)
        inside = d <= middle
        if inside.all():
            inside = d < middle
        if not inside.any() or not np.isfinite(middle):
            return Node(rows=rows)
        near, far = d[inside], d[~inside]
        return Node(None, vantage, grow(rows[inside]), grow(rows[~inside]), (near.min(), near.max()), (far.min(), far.max()))

    return grow(rows)


@dataclass
class Regions:
    """A tree of vantage points whose leaves are shards: node k splits at ``radius[k]`` around ``points[k]``; children of
    0 and more are nodes, others shards (-1 is shard 0)."""

    points: np.ndarray
    radius: np.ndarray
    children: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """How near a row of each shard can be to each vector: (vectors, shards); 0 where the vector falls itself."""
        shards = len(self.radius) + 1
        out = np.zeros((len(vectors), shards))

        def visit(node: int, least: np.ndarray) -> None:
            if node < 0:
                out[:, -node - 1] = least
                return
            d = distances(vectors, self.points[node])
            inside = d <= self.radius[node]
            visit(int(self.children[node, 0]), np.where(inside, least, np.maximum(least, d - self.radius[node])))
            # a row outside is farther than the radius, so by nothing may a vector inside be as near to it
            visit(int(self.children[node, 1]), np.where(inside, np.maximum(least, np.maximum(self.radius[node] - d, np.finfo(float).tiny)), least))

        visit(0 if len(self.radius) else -1, np.zeros(len(vectors)))
        return out

    def homes(self, vectors: np.ndarray) -> np.ndarray:
        """The shard that each vector falls in."""
        out = np.zeros(len(vectors), dtype=np.int64)

        def visit(node: int, rows: np.ndarray) -> None:
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                inside = distances(vectors[rows], self.points[node]) <= self.radius[node]
                visit(int(self.children[node, 0]), rows[inside])
                visit(int(self.children[node, 1]), rows[~inside])

        visit(0 if len(self.radius) else -1, np.arange(len(vectors)))
        return out


def regions(sample: np.ndarray, shards: int, seed: int = 5) -> Regions:
    """A tree with ``shards`` leaves that share the sample evenly."""
    rng = np.random.default_rng(seed)
    points, radius, children = [], [], []

    def grow(rows: np.ndarray, shards: int, first: int) -> int:
        if shards == 1:
            return -first - 1
        node, left = len(radius), shards // 2
        own = sample[rows] if len(rows) else sample[:1]
        vantage = own[np.argmax(distances(own, own[rng.integers(len(own))]))]
        d = distances(own, vantage)
        points.append(vantage)
        radius.append(float(np.quantile(d, left / shards, method="lower")))
        children.append((0, 0))
        inside = d[: len(rows)] <= radius[node]
        children[node] = (grow(rows[inside], left, first), grow(rows[~inside], shards - left, first + left))
        return node

    grow(np.arange(len(sample)), shards, 0)
    return Regions(np.array(points).reshape(len(points), sample.shape[1]), np.array(radius), np.array(children, dtype=np.int64).reshape(-1, 2))


class Best:
    """The k nearest candidates of each query so far, ties by id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.queries, self.own, self.k = queries, own, k
        self.limit = np.full(len(queries), np.inf) if limit is None else limit  # nothing beyond is wanted
        self.distance = np.full((len(queries), k), np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def reach(self, which: np.ndarray) -> np.ndarray:
        return np.minimum(self.distance[which, -1], self.limit[which])

    def offer(self, which: np.ndarray, vectors: np.ndarray, squares: np.ndarray, ids: np.ndarray) -> None:
        """Candidates for the queries ``which``; ``squares`` are the vectors' squared lengths.

        A matrix product gives squared distances up to a known error; only pairs that may enter by that are summed
        component by component.
        """
        for at in range(0, len(which), 256):
            part = which[at : at + 256]
            q = self.queries[part]
            with np.errstate(over="ignore"):
                own = (q * q).sum(axis=1)
            with np.errstate(over="ignore", invalid="ignore"):
                rough = own[:, None] + squares[None, :] - 2 * (q @ vectors.T)
                error = 1e-12 * (own[:, None] + squares[None, :]) * q.shape[1]
                low, high = rough - error, rough + error
            unknown = ~np.isfinite(low) | ~np.isfinite(high)  # squares too large for a double
            low[unknown], high[unknown] = -np.inf, np.inf
            other = self.own[part][:, None] != ids[None, :]
            high[~other] = np.inf
            with np.errstate(over="ignore"):
                reach = self.reach(part) ** 2 * (1 + 1e-12)
            if high.shape[1] > self.k:
                reach = np.minimum(reach, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
            row, col = np.nonzero((low <= reach[:, None]) & other)
            if not len(row):
                continue
            total = np.zeros(len(row))
            with np.errstate(over="ignore"):
                for j in range(q.shape[1]):
                    d = q[row, j] - vectors[col, j]
                    total += d * d
            touched = np.unique(row)
            every_row = np.concatenate([row, np.repeat(touched, self.k)])
            every_d = np.concatenate([np.sqrt(total), self.distance[part[touched]].ravel()])
            every_id = np.concatenate([ids[col], self.id[part[touched]].ravel()])
            order = np.lexsort((every_id, every_d, every_row))
            every_row, every_d, every_id = every_row[order], every_d[order], every_id[order]
            starts = np.searchsorted(every_row, touched)
            take = starts[:, None] + np.arange(self.k)[None, :]
            self.distance[part[touched]] = every_d[take]
            self.id[part[touched]] = every_id[take]


def search(tree: Node, vectors: np.ndarray, ids: np.ndarray, best: Best, relax: float = RELAX) -> None:
    """Offers every candidate that may be among the k nearest of any query."""
    with np.errstate(over="ignore"):
        squares = (vectors * vectors).sum(axis=1)

    def visit(node: Node, which: np.ndarray) -> None:
        if not len(which):
            return
        if node.rows is not None:
            best.offer(which, vectors[node.rows], squares[node.rows], ids[node.rows])
            return
        d = distances(best.queries[which], vectors[node.vantage])
        gap_in = np.maximum(node.inner_range[0] - d, d - node.inner_range[1])
        gap_out = np.maximum(node.outer_range[0] - d, d - node.outer_range[1])
        inside_first = gap_in <= gap_out
        for group in (inside_first, ~inside_first):
            mine, near, far = which[group], gap_in[group], gap_out[group]
            turns = [(node.inner, near), (node.outer, far)]
            for child, gap in turns if group is inside_first else turns[::-1]:
                visit(child, mine[gap * relax <= best.reach(mine) * (1 + _SLACK) + _SLACK])

    visit(tree, np.arange(len(best.queries)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter("vec_id is not null and embedding is not null")
    return rows.filter(F.coalesce(whole, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


FOUND = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    values = batch.column(dims).to_numpy(zero_copy_only=False)
    for dim in np.unique(values):
        yield int(dim), batch.filter(pa.array(values == dim))


def searched(placed: DataFrame, asked: DataFrame, k: int, relax: float) -> DataFrame:
    """query_id, vec_id, score of the k nearest rows of ``placed`` (dim, shard, vec_id, embedding) to each of ``asked``
    (the same and limit) in its shard."""
    both = placed.withColumn("limit", F.lit(None).cast("double")).withColumn("turn", F.lit(0)).unionByName(asked.withColumn("turn", F.lit(1)))
    together = both.select("dim", "shard", "turn", "vec_id", "limit", "embedding").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "turn", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        tree, vectors, ids = None, np.zeros((0, 0)), np.zeros(0, dtype=np.int64)
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            names, limits = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(4).to_numpy(zero_copy_only=False)
            flat, ends = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(keys[:, 0])
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                dim, shard, turn = (int(x) for x in keys[a])
                block = flat[ends[a] - dim : ends[b - 1]].reshape(-1, dim)
                if (dim, shard) != held:
                    held, parts, tree = (dim, shard), [], None
                if turn == 0:
                    parts.append((block, names[a:b]))
                    continue
                if not parts:
                    continue
                if tree is None:
                    vectors, ids = np.concatenate([p for p, _ in parts]), np.concatenate([i for _, i in parts])
                    parts = [(vectors[:0], ids[:0])]
                    tree = build(vectors)
                best = Best(block, names[a:b], k, limits[a:b].astype(np.float64))
                search(tree, vectors, ids, best, relax)
                ok = best.id != np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[a:b], ok.sum(axis=1))), pa.array(best.id[ok]), pa.array(best.distance[ok])], ["query_id", "vec_id", "score"])

    return together.mapInArrow(run, FOUND)


def nearest(rows: DataFrame, is_query: F.Column, k: int = K, relax: float = RELAX, cells: int = CELLS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows of each query among all rows but those of its id."""
    every = usable(rows).withColumn("dim", F.size("embedding"))
    asked = written(every.filter(is_query), "queries")
    place = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    kept = written(every.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k + 1).drop("_place"), "vectors")
    # lengths whose rows need several shards: as many rows as shards at most
    large = [(r["dim"], -(-r["n"] * r["dim"] // cells), r["n"]) for r in kept.groupBy("dim").agg(F.count("*").alias("n")).filter(F.col("n") * F.col("dim") > cells).collect()]
    trees: dict[int, Regions] = {}
    for dim, shards, n in large:
        wanted = min(SAMPLE, EACH * shards)
        share = F.lit(int(min(1.0, 2 * wanted / n) * (1 << 30)) + 1)
        drawn = kept.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30)) < share)).orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(wanted).select("embedding").collect()
        if drawn:
            trees[dim] = regions(np.array([r["embedding"] for r in drawn], dtype=np.float64), min(shards, len(drawn)))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    result = lambda df: df.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    if not trees:
        one = lambda df: df.withColumn("shard", F.lit(0))
        return result(ranked(searched(one(kept), one(asked).withColumn("limit", F.lit(float("inf"))), k, relax)))
    known = sent(kept.sparkSession, "regions", trees)  # SAMPLE vectors at most for a length

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _by_dim(batch, 2):
                tree = known().get(dim)
                shard = tree.homes(_matrix(some.column(1), dim)) if tree else np.zeros(some.num_rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(shard.astype(np.int32))], ["vec_id", "embedding", "dim", "shard"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _by_dim(batch, 2):
                if (tree := known().get(dim)) is None:
                    continue
                vectors, limit = _matrix(some.column(1), dim), some.column(3).to_numpy(zero_copy_only=False)
                open_ = tree.bounds(vectors) * relax <= (limit * (1 + _SLACK) + _SLACK)[:, None]
                open_[np.arange(len(vectors)), tree.homes(vectors)] = False
                row, shard = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(shard.astype(np.int32))], ["vec_id", "embedding", "dim", "limit", "shard"])

    fields = "vec_id long, embedding array<double>, dim int, {}shard int"
    at_home = lambda df: df.select("vec_id", "embedding", "dim").mapInArrow(home, fields.format(""))
    placed = written(at_home(kept), "vectors-placed")
    first = written(ranked(searched(placed, at_home(asked).withColumn("limit", F.lit(float("inf"))), k, relax)).drop("rank"), "neighbours")
    reach = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("reach"))
    told = asked.join(reach, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "embedding", "dim", F.coalesce("reach", F.lit(float("inf"))).alias("limit"))
    more = searched(placed, told.mapInArrow(others, fields.format("limit double, ")), k, relax)
    return result(ranked(first.union(more)))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""
