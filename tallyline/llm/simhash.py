"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link if they differ in at most ``radius`` bits. Correlated bits go into the same partition; a partition i
with threshold t_i finds all pairs that differ there in at most t_i bits, and if the thresholds sum to
``radius - partitions + 1`` (a threshold of -1 leaves a partition out), every linked pair is found in some partition.
Dynamic programming picks the thresholds, and their number of partitions, by estimated probes and candidates, so the
choice follows the size of the corpus: exact matches on three partitions for small ones, wider keys with probing of
neighbouring values for large ones. Candidates are verified on all 64 bits.

Only distinct fingerprints are probed, so exact copies cost nothing. A bucket of more than ``BUCKET`` fingerprints isn't
compared pair by pair: its fingerprints are linked through the values one bit away from them. Two fingerprints are at
most two bits apart if and only if they share such a value, each value has at most 65 fingerprints around it, and a star
of each value keeps all components. So no group is gathered and no link between different texts is lost.

Defined cases: null or empty texts have fingerprint zero, linked like any other; repeated rows each get a row of the
result; a component without any doc_id gets a null component_id; very long texts count whole; ties between partition
plans go to fewer partitions and change no link; an empty table gives an empty result; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar
from .common import read_table, written
from .components import components, with_components

SEED = 42
WORDS = 3
RADIUS = 2
BUCKET = 64
SAMPLE = 20_000
_CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of the shingles of ``words`` words, repeats included."""
    parts = text.lower().split()  # of bytes: A-Z only, and the six ASCII white space characters only
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the partitions -------------------------------------------------------------------------------------------------


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0..63 in ``parts`` groups of almost equal size, correlated bits together (greedily, from the strongest)."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    strength = np.abs(centred.T @ centred) / max(1, len(sample))
    free, out = set(range(64)), []
    for k in range(parts):
        want = len(free) // (parts - k)
        seed = max(free, key=lambda b: (sum(strength[b, o] for o in free if o != b), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < want:
            nearest = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(nearest)
            free.discard(nearest)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def probes(bits: list[int], threshold: int) -> list[int]:
    """The masks that turn a value into all values at most ``threshold`` bits away."""
    return [mask_of(list(c)) for n in range(threshold + 1) for c in combinations(bits, n)]


def estimated_cost(sample: np.ndarray, bits: list[int], threshold: int, total: int, pair_cost: float = 1.0) -> float:
    """Probes plus candidate pairs of a partition for ``total`` distinct fingerprints; the sample shows the skew.

    ``pair_cost`` is what a comparison costs beside a probe, which is a shuffled row.
    """
    if threshold < 0:
        return 0.0
    around = sum(comb(len(bits), n) for n in range(threshold + 1))
    _, counts = np.unique(sample & np.uint64(mask_of(bits)), return_counts=True)
    pairs = max(1, len(sample) * (len(sample) - 1) / 2)
    same = max((counts * (counts - 1) / 2).sum() / pairs, 2.0 ** -len(bits))
    return total * around + pair_cost * same * around * total * total / 2


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 on, one a partition, that sum to ``total`` at least cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                if (s := spent + t) not in after or after[s][0] > cost + more:
                    after[s] = (cost + more, [*chosen, t])
        best = after
    return best[total]


def plan_partitions(sample: np.ndarray, total: int, radius: int = RADIUS, pair_cost: float = 1.0) -> list[tuple[list[int], int]]:
    """The partitions to probe, each with its threshold: the cheapest plan over 1 to radius + 2 partitions."""
    plans = []
    for parts in range(1, radius + 3):
        groups = grouped_bits(sample, parts)
        costs = [[estimated_cost(sample, g, t, total, pair_cost) for t in range(-1, radius + 1)] for g in groups]
        cost, chosen = allocate(costs, radius - parts + 1)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


# --- the links ------------------------------------------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of fingerprints at most ``radius`` bits apart whose components are those of all such pairs."""
    fp = F.col("fp")
    keys = [F.struct(F.lit(p).alias("part"), fp.bitwiseAND(F.lit(_signed(mask_of(bits)))).bitwiseXOR(F.lit(_signed(flip))).alias("value")) for p, (bits, t) in enumerate(plan) for flip in probes(bits, t)]
    keyed = distinct.select("fp", F.inline(F.array(*keys)))
    hot = written(keyed.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("part", "value"), "simhash-hot")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    small = keyed.join(hot, ["part", "value"], "left_anti").groupBy("part", "value").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = small.select(F.explode(F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (x < y) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    around = [fp, *(fp.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64))] if radius == 2 else [fp.bitwiseXOR(F.lit(_signed(m))) for m in probes(list(range(64)), -(-radius // 2))]
    balls = keyed.join(hot, ["part", "value"], "left_semi").select("fp").distinct().select("fp", F.explode(F.array(*around)).alias("value"))
    # a ball of one bit has at most 65 members; for an even radius any two of them are at most that far apart
    stars = balls.groupBy("value").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    spokes = stars.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 1 << 20)).alias("b"))
    return pairs.union(spokes if radius % 2 == 0 else spokes.filter(near(F.col("a"), F.col("b")))).distinct()


def linked(distinct: DataFrame, total: int, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """``links`` of the ``total`` fingerprints ``distinct`` (fp), by the plan that suits them."""
    share = min(1.0, sample / total)
    chosen = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("fp").limit(2 * sample).toPandas()["fp"]
    plan = plan_partitions(chosen.to_numpy(dtype=np.int64).view(np.uint64), total, radius)
    return links(distinct, plan, radius)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that can be reached over links) of each row.

    ``sample`` bounds the distinct fingerprints that the partition plan is estimated on; all are probed. ``radius``
    must be even for buckets beyond the limit, whose exact way needs that.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    prints = written(fingerprints(docs, words), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    total = nodes.count()
    if total == 0:
        return prints.withColumn("component_id", F.col("doc_id"))
    return with_components(prints, nodes, components(linked(nodes.select("fp"), total, radius, sample), "simhash"))


# --- texts alike by their shingles: the corpus pipeline's near-duplicates -----------------------------------------------


def partners(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose texts have fingerprints that link, of ``marked`` (fp: a set, mark: a fingerprint).

    Each set meets the first set of its fingerprint, and that one the first of the smallest fingerprint it links with.
    """
    nodes = written(marked.groupBy(F.col("mark").alias("fp")).agg(F.min("fp").alias("first")), "simhash-nodes")
    if (total := nodes.count()) == 0:
        return marked.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    own = marked.join(nodes.withColumnRenamed("fp", "mark"), "mark").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = linked(nodes.select("fp"), total).groupBy(F.greatest("a", "b").alias("fp")).agg(F.min(F.least("a", "b")).alias("least"))
    first = lambda fp, name: nodes.select(F.col("fp").alias(fp), F.col("first").alias(name))
    across = near.join(first("fp", "a"), "fp").join(first("least", "b"), "least").select("a", "b")
    return own.union(across).filter("a != b").groupBy("a").agg(F.min("b").alias("b"))


def similar_documents(docs: DataFrame, similarity: float = similar.SIMILAR, words: int = similar.SHINGLE, **effort: int) -> DataFrame:
    """doc_id and component_id of each row, where texts link if their shingle sets are alike by ``similarity``.

    Texts whose fingerprints link are compared whole and first; what fingerprints can't see at their radius, ``similar``
    finds by prefixes of the sets, so every link counts. ``effort`` goes to it and changes no link.
    """
    return similar.similar_documents(docs, fingerprint, partners, similarity, words, **effort)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
