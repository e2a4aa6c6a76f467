"""Texts of similar shingle sets: all links of a Jaccard similarity, found exactly.

A text counts as the set of its shingles of ``words`` words. Two sets of similarity s share one of the first
``n - ceil(s * n) + 1`` of either's n shingles, whatever order all sets are in; so only these prefixes are indexed, and
the order puts rarer shingles first, by counts over all texts. Every pair that shares a prefix shingle is compared, unless

* what stands in either from that shingle on is too little (of a link's shared shingles the first one in the order
  passes that test, so it is found by that one), or
* the two are in one component already, or
* both have been compared with a third text whose distances from them differ by more than a link's distance
  (1 - Jaccard is a metric, so the triangle inequality holds), or
* the sets, counted by classes of shingles or by 32 bits of each, can't have enough in common (bounds, not estimates).

None of these loses a link. At first each text is compared with the one that the caller's marks put beside it (``simhash``:
fingerprints that link), then with the one text that shares most shingles with it among the hubs of its shingles, so a large
group of copies becomes one component with a comparison a text; only then all remaining pairs follow, so links that marks
miss are found as well. Sets are equal if their 64-bit hashes are.

The counts are one shuffle of 4 bytes a shingle, the index one of 20 bytes for each shingle of a prefix, both packed in
Python. The ``FREQUENT`` most frequent shingles, those in ``OFTEN`` sets or more, are sent to every executor; they don't
take part in the index but are known to be shared, so no task gets all texts of a frequent shingle. Later
steps hold rows of shared shingles, and texts only for comparisons. Each step is a written table; what a later one
replaces is deleted.

Defined cases: null and empty texts have the empty set and form one group; repeated rows each get a row of the result;
rows without a doc_id are linked like others, and a component without any doc_id has a null component_id; very long
texts are compared whole; ties between hubs go by hash, then by set, and change no component; an empty table gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, per_worker, sent, tidy, written
from .components import components, with_components

SEED = 42
SHINGLE = 5
SIMILAR = 0.8
#: The most frequent shingles, at most, that every executor knows (16 MB), and in how many sets those are at least.
FREQUENT = 1_000_000
OFTEN = 8
#: Shingles that one task counts at a time.
COUNTED = 4_000_000
#: Prefix shingles that one task of the index holds at a time.
ENTRIES = 500_000
#: Members of a shingle that one task compares with each other.
BLOCK = 16_384
#: From so many members on a shingle's members bring their sets, so that only pairs that link leave the task.
CROWD = 32
#: Rounds at most that compare each text with one other, before all remaining pairs.
STARS = 6

#: Place: from 0 on in the order of shingles.
_RARE = np.dtype([("key", "<u4"), ("fp", "<i8"), ("size", "<u4"), ("place", "<u4")])
_KNOWN = np.dtype([("key", "<u8"), ("fp", "<i8"), ("size", "<u4"), ("place", "<u4")])
#: Texts that a Python worker holds at a time.
SLICE = 2_000


class Words(dict):
    """Word to 64-bit hash, in a worker; starts anew when it has grown large."""

    LARGEST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LARGEST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles_of(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of the distinct shingles of a text, rising; a shorter text is one shingle.

    A-Z count as a-z; words are what ASCII white space separates.
    """
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    known = per_worker("words", "", Words)
    ids = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(parts))
    total = np.full(len(parts) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(parts) - size + 1 + j]
    return np.unique(_mixed(total))


def key_of(own: np.ndarray) -> int:
    """The hash of a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def sketch_of(own: np.ndarray) -> np.ndarray:
    """How many shingles fall in each class by their low bits; a power of two of classes, one shingle each or less."""
    classes = 8
    while classes < len(own):
        classes *= 2
    while True:
        counts = np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        classes *= 2


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """No more shingles than that are in both sets of these sketches."""
    n = min(len(x), len(y))
    fold = lambda s: s.reshape(-1, n).sum(axis=0, dtype=np.int64)
    return int(np.minimum(fold(x), fold(y)).sum())


def least_common(size, other, similarity: float):  # noqa: ANN001, ANN201
    """How many shingles linked sets of these sizes share at least (numbers, arrays or columns)."""
    return (size + other) * (similarity / (1 + similarity)) - 1e-6


def need_of(size: int, similarity: float) -> int:
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_keys(docs: DataFrame, words: int, mark: Callable[[bytes], int]) -> DataFrame:
    """doc_id, digest and mark (of the text, 64 bits), fp (of the set), size and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(2).cast(pa.binary())
            sets = [shingles_of(t.as_py() or b"", words) for t in texts]
            marks = np.array([mark(t.as_py() or b"") for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks), pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch_of(s).tobytes() for s in sets], pa.binary())],
                ["doc_id", "digest", "mark", "fp", "size", "sketch"],
            )

    rows = _texts(docs).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest long, mark long, fp long, size long, sketch binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _buckets(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return ((shingles >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _cut(bucket: np.ndarray, rows: np.ndarray, buckets: int) -> list[bytes]:
    """The bytes of the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = rows[order]
    return [rows[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(bucket, the blobs of each further column) of rows that are sorted by bucket."""
    held, parts = None, []
    for batch in batches:
        for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != held:
                if held is not None:
                    yield held, parts
                held, parts = bucket, [[] for _ in blobs]
            for p, b in zip(parts, blobs, strict=True):
                p.append(b)
    if held is not None:
        yield held, parts


def _codes(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket and 32 bits of each shingle: what shingles are counted by."""
    return (_buckets(shingles, buckets).astype(np.uint64) << np.uint64(32)) | (shingles & np.uint64(0xFFFFFFFF))


@dataclass(frozen=True)
class Frequent:
    """The codes of frequent shingles, rising, in how many sets they are, and the buckets that codes have."""

    codes: np.ndarray
    counts: np.ndarray
    buckets: int

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """The count of each shingle, 0 for those that aren't frequent."""
        if not len(self.codes) or not len(shingles):
            return np.zeros(len(shingles), dtype=np.int64)
        own = _codes(shingles, self.buckets)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        return np.where(self.codes[at] == own, self.counts[at], 0)


def frequent_shingles(docs: DataFrame, total: int, words: int, frequent: int = FREQUENT, often: int = OFTEN) -> Frequent:
    """The most frequent shingles; ``total`` is the number of shingles of all sets.

    They only choose the order of shingles: it decides how many candidates there are, not which links are found.
    """
    buckets = max(64, -(-total // COUNTED))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            sets = [shingles_of(t.as_py() or b"", words) for t in batch.column(0).cast(pa.binary())]
            sets = [s for s in sets if (k := key_of(s)) not in seen and not seen.add(k)]
            codes, n = np.unique(_codes(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), buckets), return_counts=True)
            ends = np.searchsorted(codes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            ones, more = [], []  # of those that several texts of the slice have, one entry with their number
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                key, many = codes[a:b].astype(np.uint32), n[a:b] > 1
                ones.append(key[~many].tobytes())
                more.append(np.stack([key[many], n[a:b][many].astype(np.uint32)], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), pa.array(ones, pa.binary()), pa.array(more, pa.binary())], ["bucket", "ones", "more"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (ones, more) in _by_bucket(batches):
            many = np.frombuffer(b"".join(more), dtype=np.uint32).reshape(-1, 2)
            single = np.frombuffer(b"".join(ones), dtype=np.uint32)
            order = np.argsort(keys := np.concatenate([single, many[:, 0]]), kind="stable")
            n = np.concatenate([np.ones(len(single), dtype=np.int64), many[:, 1]])[order]
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            sums = np.add.reduceat(n, starts) if len(keys) else n
            keep = sums >= often
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts][keep].astype(np.int64) + (bucket << 32)), pa.array(sums[keep])], ["code", "n"])

    cuts = _texts(docs).select("text").mapInArrow(cut, "bucket int, ones binary, more binary")
    counted = written(cuts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "code long, n long"), "similar-counts")
    # the least count that leaves no more than that many: by steps of an eighth of a power of two, some hundred rows
    step = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > frequent:
            least = r["step"] + 1
            break
    rows = counted.filter(step >= least).toArrow()  # columns: a million rows as objects would fill the driver
    discard(counted)
    codes = rows.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return Frequent(codes[order], rows.column("n").to_numpy()[order], buckets)


def shared_shingles(docs: DataFrame, frequent: Frequent, entries: int, similarity: float, words: int) -> DataFrame:
    """shingle, fp, size and place for each shingle of a prefix that is in prefixes of several sets which may link."""
    known = sent(docs.sparkSession, "frequent", frequent)  # at most FREQUENT shingles
    buckets = max(64, -(-entries // ENTRIES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = set(), known()
        for batch in _slices(batches):
            firsts, often, sizes, keys = [], [], [], []
            for t in batch.column(0).cast(pa.binary()):
                own = shingles_of(t.as_py() or b"", words)
                if len(own) == 0 or (key := key_of(own)) in seen:
                    continue
                seen.add(key)
                need = need_of(len(own), similarity)
                n = counts.of(own)
                order = np.argsort(n, kind="stable")[:need]
                firsts.append(own[order])
                often.append(n[order] > 0)
                sizes.append(len(own))
                keys.append(key)
            if not keys:
                continue
            lengths = [len(f) for f in firsts]
            shingle, is_known = np.concatenate(firsts), np.concatenate(often)
            fp, size = np.repeat(np.array(keys, dtype=np.int64), lengths), np.repeat(np.array(sizes, dtype=np.uint32), lengths)
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            blobs = []
            for which, kind in ((~is_known, _RARE), (is_known, _KNOWN)):
                rows = np.empty(int(which.sum()), dtype=kind)
                rows["key"] = shingle[which] & np.uint64(0xFFFFFFFF) if kind is _RARE else shingle[which]
                rows["fp"], rows["size"], rows["place"] = fp[which], size[which], place[which]
                bucket = _buckets(shingle[which], buckets) if kind is _RARE else _buckets(fp[which].view(np.uint64), buckets)
                blobs.append(_cut(bucket, rows, buckets))
            some = [i for i in range(buckets) if blobs[0][i] or blobs[1][i]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([b[i] for i in some], pa.binary()) for b in blobs)], ["bucket", "rare", "known"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (rare, often) in _by_bucket(batches):
            rows, told = np.unique(np.frombuffer(b"".join(rare), dtype=_RARE)), np.unique(np.frombuffer(b"".join(often), dtype=_KNOWN))
            starts = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.concatenate([starts, [len(rows)]]))
            keep = np.repeat(n > 1, n)
            two = starts[n == 2]
            size, rest = (rows["size"].astype(np.int64), rows["size"].astype(np.int64) - rows["place"])
            fail = two[np.minimum(rest[two], rest[two + 1]) < least_common(size[two], size[two + 1], similarity)]
            keep[fail] = keep[fail + 1] = False
            rows = rows[keep]
            both = lambda name, kind: pa.array(np.concatenate([rows[name], told[name]]).astype(kind))
            shingle = np.concatenate([rows["key"].astype(np.int64) + (bucket << 32), told["key"].view(np.int64) if len(told) else np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(shingle), both("fp", np.int64), both("size", np.int64), both("place", np.int64)], ["shingle", "fp", "size", "place"])

    cuts = _texts(docs).select("text").mapInArrow(cut, "bucket int, rare binary, known binary")
    return cuts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "shingle long, fp long, size long, place long")


def in_common(sketches: list[bytes | None], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``most_common`` of the sketches at these places, pair by pair; unbounded for those without a sketch."""
    out = np.full(len(left), np.iinfo(np.int64).max)
    size = np.array([len(s) if s is not None else 0 for s in sketches])
    place, rows = np.zeros(len(size), dtype=np.int64), {}
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        place[own] = np.arange(len(own))
        rows[int(n)] = np.frombuffer(b"".join(sketches[i] for i in own), dtype=np.uint8).reshape(-1, n)
    for x, y in {(int(a), int(b)) for a, b in zip(size[left], size[right], strict=True) if a and b}:
        n, pairs = min(x, y), np.flatnonzero((size[left] == x) & (size[right] == y))
        one, two = (rows[k].reshape(len(rows[k]), -1, n).sum(axis=1, dtype=np.uint16) if k > n else rows[k] for k in (x, y))
        for at in range(0, len(pairs), 1 << 15):
            some = pairs[at : at + (1 << 15)]
            out[some] = np.minimum(one[place[left[some]]], two[place[right[some]]]).sum(axis=1, dtype=np.int64)
    return out


def cross_pairs(members: DataFrame, hubs: int, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b) with different labels of all members of each shingle that may link.

    ``members`` has shingle, n, fp, size, place, label, own (32 bits of each shingle of the set, or null), and for each of ``hubs`` rounds h0, d0, ...: a
    text it was compared with and its distance (null: none). The members of a shingle that has more than ``block`` are
    dealt to parts, and every part meets every part.
    """
    far, spark = 1 - similarity + 1e-9, members.sparkSession
    dealt = members.withColumn("_parts", F.ceil(F.col("n") / block).cast("int")).withColumn("_part", F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    one = F.struct("fp", "label", "size", (F.col("size") - F.col("place")).alias("rest"), "_part", "own", *(c for k in range(hubs) for c in (F.coalesce(f"h{k}", "fp").alias(f"h{k}"), F.coalesce(f"d{k}", F.lit(0.0)).alias(f"d{k}"))))
    met = met.withColumns({"_low": F.least("_part", "_other"), "_high": F.greatest("_part", "_other")})
    # by a number of its own: comparing takes much longer than reading, by which adaptive execution joins partitions
    met = met.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "shingle", "_low", "_high").groupBy("shingle", "_low", "_high").agg(F.collect_list(one).alias("rows")).select("_low", "_high", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                fp, label, size, rest, part = (np.asarray(cell.values.field(i)) for i in range(5))
                sets = [None if s is None else np.frombuffer(s, dtype=np.uint32) for s in cell.values.field(5).to_pylist()]
                sketches = [None if s is None else sketch_of(s.astype(np.uint64)).tobytes() for s in sets]
                told = [np.asarray(cell.values.field(6 + i)) for i in range(2 * hubs)]
                left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
                step = max(1, 1_000_000 // max(1, len(right)))
                for at in range(0, len(left), step):
                    i, j = left[at : at + step, None], right[None, :]
                    good = (label[i] != label[j]) & (np.minimum(rest[i], rest[j]) >= least_common(size[i], size[j], similarity))
                    if low == high:
                        good &= fp[i] < fp[j]
                    for h, d in zip(told[::2], told[1::2], strict=True):
                        good &= (h[i] != h[j]) | (np.abs(d[i] - d[j]) <= far)
                    r, c = np.nonzero(good)
                    r, c = left[at + r], right[c]
                    if sketches[0] is not None and len(r):
                        least = least_common(size[r], size[c], similarity)
                        keep = np.flatnonzero(in_common(sketches, r, c) >= least)
                        keep = keep[[len(np.intersect1d(sets[r[k]], sets[c[k]], assume_unique=True)) >= least[k] for k in keep]] if len(keep) else keep
                        r, c = r[keep], c[keep]
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[r], fp[c])), pa.array(np.maximum(fp[r], fp[c]))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def short_sets(texts: DataFrame, words: int) -> DataFrame:
    """fp and own (32 bits of each shingle) of texts (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = [np.sort(shingles_of(t.as_py() or b"", words).astype(np.uint32)).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["fp", "own"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, own binary")


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [most_common(np.frombuffer(s, dtype=np.uint8), np.frombuffer(t, dtype=np.uint8)) >= least_common(i, j, similarity) for i, j, s, t in zip(m, n, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda fp, size, sketch: nodes.select(F.col("fp").alias(fp), F.col("size").alias(size), F.col("sketch").alias(sketch))
    return pairs.join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """a, b, linked and distance of the pairs, from the whole texts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            linked, distance = [], []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                one = shingles_of(x.as_py(), words)
                if b != last:  # rows come sorted by the join
                    last, held = b, shingles_of(y.as_py(), words)
                both = len(np.intersect1d(one, held, assume_unique=True))
                union = len(one) + len(held) - both
                linked.append(both >= similarity * union)
                distance.append(1 - both / union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], ["a", "b", "linked", "distance"])

    of = lambda fp, text: texts.select(F.col("fp").alias(fp), F.col("text").alias(text))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean, distance double")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and text of the sets ``wanted`` (fp, first: the struct of doc_id and digest of one of its rows)."""
    named = wanted.select(F.col("fp"), F.col("first.doc_id").alias("_doc"), F.col("first.digest").alias("_digest"))
    own = _texts(docs)
    rows = own.join(named, own["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(own["text"]) == F.col("_digest")))
    return rows.groupBy("fp").agg(F.first("text").alias("text"))  # rows may be repeated


def similar_documents(docs: DataFrame, mark: Callable[[bytes], int], partners: Callable[[DataFrame], DataFrame], similarity: float = SIMILAR, words: int = SHINGLE, frequent: int = FREQUENT, block: int = BLOCK, stars: int = STARS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that can be reached over links) of each row, where texts link if
    their sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``.

    ``mark`` gives 64 bits of a text, and ``partners`` of a table of sets and marks (fp, mark) the pairs (a, b) of sets to
    compare first, each a once at most. These, ``frequent``, ``block`` and ``stars`` change the effort only, never the links.
    """
    prints = written(set_keys(docs, words, mark), "similar")
    nodes = written(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.min("doc_id").alias("first_doc"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "similar-nodes")
    told = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("size") * (1 - similarity)).cast("long") + 1), F.lit(0)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    if told["n"] == 0:
        return prints.select("doc_id", F.col("doc_id").alias("component_id"))
    known = frequent_shingles(docs, told["total"], words, frequent)
    members = written(shared_shingles(docs, known, told["entries"], similarity, words), "similar-members")
    wanted = nodes.join(members.select("fp").distinct(), "fp", "left_semi")
    texts = written(texts_of(docs, wanted), "similar-texts")
    tidy(docs.sparkSession)

    links, root, left, tried = None, None, None, []

    def labelled() -> DataFrame:
        """The members of the shingles that stand in more than one component."""
        nonlocal left
        if root is None:
            return members.withColumn("label", F.col("fp"))
        now = members.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
        open_ = now.groupBy("shingle").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x != _y").select("shingle")
        old, left = left, written(now.join(open_, "shingle", "left_semi"), "similar-open")
        discard(old)
        return left

    def compare(best: DataFrame) -> Row:
        """Compares the pairs (a, b) whole and joins those that link; n and hits: how many pairs and links there were."""
        nonlocal links, root
        asked = written(possible(best, nodes, similarity), "similar-asked")
        found = written(compared(asked, texts, similarity, words), "similar-compared")
        discard(asked)
        told = found.agg(F.count("*").alias("n"), F.count_if("linked").alias("hits")).first()
        tried.append(found.select(F.col("a").alias("fp"), F.col("b").alias("h"), F.col("distance").alias("d")))
        if told["hits"]:
            more = found.filter("linked").select("a", "b")
            links = more if links is None else links.union(more)
            old, root = root, components(links, "similar")
            discard(old)
        tidy(docs.sparkSession)
        return told

    compare(partners(prints.filter("size > 0").select("fp", "mark").distinct()))
    for k in range(stars):
        now = labelled()
        hubs = now.groupBy("shingle").agg(F.min(F.struct(F.floor(F.col("place") / F.col("size") * 20).alias("step"), F.xxhash64("fp", F.lit(k)).alias("drawn"), "fp", "size", "place", "label")).alias("hub"))
        both = F.least(F.col("size") - F.col("place"), F.col("hub.size") - F.col("hub.place")) >= least_common(F.col("size"), F.col("hub.size"), similarity)
        ask = now.join(hubs, "shingle").filter((F.col("label") != F.col("hub.label")) & both)
        for other in tried:  # not the same text again
            ask = ask.join(other.select("fp", F.col("h").alias("_h")), "fp", "left").filter(F.col("_h").isNull() | (F.col("_h") != F.col("hub.fp"))).drop("_h")
        votes = ask.groupBy("fp", F.col("hub.fp").alias("hub"), F.col("hub.drawn").alias("drawn")).agg(F.count("*").alias("n"))
        best = votes.groupBy("fp").agg(F.max(F.struct("n", "drawn", "hub")).alias("best")).select(F.col("fp").alias("a"), F.col("best.hub").alias("b"))
        told = compare(best)
        if told["n"] < 100 or told["hits"] * 4 < told["n"]:
            break

    rest = labelled()
    rest = rest.join(rest.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    crowd = rest.filter(F.col("n") >= CROWD)
    crowd = crowd.join(short_sets(texts.join(crowd.select("fp").distinct(), "fp", "left_semi"), words), "fp")
    rest = rest.filter(F.col("n") < CROWD).withColumn("own", F.lit(None).cast("binary")).unionByName(crowd)
    for k, other in enumerate(tried):
        rest = rest.join(other.select("fp", F.col("h").alias(f"h{k}"), F.col("d").alias(f"d{k}")), "fp", "left")
    asked = written(possible(cross_pairs(rest, len(tried), similarity, block), nodes, similarity), "similar-asked")
    found = written(compared(asked, texts, similarity, words), "similar-compared")
    for old in (asked, left, members, texts):
        discard(old)
    tidy(docs.sparkSession)
    more = found.filter("linked").select("a", "b")
    if more.limit(1).count():
        old, root = root, components(more if links is None else links.union(more), "similar")
        discard(old)
    if root is None:
        root = more.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return with_components(prints.select("doc_id", "fp"), nodes.select("fp", "first_doc"), root).select("doc_id", "component_id")
