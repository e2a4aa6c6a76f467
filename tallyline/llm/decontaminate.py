"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts scans each text once.

Texts are normalised to words joined by single blanks: A-Z become a-z, and every ASCII character that is no letter or
digit separates words. The automaton holds each window of ``window`` consecutive item words, with a blank at either
end so that only whole words match; items of fewer words are one window. Matches are mapped back to word numbers, and
for documents with matches to character offsets of the original text.

The benchmark is small beside the corpus, but nothing relies on that: above ``SHARD_CHARS`` characters of windows the
items are dealt to several automata of bounded size, each scans the corpus, and the hits are merged.

Defined cases: a null or empty text has no words and no hits; an item without words or without an id takes no part;
very long texts are scanned whole; windows that several items share count for each of them, and words in several windows
count once; repeated rows get a row each; an empty benchmark hits nothing; an empty corpus gives an empty result; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, read_table, written

WINDOW = 10
SHARD_CHARS = 4_000_000

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _table() -> bytes:
    word = [chr(b).encode("latin-1").lower() if chr(b).isalnum() or b > 127 else b" " for b in range(256)]
    return b"".join(bytes([b]) if b > 127 else w for b, w in enumerate(word))


NORMAL = _table()


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of UTF-8 text."""
    return text.translate(NORMAL).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    """All windows of an item, each as words between blanks."""
    if not words:
        return set()
    size = min(window, len(words))
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(len(words) - size + 1)}


def automaton(items: list[tuple[int, str]], window: int = WINDOW):  # noqa: ANN201
    """Windows to (number of words, item ids), or None without any window."""
    import ahocorasick

    of: dict[bytes, set[int]] = {}
    for item, text in items:
        for w in windows_of(words_of(text.encode()), window):
            of.setdefault(w, set()).add(item)
    if not of:
        return None
    out = ahocorasick.Automaton()
    for w, ids in of.items():
        out.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(ids)))
    out.make_automaton()
    return out


HITS = "doc_id long, digest long, n_words long, ranges array<struct<first:long,last:long>>, spans array<struct<from:long,to:long>>, items array<long>"
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def scan(text: bytes, found) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[int]]:  # noqa: ANN001
    """Number of words, hit word ranges, their character offsets in the original text, and the items that occur."""
    words = words_of(text)
    if found is None or not words:
        return len(words), [], [], []
    ranges, items, starts = [], set(), None
    for end, (n, ids) in found.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        if starts is None:  # where each word's closing blank stands
            starts = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        last = int(np.searchsorted(starts, end))
        ranges.append((last - n + 1, last))
        items.update(ids)
    if not ranges:
        return len(words), [], [], []
    ranges = _merged(ranges)
    lowered = text.translate(NORMAL)
    at = [(m.start(), m.end()) for m in _WORD.finditer(lowered)]
    spans, byte, char = [], 0, 0
    for first, last in ranges:  # rising, so each stretch of the text is decoded once
        ends = []
        for to in (at[first][0], at[last][1]):
            char += len(text[byte:to].decode())
            byte = to
            ends.append(char)
        spans.append((ends[0], ends[1]))
    return len(words), ranges, spans, sorted(items)


def _hits(docs: DataFrame, items: list[tuple[int, str]], name: str, window: int, only_hit: bool) -> DataFrame:
    kept = docs.sparkSession.sparkContext.broadcast(items)  # at most about SHARD_CHARS characters of windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = per_worker("automaton", name, lambda: automaton(kept.value, window))
        for batch in batches:
            rows = [scan(t.as_py() or b"", found) for t in batch.column(2).cast(pa.binary())]
            keep = [i for i, r in enumerate(rows) if r[1] or not only_hit]
            rows = [rows[i] for i in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())),
                    batch.column(1).take(pa.array(keep, pa.int64())),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[{"first": a, "last": b} for a, b in r[1]] for r in rows], _RANGES),
                    pa.array([[{"from": a, "to": b} for a, b in r[2]] for r in rows], _SPANS),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "n_words", "ranges", "spans", "items"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(run, HITS)


def _n_hit(ranges: str) -> F.Column:
    """The number of words in the ranges, which may overlap."""
    start = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(held: F.Column, r: F.Column) -> F.Column:
        new = F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(held["upto"], r["first"] - 1))
        return F.struct(F.greatest(held["upto"], r["last"]).alias("upto"), (held["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(ranges), start, add, lambda held: held["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit (words inside occurring windows), items (ids, rising), spans.

    ``spans`` are character ranges of the original text, end exclusive.
    """
    import uuid

    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    size = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] * window
    shards = -(-size // shard_chars) or 1
    run, parts = uuid.uuid4().hex, []
    dealt = bench if shards == 1 else written(bench.withColumn("_shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))), "benchmark")
    for k in range(shards):
        mine = dealt if shards == 1 else dealt.filter(F.col("_shard") == k)
        items = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]  # bounded by shard_chars
        parts.append(_hits(docs, items, f"{run} {k}", window, shards > 1))
    if shards == 1:
        return parts[0].select("doc_id", "n_words", _n_hit("ranges").alias("n_hit"), "items", "spans")
    hits = written(reduce(DataFrame.union, parts), "benchmark-hits").distinct()
    merged = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    bare = _hits(docs, [], f"{run} none", window, False).select("doc_id", "digest", "n_words")
    joined = bare.join(merged, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    return joined.select("doc_id", "n_words", F.coalesce(_n_hit("ranges"), F.lit(0).cast("long")).alias("n_hit"), none("items", "array<long>").alias("items"), none("spans", "array<struct<from:long,to:long>>").alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
seen AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, k, i, item_id FROM seen JOIN win USING (k, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
