"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Every document is tokenised once into pieces of at most ``capacity`` ids. The plan depends only on how many pieces
there are of each length, and there are at most ``capacity`` lengths: so the histogram, whatever the size of the
corpus, fits on the driver, where branch and bound decides which lengths share a sequence. Spark then numbers the
pieces of each length (salted, so that no length lands in one task) and each piece finds its place by that number.

Defined cases: a null or empty text is a piece of one id (the end mark); a null doc_id stays null; a very long text
is tokenised whole and cut; ties between pieces of one length go by doc_id, piece and ids; repeated rows are packed each
by itself; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_worker, read_table, written

END_ID = 2
CAPACITY = 1024
VOCABULARY = "byte_bpe_50k"
#: Branchings of the search for a packing of fewer bins.
NODES = 3000
#: Incumbents value an item of size s as s to each of these powers.
POWERS = (1.05, 1.1, 1.03, 1.2, 1.0)

#: Texts with letters beyond this plane, or with very long runs, go to the reference library itself.
_UNUSUAL = re.compile("[^\x00-ɏ]")
_LONG = 20_000


def vocabulary_paths(name: str = VOCABULARY) -> tuple[str, str]:
    """The vocabulary as the ``tokenizers`` library reads it, and the same vocabulary as byte ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Token ids of a text, as ``tokenizers`` gives them with the vocabulary at ``paths[0]``.

    The same merges are also published as byte ranks, which a second library applies about four times as fast. It is
    used for texts in Latin letters without very long runs, on which both give the same ids.
    """

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(paths[0])
        # texts that hold a token of special meaning get its id from the exact library
        self.special = re.compile("|".join([re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]) or r"(?!)")
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(paths[1], pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _UNUSUAL.search(text) or self.special.search(text) or (len(text) > _LONG and re.search(r"\S{2000}|\s{2000}", text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut_lengths(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``total`` ids: all hold ``capacity`` but the first, which takes the rest."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((start, capacity) for start in range(first, total, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    paths = paths or vocabulary_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker("encoder", str(paths), lambda: Encoder(paths))
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for piece, (start, length) in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# --- the plan -------------------------------------------------------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]  # (length, how many) in falling length


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: the largest of the volume bound, the bounds by large items, and bounds by rounding.

    The last: with k + 1 units a bin, an item of size s has more than ``s * (k + 1) / capacity`` rounded down units of
    k, or exactly as many if that is whole; no bin holds more than a volume of one in these either.
    """
    best = -(-sum(s * n for s, n in histogram.items()) // capacity)
    for k in {s for s in histogram if 2 * s <= capacity} | {0}:
        big = sum(n for s, n in histogram.items() if s > capacity - k)
        half = {s: n for s, n in histogram.items() if capacity - k >= s and 2 * s > capacity}
        small = sum(s * n for s, n in histogram.items() if k <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in half.items())
        best = max(best, big + sum(half.values()) + max(0, -(-(small - room) // capacity)))
    for k in range(1, 101):
        # over k * capacity: a whole multiple counts as itself, else rounded down in units of 1 / k
        units = sum(n * (s * k if s * (k + 1) % capacity == 0 else s * (k + 1) // capacity * capacity) for s, n in histogram.items())
        best = max(best, -(-units // (k * capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best-fit decreasing on counts: equal bins are handled together, so the cost does not follow the corpus."""
    open_bins: dict[int, dict[Pattern, int]] = {}  # by room left

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            at = open_bins.setdefault(room, {})
            at[pattern] = at.get(pattern, 0) + n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for room in sorted(r for r in open_bins if r >= size):
            each = room // size
            for pattern in sorted(open_bins[room]):
                if not left:
                    break
                have = open_bins[room][pattern]
                full = min(have, left // each)
                some = left - full * each if full < have and left - full * each < each else 0
                left -= full * each + some
                open_bins[room][pattern] = have - full - (some > 0)
                put(room - each * size, (*pattern, (size, each)), full)
                if some:
                    put(room - some * size, (*pattern, (size, some)), 1)
        each = capacity // size
        put(capacity - each * size, ((size, each),), left // each)
        if rest := left % each:
            put(capacity - rest * size, ((size, rest),), 1)
    out: dict[Pattern, int] = {}
    for at in open_bins.values():
        for pattern, n in at.items():
            if n:
                out[pattern] = out.get(pattern, 0) + n
    return out


def _fits_inside(inner: list[int], outer: list[int]) -> bool:
    """Whether the items ``inner`` can be packed into bins as large as the items of ``outer``."""
    if not inner:
        return True
    rest = inner[1:]
    return any(o >= inner[0] and _fits_inside(rest, sorted([*outer[:i], o - inner[0], *outer[i + 1 :]], reverse=True)) for i, o in enumerate(outer) if o not in outer[:i])


def fillings(room: int, counts: dict[int, int]) -> Iterator[list[int]]:
    """All undominated ways to fill ``room`` with available items, least waste first, then larger items first.

    One at a time, as they are asked for: which sums the items from each place on can reach is known beforehand, so no
    step of the enumeration ends without a filling. A filling that leaves room for another item, or whose items fit
    inside those of an earlier one, is dominated: the other leaves easier items. The second test is left out for
    fillings of more than 8 items, which costs time but loses nothing.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    reach = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        sums, left, step = reach[i + 1], min(counts[sizes[i]], room // sizes[i]), 1
        while left > 0:
            sums |= sums << (min(step, left) * sizes[i])
            left, step = left - step, step * 2
        reach[i] = sums & ((2 << room) - 1)

    def exact(i: int, left: int, chosen: list[int]) -> Iterator[list[int]]:
        if left == 0:
            yield chosen
            return
        for k in range(i, len(sizes)):
            if not reach[k] >> left & 1:
                return
            for n in range(min(counts[sizes[k]], left // sizes[k]), 0, -1):
                if reach[k + 1] >> (left - n * sizes[k]) & 1:
                    yield from exact(k + 1, left - n * sizes[k], chosen + [sizes[k]] * n)

    shown: list[list[int]] = []
    for waste in range(room + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for items in exact(0, room - waste, []):
            if any(counts[s] > items.count(s) for s in sizes if s <= waste):
                continue
            if len(items) <= 8:
                if any(_fits_inside(items, o) for o in shown):
                    continue
                shown.append(items)
            yield items


def _times(items: list[int], counts: dict[int, int]) -> int:
    return min(counts[s] // items.count(s) for s in set(items))


def _without(counts: dict[int, int], items: list[int], times: int) -> dict[int, int]:
    return {s: left for s, n in counts.items() if (left := n - times * items.count(s))}


def _pattern(items: list[int]) -> Pattern:
    return tuple((s, items.count(s)) for s in sorted(set(items), reverse=True))


def _gathered(bins: list[tuple[list[int], int]]) -> dict[Pattern, int]:
    out: dict[Pattern, int] = {}
    for items, n in bins:
        out[_pattern(items)] = out.get(_pattern(items), 0) + n
    return out


def best_valued(room: int, counts: dict[int, int], power: float) -> list[int]:
    """The filling of most value, where an item of size s is worth ``s ** power``: above 1 large items come first."""
    value, steps = np.zeros(room + 1), []
    for s in sorted((s for s, n in counts.items() if n and s <= room), reverse=True):
        left, step = min(counts[s], room // s), 1
        while left > 0:
            n = min(step, left)
            more = np.full(room + 1, -1.0)
            more[n * s :] = value[: room + 1 - n * s] + n * (s / 1024) ** power
            better = more > value + 1e-12
            value = np.where(better, more, value)
            steps.append((s, n, better))
            left, step = left - step, step * 2
    items, at = [], room
    for s, n, better in reversed(steps):
        if better[at]:
            items += [s] * n
            at -= n * s
    return sorted(items, reverse=True)


def valued_fit(histogram: dict[int, int], capacity: int, power: float) -> dict[Pattern, int]:
    """The bins around the largest item left are closed with its most valued filling, as often as the counts allow."""
    counts, done = {s: n for s, n in histogram.items() if n}, []
    while counts:
        largest = max(counts)
        items = [largest, *best_valued(capacity - largest, {**counts, largest: counts[largest] - 1}, power)]
        n = _times(items, counts)
        done.append((items, n))
        counts = _without(counts, items, n)
    return _gathered(done)


def completion(histogram: dict[int, int], capacity: int, most: int, nodes: int) -> tuple[dict[Pattern, int] | None, bool]:
    """Bin completion: a packing of fewer than ``most`` bins, or None; and whether the search came to its end.

    Each node closes bins around the largest item left with one undominated filling, as often as the counts allow or
    less often. A branch ends when its bins waste more than ``most - 1`` bins can. ``nodes`` bounds the branchings.
    """
    allowed = (most - 1) * capacity - sum(s * n for s, n in histogram.items())
    if allowed < 0:
        return None, True

    def branches(counts: dict[int, int], waste: int) -> Iterator[tuple[dict[int, int], int, tuple[list[int], int]]]:
        largest = max(counts)
        for filling in fillings(capacity - largest, {**counts, largest: counts[largest] - 1}):
            lost, items = capacity - largest - sum(filling), [largest, *filling]
            if waste + lost > allowed:
                return
            n = _times(items, counts)
            for times in range(min(n, (allowed - waste) // lost) if lost else n, 0, -1):
                yield _without(counts, items, times), waste + times * lost, (items, times)

    start = {s: n for s, n in histogram.items() if n}
    if not start:
        return {}, True
    stack, done = [branches(start, 0)], []
    while stack:
        if nodes <= 0:
            return None, False
        nodes -= 1
        if (branch := next(stack[-1], None)) is None:
            stack.pop()
            del done[len(stack) - 1 :]
            continue
        counts, waste, closed = branch
        done.append(closed)
        if not counts:
            return _gathered(done), True
        stack.append(branches(counts, waste))
    return None, True


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[Pattern, int]], bool]:
    """Patterns of lengths and how many bins take each, for all pieces of the histogram; and whether no plan has fewer.

    Incumbents are best-fit decreasing and completions by value; branch and bound mends them, or proves them, as far as
    ``nodes`` branchings go.
    """
    best, least = best_fit(histogram, capacity), lower_bound(histogram, capacity)
    for power in POWERS:
        if sum(best.values()) == least:
            break
        best = min(best, valued_fit(histogram, capacity, power), key=lambda b: sum(b.values()))
    proven = (used := sum(best.values())) == least
    while not proven:
        better, ended = completion(histogram, capacity, used, nodes)
        if better is None:
            proven = ended
            break
        best = better
        proven = (used := sum(best.values())) == least
    return sorted(best.items(), reverse=True), proven


def places(plan: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first number, how many in a bin, first bin, offset) by rising first number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first_bin = 0
    for pattern, bins in plan:
        offset = 0
        for size, each in pattern:
            rows.setdefault(size, []).append((taken.get(size, 0), each, first_bin, offset))
            taken[size] = taken.get(size, 0) + each * bins
            offset += size * each
        first_bin += bins
    return {size: np.array(r, dtype=np.int64) for size, r in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, nodes: int = NODES) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    The result holds doc_id, piece, start, length, ids_crc32, sequence_id, offset, and proven: whether no packing of
    these pieces has fewer sequences, as far as the search could tell. Sequences are filled from offset 0 without gaps
    and hold at most ``capacity`` ids. Pieces of one length take its places in the order of doc_id, piece and ids, so
    ties change nothing but which of two equal pieces comes first.
    """
    pieces = written(pieces_of(docs, capacity, paths), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, proven = plan_bins(histogram, capacity, nodes)
    table = places(plan)
    salts = max(64, sum(histogram.values()) // 1_000_000)

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select(F.col("length").alias("_length"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_row", F.row_number().over(within) - 1)
    numbered = ranked.join(offsets, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s"))).withColumn("_number", F.col("_before") + F.col("_row"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.zeros((len(length), 2), dtype=np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for size in np.unique(lengths):
            at, rows = lengths == size, table[int(size)]
            mine = rows[np.searchsorted(rows[:, 0], numbers[at], side="right") - 1]
            step = numbers[at] - mine[:, 0]
            out[at, 0] = mine[:, 2] + step // mine[:, 1]
            out[at, 1] = mine[:, 3] + step % mine[:, 1] * size
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = numbered.withColumn("_place", place("length", "_number"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset", F.lit(proven).alias("proven"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
