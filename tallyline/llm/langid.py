"""Language identification in two steps: the language family, then one-versus-one linear support vector machines.

Features are hashed trigrams of letters (UTF-8 bytes, lower case, everything else a blank), as frequencies over the whole
text. Machines between families, and between the languages of one family, are trained in numpy on a bounded sample
(``SAMPLE`` texts of each language at most, fewer if there are very many languages), by accelerated gradient descent on the squared hinge loss. A text gets the
family that wins most comparisons, then the language that wins most within it; ties go to the larger sum of margins.

Defined cases: a null text, or one without a letter, is ``und`` with score 1; without training rows every text is ``und``
with score 0; a language that ``FAMILIES`` doesn't name is a family of its own, or with those nearest to it if there are
more than ``MOST``; very long texts are read whole; repeated rows get a row each and train once; ties of votes go to the
larger sum of margins, then to the greater name; an empty table gives an empty result; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, read_table, sent

BITS = 13
SAMPLE = 600
#: Training texts of all languages together, and of one language at least.
TEXTS = 64 * SAMPLE
LEAST = 40
#: Families at most; beyond, languages that no family names are put together.
MOST = 64
CHUNK = 2_000_000

#: Families of common languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "es fr it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ne ur",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def _normal_table() -> bytes:
    return bytes((b | 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalpha() else 32 for b in range(256))


NORMAL = _normal_table()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def letters_of(text: str) -> bytes:
    """Words of letters between single blanks, in lower case."""
    return b" " + b" ".join(text.lower().encode().translate(NORMAL).split()) + b" "


def grams(raw: bytes) -> np.ndarray:
    """The hashed trigram that starts at each byte but the last two."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


def frequencies(text: str) -> np.ndarray:
    """How often each hashed trigram is, of 100."""
    counts, total, raw = np.zeros(1 << BITS, dtype=np.float64), 0, letters_of(text)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        found = grams(raw[at : at + CHUNK + 2])
        counts += np.bincount(found, minlength=1 << BITS)
        total += len(found)
    return (counts * (100 / max(1, total))).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine for labels y of -1 and 1, classes weighted alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    x1 = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    v = np.random.default_rng(1).normal(size=x1.shape[1])
    for _ in range(12):  # the curvature, by power iteration
        v = x1.T @ (weight * (x1 @ v))
        v /= np.linalg.norm(v) or 1
    rate = 1 / (2 * float(v @ (x1.T @ (weight * (x1 @ v)))) + penalty + 1e-12)
    w = look = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(steps):
        miss = np.maximum(0, 1 - y * (x1 @ look))
        step = look - rate * (penalty * look - 2 * (x1.T @ (weight * miss * y)))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = step + (t - 1) / t_next * (step - w)
        w, t = step, t_next
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    #: (group, a, b): machine number; positive margins speak for a. The group "" compares families.
    pairs: dict[tuple[str, str, str], int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # (hashes, machines)
    bias: np.ndarray | None = None

    def winner(self, group: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Who wins most comparisons, and the chance by the closest of them."""
        if len(names) == 1:
            return names[0], 1.0
        won, total, closest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = float(margins[self.pairs[group, a, b]])
            for name, own in ((a, m), (b, -m)):
                won[name] += own > 0
                total[name] += own
                closest[name] = min(closest[name], own)
        best = max(names, key=lambda n: (won[n], total[n], n))
        return best, float(1 / (1 + np.exp(-np.clip(3 * closest[best], -30, 30))))

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        family, p = self.winner("", self.families, margins)
        language, q = self.winner(family, self.languages[family], margins)
        return language, p * q


def grouped(x: np.ndarray, langs: list[str], most: int = MOST) -> dict[str, str]:
    """The family of each language. Beyond ``most`` families the nearest by mean frequencies go together, as evenly as
    the bound needs, so that machines don't grow with the square of the languages."""
    named = {lang: FAMILY_OF.get(lang, lang) for lang in sorted(set(langs))}
    of = np.array(langs)
    own = [lang for lang in named if lang not in FAMILY_OF]
    free = max(1, most - len({f for lang, f in named.items() if lang in FAMILY_OF}))
    if len(own) <= free:
        return named
    means = np.stack([x[of == lang].mean(axis=0) for lang in own])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    left = list(range(len(own)))
    for k in range(free, 0, -1):
        near = sorted(left, key=lambda i: (-float(means[left[0]] @ means[i]) if i != left[0] else -np.inf, i))[: -(-len(left) // k)]
        for i in near:
            named[own[i]] = f"like {own[near[0]]}"
        left = [i for i in left if i not in near]
        if not left:
            break
    return named


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    if not langs:
        return None
    families = grouped(x, langs)
    family = [families[lang] for lang in langs]
    names = {f: sorted({lang for lang, g in zip(langs, family, strict=True) if g == f}) for f in sorted(set(family))}
    model = Model(sorted(names), names)
    columns, bias = [], []
    for group, members, of in [("", model.families, family), *((f, names[f], langs) for f in model.families)]:
        of = np.array(of)
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((of == a) | (of == b))
            w, c = svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))
            model.pairs[group, a, b] = len(columns)
            columns.append(w)
            bias.append(c)
    model.weights = np.stack(columns, axis=1) * np.float32(100) if columns else np.zeros((1 << BITS, 0), dtype=np.float32)
    model.bias = np.array(bias)
    return model


def margins_of(texts: list[str], model: Model) -> np.ndarray:
    """The margin of each machine for each text, from all of its trigrams."""
    sums, counts = np.zeros((len(texts), model.weights.shape[1])), np.zeros(len(texts))
    pieces: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            lengths = np.array([len(p) for _, p in pieces])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            values = model.weights[grams(b"".join(p for _, p in pieces))]
            within = np.ones(len(values), dtype=bool)  # trigrams that don't run into the next text
            ends = np.cumsum(lengths)[:-1]
            within[ends - 1] = within[ends - 2] = False
            values[~within] = 0
            rows = np.array([i for i, _ in pieces])
            np.add.at(sums, rows, np.add.reduceat(values, starts, axis=0, dtype=np.float64))
            np.add.at(counts, rows, lengths - 2)
            pieces.clear()
            held = 0

    for i, text in enumerate(texts):
        raw = letters_of(text)
        for at in range(0, max(1, len(raw) - 2), CHUNK):
            if len(part := raw[at : at + CHUNK + 2]) > 2:
                pieces.append((i, part))
                held += len(part)
            if held >= CHUNK:
                flush()
    flush()
    return sums / np.maximum(1, counts)[:, None] + model.bias


def trained(docs: DataFrame, keep: F.Column, sample: int = SAMPLE, texts: int = TEXTS) -> Model | None:
    """The machines for all languages, from rows where ``keep``, drawn by a hash of doc_id and text.

    Rows that share an id are drawn apart, rows that repeat id and text count once. About ``sample`` texts of each language, fewer if all would be more than ``texts``, but ``LEAST`` at least.
    """
    told = docs.filter(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in told.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    sample = min(sample, max(LEAST, texts // len(counts)))
    share = F.lit(json.dumps({lang: int(min(1.0, sample / n) * (1 << 30)) for lang, n in counts.items()}))
    share = F.from_json(share, "map<string,long>")[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    x = frequencies(text)
                    at = np.flatnonzero(x).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([lang], pa.string()), pa.array([at.tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], ["doc_id", "lang", "at", "x"])

    mark = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(5))
    drawn = told.filter(F.pmod(mark, F.lit(1 << 30)) < share).select(mark.alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # the shares bound what is expected, the limit what can be
    chosen = drawn.groupBy("mark", "lang").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "lang").limit(2 * sample * len(counts))
    rows = chosen.mapInArrow(run, "doc_id long, lang string, at binary, x binary").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    x = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, np.frombuffer(at, dtype=np.int32)] = np.frombuffer(v, dtype=np.float32)
    return fit(x, list(rows["lang"]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row, from its whole text."""
    known = sent(docs.sparkSession, "languages", model)  # 2**BITS weights a machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if own is None:
                found = [("und", 0.0)] * len(texts)
            else:
                some = [i for i, t in enumerate(texts) if t and has_letter(t)]
                found = [("und", 1.0)] * len(texts)
                for i, m in zip(some, margins_of([texts[i] for i in some], own), strict=True):
                    found[i] = own.predict(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, trained(docs, crc32_mod(F.col("doc_id"), 4) != 2))
    return found.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
