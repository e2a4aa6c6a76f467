"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word's vector is the sum of the hashed vectors of the word and of its first 4 to 7 bytes, so that inflected and
compound forms share what is learned. The network is trained in numpy on a bounded sample of labelled rows (``SAMPLE``
rows of each label at most, texts of at most ``TRAIN_WORDS`` words) and applied to every whole text. The filters are
applied to each word of a worker's vocabulary once; a filter of width w over words is then a sum of w table rows. Texts
are handled in chunks of ``CHUNK`` words, whatever their length, with running maxima.

A row's threshold depends on the language that its own function words show; it is calibrated on held-back training rows
and moved to a score of 0.5. Labels, lang, source and doc_id are no input of a score.

Defined cases: a null or empty text gets the score of no words; rows without a label or a doc_id don't train, nor do
texts of more words; rows that share an id train each by itself, rows that repeat id and text once; of several labels of
an id the larger counts; without both labels in the training rows every score is the share of toxic ones (0 if none);
very long texts are scored whole; a score of exactly 0.5 is toxic; ties between languages shown go to the first in the
list; an empty table gives an empty result; repeated rows get a row each; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, per_worker, read_table, sent, written

BITS = 17
DIM = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
SAMPLE = 3000
TRAIN_WORDS = 8192
CHUNK = 100_000
WIDE = 1 + len(PREFIXES)  # features of a word
NONE = (1 << BITS) - 1  # the id of no feature, whose vector stays zero

#: Common function words that tell four languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with it on be by this are from or an which not at have he as",
    "de": "der die und das den von zu mit ein nicht ist im dem des eine auch sich auf für als wird einer",
    "fr": "le les des et est une pour dans avec sur du qui pas au ce il sont plus par aux ou mais",
    "es": "el los las y una su es con por del al como más pero sus se lo para este esta ha",
}
LANGUAGES = len(FUNCTION_WORDS) + 1  # the first is: none shown


def _normal_table() -> bytes:
    return bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


NORMAL = _normal_table()


def words_of(text: str) -> list[bytes]:
    """Lower-case words; every ASCII character that is no letter or digit separates them."""
    return text.lower().encode().translate(NORMAL).split()


def features_of(word: bytes) -> list[int]:
    """The hashed ids of a word and of its beginnings."""
    return [zlib.crc32(word) % NONE, *(zlib.crc32(b"%d %s" % (n, word[:n])) % NONE if len(word) > n else NONE for n in PREFIXES)]


def _votes() -> dict[bytes, int]:
    owners: dict[bytes, set[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values(), start=1):
        for w in words.split():
            owners.setdefault(w.encode(), set()).add(k)
    return {w: next(iter(who)) for w, who in owners.items() if len(who) == 1}


class Vocabulary(dict):
    """Word to number, with each number's features and language vote; number 0 is no word."""

    def __init__(self) -> None:
        super().__init__()
        self.known = _votes()
        self.features = array("i", [NONE] * WIDE)
        self.votes = array("b", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.votes)
        self.features.extend(features_of(word))
        self.votes.append(self.known.get(word, 0))
        return n

    def table(self, start: int = 0) -> np.ndarray:
        """The features of the words from number ``start`` on, a row each."""
        return np.array(self.features[start * WIDE :], dtype=np.int32).reshape(-1, WIDE)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


@dataclass
class Model:
    embedding: np.ndarray  # (ids, DIM)
    filters: list[np.ndarray]  # a width's (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # logits, by language

    def projected(self, features: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place of the window: (words, places of all widths * FILTERS)."""
        flat = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        return self.embedding[features].sum(axis=1) @ flat


def pooled(numbers: np.ndarray, starts: np.ndarray, table: np.ndarray, bias: list[np.ndarray]) -> np.ndarray:
    """Max-pooled filter outputs of each text; ``numbers`` holds the texts one by one, each with trailing zeros."""
    parts, at = [], 0
    for b, width in zip(bias, WIDTHS, strict=True):
        conv = table[numbers, at : at + FILTERS]
        for j in range(1, width):
            conv[:-j] += table[numbers[j:], at + j * FILTERS : at + (j + 1) * FILTERS]
        at += width * FILTERS
        parts.append(np.maximum(np.maximum.reduceat(conv, starts, axis=0) + b, 0))
    return np.concatenate(parts, axis=1)


def languages_of(texts: list[np.ndarray], votes: np.ndarray) -> np.ndarray:
    """The language that most of a text's function words vote for, 0 without any."""
    tally = np.array([np.bincount(votes[t], minlength=LANGUAGES) for t in texts], dtype=np.int64).reshape(len(texts), LANGUAGES)
    tally[:, 0] = 0
    return np.where(tally.max(axis=1, initial=0) > 0, tally.argmax(axis=1), 0)


def logits_of(texts: list[np.ndarray], model: Model, table: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """The logit of each text (as word numbers), less the threshold of the language that it shows."""
    wide = max(WIDTHS) - 1
    features = np.zeros((len(texts), model.out.shape[0]), dtype=np.float32)
    pad = np.zeros(wide, dtype=np.int32)
    pieces: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if pieces:
            joined = np.concatenate([x for _, p in pieces for x in (p, pad)] + [pad])
            starts = np.cumsum([0, *(len(p) + wide for _, p in pieces[:-1])])
            np.maximum.at(features, np.array([i for i, _ in pieces]), pooled(joined, starts, table, model.bias))
            pieces.clear()
            held = 0

    for i, numbers in enumerate(texts):
        for at in range(0, max(1, len(numbers)), CHUNK):
            part = numbers[at : at + CHUNK + wide]  # overlapping, so that no window is lost
            pieces.append((i, part))
            held += len(part) + wide
            if held >= CHUNK:
                flush()
    flush()
    return features @ model.out + model.out_bias - model.thresholds[languages_of(texts, votes)]


def train(texts: list[np.ndarray], features: np.ndarray, labels: np.ndarray, seed: int = 7, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Model:
    """Adam on cross-entropy with dropout of words and of whole-word features; max pooling passes gradients to its
    winning windows only.

    The first embedding coordinate starts as the smoothed log odds of a feature's presence in toxic texts.
    """
    rng = np.random.default_rng(seed)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    p1 = n1 / (n1 + n0)
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for numbers, y in zip(texts, labels, strict=True):
        (toxic if y else clean)[np.unique(features[np.unique(numbers)])] += 1
    odds = np.log((toxic + 5 * p1) / (clean + 5 * (1 - p1))) - np.log(p1 / (1 - p1))
    embedding = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -1, 5) / 2
    embedding[NONE] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 1
    bias = [np.full(FILTERS, -1.0, dtype=np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    for k in range(len(WIDTHS)):
        out[k * FILTERS : k * FILTERS + FILTERS // 2] += 0.2
    model = Model(embedding, filters, bias, out, -3.0, np.zeros(LANGUAGES))

    params = [*filters, *bias, out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    squares, out_square, wide, step = np.full(1 << BITS, 1e-6, dtype=np.float32), 1e-6, max(WIDTHS) - 1, 0
    pad = np.zeros(wide, dtype=np.int32)
    weight = np.where(labels == 1, np.sqrt(n0 / n1), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            some = [t[rng.random(len(t)) > 0.1] for t in (texts[i] for i in rows)]
            numbers = np.concatenate([x for t in some for x in (t, pad)] + [pad])
            lengths = np.array([len(t) + wide for t in some])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            owner = np.repeat(np.arange(len(some)), lengths)
            words, place = np.unique(numbers, return_inverse=True)
            mine = features[words]
            mine[rng.random(len(mine)) < 0.3, 0] = NONE
            vectors = model.embedding[mine].sum(axis=1)
            hidden, winners = [], []
            for f, b in zip(filters, bias, strict=True):
                conv = (vectors @ f[0])[place]
                for j in range(1, len(f)):
                    conv[:-j] += (vectors @ f[j])[place[j:]]
                conv = conv[: len(owner)]
                top = np.maximum.reduceat(conv, starts, axis=0)
                spot = np.where(conv == top[owner], np.arange(len(owner))[:, None], len(owner))
                winners.append(np.minimum.reduceat(spot, starts, axis=0))
                hidden.append(top + b)
            x = np.concatenate(hidden, axis=1)
            active = np.maximum(x, 0)
            z = active @ out + model.out_bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            dz = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads_out = active.T @ dz + 1e-4 * out
            dx = np.outer(dz, out) * (x > 0)
            grads_f, grads_b, touched, pulls = [], [], [], []
            for k, f in enumerate(filters):
                d = dx[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.zeros_like(f)
                for j in range(len(f)):
                    spots = place[winners[k] + j]
                    g[j] = np.einsum("bcd,bc->dc", vectors[spots], d)
                    touched.append(spots.ravel())
                    pulls.append((d[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                grads_f.append(g + 1e-4 * f)
                grads_b.append(d.sum(axis=0))
            step += 1
            for p_, g_, m, v in zip(params, [*grads_f, *grads_b, grads_out], first, second, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            out_square += float(dz.sum()) ** 2
            model.out_bias -= rate * 5 * float(dz.sum()) / np.sqrt(out_square)
            word_pull = np.zeros((len(words), DIM), dtype=np.float32)
            np.add.at(word_pull, np.concatenate(touched), np.concatenate(pulls))
            moved = np.flatnonzero(np.abs(word_pull).sum(axis=1) > 0)
            who, inverse = np.unique(mine[moved], return_inverse=True)
            pull = np.zeros((len(who), DIM), dtype=np.float32)
            np.add.at(pull, inverse.ravel(), np.repeat(word_pull[moved], mine.shape[1], axis=0))
            pull[who == NONE] = 0
            squares[who] += (pull * pull).mean(axis=1)
            model.embedding[who] -= rate * pull / np.sqrt(squares[who])[:, None]
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Of the logits that split labels with the best F1 the one nearest to 0; 0 if one label is missing."""
    if len(logits) == 0 or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    z = logits[order]
    high, low = float(z[k]), float(z[k + 1]) if k + 1 < len(z) else float(z[k]) - 1
    margin = (high - low) / 10
    return min(max(0.0, low + margin), high - margin)


def fit(texts: list[np.ndarray], features: np.ndarray, votes: np.ndarray, labels: np.ndarray) -> Model:
    """Trains on four fifths, calibrates each language's threshold on the rest, then trains on all."""
    fold = np.arange(len(texts)) % 5 == 0
    if labels[~fold].min() == labels[~fold].max() or labels[fold].min() == labels[fold].max():
        return train(texts, features, labels)
    part = train([t for t, f in zip(texts, fold, strict=True) if not f], features, labels[~fold])
    held, y = [t for t, f in zip(texts, fold, strict=True) if f], labels[fold]
    z = logits_of(held, part, part.projected(features), votes)
    shown = languages_of(held, votes)
    model = train(texts, features, labels)
    overall = best_threshold(z, y)
    for k in range(LANGUAGES):
        mine = shown == k
        n = min(int((y[mine] == 1).sum()), int((y[mine] == 0).sum()))
        model.thresholds[k] = (n * best_threshold(z[mine], y[mine]) + 20 * overall) / (n + 20) if n else overall
    return model


def training_rows(docs: DataFrame, labels: DataFrame, keep: F.Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and toxic of a sample by hash of about ``sample`` rows of each label, from rows where ``keep``.

    First ids are drawn, then rows: an id that many rows share gives no more of them than the bound.
    """
    told = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("_toxic")).filter(keep)

    def shares(rows: DataFrame) -> F.Column:
        share = F.lit(0)
        for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect():
            share = F.when(F.col("_toxic") == r["_toxic"], F.lit(int(min(1.0, sample / r["n"]) * (1 << 30)))).otherwise(share)
        return share

    within = lambda mark, share: F.pmod(mark, F.lit(1 << 30)) < share
    # the shares bound what is expected, the limit what can be: small enough to send to every executor
    ids = written(told.filter(within(F.xxhash64("_doc", F.lit(11)), shares(told))).limit(4 * sample), "toxicity-sample")
    on = F.col("doc_id") == F.col("_doc")
    share = shares(docs.select("doc_id").join(F.broadcast(ids), on))
    mark = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(13))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), on).filter(F.col("text").isNotNull() & within(mark, share))
    once = rows.groupBy(mark.alias("mark")).agg(F.first(F.col("doc_id").cast("long")).alias("doc_id"), F.first("text").alias("text"), F.first("_toxic").alias("toxic"))
    return once.select("doc_id", "text", "toxic").limit(4 * sample)


def trained(docs: DataFrame, labels: DataFrame, keep: F.Column, sample: int = SAMPLE) -> Model | float:
    """The fitted model, or the share of toxic rows where one label is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t.as_py()) for t in batch.column(1)]
            mask = pa.array([len(f) <= TRAIN_WORDS for f in found])
            raw = pa.array([b" ".join(f) if len(f) <= TRAIN_WORDS else b"" for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, batch.column(2)], ["doc_id", "words", "toxic"]).filter(mask)

    rows = training_rows(docs, labels, keep, sample).mapInArrow(run, "doc_id long, words binary, toxic int").toPandas()
    rows["at"] = [zlib.crc32(b"order %d" % d) for d in rows["doc_id"]]
    rows = rows.sort_values(["at", "doc_id", "words"], kind="stable")
    y = rows["toxic"].to_numpy(dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    vocabulary = Vocabulary()
    texts = [vocabulary.encode(w.split()) for w in rows["words"]]
    del rows
    return fit(texts, vocabulary.table(), np.array(vocabulary.votes, dtype=np.int8), y)


class Scorer:
    """A worker's vocabulary and table for a model; both start anew when the vocabulary has grown large."""

    LARGEST = 60_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.vocabulary = Vocabulary()
        self.table = np.zeros((0, sum(WIDTHS) * FILTERS), dtype=np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.vocabulary) > self.LARGEST:
            self.clear()
        numbers = [self.vocabulary.encode(words_of(t or "")) for t in texts]
        new = self.vocabulary.table(len(self.table))
        if len(new):
            self.table = np.concatenate([self.table, self.model.projected(new)])
        z = logits_of(numbers, self.model, self.table, np.array(self.vocabulary.votes, dtype=np.int8))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score (0 to 1) of each row, from its whole text."""
    if isinstance(model, float):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(model).alias("score"))
    known, name = sent(docs.sparkSession, "toxicity", model), uuid.uuid4().hex  # a fixed size: 2**BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker("toxicity", name, lambda: Scorer(known()))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scorer.scores(some.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, keep: F.Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and predicted (1 if the score is at least 0.5) of each row; ``keep`` picks training rows by _doc."""
    found = score(docs, trained(docs, labels, keep, sample))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    found = toxicity(docs, labels, crc32_mod(F.col("_doc"), 5) != 0)
    return found.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
