"""The corpus pipeline: toxic texts out, near-duplicates out, benchmark leaks out, surrogates in, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Every
stage works on all rows that its predecessor kept.

Decisions are made for rows, not for ids: a row is known by a 64-bit hash of its doc_id and text, so two texts that
share an id, or lack one, are judged each by itself, and repeated rows alike. In all stages null and empty texts are
texts without words, very long texts are read whole, an empty table gives an empty result, and columns beside doc_id
and text pass through whatever their names (n_chars, where there is one, follows a changed text).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, packing, pii, simhash, toxicity
from tallyline.llm.common import read_table, tidy, written

#: The setting that holds the key of surrogates; without it a key that protects nothing, for tests.
KEY, TEST_KEY = "spark.tallyline.pii.key", "a key for tests, which protects nothing"
#: The setting of rows that go to a Python worker at a time, and what stages hold it at: with whole texts, Spark's own
#: 10,000 rows fill buffers of an executor and of its workers that neither gives back.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "500"


def _row() -> Column:
    """The hash that a row is known by."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull())


def _known(docs: DataFrame) -> DataFrame:
    """What the operators get: doc_id (the row's hash) and text."""
    return docs.select(_row().alias("doc_id"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash is none of ``rejected`` (doc_id)."""
    name = f"_rejected_{uuid.uuid4().hex}"  # no column of docs
    return docs.join(rejected.select(F.col("doc_id").alias(name)).distinct(), _row() == F.col(name), "left_anti")


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, whose written tables are made in batches of ``ROWS``; the session's setting holds again afterwards.

    The driver is tidied before and after, so that stages don't add up in its memory.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = spark.conf.get(BATCH)
        tidy(spark)
        spark.conf.set(BATCH, ROWS)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(BATCH, before)
            tidy(spark)

    return run


@_in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5 go; ties there are toxic.

    The classifier learns from labelled rows of ``docs``; rows without a label or a doc_id are scored like all others. A
    null or empty text gets the score of no words.
    """
    found = toxicity.score(_known(docs), toxicity.trained(docs, read_table(spark, sf_dir, "labels"), F.lit(True)))
    return _without(docs, written(found.filter("score >= 0.5"), "toxic"))


@_in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word shingles alike by 0.8 or more one document stays.

    SimHash fingerprints that link give the first texts to compare; links that they miss are found by shingles.
    It is that of the smallest doc_id, rows without one last; ties (texts that share the id) go by the row's hash. Null
    and empty texts are one group. Of repeated rows the smallest by the other columns stays.
    """
    found = written(simhash.similar_documents(_known(docs)), "components").distinct()
    ids = docs.select(_row().alias("_row"), F.col("doc_id").alias("_doc")).distinct()
    told = found.join(ids, F.col("doc_id") == F.col("_row"))
    first = told.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_row")).alias("first"))
    kept = written(first.select(F.col("first._row").alias("doc_id")), "kept")
    name = f"_kept_{uuid.uuid4().hex}"
    rows = docs.join(kept.select(F.col("doc_id").alias(name)), _row() == F.col(name), "left_semi")
    if kept.count() == rows.count():
        return rows
    one = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return rows.groupBy(_row().alias(name)).agg(F.min(one).alias(f"{name}_row")).select(f"{name}_row.*")


@_in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go; items without words or without an id take no part, and an
    empty benchmark removes nothing. There are no ties: a document has such a window or not."""
    found = decontaminate.decontaminate(_known(docs), read_table(spark, sf_dir, "benchmark"))
    return _without(docs, written(found.filter("n_hit > 0"), "contaminated"))


@_in_small_batches
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates replace personal data in every text; all rows stay, repeated ones alike.

    Ties between values that want one surrogate are settled by their order. A null text stays null.
    """
    kinds = f"_kinds_{uuid.uuid4().hex}"
    done = pii.rewritten(docs, key=spark.conf.get(KEY, TEST_KEY), kinds=kinds)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(kinds) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the remaining documents in sequences of 1024 tokens; repeated rows are packed each by itself, and
    pieces of one length go by doc_id, piece and ids. A null or empty text is a piece of one id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's result is a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and a tokeniser are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
