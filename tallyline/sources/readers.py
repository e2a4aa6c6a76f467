"""Record sources: lines, separators, CSV, TSV, JSON Lines and Parquet, each with record numbers on request.

Every reader returns a DataFrame. Text readers give ``value``; structured ones give named columns. ``numbered`` adds
``filename``, ``fnr`` and ``nr``: the place of a record in its file and over all files in argument order. Data records
count from 1; a header isn't a record.
"""

from __future__ import annotations

import io
import itertools
import lzma
import re
import tarfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import java_regex, quote

FORMATS = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".pq": "parquet"}
#: Codecs that Spark's text readers decode by extension, and those decoded in Python workers.
NATIVE_CODECS = (".gz", ".bz2", ".zst", ".zstd")
PYTHON_CODECS = (".xz", ".lzma", ".tgz", ".lz4")


def format_of(path: str) -> str:
    """The format by extension, under a compression suffix; text by default."""
    name = path.lower()
    for codec in NATIVE_CODECS + PYTHON_CODECS:
        name = name.removesuffix(codec)
    dot = name.rfind(".")
    return FORMATS.get(name[dot:], "text") if dot >= 0 else "text"


def _needs_python(paths: list[str]) -> bool:
    return any(p.lower().endswith(PYTHON_CODECS) for p in paths)


def _decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """value: the lines of files whose codec Spark lacks, decoded in Python workers (one task a file).

    The compressed file is one value, 2 GB at most; it is decoded as a stream, some lines at a time.
    """

    def opened(name: str, content: bytes) -> Iterator[IO[bytes]]:
        if name.endswith((".xz", ".lzma")):
            yield lzma.open(io.BytesIO(content))
        elif name.endswith(".tgz"):
            with tarfile.open(fileobj=io.BytesIO(content), mode="r|gz") as tar:
                yield from (tar.extractfile(m) for m in tar if m.isfile())
        elif name.endswith(".lz4"):
            yield io.BufferedReader(pa.input_stream(pa.BufferReader(content), compression="lz4"))
        else:
            yield io.BytesIO(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for file in opened(path.lower(), content):
                    while some := list(itertools.islice(file, 10_000)):
                        texts = [x.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for x in some]
                        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "value string")


def lines(spark: SparkSession, paths: str | list[str], separator: str = "\n", regex: bool = False) -> DataFrame:
    """One record a line, without its line end; other separators are texts or regular expressions.

    A regular expression may match across lines, so it is split within whole files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if _needs_python(paths):
        return _decoded(spark, paths)
    if regex or len(separator) > 1:
        whole = spark.read.text(paths, wholetext=True)
        body = F.regexp_replace("value", r"\n\z", "")
        parts = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, java_regex(separator) if regex else quote(separator), -1))
        return whole.select(F.explode(parts).alias("value"))
    if separator == "\n":
        return spark.read.text(paths)
    return spark.read.text(paths, lineSep=separator).filter("value != '\n'")


def delimited(spark: SparkSession, paths: str | list[str], separator: str = ",", header: bool = False, schema: str | None = None) -> DataFrame:
    """RFC 4180 fields: quotes, doubled quotes, line ends within quotes. Empty fields are empty texts."""
    reader = spark.read.option("sep", separator).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "\x00").option("emptyValue", "").option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).csv(paths)
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) if k == "string" else F.col(f"`{n}`") for n, k in df.dtypes])


def csv(spark: SparkSession, paths: str | list[str], header: bool = True, schema: str | None = None) -> DataFrame:
    return delimited(spark, paths, ",", header, schema)


def tsv(spark: SparkSession, paths: str | list[str], header: bool = True, schema: str | None = None) -> DataFrame:
    return delimited(spark, paths, "\t", header, schema)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """By name; without a schema one pass infers it."""
    return (spark.read.schema(schema) if schema else spark.read).json(paths)


def json_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """By place: value (the line) and fields (top-level values in order, nested ones as JSON text)."""
    text = spark.read.text(paths)
    keys = F.json_object_keys("value")
    field = lambda k: F.coalesce(F.call_function("get_json_object", F.col("value"), F.concat(F.lit("$['"), k, F.lit("']"))), F.lit(""))
    return text.withColumn("fields", F.when(keys.isNull(), F.array("value")).otherwise(F.transform(keys, field)))


def parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def read(spark: SparkSession, paths: str | list[str], mode: str | None = None, header: bool = True) -> DataFrame:
    """By mode, or by the first path's extension."""
    first = paths if isinstance(paths, str) else paths[0]
    mode = mode or format_of(first)
    return {"text": lambda: lines(spark, paths), "csv": lambda: csv(spark, paths, header), "tsv": lambda: tsv(spark, paths, header), "json": lambda: json_lines(spark, paths), "parquet": lambda: parquet(spark, paths)}[mode]()


def numbered(spark: SparkSession, paths: str | list[str], mode: str | None = None, header: bool = True, separator: str = "\n", regex: bool = False) -> DataFrame:
    """Records with filename, fnr and nr, files in argument order.

    Records of a file are numbered by partition and place: monotonically increasing ids follow file splits, and the
    counts of earlier partitions are added from a table with one row a partition.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for k, path in enumerate(paths):
        rows = lines(spark, path, separator, regex) if separator != "\n" or regex else read(spark, path, mode, header)
        rows = rows.withColumn("_file", F.lit(k)).withColumn("filename", F.lit(path)).withColumn("_id", F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    part = F.shiftright("_id", 33)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    counts = out.groupBy("_file", part.alias("_part")).agg(F.count("*").alias("_n"))
    in_file = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("_file", "_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("_file", "_part", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_f"), F.coalesce(F.sum("_n").over(overall), F.lit(0)).alias("_a"))
    joined = out.withColumn("_part", part).join(F.broadcast(carry), ["_file", "_part"])
    return joined.withColumn("fnr", place + F.col("_f")).withColumn("nr", place + F.col("_a")).drop("_file", "_part", "_id", "_f", "_a")


def split_fields(rows: DataFrame, separator: str | None = None, regex: bool = False, most: int | None = None) -> DataFrame:
    """With ``fields``: by white space, a text or a regular expression; ``most`` splits no further than needed."""
    from ..functions.strings import split

    if most and separator and not regex and separator != " ":
        return rows.withColumn("fields", F.split("value", quote(separator), most + 1))
    return rows.withColumn("fields", split(F.col("value"), separator, regex))


def whole(spark: SparkSession, path: str) -> DataFrame:
    """One row: the file's text."""
    return spark.read.text(path, wholetext=True)


def sequence(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Whole numbers from first to last, up or down."""
    step = 1 if last >= first else -1
    return spark.range(first, last + step, step).withColumnRenamed("id", "value")


def environment(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The driver's environment as rows."""
    import os

    kept = {k: v for k, v in os.environ.items() if names is None or k in names}
    return spark.createDataFrame(sorted(kept.items()), "name string, value string")


def stdin(spark: SparkSession, text: str) -> DataFrame:
    """Lines that the driver has read."""
    rows = text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    return spark.createDataFrame([(r.removesuffix("\r"),) for r in rows], "value string")


def valid_regex(pattern: str) -> str:
    re.compile(pattern)
    return pattern
