"""Running programs: parse, classify, lower, or fall back to the sequential machine in one task."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from . import lower
from .accumulate import accumulated
from .columns import Unlowered
from .syntax import Node, Tree, parse

log = logging.getLogger(__name__)


@dataclass
class Result:
    """``how`` the program ran, and its output: nr, place and line (and n, s where keys are ordered)."""

    how: str
    output: DataFrame
    falling: bool = False
    multiline: bool = False  # whether a print may hold line ends of its own

    @property
    def lines(self) -> DataFrame:
        """Output lines in no particular order."""
        return self.output.select(F.explode(F.split("line", "\n")).alias("line")) if self.multiline else self.output.select("line")

    def ordered(self) -> DataFrame:
        """Output lines in the order that the program prints them."""
        extra = [F.col("n"), F.col("s").desc() if self.falling else F.col("s")] if "n" in self.output.columns else []
        if not self.multiline:
            return self.output.orderBy("nr", *extra, "place").select("line")
        parts = self.output.select("*", F.posexplode(F.split("line", "\n")).alias("_at", "_part"))
        return parts.orderBy("nr", *extra, "place", "_at").select(F.col("_part").alias("line"))

    def collect(self) -> list[str]:
        return [r["line"] for r in self.ordered().collect()]


@dataclass
class Program:
    """A program and its options, as on a command line."""

    source: str
    fs: str = " "
    ofs: str = " "
    mode: str | None = None
    header: bool = False
    variables: dict[str, str] = field(default_factory=dict)
    commands: bool = False

    @property
    def tree(self) -> Tree:
        return parse(self.source)

    def input(self, spark: SparkSession, paths: list[str]) -> lower.Source:
        mode = self.mode or (readers.format_of(paths[0]) if paths and self.fs == " " else "text")
        separator, regex = "\n", False
        for n in self.tree.begin:
            e = n.args[0] if n.kind == "expr" else None
            if e is not None and e.kind == "assign" and e.args[1] == Node("var", ("RS",)) and e.args[2].kind == "str":
                separator = e.args[2].args[0]
                regex = len(separator) > 1
        named = mode == "parquet" or self.header
        if named:
            read = lambda p: readers.read(spark, p, mode, True)
        elif mode in ("csv", "tsv"):
            read = lambda p: fields_row(readers.delimited(spark, p, "," if mode == "csv" else "\t"), "," if mode == "csv" else "\t")
        elif mode == "json":
            read = lambda p: readers.json_records(spark, p)
        else:
            read = lambda p: readers.lines(spark, p, separator, regex)
        rows = listed([(p, read(p)) for p in paths])
        rows = numbered(rows) if reads_numbers(self.tree) else rows.withColumn("nr", F.col("_id")).withColumn("fnr", F.lit(None).cast("long")).drop("_id")
        columns = {n: k for n, k in rows.dtypes if n not in ("nr", "fnr", "file", "filename")} if named else {}
        number = None if reads_numbers(self.tree) else lambda df: numbered(df.withColumn("_id", F.col("nr")))
        return lower.Source(rows, columns, self.fs, self.ofs, dict(self.variables), number)

    def on(self, spark: SparkSession, rows: DataFrame, order: str) -> Result:
        """Runs over a table with named columns; ``order`` is a unique number that orders it."""
        columns = {n: k for n, k in rows.dtypes if n != "nr"}
        tree = self.tree
        uses_nr = any(n.kind == "var" and n.args[0] in ("NR", "FNR") for n in tree.nodes())
        if uses_nr:
            from ..operators.ordered import Ordered

            rows = Ordered(rows, order).numbered()
        else:
            rows = rows.withColumn("nr", F.col(order))
        rows = rows.withColumn("fnr", F.col("nr")).withColumn("file", F.lit(0)).withColumn("filename", F.lit(""))
        return self._run(spark, tree, lower.Source(rows, columns, self.fs, self.ofs, dict(self.variables)), 1)

    def run(self, spark: SparkSession, paths: str | list[str] = ()) -> Result:
        paths = [paths] if isinstance(paths, str) else list(paths)
        tree = self.tree
        if not paths or not (tree.rules or tree.end or tree.begin_file or tree.end_file):
            return self._machine(spark, tree, None)
        return self._run(spark, tree, self.input(spark, paths), len(paths))

    def _run(self, spark: SparkSession, tree: Tree, source: lower.Source, paths: int) -> Result:
        names = list(source.columns)
        if not names and "fields" in source.rows.columns:
            return self._machine(spark, tree, source)
        ways = {
            "stateless": lambda s: lower.stateless(tree, s),
            "distinct": lambda s: lower.distinct(tree, s),
            "lookup": lambda s: lower.lookup(tree, s, paths),
            "field lookup": lambda s: lower.field_lookup(tree, s, paths),
            "by number": lambda s: lower.by_number(tree, s),
            "running count": lambda s: lower.running_count(tree, s),
            "range": lambda s: lower.ranges(tree, s),
            "last": lambda s: lower.last_records(tree, s),
            "accumulate": lambda s: accumulated(tree, s, spark),
            "ordered": lambda s: lower.ordered(tree, s),
        }
        multiline = any(n.kind == "str" and "\n" in n.args[0] for n in tree.nodes())
        for how, way in ways.items():
            copy = replace(source)
            try:
                out = way(copy)
            except Unlowered as why:
                log.debug("not %s: %s", how, why)
                continue
            if isinstance(out, tuple):
                falling = len(tree.end) == 1 and tree.end[0].kind == "forin" and tree.end[0].args[2] == "rsort"
                return Result(out[0], out[1], falling, multiline)
            return Result(how, out, False, multiline)
        return self._machine(spark, tree, source)

    def _machine(self, spark: SparkSession, tree: Tree, source: lower.Source | None) -> Result:
        """One task over all records in order: correct for any program, and no faster than one core."""
        from .machine import Machine

        log.warning("the program runs on the sequential machine, in one task")
        names = list(source.columns) if source else []
        options = {"variables": dict(self.variables), "fs": self.fs, "ofs": self.ofs, "columns": names, "commands": self.commands}
        if source is None:
            rows = spark.createDataFrame([], "nr long, filename string, value string, fields array<string>")
        else:
            texts = [lower.field_text(n, k) for n, k in source.columns.items()]
            fields = F.array(*texts) if names else F.col("fields") if "fields" in source.rows.columns else F.lit(None).cast("array<string>")
            value = F.concat_ws(self.ofs, *texts) if names else F.col("value")
            rows = source.rows.select("nr", "filename", value.alias("value"), fields.alias("fields"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Machine(tree, **options)

            def records() -> Iterator[tuple[str, str, list[str] | None]]:
                for batch in batches:
                    yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)

            out = m.run(records())
            lines = "".join(s for target, s in out if target is None).split("\n")
            if lines and lines[-1] == "":
                lines.pop()
            for at in range(0, len(lines), 10_000):
                some = lines[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array([0] * len(some), pa.int32()), pa.array(some, pa.string())], ["nr", "place", "line"])

        schema = "nr long, place int, line string"
        if source is None:
            # without input there is nothing to distribute
            (batch, *_) = [*run(iter(())), None]
            made = [] if batch is None else list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            return Result("machine", spark.createDataFrame(made, schema))
        return Result("machine", rows.repartition(1).sortWithinPartitions("nr").mapInArrow(run, schema))


def fields_row(rows: DataFrame, separator: str) -> DataFrame:
    """Delimited records as value (the fields joined) and fields."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(F.concat_ws(separator, *names).alias("value"), F.array(*names).alias("fields"))


def reads_numbers(tree: Tree) -> bool:
    """Whether rules read NR or FNR; the comparison that marks the first file, and END, need no record numbers."""
    for k, r in enumerate(tree.rules):
        patterns = [] if k == 0 and r.kind == "when" and lower.first_file(r) else r.patterns
        if any(n.kind == "var" and n.args[0] in ("NR", "FNR") for p in (*patterns, *(r.body or ())) for n in p.walk()):
            return True
    nodes = [n for _, body in tree.functions.values() for b in body for n in b.walk()] + [n for b in (*tree.begin_file, *tree.end_file) for n in b.walk()]
    return any(n.kind == "var" and n.args[0] in ("NR", "FNR") for n in nodes) or any(n.kind == "call" and n.args[0] in ("collect", "acc", "accumulate") for r in tree.rules for b in r.body or () for n in b.walk())


def listed(files: list[tuple[str, DataFrame]]) -> DataFrame:
    """Records with file, filename and _id, which rises with the records of all files in order."""
    out = None
    for k, (path, rows) in enumerate(files):
        rows = rows.withColumn("file", F.lit(k)).withColumn("filename", F.lit(path))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("_id", F.monotonically_increasing_id())


def numbered(rows: DataFrame) -> DataFrame:
    """With nr and fnr from 1: places within partitions plus what earlier partitions hold, one row a partition."""
    from pyspark.sql import Window

    own = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    per = own.groupBy("file", "_part").agg(F.count("*").alias("_n"))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier("file")), F.lit(0)).alias("_f"), F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_a"))
    # as many rows as the input has partitions
    return own.join(F.broadcast(carry), F.col("_part") == F.col("_p")).withColumn("fnr", F.col("_place") + F.col("_f")).withColumn("nr", F.col("_place") + F.col("_a")).drop("_id", "_part", "_p", "_place", "_f", "_a")


def run(spark: SparkSession, program: str, paths: str | list[str] = (), **options) -> Result:  # noqa: ANN003
    return Program(program, **options).run(spark, paths)


def _by_value() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules["tallyline"])


_by_value()
