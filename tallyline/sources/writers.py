"""Record sinks: printed lines, files whose name is an expression, typed formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import number_text


def printed(rows: DataFrame, *values: str | Column, ofs: str = " ", fmt: str | None = None) -> DataFrame:
    """``line``: the values as texts, joined. Numbers print plainly; null prints as nothing."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    kinds = dict(rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).dtypes)

    def text(i: int, c: Column) -> Column:
        if kinds[f"c{i}"] in ("double", "float"):
            return F.format_string(fmt, c) if fmt else number_text(c)
        return c.cast("string")

    return rows.select(F.concat_ws(ofs, *[F.coalesce(text(i, c), F.lit("")) for i, c in enumerate(columns)]).alias("line"))


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    lines.select("line").write.mode("append" if append else "overwrite").text(path)


def write_by(lines: DataFrame, target: Column, path: str, append: bool = False) -> None:
    """A folder ``target=...`` for each value of an expression."""
    lines.withColumn("target", target).select("line", "target").write.mode("append" if append else "overwrite").partitionBy("target").text(path)


def write_delimited(rows: DataFrame, path: str, separator: str = ",", header: bool = True, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("sep", separator).option("header", header).option("quote", '"').option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_parquet(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").parquet(path)


def print_array(array: Column) -> Column:
    """The values of a sequence, a line each."""
    return F.array_join(array.cast("array<string>"), "\n")
