"""Dates in UTC: strftime formats compiled to Columns, calendar fields to epoch seconds and back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strptime specifiers as Java date patterns.
PARSED = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "I": "hh", "p": "a", "Z": "zzz", "z": "Z"}


def timestamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _specifier(ts: Column, kind: str) -> Column:
    pattern = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "A": "EEEE", "a": "E", "B": "MMMM", "b": "MMM", "y": "yy", "I": "hh", "p": "a"}
    if kind in pattern:
        return F.date_format(ts, pattern[kind])
    made = {
        "s": lambda: F.unix_timestamp(ts).cast("string"),
        "j": lambda: F.lpad(F.dayofyear(ts).cast("string"), 3, "0"),
        "u": lambda: (F.weekday(ts) + 1).cast("string"),
        "w": lambda: (F.dayofweek(ts) - 1).cast("string"),
        "e": lambda: F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
        "C": lambda: F.lpad(F.floor(F.year(ts) / 100).cast("string"), 2, "0"),
        "Z": lambda: F.lit("UTC"),
        "z": lambda: F.lit("+0000"),
        "n": lambda: F.lit("\n"),
        "t": lambda: F.lit("\t"),
        "F": lambda: F.date_format(ts, "yyyy-MM-dd"),
        "T": lambda: F.date_format(ts, "HH:mm:ss"),
        "%": lambda: F.lit("%"),
    }
    return made[kind]() if kind in made else F.lit(f"%{kind}")


def strftime(fmt: str, ts: Column) -> Column:
    """``ts`` (timestamp) by specifiers; unknown ones stay."""
    parts = re.split(r"(%.)", fmt)
    return F.concat(*[_specifier(ts, p[1]) if re.fullmatch("%.", p) else F.lit(p) for p in parts if p]) if fmt else F.lit("")


def mktime(text: Column) -> Column:
    """Epoch seconds of "Y M D h m s"; months, days and times roll over; -1 unless there are six numbers."""
    n = [F.get(F.split(F.trim(text), r"\s+"), F.lit(i)).try_cast("bigint") for i in range(6)]
    months = n[0] * 12 + n[1] - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1))
    seconds = (F.unix_date(first).cast("bigint") + n[2] - 1) * 86400 + n[3] * 3600 + n[4] * 60 + n[5]
    return F.coalesce(seconds, F.lit(-1).cast("bigint"))


def parsedate(text: Column, fmt: str) -> Column:
    """Epoch seconds of a text in a strptime format, null if it doesn't fit."""
    java = re.sub(r"%(.)|([A-Za-z]+)", lambda m: PARSED.get(m[1], m[1]) if m[1] else f"'{m[2]}'", fmt)
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(java)))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)
