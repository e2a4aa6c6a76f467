"""JSON paths: .key, [n] from 0, [] for all elements; a key on an array goes to each element."""

from __future__ import annotations

import json as _json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"\.?([A-Za-z_][\w-]*)|\[(\d*)\]|\[\"([^\"]*)\"\]")


def steps(path: str) -> list[str | int | None]:
    """Keys, indexes, and None for all elements."""
    out: list[str | int | None] = []
    for m in STEP.finditer(path):
        out.append(m[1] if m[1] is not None else m[3] if m[3] is not None else int(m[2]) if m[2] else None)
    return out


def spark_path(path: str) -> str:
    return "$" + "".join("[*]" if s is None else f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps(path))


def navigate(value: Any, todo: list[str | int | None]) -> list[Any]:
    """All values at the path, in order (for rows that are already Python values)."""
    if not todo:
        return [value]
    step, rest = todo[0], todo[1:]
    if step is None:
        return [x for v in (value if isinstance(value, list) else []) for x in navigate(v, rest)]
    if isinstance(step, int):
        return navigate(value[step], rest) if isinstance(value, list) and step < len(value) else []
    if isinstance(value, list):
        return [x for v in value for x in navigate(v, todo)]
    return navigate(value[step], rest) if isinstance(value, dict) and step in value else []


def text_of(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (dict, list)):
        return _json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def jpath(document: Column, path: str) -> Column:
    """The value at a path as text: true 1, false 0, null and no value empty; several joined by line ends."""
    todo = steps(path)
    found = F.get_json_object(document, spark_path(path) if todo else "$")
    if None in todo:
        wrapped = F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]")))
        return F.coalesce(F.array_join(F.transform(F.from_json(wrapped, "array<string>"), _plain), "\n"), F.lit(""))
    return F.coalesce(_plain(found), F.lit(""))


def _plain(x: Column) -> Column:
    return F.when(x == "true", "1").when(x == "false", "0").otherwise(x)


def elements(document: Column, path: str) -> Column:
    """The array at a path, each element as text."""
    return F.coalesce(F.from_json(F.get_json_object(document, spark_path(path)), "array<string>"), F.array().cast("array<string>"))


def members(document: Column) -> Column:
    """The keys of an object, in order."""
    return F.json_object_keys(document)
