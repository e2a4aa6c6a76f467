"""Values of sequential programs: floats and texts, None for a variable never set, NOTHING for a failed ``expr?``."""

from __future__ import annotations

import math
import re
from typing import Any

_NUMERIC = re.compile(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity|nan)", re.IGNORECASE)
_PREFIX = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)")


class _Nothing:
    def __repr__(self) -> str:
        return "NOTHING"


NOTHING = _Nothing()


def looks_numeric(v: Any) -> bool:
    return not isinstance(v, str) and v is not NOTHING or (isinstance(v, str) and bool(_NUMERIC.fullmatch(v.strip())))


def number(v: Any) -> float:
    if isinstance(v, float):
        return v
    if not isinstance(v, str):
        return 0.0
    t = v.strip()
    if _NUMERIC.fullmatch(t):
        return float(t)
    m = _PREFIX.match(t)
    return float(m[0]) if m else 0.0


def number_text(n: float, fmt: str | None = None) -> str:
    if math.isnan(n):
        return "nan"
    if math.isinf(n):
        return "inf" if n > 0 else "-inf"
    if n == int(n) and abs(n) < 9.2e18:
        return str(int(n))
    if fmt and fmt != "%.6g":
        return fmt % n
    return ("%.6f" % n).rstrip("0").rstrip(".")


def text(v: Any, fmt: str | None = None) -> str:
    if isinstance(v, str):
        return v
    return number_text(v, fmt) if isinstance(v, float) else ""


def truthy(v: Any) -> bool:
    if isinstance(v, float):
        return v != 0
    return isinstance(v, str) and v not in ("", "0")


def compare(op: str, a: Any, b: Any) -> bool:
    if looks_numeric(a) and looks_numeric(b):
        x, y = number(a), number(b)
    else:
        x, y = text(a).encode(), text(b).encode()
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op]


def arithmetic(op: str, a: float, b: float) -> float:
    try:
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            return a / b if b else 0.0
        if op == "%":
            return math.fmod(a, b) if b else 0.0
        out = a**b
        return float(out) if isinstance(out, (int, float)) else math.nan
    except OverflowError:
        return math.inf
    except ValueError:
        return math.nan


def smart_key(key: str) -> tuple[bool, float, str]:
    """Numbers first, in order, then texts."""
    numeric = looks_numeric(key)
    return (not numeric, number(key) if numeric else 0.0, key)


def regex(pattern: str) -> re.Pattern[str]:
    """Java and POSIX classes that Python lacks are spelled out."""
    pattern = re.sub(r"\[:(\w+):\]", lambda m: {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "blank": r" \t", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f"}.get(m[1], m[0]), pattern)
    return re.compile(pattern)
