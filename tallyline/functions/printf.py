"""printf formats: a constant one is compiled to Columns, so rows never leave the JVM; %e, %g and widths that are
arguments run in pandas batches."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import once, to_number

SPEC = re.compile(r"%(?P<flags>[-+ 0#]*)(?P<width>\*|\d+)?(?:\.(?P<precision>\*|\d*))?(?P<kind>[diouxXeEfFgGsc%])")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "/": "/", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), text)


@dataclass
class Piece:
    text: str = ""
    flags: str = ""
    width: int | str | None = None
    precision: int | str | None = None
    kind: str = ""


def parse(fmt: str) -> list[Piece]:
    """Literal pieces (kind "") and conversions in order; unknown conversions stay literal."""
    out, at = [], 0
    for m in SPEC.finditer(fmt):
        if m.start() > at:
            out.append(Piece(fmt[at : m.start()]))
        at = m.end()
        if m["kind"] == "%":
            out.append(Piece("%"))
            continue
        number = lambda x: x if x == "*" else None if x is None else int(x or 0)
        out.append(Piece("", m["flags"], number(m["width"]), number(m["precision"]), m["kind"]))
    if at < len(fmt):
        out.append(Piece(fmt[at:]))
    return out


def general(number: float, precision: int | None, alternate: bool = False, upper: bool = False) -> str:
    return f"%{'#' if alternate else ''}.{6 if precision is None else precision}{'G' if upper else 'g'}" % number


def sprintf(fmt: str, values: list[Any], number=float, text=str) -> str:  # noqa: ANN001
    """C's conversions for Python values; missing ones are empty or 0. ``number`` and ``text`` coerce a value."""
    values, out, k = list(values), [], 0

    def take() -> Any:
        nonlocal k
        k += 1
        return values[k - 1] if k <= len(values) else ""

    def whole_or_zero() -> int:
        n = number(take())
        return int(n) if math.isfinite(n) else 0

    for p in parse(fmt):
        if not p.kind:
            out.append(p.text)
            continue
        width = whole_or_zero() if p.width == "*" else p.width
        precision = whole_or_zero() if p.precision == "*" else p.precision
        flags, value = p.flags, take()
        if width is not None and width < 0:
            flags, width = flags + "-", -width
        spec = f"%{flags}{'' if width is None else width}{'' if precision is None or precision < 0 else f'.{precision}'}"
        if p.kind == "s":
            out.append(f"{spec.replace('0', '', 1) if flags.startswith('0') else spec}s" % text(value))
        elif p.kind == "c":
            n = value if isinstance(value, (int, float)) else None
            shown = chr(int(n)) if n else text(value)[:1]
            out.append(f"%{'-' if '-' in flags else ''}{'' if width is None else width}s" % shown)
        else:
            n = number(value)
            if n != n or n in (float("inf"), float("-inf")):
                out.append(f"%{'-' if '-' in flags else ''}{'' if width is None else width}s" % ("nan" if n != n else "inf" if n > 0 else "-inf"))
            elif p.kind in "diouxX":
                whole = int(n)
                if p.kind in "ouxX" and whole < 0:
                    whole += 1 << 64
                out.append(f"{spec}{'d' if p.kind in 'diu' else p.kind}" % whole)
            else:
                out.append(f"{spec}{p.kind}" % n)
    return "".join(out)


def fixed(x: Column, precision: int) -> Column:
    """|x| with ``precision`` decimals, rounded by its exact binary value (ties to even), as C does.

    The fraction is split at 26 bits, so that both parts times 10**precision are exact; the formatter of the JVM rounds
    the shortest decimal text instead, which differs for values such as 1382.85.
    """
    x, power = F.abs(x), float(10**precision)
    fraction = x - F.floor(x)
    high = F.floor(fraction * float(1 << 26)) / float(1 << 26)
    low = (fraction - high) * power
    whole = F.floor(high * power)
    over = high * power - whole - 0.5  # exact; the rest beyond it is low
    up = F.when(over > -low, 1).when(over == -low, (F.floor(x) if precision == 0 else whole) % 2).otherwise(0)
    digits = whole + up
    body = (F.floor(x) + F.when(digits >= int(power), 1).otherwise(0)).cast("string")
    if precision:
        body = F.concat(body, F.lit("."), F.lpad((digits % int(power)).cast("string"), precision, "0"))
    return F.when(x >= float(1 << 53), F.format_string(f"%.{precision}f", x)).otherwise(body)


def _decimal(x: Column, flags: str, width: int, precision: int) -> Column:
    return once(x, lambda v: _decimal_of(v, flags, width, precision))


def _decimal_of(x: Column, flags: str, width: int, precision: int) -> Column:
    if precision > 8:
        body = F.format_string(f"%.{precision}f", F.abs(x))
    else:
        body = fixed(F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x), precision)
    # the text of a zero shows its sign, which no comparison does
    negative = F.when(x == 0, x.cast("string").startswith("-")).otherwise(x < 0)
    sign = F.when(negative, "-").otherwise("+" if "+" in flags else " " if " " in flags else "")
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    padded = F.concat(sign, body)
    if width and "-" not in flags and "0" in flags:
        zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(padded), F.lit(0)))
        return F.when(odd.isNull(), F.concat(sign, zeros, body)).otherwise(F.lpad(odd, width, " "))
    text = F.coalesce(odd, padded)
    spaces = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(text, spaces) if "-" in flags else F.concat(spaces, text)


def format_columns(fmt: str, *args: Column, text: tuple[bool, ...] | None = None) -> Column:
    """A constant format as one Column. ``text`` tells which arguments are texts (numbers are coerced from them)."""
    pieces, rest, out = parse(unescape(fmt)), list(args), []
    is_text = list(text or [False] * len(args))
    if any(p.width == "*" or p.precision == "*" or p.kind in ("e", "E", "g", "G") for p in pieces):
        return format_rows(fmt, *args)
    for p in pieces:
        if not p.kind:
            out.append(F.lit(p.text))
            continue
        value, textual = (rest.pop(0), is_text.pop(0)) if rest else (F.lit(""), True)
        number = to_number(value) if textual else value.cast("double")
        width = "" if p.width is None else str(p.width)
        if p.kind in ("s", "c"):
            s = F.left(value.cast("string"), F.lit(p.precision if p.kind == "s" else 1)) if p.kind == "c" or p.precision is not None else value.cast("string")
            s = F.coalesce(s, F.lit(""))
            w = int(width or 0)
            pad = F.rpad(s, w, " ") if "-" in p.flags else F.lpad(s, w, " ")
            out.append(F.when(F.length(s) >= w, s).otherwise(pad) if w else s)
        elif p.kind in "diu":
            digits = F.format_string(f"%{p.flags}{width}d", number.cast("bigint"))
            out.append(digits)
        elif p.kind in "oxX":
            out.append(F.format_string(f"%{p.flags.replace('+', '').replace(' ', '')}{width}{p.kind}", number.cast("bigint")))
        else:
            out.append(_decimal(number, p.flags, int(width or 0), 6 if p.precision is None else p.precision))
    return F.concat(*out) if out else F.lit("")


def format_rows(fmt: str, *args: Column) -> Column:
    """Any format, in pandas batches: for %e, %g and widths that are arguments."""
    plain = unescape(fmt)

    @F.pandas_udf("string")
    def run(*columns):  # noqa: ANN002, ANN202
        import pandas as pd

        def number(v: Any) -> float:
            try:
                return float(v)
            except (TypeError, ValueError):
                return 0.0

        return pd.Series([sprintf(plain, list(row), number) for row in zip(*columns, strict=True)])

    return run(*args) if args else F.lit(sprintf(plain, []))
