"""The functions that programs call: pure ones by value, stateful ones on a machine's arrays, fields and streams."""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from typing import TYPE_CHECKING, Any

from ..functions import jsons
from ..functions.printf import general  # noqa: F401
from ..functions.strings import EMOJI
from .syntax import Node, ProgramError
from .values import NOTHING, looks_numeric, number, regex, smart_key, text, truthy

if TYPE_CHECKING:
    from .machine import Machine

Expr = Callable[[], Any]

# --- pure -----------------------------------------------------------------------------------------------------------


def _substr(s: Any, start: Any, n: Any = None) -> str:
    t, first = text(s), max(int(number(start)), 1)
    return t[first - 1 :] if n is None else t[first - 1 : first - 1 + max(0, int(number(n)))]


def _pad(left: bool) -> Callable[..., str]:
    def run(s: Any, width: Any, fill: Any = " ") -> str:
        t, c = text(s), (text(fill) or " ")[0]
        return t.rjust(int(number(width)), c) if left else t.ljust(int(number(width)), c)

    return run


def _emoji(name: Any) -> str:
    t = text(name).lower()
    code = EMOJI.get(t) or EMOJI.get(t.removesuffix("s"))
    return chr(code) if code else text(name)


def _safe(f: Callable[..., float]) -> Callable[..., float]:
    def run(*args: Any) -> float:
        try:
            return float(f(*[number(a) for a in args]))
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf

    return run


def _log(f: Callable[[float], float]) -> Callable[..., float]:
    def run(x: Any) -> float:
        n = number(x)
        return f(n) if n > 0 else -math.inf if n == 0 else math.nan

    return run


def _hex(n: Any) -> str:
    v = int(number(n))
    return hex(v if v >= 0 else v + (1 << 64))


_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _moment(seconds: float) -> datetime:
    return _EPOCH + timedelta(seconds=seconds)


def strftime(fmt: Any = None, ts: Any = None) -> str:
    moment = _moment(time.time() if ts is None else math.floor(number(ts)))
    fields = {
        "Y": "%Y", "m": "%m", "d": "%d", "H": "%H", "M": "%M", "S": "%S", "A": "%A", "a": "%a", "B": "%B", "b": "%b", "j": "%j", "u": "%u", "w": "%w", "y": "%y", "p": "%p", "I": "%I",
    }
    plain = {"s": str(int((moment - _EPOCH).total_seconds())), "Z": "UTC", "z": "+0000", "e": f"{moment.day:2d}", "C": f"{moment.year // 100:02d}", "n": "\n", "t": "\t", "%": "%", "F": f"{moment:%Y-%m-%d}", "T": f"{moment:%H:%M:%S}"}
    out, source, k = [], "%Y-%m-%d %H:%M:%S" if fmt is None else text(fmt), 0
    while k < len(source):
        if source[k] == "%" and k + 1 < len(source):
            c = source[k + 1]
            out.append(moment.strftime(fields[c]) if c in fields else plain.get(c, f"%{c}"))
            k += 2
        else:
            out.append(source[k])
            k += 1
    return "".join(out)


def mktime(spec: Any) -> float:
    parts = text(spec).split()
    try:
        y, mo, d, h, mi, s = (int(p) for p in parts[:6])
    except ValueError:
        return -1.0
    months = y * 12 + mo - 1
    first = datetime(months // 12, months % 12 + 1, 1, tzinfo=UTC)
    return (first - _EPOCH).total_seconds() + (d - 1) * 86400 + h * 3600 + mi * 60 + s


def parsedate(s: Any, fmt: Any) -> Any:
    try:
        return (datetime.strptime(text(s), text(fmt)).replace(tzinfo=UTC) - _EPOCH).total_seconds()
    except ValueError:
        return NOTHING


def jpath(document: Any, path: Any = "") -> str:
    try:
        value = json.loads(text(document))
    except ValueError:
        return ""
    return "\n".join(jsons.text_of(v) for v in jsons.navigate(value, jsons.steps(text(path))))


def _bits(f: Callable[[int, int], int]) -> Callable[..., float]:
    def run(a: Any, b: Any) -> float:
        v = f(int(number(a)), int(number(b))) & ((1 << 64) - 1)
        return float(v - (1 << 64) if v >> 63 else v)

    return run


def _unsigned(n: int) -> int:
    return n & ((1 << 64) - 1)


PURE: dict[str, Callable[..., Any]] = {
    "substr": _substr,
    "index": lambda s, t: float(text(s).find(text(t)) + 1),
    "tolower": lambda s: text(s).lower(),
    "toupper": lambda s: text(s).upper(),
    "trim": lambda s: text(s).strip(),
    "ltrim": lambda s: text(s).lstrip(),
    "rtrim": lambda s: text(s).rstrip(),
    "startswith": lambda s, t: float(text(s).startswith(text(t))),
    "endswith": lambda s, t: float(text(s).endswith(text(t))),
    "repeat": lambda s, n: text(s) * max(0, int(number(n))),
    "chr": lambda n: chr(int(number(n))),
    "ord": lambda s: float(ord(text(s)[0])) if text(s) else 0.0,
    "hex": _hex,
    "lpad": _pad(True),
    "rpad": _pad(False),
    "emoji": _emoji,
    "int": lambda x: float(math.trunc(number(x))) if math.isfinite(number(x)) else number(x),
    "sqrt": _safe(math.sqrt),
    "abs": _safe(abs),
    "ceil": _safe(math.ceil),
    "floor": _safe(math.floor),
    "round": _safe(lambda x: math.copysign(math.floor(abs(x) + 0.5), x)),
    "sin": _safe(math.sin),
    "cos": _safe(math.cos),
    "atan2": _safe(math.atan2),
    "exp": _safe(math.exp),
    "log": _log(math.log),
    "log2": _log(math.log2),
    "log10": _log(math.log10),
    "and": _bits(lambda a, b: a & b),
    "or": _bits(lambda a, b: a | b),
    "xor": _bits(lambda a, b: a ^ b),
    "lshift": _bits(lambda a, b: a << (b & 63)),
    "rshift": _bits(lambda a, b: _unsigned(a) >> (b & 63)),
    "compl": lambda a: float(~int(number(a))),
    "systime": lambda: float(int(time.time())),
    "strftime": strftime,
    "mktime": mktime,
    "parsedate": parsedate,
}
ALIASES = {"idx": "index", "lower": "tolower", "upper": "toupper", "sw": "startswith", "ew": "endswith", "rep": "repeat", "moji": "emoji", "now": "systime", "pdate": "parsedate"}
PURE |= {alias: PURE[name] for alias, name in ALIASES.items()}

# --- stateful -------------------------------------------------------------------------------------------------------

STATEFUL: dict[str, Callable[[Machine, list[Node]], Expr]] = {}
#: Stateful functions that keep their meaning where a program defines the same name.
ARRAY_FIRST: set[str] = set()
#: Which arguments of a function are arrays.
ARRAY_ARGUMENTS: dict[str, tuple[int, ...]] = {}


def stateful(*names: str, arrays: tuple[int, ...] = ()):  # noqa: ANN201
    def keep(f: Callable[[Machine, list[Node]], Expr]) -> Callable[[Machine, list[Node]], Expr]:
        for n in names:
            STATEFUL[n] = f
            ARRAY_FIRST.add(n)
            if arrays:
                ARRAY_ARGUMENTS[n] = arrays
        return f

    return keep


def _name(m: Machine, e: Node) -> Callable[[], str]:
    """The array that an argument names: a variable's name, or what a call returns."""
    while e.kind == "group":
        e = e.args[0]
    if e.kind == "var":
        name = e.args[0]
        return lambda: name
    f = m.expr(e)
    return lambda: text(f())


def _array(m: Machine, e: Node) -> Callable[[], dict[str, Any]]:
    name = _name(m, e)
    return lambda: m.arrays.setdefault(name(), {})


def _put(m: Machine, name: str, values: list[Any]) -> None:
    m.arrays[name] = {str(i): v for i, v in enumerate(values, 1)}


def _in_order(a: dict[str, Any]) -> list[Any]:
    return [a[k] for k in sorted(a, key=smart_key)]


def _numbers(a: dict[str, Any]) -> list[float]:
    return [number(v) for v in a.values()]


def _options(m: Machine, args: list[Node], start: int, defaults: list[Any]) -> Callable[[], list[Any]]:
    parts = [m.expr(a) for a in args[start : start + len(defaults)]]
    return lambda: [p() for p in parts] + defaults[len(parts) :]


@stateful("length", "len", "l")
def _length(m: Machine, args: list[Node]) -> Expr:
    if not args:
        return lambda: float(len(m.record))
    if args[0].kind == "var" and (args[0].args[0] in m.array_names or args[0].args[0] == "HDR"):
        name = args[0].args[0]
        return lambda: float(len(m.arrays.get(name, {}))) if name in m.arrays or name not in m.vars else float(len(text(m.vars[name])))
    f = m.expr(args[0])
    return lambda: float(len(text(f())))


@stateful("rev", "reverse")
def _reverse(m: Machine, args: list[Node]) -> Expr:
    if not args:
        return lambda: m.record[::-1]
    if args[0].kind == "var" and args[0].args[0] in m.array_names:
        name = args[0].args[0]

        def run() -> str:
            _put(m, name, _in_order(m.arrays.get(name, {}))[::-1])
            return name

        return run
    f = m.expr(args[0])
    return lambda: text(f())[::-1]


@stateful("flip")
def _flip(m: Machine, args: list[Node]) -> Expr:
    def run() -> str:
        m.fields = m.need_fields()[::-1]
        m.joined()
        return m.record

    return run


def _substitute(everywhere: bool) -> Callable[[Machine, list[Node]], Expr]:
    def build(m: Machine, args: list[Node]) -> Expr:
        pattern = args[0]
        replacement = m.expr(args[1])
        get, put = m.setter(args[2] if len(args) > 2 else Node("field", (Node("num", (0.0,)),)))
        dynamic = None if pattern.kind == "re" else m.expr(pattern)

        def run() -> float:
            found = m.compiled(pattern.args[0]) if dynamic is None else m.compiled(text(dynamic()))
            r = text(replacement())

            def one(match: Any) -> str:
                out, k = [], 0
                while k < len(r):
                    if r[k] == "\\" and k + 1 < len(r) and r[k + 1] in "&\\":
                        out.append(r[k + 1])
                        k += 1
                    else:
                        out.append(match[0] if r[k] == "&" else r[k])
                    k += 1
                return "".join(out)

            before = text(get())
            if not found.search(before):
                return 0.0  # nothing is written
            new, n = found.subn(one, before, count=0 if everywhere else 1)
            put(new)
            return float(n)

        return run

    return build


STATEFUL["sub"], STATEFUL["gsub"] = _substitute(False), _substitute(True)
ARRAY_FIRST |= {"sub", "gsub"}


@stateful("gensub")
def _gensub(m: Machine, args: list[Node]) -> Expr:
    pattern, parts = args[0], [m.expr(a) for a in args[1:]]
    dynamic = None if pattern.kind == "re" else m.expr(pattern)

    def run() -> str:
        found = m.compiled(pattern.args[0] if dynamic is None else text(dynamic()))
        r, how = text(parts[0]()), text(parts[1]()) if len(parts) > 1 else "g"
        s = text(parts[2]()) if len(parts) > 2 else m.record

        def groups(match: Any) -> str:
            return regex(r"\$(\d|\{\w+\})|\\(\d)").sub(lambda g: match[int((g[1] or g[2]).strip("{}"))] or "", r)

        if how[:1] in ("g", "G"):
            return found.sub(groups, s)
        n = int(number(how))
        for k, match in enumerate(found.finditer(s), 1):
            if k == n:
                return s[: match.start()] + r + s[match.end() :]
        return s

    return run


@stateful("match", arrays=(2,))
def _match(m: Machine, args: list[Node]) -> Expr:
    f, found = m.expr(args[0]), m.searcher(args[1])
    name = _name(m, args[2]) if len(args) > 2 else None

    def run() -> float:
        hit = found(text(f()))
        m.vars["RSTART"] = float(hit.start() + 1) if hit else 0.0
        m.vars["RLENGTH"] = float(hit.end() - hit.start()) if hit else -1.0
        if name:
            m.arrays[name()] = {str(i): (hit[i] or "") for i in range(hit.re.groups + 1)} if hit else {}
        return m.vars["RSTART"]

    return run


@stateful("split", arrays=(1,))
def _split(m: Machine, args: list[Node]) -> Expr:
    f, name = m.expr(args[0]), _name(m, args[1])
    sep = None if len(args) < 3 else (args[2].args[0] if args[2].kind == "re" else m.expr(args[2]))

    def run() -> float:
        s = text(f())
        if isinstance(sep, str):
            parts = m.compiled(sep).split(s) if s else []
        else:
            parts = m.split_text(s, text(m.vars["FS"] if sep is None else sep()))
        _put(m, name(), parts)
        return float(len(parts))

    return run


@stateful("sprintf")
def _sprintf(m: Machine, args: list[Node]) -> Expr:
    parts = [m.expr(a) for a in args]
    return lambda: m.sprintf([p() for p in parts])


@stateful("jpath", "jp", arrays=(2,))
def _jpath(m: Machine, args: list[Node]) -> Expr:
    parts = [m.expr(a) for a in args[:2]]
    if len(args) < 3:
        return lambda: jpath(*[p() for p in parts])
    name = _name(m, args[2])

    def run() -> float:
        try:
            found = jsons.navigate(json.loads(text(parts[0]())), jsons.steps(text(parts[1]())))
        except ValueError:
            found = []
        value = found[0] if len(found) == 1 else found
        if isinstance(value, dict):
            m.arrays[name()] = {k: jsons.text_of(v) for k, v in value.items()}
        elif isinstance(value, list):
            _put(m, name(), [jsons.text_of(v) for v in value])
        else:
            m.arrays[name()] = {"0": jsons.text_of(value)}
        return float(len(m.arrays[name()]))

    return run


@stateful("join", arrays=(0,))
def _join(m: Machine, args: list[Node]) -> Expr:
    a, rest = _array(m, args[0]), _options(m, args, 1, [None])

    def run() -> str:
        sep = rest()[0]
        return text(m.vars["OFS"] if sep is None else sep).join(text(v) for v in _in_order(a()))

    return run


@stateful("keys", arrays=(0,))
def _keys(m: Machine, args: list[Node]) -> Expr:
    a = _array(m, args[0])
    return lambda: text(m.vars["ORS"]).join(sorted(a(), key=smart_key))


@stateful("vals", "values", arrays=(0,))
def _vals(m: Machine, args: list[Node]) -> Expr:
    a = _array(m, args[0])
    return lambda: text(m.vars["ORS"]).join(text(v) for v in _in_order(a()))


def _changes(*names: str):  # noqa: ANN202
    """Functions that change an array in place and return its name; given the values in key order, then options."""

    def keep(f: Callable[..., list[Any]]) -> Callable[..., list[Any]]:
        @stateful(*names, arrays=(0,))
        def build(m: Machine, args: list[Node]) -> Expr:
            name, parts = _name(m, args[0]), [m.expr(a) for a in args[1:]]

            def run() -> str:
                n = name()
                _put(m, n, f(m, _in_order(m.arrays.get(n, {})), *[p() for p in parts]))
                return n

            return run

        return f

    return keep


@_changes("uniq", "unique")
def _uniq(m: Machine, values: list[Any]) -> list[Any]:
    return list(dict.fromkeys(text(v) for v in values))


@_changes("shuf")
def _shuf(m: Machine, values: list[Any]) -> list[Any]:
    m.random.shuffle(values)
    return values


@_changes("top")
def _top(m: Machine, values: list[Any], n: Any) -> list[Any]:
    return sorted(values, key=number, reverse=True)[: max(0, int(number(n)))]


@_changes("bottom", "bot")
def _bottom(m: Machine, values: list[Any], n: Any) -> list[Any]:
    return sorted(values, key=number)[: max(0, int(number(n)))]


@_changes("runtotal", "runtot")
def _runtotal(m: Machine, values: list[Any]) -> list[Any]:
    out, total = [], 0.0
    for v in values:
        total += number(v)
        out.append(total)
    return out


@_changes("norm", "normalize")
def _norm(m: Machine, values: list[Any]) -> list[Any]:
    ns = [number(v) for v in values]
    low, high = (min(ns), max(ns)) if ns else (0.0, 0.0)
    return [(n - low) / (high - low) if high > low else 0.0 for n in ns]


def _sort_key(v: Any) -> tuple[bool, float, str]:
    return smart_key(text(v))


@stateful("asort", arrays=(0, 1))
def _asort(m: Machine, args: list[Node]) -> Expr:
    return _sorted_into(m, args, lambda a: sorted(a.values(), key=_sort_key))


@stateful("asorti", arrays=(0, 1))
def _asorti(m: Machine, args: list[Node]) -> Expr:
    return _sorted_into(m, args, lambda a: sorted(a))


def _sorted_into(m: Machine, args: list[Node], order: Callable[[dict[str, Any]], list[Any]]) -> Expr:
    name, to = _name(m, args[0]), _name(m, args[1]) if len(args) > 1 else None

    def run() -> Any:
        values = order(m.arrays.get(name(), {}))
        _put(m, to() if to else name(), values)
        return float(len(values)) if to else name()

    return run


@stateful("inv", "invert", arrays=(0,))
def _inv(m: Machine, args: list[Node]) -> Expr:
    name = _name(m, args[0])

    def run() -> str:
        n = name()
        m.arrays[n] = {text(v): k for k, v in m.arrays.get(n, {}).items()}
        return n

    return run


@stateful("tidy", arrays=(0,))
def _tidy(m: Machine, args: list[Node]) -> Expr:
    name = _name(m, args[0])

    def run() -> str:
        n = name()
        m.arrays[n] = {k: v for k, v in m.arrays.get(n, {}).items() if truthy(v)}
        return n

    return run


@stateful("diff", arrays=(0, 1))
def _diff(m: Machine, args: list[Node]) -> Expr:
    return _set(m, args, lambda a, b: {k: v for k, v in a.items() if k not in b})


@stateful("inter", arrays=(0, 1))
def _inter(m: Machine, args: list[Node]) -> Expr:
    return _set(m, args, lambda a, b: {k: v for k, v in a.items() if k in b})


@stateful("union", arrays=(0, 1))
def _union(m: Machine, args: list[Node]) -> Expr:
    return _set(m, args, lambda a, b: {**b, **a})


def _set(m: Machine, args: list[Node], f: Callable[[dict, dict], dict]) -> Expr:
    a, b = _name(m, args[0]), _name(m, args[1])

    def run() -> str:
        n = a()
        m.arrays[n] = f(m.arrays.get(n, {}), m.arrays.get(b(), {}))
        return n

    return run


@stateful("seq", arrays=(0,))
def _seq(m: Machine, args: list[Node]) -> Expr:
    parts = [m.expr(a) for a in args[-2:]]
    name = _name(m, args[0]) if len(args) > 2 else None

    def run() -> str:
        a, b = (int(number(p())) for p in parts)
        values = [float(v) for v in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
        if name is None:
            return text(m.vars["ORS"]).join(text(v) for v in values)
        _put(m, name(), values)
        return name()

    return run


@stateful("samp", arrays=(0,))
def _samp(m: Machine, args: list[Node]) -> Expr:
    name, n = _name(m, args[0]), m.expr(args[1])

    def run() -> float:
        values = _in_order(m.arrays.get(name(), {}))
        some = m.random.sample(values, min(len(values), max(0, int(number(n())))))
        _put(m, name(), some)
        return float(len(some))

    return run


@stateful("collect", "acc", "accumulate", arrays=(0,))
def _collect(m: Machine, args: list[Node]) -> Expr:
    a, f = _array(m, args[0]), m.expr(args[1])

    def run() -> float:
        v, into = f(), a()
        if text(v) != "" and not (looks_numeric(v) and math.isnan(number(v))):
            into[str(len(into) + 1)] = v
        return float(len(into))

    return run


@stateful("window", "win", arrays=(0,))
def _window(m: Machine, args: list[Node]) -> Expr:
    name, n, f = _name(m, args[0]), m.expr(args[1]), m.expr(args[2])

    def run() -> float:
        size, v = int(number(n())), f()
        values = _in_order(m.arrays.get(name(), {}))
        if text(v) != "" and not (looks_numeric(v) and math.isnan(number(v))):
            values = [*values, v][-size:]
        _put(m, name(), values)
        return float(len(values))

    return run


@stateful("map", arrays=(0,))
def _map(m: Machine, args: list[Node]) -> Expr:
    name, f, rest = _name(m, args[0]), m.expr(args[1]), _options(m, args, 2, [None])

    def run() -> str:
        n, call, fmt = name(), text(f()), rest()[0]
        a = m.arrays.get(n, {})
        for k, v in a.items():
            new = m.invoke(call, [v])
            a[k] = new if fmt is None else m.sprintf([fmt, new, v])
        return n

    return run


@stateful("filter", "fltr", arrays=(0,))
def _filter(m: Machine, args: list[Node]) -> Expr:
    name, f = _name(m, args[0]), m.expr(args[1])

    def run() -> str:
        n, call = name(), text(f())
        _put(m, n, [v for v in _in_order(m.arrays.get(n, {})) if truthy(m.invoke(call, [v]))])
        return n

    return run


# --- statistics -----------------------------------------------------------------------------------------------------


def percentile(values: list[float], p: float) -> float:
    if not values:
        return 0.0
    s = sorted(values)
    at = min(max(p, 0.0), 100.0) / 100 * (len(s) - 1)
    low = math.floor(at)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)


def _mean(v: list[float]) -> float:
    return sum(v) / len(v) if v else 0.0


def _variance(v: list[float]) -> float:
    mean = _mean(v)
    return sum((x - mean) ** 2 for x in v) / len(v) if v else 0.0


def interquartile_mean(v: list[float]) -> float:
    s = sorted(v)
    some = s[max(math.ceil(0.25 * len(s)), 1) - 1 : math.floor(0.75 * len(s))]
    return _mean(some) if some else _mean(s)


def _statistic(*names: str, default: float | None = None):  # noqa: ANN202
    def keep(f: Callable[..., float]) -> Callable[..., float]:
        @stateful(*names, arrays=(0,))
        def build(m: Machine, args: list[Node]) -> Expr:
            a, rest = _array(m, args[0]), _options(m, args, 1, [] if default is None else [default])
            return lambda: f(_numbers(a()), *[number(x) for x in rest()])

        return f

    return keep


_statistic("sum")(lambda v: float(sum(v)))
_statistic("mean", "avg")(_mean)
_statistic("variance", "var")(_variance)
_statistic("stddev", "sd")(lambda v: math.sqrt(_variance(v)))
_statistic("median", "med")(lambda v: percentile(v, 50.0))
_statistic("percentile", "p", "pct", default=50.0)(percentile)
_statistic("quantile", "q", default=0.5)(lambda v, q: percentile(v, q * 100))
_statistic("iqm")(interquartile_mean)


def _extreme(pick: Callable[..., float]) -> Callable[[Machine, list[Node]], Expr]:
    def build(m: Machine, args: list[Node]) -> Expr:
        if len(args) == 1:
            a = _array(m, args[0])
            return lambda: pick(_numbers(a()), default=0.0)
        parts = [m.expr(x) for x in args]
        return lambda: pick(number(p()) for p in parts)

    return build


for _n, _f in (("min", min), ("max", max)):
    STATEFUL[_n] = _extreme(_f)
    ARRAY_FIRST.add(_n)
    ARRAY_ARGUMENTS[_n] = (0,)


@stateful("hist", arrays=(0, 2))
def _hist(m: Machine, args: list[Node]) -> Expr:
    from ..operators.aggregate import nice_bins

    name, rest = _name(m, args[0]), _options(m, args, 1, [0.0])
    to = _name(m, args[2]) if len(args) > 2 else None
    ends = [m.expr(a) for a in args[3:5]]

    def run() -> str:
        values = _numbers(m.arrays.get(name(), {}))
        bins = int(number(rest()[0]))
        low = number(ends[0]()) if ends else min(values, default=0.0)
        high = number(ends[1]()) if len(ends) > 1 else max(values, default=0.0)
        if bins > 0:
            start, width = low, (high - low) / bins or 1.0
        else:
            start, width, bins = nice_bins(low, high, len(values))
        counts = [0] * bins
        for v in values:
            counts[min(max(math.floor((v - start) / width), 0), bins - 1)] += 1
        out = to() if to else "_hist"
        _put(m, out, [float(c) for c in counts])
        m.histograms[out] = {"low": start, "width": width, "bins": float(bins)}
        return out

    return run


# --- charts, timers, files ------------------------------------------------------------------------------------------


def _chart(box: bool) -> Callable[[Machine, list[Node]], Expr]:
    def build(m: Machine, args: list[Node]) -> Expr:
        from ..charts import bars, boxed

        name, rest = _name(m, args[0]), _options(m, args, 1, [40.0, "█", 0.0, "", "", ""])

        def run() -> str:
            n = name()
            a = m.arrays.get(n, {})
            width, char, precision, title, label, _ = rest()
            rows = [(k, number(a[k])) for k in sorted(a, key=smart_key)]
            if h := m.histograms.get(n):
                digits = max(0, int(number(precision)))
                rows = [(f"{h['low'] + i * h['width']:.{digits}f}-{h['low'] + (i + 1) * h['width']:.{digits}f}", v) for i, (_, v) in enumerate(rows)]
            draw = bars(rows, int(number(width)), text(char))
            return "\n".join(boxed(draw, text(title) if text(title) else n, text(label))) if box else "\n".join(draw)

        return run

    return build


for _n, _b in (("plot", False), ("plotbox", True), ("pbox", True)):
    STATEFUL[_n] = _chart(_b)
    ARRAY_ARGUMENTS[_n] = (0,)


@stateful("typeof")
def _typeof(m: Machine, args: list[Node]) -> Expr:
    e = args[0]
    if e.kind == "var":
        name = e.args[0]
        return lambda: "array" if name in m.arrays and name not in m.vars else "uninitialized" if m.vars.get(name) is None else "number" if isinstance(m.vars[name], float) else "string"
    f = m.expr(e)

    def run() -> str:
        v = f()
        return "uninitialized" if v is None else "number" if isinstance(v, float) else "string"

    return run


@stateful("clr", "clear")
def _clear(m: Machine, args: list[Node]) -> Expr:
    get, put = m.setter(args[0])

    def run() -> Any:
        v = get()
        put("")
        return v

    return run


@stateful("rand")
def _rand(m: Machine, args: list[Node]) -> Expr:
    return lambda: m.random.random()


@stateful("srand")
def _srand(m: Machine, args: list[Node]) -> Expr:
    f = m.expr(args[0]) if args else lambda: time.time()

    def run() -> float:
        before, m.seed = m.seed, float(number(f()))
        m.random.seed(m.seed)
        return number(before)

    return run


@stateful("slurp", arrays=(1,))
def _slurp(m: Machine, args: list[Node]) -> Expr:
    f, name = m.expr(args[0]), _name(m, args[1]) if len(args) > 1 else None

    def run() -> Any:
        path = text(f())
        try:
            rows = [r for _, r, _ in m.pending or ()] if path == "-" else list(m.opened(path))
        except OSError:
            return -1.0 if name else ""
        if name is None:
            return "\n".join(rows)
        _put(m, name(), rows)
        return float(len(rows))

    return run


@stateful("close")
def _close(m: Machine, args: list[Node]) -> Expr:
    f = m.expr(args[0])

    def run() -> float:
        name = text(f())
        found = [m.readers.pop(k, None) for k in (name, f"|{name}")]
        return 0.0 if any(r is not None for r in found) or any(t and t.lstrip("|") == name for t, _ in m.out) else -1.0

    return run


@stateful("fflush")
def _fflush(m: Machine, args: list[Node]) -> Expr:
    return lambda: 0.0


@stateful("system", "sys")
def _system(m: Machine, args: list[Node]) -> Expr:
    f = m.expr(args[0])

    def run() -> float:
        import subprocess

        if not m.commands:
            raise PermissionError("commands aren't allowed here")
        done = subprocess.run(["sh", "-c", text(f())], capture_output=True, text=True, check=False)
        m.emit(None, done.stdout)
        return float(done.returncode)

    return run


@stateful("dump")
def _dump(m: Machine, args: list[Node]) -> Expr:
    e = args[0]
    f = None if e.kind == "var" and e.args[0] in m.array_names else m.expr(e)
    to = m.expr(args[1]) if len(args) > 1 else None

    def run() -> float:
        if f is None:
            a = m.arrays.get(e.args[0], {})
            said = f"dump: array {e.args[0]} ({len(a)} elements)\n" + "".join(f"  [{k}] {text(a[k])}\n" for k in sorted(a, key=smart_key))
        else:
            v = f()
            said = f"dump: {'number' if isinstance(v, float) else 'string'} {text(v)}\n"
        if to:
            m.emit(text(to()), said)
        else:
            print(said, end="", file=sys.stderr)
        return 0.0

    return run


@stateful("clk", "clock")
def _clock(m: Machine, args: list[Node]) -> Expr:
    return lambda: time.perf_counter() - m.timers[""]


@stateful("tic", "start")
def _tic(m: Machine, args: list[Node]) -> Expr:
    f = m.expr(args[0]) if args else lambda: ""

    def run() -> float:
        m.timers[text(f())] = time.perf_counter()
        return 0.0

    return run


@stateful("toc", "elapsed")
def _toc(m: Machine, args: list[Node]) -> Expr:
    f = m.expr(args[0]) if args else lambda: ""
    return lambda: time.perf_counter() - m.timers.get(text(f()), m.timers[""])


def check(name: str) -> None:
    if name not in PURE and name not in STATEFUL:
        raise ProgramError(1, 1, f"no function {name!r}")
