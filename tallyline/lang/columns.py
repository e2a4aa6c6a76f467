"""Program expressions as Spark Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import coerce, dates, jsons, numbers, strings
from ..functions.printf import format_columns
from .syntax import Node, Tree, ungrouped


class Unlowered(Exception):  # noqa: N818
    """The program, or this way of running it, has no relational form."""


@dataclass(frozen=True)
class Value:
    """A Column with its static kind: num, str or bool."""

    column: Column
    kind: str
    has: Column | None = None  # where it has been set at all: else it prints as nothing

    @property
    def num(self) -> Column:
        return self.column if self.kind == "num" else self.column.cast("double") if self.kind == "bool" else coerce.to_number(self.column)

    @property
    def str(self) -> Column:
        out = coerce.number_text(self.num) if self.kind != "str" else self.column
        return out if self.has is None else F.when(self.has, out).otherwise("")

    @property
    def test(self) -> Column:
        return F.coalesce(self.column, F.lit(False)) if self.kind == "bool" else coerce.truthy(self.column, numeric=self.kind == "num")


def literal(v: float | str) -> Value:
    return Value(F.lit(v), "num" if isinstance(v, float) else "str")




@dataclass
class Scope:
    """What names stand for: the record's text and fields, variables by name, and array reads."""

    record: Value
    fields: Callable[[], Column]
    count: Callable[[], Column]
    variables: dict[str, Value] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)  # column name to its type
    names: list[str] = field(default_factory=list)
    tree: Tree | None = None
    array_read: Callable[[str, list[Node]], Value] | None = None
    array_has: Callable[[str, list[Node]], Column] | None = None
    aggregate: Callable[[str, list[Node]], Value | None] | None = None
    unset: Callable[[str], Value] | None = None
    nth: Callable[[int], Column] | None = None  # one field without splitting all, where few are read
    depth: int = 0

    def written(self, name: str) -> bool:
        """Whether the program sets the variable anywhere."""
        nodes = self.tree.nodes() if self.tree else ()
        return any(n.kind in ("assign", "step", "forin", "getline", "call") and Node("var", (name,)) in (n, *n.args, *(n.args[1] if n.kind == "call" else ())) or (n.kind == "forin" and n.args[0] == name) for n in nodes)


_NUMERIC = {"int": numbers.integer, "sqrt": F.sqrt, "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": numbers.rounded, "sin": F.sin, "cos": F.cos, "exp": F.exp, "log": numbers.logarithm, "log2": F.log2, "log10": F.log10, "compl": lambda x: numbers.complement(x).cast("double")}
_TEXTUAL = {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": coerce.trim, "ltrim": strings.ltrim, "rtrim": strings.rtrim, "rev": F.reverse, "reverse": F.reverse, "emoji": strings.emoji, "moji": strings.emoji}


class Lowering:
    def __init__(self, scope: Scope):
        self.scope = scope

    def value(self, n: Node) -> Value:
        f = getattr(self, f"on_{n.kind}", None)
        if f is None:
            raise Unlowered(n.kind)
        return f(*n.args)

    def on_num(self, v: float) -> Value:
        return literal(v)

    def on_str(self, v: str) -> Value:
        return literal(v)

    def on_re(self, source: str) -> Value:
        return Value(self.scope.record.str.rlike(strings.java_regex(source)), "bool")

    def on_group(self, e: Node) -> Value:
        return self.value(e)

    def on_var(self, name: str) -> Value:
        s = self.scope
        if name in s.variables:
            return s.variables[name]
        if name == "NF":
            return Value(s.count().cast("double"), "num")
        if s.unset:
            return s.unset(name)
        raise Unlowered(f"variable {name}")

    def on_field(self, e: Node) -> Value:
        s, e = self.scope, ungrouped(e)
        if e.kind in ("var", "str") and e.args[0] in s.columns:
            name = e.args[0]
            kind = "num" if s.columns[name] in ("double", "float", "int", "bigint", "smallint", "tinyint") or s.columns[name].startswith("decimal") else "str"
            column = F.col(f"`{name}`")
            return Value(column.cast("double") if kind == "num" else F.coalesce(column.cast("string"), F.lit("")), kind)
        if e.kind == "num":
            n = int(e.args[0])
            if n == 0:
                return s.record
            if s.names and n <= len(s.names):
                return self.on_field(Node("str", (s.names[n - 1],)))
            if s.nth:
                return Value(s.nth(n), "str")
            return Value(F.coalesce(F.get(s.fields(), F.lit(n - 1)), F.lit("")), "str")
        if e.kind == "unary" and e.args[0] == "-" and e.args[1].kind == "num":
            n = int(e.args[1].args[0])
            return Value(F.coalesce(F.try_element_at(s.fields(), F.lit(-n)), s.record.str), "str")
        if s.names and (e.kind == "str" or (e.kind == "var" and e.args[0] != "NF" and e.args[0] not in s.variables and not s.written(e.args[0]))):
            raise ValueError(f"no column {e.args[0]!r}")
        at = self.value(e).num.cast("int")
        fields = s.fields()
        found = F.when(at > 0, F.get(fields, at - 1)).when(at < 0, F.coalesce(F.try_element_at(fields, at), s.record.str)).otherwise(s.record.str)
        return Value(F.coalesce(found, F.lit("")), "str")

    def on_unary(self, op: str, e: Node) -> Value:
        v = self.value(e)
        if op == "!":
            return Value(~v.test, "bool")
        return Value(-v.num if op == "-" else v.num, "num")

    def on_binary(self, op: str, a: Node, b: Node) -> Value:
        x, y = self.value(a), self.value(b)
        if op in ("<", "<=", ">", ">=", "==", "!="):
            return Value(_compared(op, x, y), "bool")
        out = {"+": lambda: x.num + y.num, "-": lambda: x.num - y.num, "*": lambda: x.num * y.num, "/": lambda: coerce.divide(x.num, y.num), "%": lambda: coerce.modulo(x.num, y.num), "**": lambda: F.pow(x.num, y.num)}[op]()
        return Value(out, "num")

    def on_and(self, a: Node, b: Node) -> Value:
        return Value(self.value(a).test & self.value(b).test, "bool")

    def on_or(self, a: Node, b: Node) -> Value:
        return Value(self.value(a).test | self.value(b).test, "bool")

    def on_cond(self, c: Node, a: Node, b: Node) -> Value:
        t, x, y = self.value(c).test, self.value(a), self.value(b)
        if x.kind == y.kind:
            return Value(F.when(t, x.column).otherwise(y.column), x.kind)
        return Value(F.when(t, x.str).otherwise(y.str), "str")

    def on_default(self, a: Node, b: Node) -> Value:
        x, y = self.value(a), self.value(b)
        return x if x.kind != "str" else Value(coerce.or_default(x.str, y.str), "str")

    def on_match(self, negated: bool, a: Node, b: Node) -> Value:
        x = self.value(a).str
        found = x.rlike(strings.java_regex(b.args[0])) if b.kind in ("re", "str") else F.regexp_like(x, self.value(b).str)
        return Value(~found if negated else found, "bool")

    def on_concat(self, a: Node, b: Node) -> Value:
        return Value(F.concat(self.value(a).str, self.value(b).str), "str")

    def on_in(self, keys: list[Node], name: str) -> Value:
        if not self.scope.array_has:
            raise Unlowered("in")
        return Value(self.scope.array_has(name, keys), "bool")

    def on_index(self, name: str, keys: list[Node]) -> Value:
        if not self.scope.array_read:
            raise Unlowered("array read")
        return self.scope.array_read(name, keys)

    def on_call(self, name: str, args: list[Node]) -> Value:
        s = self.scope
        if s.aggregate and (found := s.aggregate(name, args)) is not None:
            return found
        if s.tree and name in s.tree.functions:
            return self.inlined(name, args)
        if name in ("length", "len", "l"):
            return Value(F.length(self.value(args[0]).str if args else s.record.str).cast("double"), "num")
        if name in ("rev", "reverse") and not args:
            return Value(F.reverse(s.record.str), "str")
        if name in _NUMERIC and len(args) == 1:
            return Value(_NUMERIC[name](self.value(args[0]).num), "num")
        if name in _TEXTUAL and len(args) == 1:
            return Value(_TEXTUAL[name](self.value(args[0]).str), "str")
        if name == "substr":
            parts = [self.value(a) for a in args]
            return Value(strings.substr(parts[0].str, parts[1].num, parts[2].num if len(parts) > 2 else None), "str")
        if name in ("index", "idx"):
            return Value(strings.index(self.value(args[0]).str, self.value(args[1]).str).cast("double"), "num")
        if name in ("startswith", "sw", "endswith", "ew"):
            x, y = (self.value(a).str for a in args)
            return Value((F.startswith if name in ("startswith", "sw") else F.endswith)(x, y), "bool")
        if name in ("min", "max") and len(args) == 2:
            return Value((F.least if name == "min" else F.greatest)(*[self.value(a).num for a in args]), "num")
        if name == "atan2":
            return Value(F.atan2(*[self.value(a).num for a in args]), "num")
        if name in ("and", "or", "xor"):
            f = {"and": numbers.bit_and, "or": numbers.bit_or, "xor": numbers.bit_xor}[name]
            return Value(f(*[self.value(a).num for a in args]).cast("double"), "num")
        if name in ("repeat", "rep"):
            return Value(F.repeat(self.value(args[0]).str, F.greatest(self.value(args[1]).num.cast("int"), F.lit(0))), "str")
        if name in ("lpad", "rpad") and all(a.kind in ("num", "str") for a in args[1:]):
            f = strings.lpad if name == "lpad" else strings.rpad
            return Value(f(self.value(args[0]).str, int(args[1].args[0]), str(args[2].args[0]) if len(args) > 2 else " "), "str")
        if name == "sprintf" and args and args[0].kind == "str":
            return Value(self.formatted(args), "str")
        if name == "strftime" and len(args) == 2 and args[0].kind == "str":
            return Value(dates.strftime(args[0].args[0], dates.timestamp(F.floor(self.value(args[1]).num))), "str")
        if name == "mktime" and args:
            return Value(dates.mktime(self.value(args[0]).str).cast("double"), "num")
        if name in ("parsedate", "pdate") and len(args) == 2 and args[1].kind == "str":
            return Value(dates.parsedate(self.value(args[0]).str, args[1].args[0]).cast("double"), "num")
        if name in ("jpath", "jp") and len(args) == 2 and args[1].kind == "str":
            return Value(jsons.jpath(self.value(args[0]).str, args[1].args[0]), "str")
        if name == "gensub" and len(args) >= 3 and args[0].kind in ("re", "str") and args[1].kind == "str" and args[2].kind in ("str", "num"):
            how = args[2].args[0]
            return Value(strings.gensub(args[0].args[0], args[1].args[0], how if isinstance(how, str) else int(how), self.value(args[3]).str if len(args) > 3 else s.record.str), "str")
        raise Unlowered(f"function {name}")

    def formatted(self, args: list[Node]) -> Column:
        values = [self.value(a) for a in args[1:]]
        return format_columns(args[0].args[0], *[v.column if v.kind != "bool" else v.num for v in values], text=tuple(v.kind == "str" for v in values))

    def inlined(self, name: str, args: list[Node]) -> Value:
        """A function that only returns an expression of its parameters."""
        s = self.scope
        names, body = s.tree.functions[name]
        if len(body) != 1 or body[0].kind != "return" or body[0].args[0] is None or s.depth > 20:
            raise Unlowered(f"function {name}")
        given = {n: self.value(a) for n, a in zip(names, args, strict=False)}
        given |= {n: literal("") for n in names[len(args) :]}
        inner = Scope(**{**s.__dict__, "variables": s.variables | given, "depth": s.depth + 1})
        return Lowering(inner).value(body[0].args[0])


def _compared(op: str, x: Value, y: Value) -> Column:
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    if x.kind != "str" and y.kind != "str":
        return ops[op](x.num, y.num)
    sure = [v for v in (x, y) if v.kind != "str"]
    if sure:  # one side is a number for certain
        other = x if x.kind == "str" else y
        return F.when(coerce.looks_numeric(other.str), ops[op](x.num, y.num)).otherwise(ops[op](x.str, y.str))
    return coerce.compare(op, x.str, y.str)
