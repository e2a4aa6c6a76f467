"""Programs as Spark plans: each class of program state has its relational form.

stateless    filters and projections                            (also with nextfile-free exits as limits)
accumulate   aggregates by key, the END block over them
distinct     the first record of each key
lookup       arrays of the first file joined to the records of the others
ordered      values of earlier records, running sums and counts
range        two-state automaton over the record order
last         the last records

Whatever isn't one of them raises Unlowered, and ``run`` falls back to the sequential machine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import gsub, sub
from ..operators.ordered import Ordered
from ..operators.select import until
from .columns import Lowering, Scope, Unlowered, Value, literal
from .syntax import Node, Rule, Tree, ungrouped

SPECIAL = frozenset("NR FNR NF FILENAME FS OFS RS ORS SUBSEP OFMT CONVFMT RSTART RLENGTH".split())


@dataclass
class Source:
    """The input: ``rows`` with value, nr, fnr and file number, or named columns; and how fields are split."""

    rows: DataFrame
    columns: dict[str, str] = field(default_factory=dict)
    fs: str = " "
    ofs: str = " "
    variables: dict[str, str] = field(default_factory=dict)
    #: Replaces nr, which otherwise only rises with the records, by their numbers from 1.
    number: Callable[[DataFrame], DataFrame] | None = None

    def numbered(self) -> DataFrame:
        return self.number(self.rows) if self.number else self.rows

    def scope(self, tree: Tree) -> Scope:
        names = list(self.columns)
        if names:
            texts = [field_text(n, k) for n, k in self.columns.items()]
            fields = lambda: F.array(*texts)
            record = Value(F.concat_ws(self.ofs, *texts), "str")
        else:
            fields = lambda: split_by(F.col("value"), self.fs)
            record = Value(F.col("value"), "str")
        given = {n: _given(v) for n, v in self.variables.items()}
        given |= {"NR": Value(F.col("nr").cast("double"), "num"), "FNR": Value(F.col("fnr").cast("double"), "num"), "FILENAME": Value(F.col("filename"), "str"), "FS": literal(self.fs), "OFS": literal(self.ofs), "SUBSEP": literal("\x1c"), "ORS": literal("\n")}
        nth = None if names or len(fields_read(tree)) > FEW else lambda n: field_at(F.col("value"), self.fs, n)
        return Scope(record, fields, lambda: F.size(fields()), given, self.columns, names, tree, nth=nth)


#: Up to so many fields are read one by one.
FEW = 3


def fields_read(tree: Tree) -> set[float]:
    """The constant field numbers of a program."""
    return {n.args[0].args[0] for n in tree.nodes() if n.kind == "field" and n.args[0].kind == "num" and n.args[0].args[0] > 0}


def field_at(value: Column, fs: str, n: int) -> Column:
    """The n-th field, empty if there are fewer."""
    if fs == " ":
        return F.regexp_extract(value, rf"^\s*(?:\S+\s+){{{n - 1}}}(\S+)", 1)
    if len(fs) == 1:
        return F.split_part(value, F.lit(fs), F.lit(n))
    return F.coalesce(F.get(split_by(value, fs), F.lit(n - 1)), F.lit(""))


def _given(v: str) -> Value:
    return literal(v)


def field_text(name: str, kind: str) -> Column:
    """A typed column as a field: whole numbers plainly, true and false as 1 and 0, times in ISO form, null as nothing."""
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("string")).otherwise(c.cast("string"))
    elif kind == "boolean":
        text = c.cast("int").cast("string")
    elif kind.startswith("timestamp"):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def split_by(value: Column, fs: str) -> Column:
    from ..functions.strings import java_regex, split

    if fs == " ":
        return split(value)
    empty = F.array().cast("array<string>")
    parts = split(value, fs) if len(fs) == 1 else F.split(value, java_regex(fs), -1)
    return F.when(value == "", empty).otherwise(parts)


# --- what programs read and write ------------------------------------------------------------------------------------


def written_names(nodes) -> set[str]:  # noqa: ANN001
    out = set()
    for n in nodes:
        target = n.args[1] if n.kind == "assign" else n.args[2] if n.kind == "step" else n.args[0] if n.kind == "getline" else None
        if target is not None and target.kind in ("var", "index"):
            out.add(target.args[0])
        if n.kind == "forin":
            out.add(n.args[0])
        if n.kind == "call" and n.args[0] in ("sub", "gsub") and len(n.args[1]) > 2 and n.args[1][2].kind in ("var", "index"):
            out.add(n.args[1][2].args[0])
        if n.kind == "call" and n.args[0] in ("clr", "clear"):
            out.add(n.args[1][0].args[0])
    return out


def nodes_of(block: list[Node] | None):  # noqa: ANN201
    for n in block or []:
        yield from n.walk()


def rule_nodes(r: Rule):  # noqa: ANN201
    for p in r.patterns:
        yield from p.walk()
    yield from nodes_of(r.body)


def constants(tree: Tree, source: Source) -> dict[str, Value]:
    """Variables that BEGIN sets once to constants and nothing else changes; separators take effect on the source."""
    out: dict[str, Value] = {}
    changed = set()
    for r in tree.rules:
        changed |= written_names(rule_nodes(r))
    changed |= written_names(nodes_of(tree.end))
    for n in tree.begin:
        e = n.args[0] if n.kind == "expr" else None
        if e is None or e.kind != "assign" or e.args[0] or e.args[1].kind != "var":
            raise Unlowered("BEGIN does more than set constants")
        name, v = e.args[1].args[0], ungrouped(e.args[2])
        if v.kind == "unary" and v.args[0] == "-" and v.args[1].kind == "num":
            v = Node("num", (-v.args[1].args[0],))
        if v.kind not in ("num", "str") or name in changed:
            raise Unlowered(f"BEGIN variable {name}")
        if name == "FS":
            source.fs = str(v.args[0])
        elif name == "OFS":
            source.ofs = str(v.args[0])
        elif name in ("RS", "SUBSEP", "OFMT", "CONVFMT"):
            raise Unlowered(name)
        out[name] = literal(v.args[0])
    return out


# --- stateless bodies ------------------------------------------------------------------------------------------------


@dataclass
class State:
    """One record on its way through the rules: variables, record and fields as they stand."""

    scope: Scope
    ofs: str
    ors: str = "\n"
    alive: Column | None = None  # where no rule has gone on to the next record
    lines: list[Column] = field(default_factory=list)
    carried: set[str] = field(default_factory=set)
    rows: DataFrame | None = None
    bound: int = 0

    def bind(self, c: Column) -> Column:
        """The expression as a column of its own, so that later expressions share its value."""
        if self.rows is None:
            return c
        name, self.bound = f"_b{self.bound}", self.bound + 1
        self.rows = self.rows.withColumn(name, c)
        return F.col(name)

    def lower(self) -> Lowering:
        return Lowering(self.scope)

    def emit(self, when: Column | None, line: Column) -> None:
        self.lines.append(F.when(when, line) if when is not None else line)

    def set(self, when: Column | None, name: str, v: Value) -> None:
        old = self.scope.variables.get(name)
        if when is not None:
            old = old or literal("")
            v = Value(F.when(when, v.column).otherwise(old.column), v.kind) if v.kind == old.kind else Value(F.when(when, v.str).otherwise(old.str), "str")
        v = Value(self.bind(v.column), v.kind, v.has)
        self.scope = Scope(**{**self.scope.__dict__, "variables": self.scope.variables | {name: v}})

    def set_fields(self, when: Column | None, fields: Column) -> None:
        before = self.scope.fields()
        now = self.bind(F.when(when, fields).otherwise(before) if when is not None else fields)
        joined = F.array_join(now, self.ofs)
        record = self.bind(F.when(when, joined).otherwise(self.scope.record.str) if when is not None else joined)
        self.scope = Scope(**{**self.scope.__dict__, "record": Value(record, "str"), "fields": lambda: now, "count": lambda: F.size(now), "columns": {}, "names": [], "nth": None})

    def set_record(self, when: Column | None, record: Column, fs: str) -> None:
        now = self.bind(F.when(when, record).otherwise(self.scope.record.str) if when is not None else record)
        self.scope = Scope(**{**self.scope.__dict__, "record": Value(now, "str"), "fields": lambda: split_by(now, fs), "count": lambda: F.size(split_by(now, fs)), "columns": {}, "names": [], "nth": None})


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def body(state: State, block: list[Node], when: Column | None, fs: str) -> Column | None:
    """Runs statements on the state; returns where they go on to the next record (None: nowhere)."""
    stopped: Column | None = None
    for n in block:
        live = when if stopped is None else _both(when, ~stopped)
        stop = statement(state, n, live, fs)
        if stop is not None:
            stopped = stop if stopped is None else stopped | stop
    return stopped


def statement(state: State, n: Node, when: Column | None, fs: str) -> Column | None:
    if n.kind == "block":
        return body(state, n.args[0], when, fs)
    if n.kind == "next":
        return when if when is not None else F.lit(True)
    if n.kind == "print":
        args, redirect = n.args
        if redirect:
            raise Unlowered("redirect")
        parts = [state.lower().value(a).str for a in args] or [state.scope.record.str]
        state.emit(when, F.concat_ws(state.ofs, *parts))
        return None
    if n.kind == "printf":
        args, redirect = n.args
        if redirect or not args or args[0].kind != "str" or not args[0].args[0].endswith("\n"):
            raise Unlowered("printf without a line end")
        text = Node("str", (args[0].args[0][:-1],))
        state.emit(when, state.lower().formatted([text, *args[1:]]))
        return None
    if n.kind == "if":
        test, then, other = n.args
        t = state.bind(state.lower().value(test).test)
        a = body(state, then, _both(when, t), fs)
        b = body(state, other, _both(when, ~t), fs)
        return a if b is None else b if a is None else a | b
    if n.kind == "expr":
        effect(state, ungrouped(n.args[0]), when, fs)
        return None
    raise Unlowered(n.kind)


def effect(state: State, e: Node, when: Column | None, fs: str) -> None:
    low = state.lower()
    if e.kind == "assign":
        op, target, value = e.args
        if target.kind == "var" and target.args[0] not in SPECIAL and target.args[0] not in state.carried:
            name = target.args[0]
            v = low.value(value if not op else Node("binary", (op, target, value)))
            state.set(when, name, v)
            return
        if target.kind == "field":
            at = ungrouped(target.args[0])
            v = low.value(value if not op else Node("binary", (op, target, value)))
            if at.kind == "num" and at.args[0] == 0:
                state.set_record(when, v.str, fs)
                return
            if at.kind == "num":
                k = int(at.args[0])
            elif at.kind in ("var", "str") and at.args[0] in state.scope.names:
                k = state.scope.names.index(at.args[0]) + 1
            elif at.kind == "var" and at.args[0] == "NF":
                fields, text = state.scope.fields(), v.str
                state.set_fields(when, F.transform(fields, lambda f, i: F.when(i == F.size(fields) - 1, text).otherwise(f)))
                return
            else:
                raise Unlowered("computed field assignment")
            fields, text = state.scope.fields(), v.str
            padded = F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.lit(k) - F.size(fields), F.lit(0))))
            state.set_fields(when, F.transform(padded, lambda f, i: F.when(i == k - 1, text).otherwise(f)))
            return
    if e.kind == "call" and e.args[0] in ("sub", "gsub"):
        name, args = e.args
        if args[0].kind in ("re", "str") and args[1].kind == "str":
            target = args[2] if len(args) > 2 else Node("field", (Node("num", (0.0,)),))
            old = low.value(target).str
            new = (sub if name == "sub" else gsub)(old, args[0].args[0], args[1].args[0])
            where = _both(when, old.rlike(args[0].args[0]))
            if target.kind == "field" and target.args[0].kind == "num" and target.args[0].args[0] == 0:
                state.set_record(where, new, fs)
                return
            if target.kind == "var" and target.args[0] not in state.carried:
                state.set(where, target.args[0], Value(new, "str"))
                return
    if e.kind == "call" and e.args[0] == "flip":
        state.set_fields(when, F.reverse(state.scope.fields()))
        return
    if e.kind in ("num", "str", "var", "field"):
        return
    raise Unlowered(f"effect {e.kind}")


def pattern_of(state: State, n: Node, raw: Value) -> Column:
    """A rule's condition; a bare regular expression looks at the record as it was read."""
    if n.kind == "re":
        return Lowering(Scope(**{**state.scope.__dict__, "record": raw})).value(n).test
    return state.lower().value(n).test


def through(state: State, rules: list[Rule], fs: str) -> None:
    raw = state.scope.record
    for r in rules:
        if r.kind not in ("always", "when"):
            raise Unlowered(r.kind)
        when = state.alive
        if r.kind == "when":
            if r.patterns[0].kind == "assign" and r.patterns[0].args[1].kind == "var" and r.patterns[0].args[1].args[0] in SPECIAL:
                raise Unlowered("assignment to a separator")
            e = ungrouped(r.patterns[0])
            if any(n.kind in ("assign", "step") for n in e.walk()):
                raise Unlowered("pattern with an effect")
            when = _both(when, pattern_of(state, e, raw))
            when = state.bind(when) if len(rules) > 1 else when
        if r.body is None:
            state.emit(when, state.scope.record.str)
            continue
        stopped = body(state, r.body, when, fs)
        if stopped is not None:
            state.alive = state.bind(_both(state.alive, ~stopped))


def emitted(rows: DataFrame, lines: list[Column]) -> DataFrame:
    """nr, place and line of all output lines of records."""
    if not lines:
        return rows.select(F.col("nr"), F.lit(0).alias("place"), F.lit("").alias("line")).filter(F.lit(False))
    if len(lines) == 1:
        return rows.select(F.col("nr"), F.lit(0).alias("place"), lines[0].alias("line")).filter("line is not null")
    structs = F.array(*[F.struct(F.lit(k).alias("place"), line.alias("line")) for k, line in enumerate(lines)])
    return rows.select("nr", F.inline(structs)).filter("line is not null")


def checked_end(tree: Tree) -> None:
    if tree.end or tree.begin_file or tree.end_file:
        raise Unlowered("END")


def carried_names(tree: Tree) -> set[str]:
    """Variables whose value may come from an earlier record: read before the rules certainly write them."""
    writes = set()
    for r in tree.rules:
        writes |= written_names(rule_nodes(r))
    writes -= SPECIAL
    sure: set[str] = set()
    carried: set[str] = set()

    def reads(n: Node) -> None:
        if n.kind == "assign":
            op, target, value = n.args
            reads(value)
            if op or target.kind != "var":
                reads(target)
            else:
                sure.add(target.args[0])
            return
        if n.kind == "step":
            reads(n.args[2])
            return
        if n.kind in ("var", "index") and n.args[0] in writes and n.args[0] not in sure:
            carried.add(n.args[0])
        for x in n.args:
            for y in x if isinstance(x, (list, tuple)) else (x,):
                if isinstance(y, Node):
                    reads(y)

    for r in tree.rules:
        for p in r.patterns:
            reads(p)
        before = set(sure)
        for n in r.body or []:
            if n.kind in ("if", "while", "for", "forin", "do", "block"):
                inner = set(sure)
                reads(n)
                sure.clear()
                sure.update(inner)
            else:
                reads(n)
        if r.kind != "always":
            sure.clear()
            sure.update(before)
    return carried


def stateless(tree: Tree, source: Source) -> DataFrame:
    checked_end(tree)
    tree, stop = until_exit(tree)
    tree, limit = without_exit(tree)
    known = constants(tree, source)
    if carried_names(tree):
        raise Unlowered("carried variables")
    rows = source.rows if limit is None else source.rows.filter(F.col("nr") <= limit)
    if stop is not None:
        at_exit = source.scope(tree)
        at_exit.variables |= known
        rows = until(rows, pattern_of(State(at_exit, source.ofs), ungrouped(stop), at_exit.record))
    scope = source.scope(tree)
    scope.variables |= known
    scope.unset = lambda name: literal("") if name not in SPECIAL else _unlowered(name)
    rules = tree.rules
    if len(rules) == 1 and rules[0].kind == "when" and not written_names(rules[0].patterns[0].walk()):
        # a filter of its own, which reaches the scan
        test = Lowering(scope).value(ungrouped(rules[0].patterns[0]))
        rows = rows.filter(test.column if test.kind == "bool" else test.test)
        rules = [Rule("always", (), rules[0].body if rules[0].body is not None else [Node("print", ([], None))])]
    state = State(scope, source.ofs, rows=rows)
    if "ORS" in known:
        ors = [n for n in tree.begin if n.args[0].args[1].args[0] == "ORS"][-1].args[0].args[2].args[0]
        if not str(ors).endswith("\n"):
            raise Unlowered("ORS without a line end")
        state.ors = str(ors)
    through(state, rules, source.fs)
    extra = state.ors[:-1]
    return emitted(state.rows, [F.concat(x, F.lit(extra)) if extra else x for x in state.lines])


def _unlowered(name: str) -> Value:
    raise Unlowered(name)


def until_exit(tree: Tree) -> tuple[Tree, Node | None]:
    """The pattern of the one rule that ends in ``exit`` after other actions, and the program with ``next`` there."""
    ends = [k for k, r in enumerate(tree.rules) if r.kind == "when" and r.body and len(r.body) > 1 and r.body[-1] == Node("exit", (None,))]
    others = sum(n.kind in ("exit", "next") for r in tree.rules for n in rule_nodes(r))
    if len(ends) != 1 or others != 1 or written_names(tree.rules[ends[0]].patterns[0].walk()):
        return tree, None
    r = tree.rules[ends[0]]
    rules = [*tree.rules[: ends[0]], Rule("when", r.patterns, [*r.body[:-1], Node("next")]), *tree.rules[ends[0] + 1 :]]
    return Tree(tree.begin, tree.end, tree.begin_file, tree.end_file, rules, tree.functions), r.patterns[0]


def without_exit(tree: Tree) -> tuple[Tree, int | None]:
    """``NR > k { exit }`` at the start as a limit."""
    if tree.rules and (r := tree.rules[0]).kind == "when" and r.body and len(r.body) == 1 and r.body[0].kind == "exit":
        p = ungrouped(r.patterns[0])
        if p.kind == "binary" and p.args[0] in (">", ">=", "==") and p.args[1] == Node("var", ("NR",)) and p.args[2].kind == "num":
            k = int(p.args[2].args[0])
            return Tree(tree.begin, tree.end, tree.begin_file, tree.end_file, tree.rules[1:], tree.functions), k if p.args[0] == ">" else k - 1
    for r in tree.rules:
        if any(n.kind in ("exit", "nextfile", "getline") for n in rule_nodes(r)):
            raise Unlowered("exit")
    return tree, None


# --- the first record of each key ------------------------------------------------------------------------------------


def _seen(p: Node) -> list[Node] | None:
    """The keys of ``!seen[...]++``."""
    p = ungrouped(p)
    if p.kind == "unary" and p.args[0] == "!":
        e = ungrouped(p.args[1])
        if e.kind == "step" and e.args[0] == "++" and not e.args[1] and e.args[2].kind == "index":
            return e.args[2].args[1]
    return None


def distinct(tree: Tree, source: Source) -> DataFrame:
    checked_end(tree)
    if len(tree.rules) != 1 or tree.rules[0].kind != "when" or (keys := _seen(tree.rules[0].patterns[0])) is None:
        raise Unlowered("not the first of each key")
    known = constants(tree, source)
    scope = source.scope(tree)
    scope.variables |= known
    low = Lowering(scope)
    rows = source.rows.select("*", *[low.value(k).str.alias(f"_k{i}") for i, k in enumerate(keys)])
    body = tree.rules[0].body if tree.rules[0].body is not None else [Node("print", ([], None))]
    whole = len(keys) == 1 and ungrouped(keys[0]) == Node("field", (Node("num", (0.0,)),)) and not source.columns and "value" in rows.columns
    if whole and not any(n.kind == "var" or n.kind == "call" for s in body for n in s.walk()):
        # the record is the key: nothing else of it has to be kept
        first = Ordered(rows.select("nr", "value"), "nr").first_seen("value", alone=True)
    else:
        first = Ordered(rows, "nr").first_seen(*[f"_k{i}" for i in range(len(keys))])
    rule = Rule("always", (), body)
    return stateless(Tree(tree.begin, rules=[rule], functions=tree.functions), Source(first, source.columns, source.fs, source.ofs, source.variables))


# --- ranges and last records -----------------------------------------------------------------------------------------


def ranges(tree: Tree, source: Source) -> DataFrame:
    checked_end(tree)
    if len(tree.rules) != 1 or tree.rules[0].kind != "range":
        raise Unlowered("not a single range")
    known = constants(tree, source)
    scope = source.scope(tree)
    scope.variables |= known
    state = State(scope, source.ofs)
    start, end = (pattern_of(state, ungrouped(p), scope.record) for p in tree.rules[0].patterns)
    inside = Ordered(source.numbered(), "nr").between(start, end)
    return _then(tree, source, inside, tree.rules[0].body)


def _then(tree: Tree, source: Source, rows: DataFrame, block: list[Node] | None) -> DataFrame:
    rule = Rule("always", (), block if block is not None else [Node("print", ([], None))])
    return stateless(Tree(tree.begin, rules=[rule], functions=tree.functions), Source(rows, source.columns, source.fs, source.ofs, source.variables))


def last_records(tree: Tree, source: Source) -> DataFrame:
    if len(tree.rules) == 1 and tree.rules[0].kind == "last" and not tree.end:
        n = ungrouped(tree.rules[0].patterns[0])
        if n.kind != "num":
            raise Unlowered("last of an expression")
        return _then(tree, source, source.rows.orderBy(F.desc("nr")).limit(int(n.args[0])), tree.rules[0].body)
    if not tree.rules and len(tree.end) == 1 and tree.end[0] == Node("print", ([], None)):
        return _then(tree, source, source.rows.orderBy(F.desc("nr")).limit(1), None)
    raise Unlowered("not the last records")


# --- two files -------------------------------------------------------------------------------------------------------


def first_file(r: Rule) -> bool:
    """Whether a rule's pattern is NR == FNR: the records of the first file."""
    p = ungrouped(r.patterns[0]) if r.patterns else None
    same = (Node("var", ("NR",)), Node("var", ("FNR",)))
    return p is not None and p.kind == "binary" and p.args[0] == "==" and (p.args[1], p.args[2]) in (same, same[::-1])


def _from_first(first: Rule, low: Lowering, build: DataFrame) -> dict[str, DataFrame]:
    """The arrays that the first file's rule makes: _k0, ... and _v, the last value or the count of each key."""
    arrays: dict[str, DataFrame] = {}
    for n in first.body[:-1]:
        e = ungrouped(n.args[0]) if n.kind == "expr" else None
        target = e.args[1] if e is not None and e.kind == "assign" else e.args[2] if e is not None and e.kind == "step" else None
        if target is None or target.kind != "index" or (e.kind == "assign" and e.args[0]) or target.args[0] in arrays:
            raise Unlowered("more than an array from the first file")
        keys = [low.value(k).str.alias(f"_k{i}") for i, k in enumerate(target.args[1])]
        if e.kind == "assign":
            v = low.value(e.args[2])
            made = F.max_by(v.str, F.col("nr"))
        else:
            made = F.count("*").cast("string")
        arrays[target.args[0]] = build.select("*", *keys).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(made.alias("_v"))
    return arrays


def _counting(n: Node) -> tuple[str, Node, Node, bool, list[Node]] | None:
    """Variable, first and last value, direction and body of ``for (i = a; i <= b; i++)`` or the like downwards."""
    if n.kind != "for" or any(part is None for part in n.args[:3]):
        return None
    start, test, step, block = n.args
    made = ungrouped(start.args[0]) if start.kind == "expr" else None
    turn = ungrouped(step.args[0]) if step.kind == "expr" else None
    if made is None or made.kind != "assign" or made.args[0] or made.args[1].kind != "var" or turn is None or turn.kind != "step" or test.kind != "binary":
        return None
    name, up = made.args[1], turn.args[0] == "++"
    if turn.args[2] != name or test.args[1] != name:
        return None
    op, end = test.args[0], test.args[2]
    if op == ">" and not up and end == Node("num", (0.0,)):
        op, end = ">=", Node("num", (1.0,))
    return (name.args[0], made.args[2], end, up, block) if op == ("<=" if up else ">=") else None


def by_number(tree: Tree, source: Source) -> DataFrame:
    """``a[NR] = e`` in every record, and an END loop over the numbers, up or down, that prints the cells."""
    if len(tree.rules) != 1 or tree.rules[0].kind != "always" or len(tree.rules[0].body or []) != 1 or len(tree.end) != 1:
        raise Unlowered("not a cell a record")
    n, one, number = tree.rules[0].body[0], Node("num", (1.0,)), Node("var", ("NR",))
    e = ungrouped(n.args[0]) if n.kind == "expr" else None
    found = _counting(tree.end[0])
    if e is None or found is None or e.kind != "assign" or e.args[0] or e.args[1].kind != "index" or e.args[1].args[1] != [number]:
        raise Unlowered("not a loop over records")
    name, first, last, up, block = found
    cell = Node("index", (e.args[1].args[0], [Node("var", (name,))]))
    if (first, last) != ((one, number) if up else (number, one)) or block != [Node("print", ([cell], None))]:
        raise Unlowered("not a loop over all records")
    known = constants(tree, source)
    scope = source.scope(tree)
    scope.variables |= known
    rows = source.rows
    out = emitted(rows, [Lowering(scope).value(e.args[2]).str])
    return out if up else out.withColumn("nr", -F.col("nr"))


def field_lookup(tree: Tree, source: Source, paths: int) -> DataFrame:
    """An array from the first file, and every field of other records replaced by its value where there is one.

    Fields are looked up as rows, and each record is put together again from its own.
    """
    checked_end(tree)
    if paths < 2 or len(tree.rules) != 2 or not first_file(tree.rules[0]) or not tree.rules[0].body or tree.rules[0].body[-1].kind != "next" or tree.rules[1].kind != "always" or source.columns:
        raise Unlowered("not fields looked up")
    body = tree.rules[1].body or []
    found = _counting(body[0]) if len(body) == 2 and body[1] == Node("print", ([], None)) else None
    if found is None or not found[3] or (found[1], found[2]) != (Node("num", (1.0,)), Node("var", ("NF",))) or len(found[4]) != 1:
        raise Unlowered("not a loop over fields")
    known = constants(tree, source)
    scope = source.scope(tree)
    scope.variables |= known
    arrays = _from_first(tree.rules[0], Lowering(scope), source.rows.filter("file = 0"))
    if len(arrays) != 1:
        raise Unlowered("not one array")
    (name, array), spot = next(iter(arrays.items())), Node("field", (Node("var", (found[0],)),))
    value = Node("index", (name, [spot]))
    if found[4][0] != Node("if", (Node("in", ([spot], name)), [Node("expr", (Node("assign", ("", spot, value)),))], [])) or len(array.columns) != 2:
        raise Unlowered("not a lookup of the field")
    rows = source.rows.filter("file > 0").select("nr", "value")
    words = rows.select("nr", F.posexplode(split_by(F.col("value"), source.fs)).alias("_at", "_word"))
    told = words.join(array, F.col("_word") == F.col("_k0"), "left")
    listed = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_v", "_word").alias("_new"))))
    made = told.groupBy(F.col("nr").alias("_nr")).agg(F.max(F.col("_v").isNotNull()).alias("_hit"), F.array_join(F.transform(listed, lambda x: x["_new"]), source.ofs).alias("_line")).filter("_hit")
    both = rows.join(made, F.col("nr") == F.col("_nr"), "left")
    return emitted(both, [F.coalesce("_line", "value")])


def running_count(tree: Tree, source: Source) -> DataFrame:
    """``a[k] = e; n = 0; for (x in a) n++``: the number of distinct keys so far, in every record."""
    checked_end(tree)
    if len(tree.rules) != 1 or tree.rules[0].kind != "always" or len(tree.rules[0].body or []) < 4:
        raise Unlowered("no running count")
    cell, zero, loop, *rest = tree.rules[0].body
    e = ungrouped(cell.args[0]) if cell.kind == "expr" else None
    z = ungrouped(zero.args[0]) if zero.kind == "expr" else None
    if e is None or e.kind not in ("assign", "step") or z is None or z.kind != "assign" or z.args[0] or z.args[1].kind != "var" or z.args[2] != Node("num", (0.0,)) or loop.kind != "forin":
        raise Unlowered("no running count")
    target, count = e.args[1] if e.kind == "assign" else e.args[2], z.args[1]
    step = Node("expr", (Node("step", ("++", False, count)),))
    if target.kind != "index" or len(target.args[1]) != 1 or loop.args[1] != target.args[0] or loop.args[3] != [step]:
        raise Unlowered("no running count")
    uses = [x for n in rest for x in n.walk() if x.kind in ("index", "in", "forin", "delete")]
    if uses or count.args[0] in written_names(x for n in rest for x in n.walk()):
        raise Unlowered("the array or its count is used elsewhere")
    known = constants(tree, source)
    scope = source.scope(tree)
    scope.variables |= known
    rows = source.numbered()
    rows = rows.select("*", Lowering(scope).value(target.args[1][0]).str.alias("_key"))
    rows = Ordered(rows, "nr").running_distinct("_key", "_count")
    scope.variables[count.args[0]] = Value(F.col("_count").cast("double"), "num")
    scope.unset = lambda name: literal("") if name not in SPECIAL else _unlowered(name)
    state = State(scope, source.ofs, rows=rows)
    through(state, [Rule("always", (), rest)], source.fs)
    return emitted(state.rows, state.lines)


def lookup(tree: Tree, source: Source, paths: int) -> DataFrame:
    checked_end(tree)
    if paths < 2 or len(tree.rules) < 2:
        raise Unlowered("not two files")
    first = tree.rules[0]
    if not first_file(first) or not first.body or first.body[-1].kind != "next":
        raise Unlowered("no array from the first file")
    known = constants(tree, source)
    scope = source.scope(tree)
    scope.variables |= known
    low = Lowering(scope)
    build, probe = source.rows.filter("file = 0"), source.rows.filter("file > 0")
    arrays = _from_first(first, low, build)
    rest = Tree(tree.begin, rules=tree.rules[1:], functions=tree.functions)
    if written_names(n for r in rest.rules for n in rule_nodes(r)) & set(arrays):
        raise Unlowered("the array changes later")
    joined: dict[str, tuple[str, int]] = {}
    for n in (x for r in rest.rules for x in rule_nodes(r)):
        name, keys = (n.args[1], n.args[0]) if n.kind == "in" else (n.args[0], n.args[1]) if n.kind == "index" else (None, None)
        if name in arrays and (spot := f"{name} {keys!r}") not in joined:
            joined[spot] = (name, k := len(joined))
            given = [low.value(x).str for x in keys]
            right = arrays[name].select(*[F.col(c).alias(f"_j{k}_{c}") for c in arrays[name].columns], F.lit(True).alias(f"_j{k}_there"))
            on = reduce(lambda a, b: a & b, [g == F.col(f"_j{k}__k{i}") for i, g in enumerate(given)])
            probe = probe.join(right, on, "left")

    def there(name: str, keys: list[Node]) -> Column:
        if (spot := f"{name} {keys!r}") not in joined:
            raise Unlowered(f"array {name}")
        return F.col(f"_j{joined[spot][1]}_there").isNotNull()

    def read(name: str, keys: list[Node]) -> Value:
        there(name, keys)
        return Value(F.coalesce(F.col(f"_j{joined[f'{name} {keys!r}'][1]}__v"), F.lit("")), "str")

    if carried_names(rest):
        raise Unlowered("carried variables")
    scope.array_has, scope.array_read, scope.unset = there, read, lambda name: literal("") if name not in SPECIAL else _unlowered(name)
    state = State(scope, source.ofs, rows=probe)
    through(state, rest.rules, source.fs)
    return emitted(state.rows, state.lines)


# --- values of earlier records ---------------------------------------------------------------------------------------


def _record_cell(changes: list[tuple[Rule, Node]]) -> bool:
    """Whether an array is only written as ``a[NR] = e``, in the first rule and for every record."""
    if len(changes) != 1 or changes[0][1] is None or changes[0][0].kind != "always":
        return False
    e = changes[0][1]
    return e.kind == "assign" and not e.args[0] and e.args[1].kind == "index" and e.args[1].args[1] == [Node("var", ("NR",))]


def earlier_cells(tree: Tree, cells: dict[str, Node], rows: DataFrame, low: Lowering):  # noqa: ANN201
    """How to read ``a[NR]`` and ``a[NR - k]``, and the rows with a column for each k that is read."""
    found: dict[tuple[str, int], Value] = {}
    for r in tree.rules if cells else ():
        for n in rule_nodes(r):
            if n.kind != "index" or n.args[0] not in cells or (n.args[0], k := _offset(n.args[1])) in found:
                continue
            v = low.value(cells[n.args[0]].args[2])
            if k == 0:
                found[n.args[0], 0] = v
                continue
            column = f"_e_{n.args[0]}_{k}"
            rows = Ordered(rows, "nr").earlier(v.column, k, column)
            found[n.args[0], k] = Value(F.coalesce(F.col(column), F.lit(0.0 if v.kind == "num" else "")), v.kind)

    def read(name: str, keys: list[Node]) -> Value:
        if name not in cells:
            raise Unlowered(f"array {name}")
        return found[name, _offset(keys)]

    return read, rows


def _offset(keys: list[Node]) -> int:
    """k of the key ``NR - k``."""
    e = ungrouped(keys[0]) if len(keys) == 1 else None
    if e == Node("var", ("NR",)):
        return 0
    if e is not None and e.kind == "binary" and e.args[0] == "-" and e.args[1] == Node("var", ("NR",)) and e.args[2].kind == "num" and e.args[2].args[0] >= 0:
        return int(e.args[2].args[0])
    raise Unlowered("cell of another record")


def ordered(tree: Tree, source: Source) -> DataFrame:
    """Carried scalars: ``v = e`` in every record (the value before), ``v += e`` and ``v++`` (a running sum)."""
    checked_end(tree)
    known = constants(tree, source)
    carried = carried_names(tree)
    if not carried:
        raise Unlowered("nothing is carried")
    scope = source.scope(tree)
    scope.variables |= known
    low = Lowering(scope)
    rows = source.numbered()
    changes: dict[str, list[tuple[Rule, Node]]] = {}
    for r in tree.rules:
        for n in r.body or []:
            e = ungrouped(n.args[0]) if n.kind == "expr" else None
            for w in written_names(n.walk()) & carried:
                changes.setdefault(w, []).append((r, e))
        if r.patterns and written_names(r.patterns[0].walk()):
            raise Unlowered("pattern with an effect")
    before: dict[str, Value] = {}
    after: dict[str, Value] = {}
    cells = {name: changes[name][0][1] for name in carried if _record_cell(changes.get(name, []))}
    read, rows = earlier_cells(tree, cells, rows, low)
    scope.array_read = read if cells else None
    for name in sorted(carried - set(cells)):
        (r, e), *more = changes.get(name, [(None, None)])
        if more or e is None or r.kind not in ("always", "when"):
            raise Unlowered(f"changes of {name}")
        when = None if r.kind == "always" else pattern_of(State(scope, source.ofs), ungrouped(r.patterns[0]), scope.record)
        column = f"_c_{name}"
        if e.kind == "assign" and not e.args[0] and e.args[1] == Node("var", (name,)) and when is None:
            v = low.value(e.args[2])
            rows = Ordered(rows, "nr").lag(v.column, column)
            before[name] = Value(F.coalesce(F.col(column), F.lit(0.0 if v.kind == "num" else "")), v.kind) if v.kind != "bool" else _unlowered("bool")
            after[name] = v
        elif (e.kind == "assign" and e.args[0] == "+" and e.args[1] == Node("var", (name,))) or (e.kind == "step" and e.args[0] == "++" and e.args[2] == Node("var", (name,))):
            step = low.value(e.args[2]).num if e.kind == "assign" else F.lit(1.0)
            step = step if when is None else F.when(when, step).otherwise(0.0)
            rows = Ordered(rows, "nr").running_sum(step, column)
            after[name] = Value(F.col(column).cast("double"), "num")
            before[name] = Value(F.col(column).cast("double") - step, "num")
        else:
            raise Unlowered(f"changes of {name}")
    state = State(scope, source.ofs, rows=rows)
    state.scope.variables |= before
    state.scope.unset = lambda name: literal("") if name not in SPECIAL else _unlowered(name)
    state.carried = set(carried)
    raw = state.scope.record
    for r in tree.rules:
        when = state.alive if r.kind == "always" else _both(state.alive, pattern_of(state, ungrouped(r.patterns[0]), raw))
        if r.body is None:
            state.emit(when, state.scope.record.str)
            continue
        for n in r.body:
            mine = written_names(n.walk()) & carried
            if mine <= set(cells) and mine:
                continue
            if mine:
                state.scope.variables = {**state.scope.variables, **{w: after[w] for w in mine}}
                continue
            if statement(state, n, when, source.fs) is not None:
                raise Unlowered("next among carried values")
    return emitted(state.rows, state.lines)


