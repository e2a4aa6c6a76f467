"""Accumulator programs: rules that only gather, and an END block over what they gathered.

Scalars become one global aggregate, arrays one aggregate for each set of keys. An END block of prints, conditions and
loops over keys is lowered as well; any other END block runs on the sequential machine over the aggregated rows, one
row for each array cell, never over the records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import aggregate
from .builtins import ARRAY_ARGUMENTS
from .columns import Lowering, Scope, Unlowered, Value, literal
from .lower import SPECIAL, Source, State, _both, constants, pattern_of, rule_nodes, statement, written_names, without_exit
from .syntax import Node, Tree, ungrouped

RESULT = "nr long, place int, n double, s string, line string"


@dataclass
class Gathered:
    """One accumulator: how it is aggregated, over which rows, by which keys (None: a scalar)."""

    name: str
    kind: str  # sum, last, concat
    rows: str  # "records" or "fields"
    keys: tuple[str, ...] | None
    key_columns: list[Column] = field(default_factory=list)
    parts: list[tuple[Column | None, Value]] = field(default_factory=list)
    sep: str = ""


def _sum_form(e: Node) -> tuple[Node, Node, float] | None:
    """(target, amount, sign) of ``t += e``, ``t++``, ``t = t + e`` and their negatives."""
    if e.kind == "step":
        return e.args[2], Node("num", (1.0,)), 1.0 if e.args[0] == "++" else -1.0
    if e.kind == "assign" and e.args[0] in ("+", "-"):
        return e.args[1], e.args[2], 1.0 if e.args[0] == "+" else -1.0
    if e.kind == "assign" and not e.args[0]:
        v = ungrouped(e.args[2])
        if v.kind == "binary" and v.args[0] in ("+", "-") and v.args[1] == e.args[1]:
            return e.args[1], v.args[2], 1.0 if v.args[0] == "+" else -1.0
    return None


def _concat_form(e: Node) -> tuple[Node, str, Node] | None:
    """(target, separator, amount) of ``t = t (t ? sep : "") e`` and ``t = t sep e``."""
    if e.kind != "assign" or e.args[0]:
        return None
    chain: list[Node] = []
    v = ungrouped(e.args[2])
    while v.kind == "concat":
        chain.insert(0, v.args[1])
        v = ungrouped(v.args[0])
    if v != e.args[1] or not chain:
        return None
    first = ungrouped(chain[0])
    if len(chain) == 2 and first.kind == "cond" and ungrouped(first.args[0]) == e.args[1] and first.args[1].kind == "str" and first.args[2] == Node("str", ("",)):
        return e.args[1], first.args[1].args[0], chain[1]
    if len(chain) == 1:
        return e.args[1], "", chain[0]
    return None


def _field_loop(n: Node) -> tuple[str, list[Node]] | None:
    """The variable and body of ``for (i = 1; i <= NF; i++)``."""
    if n.kind != "for" or n.args[0] is None or n.args[1] is None or n.args[2] is None:
        return None
    first, test, step = ungrouped(n.args[0].args[0]), ungrouped(n.args[1]), ungrouped(n.args[2].args[0])
    if first.kind != "assign" or first.args[0] or first.args[1].kind != "var" or first.args[2] != Node("num", (1.0,)):
        return None
    i = first.args[1]
    if test != Node("binary", ("<=", i, Node("var", ("NF",)))) or step.kind != "step" or step.args[0] != "++" or step.args[2] != i:
        return None
    return i.args[0], n.args[3]


class Gathering:
    def __init__(self, tree: Tree, source: Source):
        self.tree, self.source = tree, source
        self.known = constants(tree, source)
        self.scope = source.scope(tree)
        self.scope.variables |= self.known
        self.found: dict[str, Gathered] = {}
        self.fields: DataFrame | None = None
        self.targets = set()
        for r in tree.rules:
            self.targets |= written_names(rule_nodes(r))
        state = State(self.scope, source.ofs)
        for r in tree.rules:
            if r.kind not in ("always", "when"):
                raise Unlowered(r.kind)
            if r.kind == "when" and self._best(r.patterns[0], r.body or []):
                continue
            if r.body is None:
                raise Unlowered("prints records")
            when = state.alive
            if r.kind == "when":
                if written_names(r.patterns[0].walk()):
                    raise Unlowered("pattern with an effect")
                self._no_reads([r.patterns[0]])
                when = _both(when, pattern_of(state, ungrouped(r.patterns[0]), self.scope.record))
            stopped = self.block(r.body, when, Lowering(self.scope), "records")
            if stopped is not None:
                state.alive = _both(state.alive, ~stopped)

    def _no_reads(self, nodes: list[Node]) -> None:
        for n in nodes:
            for x in n.walk():
                if x.kind in ("var", "index") and x.args[0] in self.targets:
                    raise Unlowered(f"{x.args[0]} is read while it is gathered")

    def block(self, body: list[Node], when: Column | None, low: Lowering, rows: str) -> Column | None:
        stopped: Column | None = None
        for n in body:
            live = when if stopped is None else _both(when, ~stopped)
            if n.kind == "next":
                return live if stopped is None else stopped | (live if live is not None else F.lit(True))
            if n.kind == "block":
                stop = self.block(n.args[0], live, low, rows)
            elif n.kind == "if":
                self._no_reads([n.args[0]])
                t = low.value(n.args[0]).test
                a = self.block(n.args[1], _both(live, t), low, rows)
                b = self.block(n.args[2], _both(live, ~t), low, rows)
                stop = a if b is None else b if a is None else a | b
            elif n.kind == "for" and rows == "records" and (loop := _field_loop(n)):
                self.each_field(*loop, live)
                stop = None
            elif n.kind == "expr":
                self.gather(ungrouped(n.args[0]), live, low, rows)
                stop = None
            else:
                raise Unlowered(n.kind)
            if stop is not None:
                stopped = stop if stopped is None else stopped | stop
        return stopped

    def each_field(self, i: str, body: list[Node], when: Column | None) -> None:
        if self.fields is not None:
            raise Unlowered("two loops over fields")
        self.targets.discard(i)
        live = F.lit(True) if when is None else when
        self.fields = self.source.rows.filter(live).select("*", F.posexplode(self.scope.fields()).alias("_i", "_f"))
        own = Value(F.col("_f"), "str")

        class AtField(Lowering):
            def on_field(self, e: Node) -> Value:
                return own if ungrouped(e) == Node("var", (i,)) else super().on_field(e)

        inner = replace(self.scope, variables=self.scope.variables | {i: Value((F.col("_i") + 1).cast("double"), "num")})
        self.block(body, None, AtField(inner), "fields")

    def gather(self, e: Node, when: Column | None, low: Lowering, rows: str) -> None:
        if s := _sum_form(e):
            target, amount, sign = s
            self._no_reads([amount])
            v = low.value(amount)
            self.add(target, "sum", when, Value(v.num * sign if sign < 0 else v.num, "num"), low, rows)
        elif (c := _concat_form(e)) and e.args[1].kind == "index":
            self._no_reads([c[2]])
            self.add(c[0], "concat", when, low.value(c[2]), low, rows, c[1])
        elif e.kind == "assign" and not e.args[0] and e.args[1].kind in ("var", "index"):
            self._no_reads([e.args[2]])
            self.add(e.args[1], "last", when, low.value(e.args[2]), low, rows)
        elif e.kind == "call" and e.args[0] in ("collect", "acc", "accumulate") and e.args[1][0].kind == "var":
            name, v = e.args[1][0].args[0], low.value(e.args[1][1])
            kept = (v.str != "") & ~F.isnan(v.num) if v.kind == "str" else ~F.isnan(v.num)
            self.add(Node("index", (name, [Node("var", ("NR",))])), "last", _both(when, kept), v, low, rows)
        else:
            raise Unlowered("more than gathering")

    def add(self, target: Node, kind: str, when: Column | None, v: Value, low: Lowering, rows: str, sep: str = "") -> None:
        if target.kind not in ("var", "index") or target.args[0] in SPECIAL:
            raise Unlowered("target")
        name = target.args[0]
        keys = None
        columns: list[Column] = []
        if target.kind == "index":
            self._no_reads(target.args[1])
            keys = tuple(repr(k) for k in target.args[1])
            columns = [low.value(k).str for k in target.args[1]]
        old = self.found.get(name)
        if old:
            if (old.kind, old.rows, old.keys) != (kind, rows, keys) or kind != "sum":
                raise Unlowered(f"{name} is gathered in several ways")
        else:
            old = self.found[name] = Gathered(name, kind, rows, keys, columns, [], sep)
        old.parts.append((when, v))

    def _best(self, p: Node, body: list[Node]) -> bool:
        """``e > m { m = e; payload = x }``: the first record of the largest positive e (or smallest, with <)."""
        p = ungrouped(p)
        if p.kind != "binary" or p.args[0] not in (">",) or p.args[2].kind != "var":
            return False
        m = p.args[2].args[0]
        sets = [ungrouped(n.args[0]) for n in body if n.kind == "expr"]
        if len(sets) != len(body) or not all(s.kind == "assign" and not s.args[0] and s.args[1].kind == "var" for s in sets):
            return False
        if not any(s.args[1].args[0] == m and s.args[2] == p.args[1] for s in sets):
            return False
        low = Lowering(self.scope)
        by = low.value(p.args[1])
        order = F.struct(by.num.alias("v"), (-F.col("nr")).alias("o"))
        payloads = [(s.args[1].args[0], low.value(s.args[2])) for s in sets]
        for name, v in payloads:
            if name in self.found:
                raise Unlowered(f"{name} is gathered in several ways")
            self.found[name] = Gathered(name, "best", "records", None, [order], [(by.num > 0, v)])
        return True

    # aggregates

    def rows_of(self, rows: str) -> DataFrame:
        return self.source.rows if rows == "records" else self.fields

    def aggregates(self, g: Gathered) -> list[Column]:
        """The value of an accumulator, and whether it was ever written."""
        has = reduce(lambda a, b: a | b, [F.lit(True) if w is None else w for w, _ in g.parts])
        if g.kind == "sum":
            value = F.sum(reduce(lambda a, b: a + b, [v.num if w is None else F.when(w, v.num).otherwise(0.0) for w, v in g.parts]))
        elif g.kind == "best":
            when, v = g.parts[0]
            value = F.max_by(F.when(when, v.column), F.when(when, g.key_columns[0]))
        else:
            when, v = g.parts[0]
            order = F.struct("nr", "_i") if g.rows == "fields" else F.struct("nr")
            if g.kind == "last":
                value = F.max_by(v.column, order if when is None else F.when(when, order))
            else:
                listed = F.collect_list(F.struct(order.alias("o"), v.str.alias("v")) if when is None else F.when(when, F.struct(order.alias("o"), v.str.alias("v"))))
                value = F.array_join(F.transform(F.array_sort(listed), lambda x: x["v"]), g.sep)
        return [value.alias(f"v_{g.name}"), F.coalesce(F.bool_or(F.coalesce(has, F.lit(False))), F.lit(False)).alias(f"h_{g.name}")]

    def kind_of(self, g: Gathered) -> str:
        return "num" if g.kind == "sum" else "str" if g.kind == "concat" else g.parts[0][1].kind

    def scalars(self) -> DataFrame:
        """One row: all scalars and the number of records."""
        out = self.source.rows.agg(F.count("*").cast("double").alias("v_NR"), *[a for g in self.found.values() if g.keys is None and g.rows == "records" for a in self.aggregates(g)])
        more = [g for g in self.found.values() if g.keys is None and g.rows == "fields"]
        if more:
            other = self.fields.agg(*[a for g in more for a in self.aggregates(g)])
            out = out.select("*", *[other.select(c).scalar().alias(c) for c in other.columns])
        return out

    def group(self, name: str) -> tuple[tuple[str, tuple[str, ...]], DataFrame]:
        """The table of an array: its keys as texts k0.., values v_name and h_name, with all arrays of the same keys."""
        g = self.found[name]
        together = [o for o in self.found.values() if (o.rows, o.keys) == (g.rows, g.keys)]
        keys = [c.alias(f"k{i}") for i, c in enumerate(g.key_columns)]
        return (g.rows, g.keys), self.rows_of(g.rows).groupBy(*keys).agg(*[a for o in together for a in self.aggregates(o)])


# --- END as a plan ---------------------------------------------------------------------------------------------------


def _value(g: Gathering, name: str, column: Column | None = None, has: Column | None = None) -> Value:
    one = g.found[name]
    kind = g.kind_of(one)
    c, h = column if column is not None else F.col(f"v_{name}"), has if has is not None else F.col(f"h_{name}")
    default = F.lit(0.0) if kind == "num" else F.lit("") if kind == "str" else F.lit(False)
    return Value(F.coalesce(c, default), kind, F.coalesce(h, F.lit(False)))


_STATISTICS = {"sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg, "avg": F.avg, "variance": F.var_pop, "var": F.var_pop, "stddev": F.stddev_pop, "sd": F.stddev_pop, "min": F.min, "max": F.max}


def end_plan(g: Gathering, spark: SparkSession) -> DataFrame:
    scalars = g.scalars()
    arrays = {n for n, o in g.found.items() if o.keys is not None}
    at: list[State] = []  # the state that is being lowered: scalar subqueries become columns of its rows

    def bound(v: Value) -> Value:
        return Value(at[-1].bind(v.column), v.kind, v.has if v.has is None else at[-1].bind(v.has))

    def quantile_of(n: Node, array: str) -> float | None:
        """The percentage of a call that asks for a quantile of the array."""
        if n.kind != "call" or not n.args[1] or n.args[1][0] != Node("var", (array,)):
            return None
        name, args = n.args[0], n.args[1]
        if name in ("median", "med"):
            return 50.0 if len(args) == 1 else None
        if name in ("p", "percentile", "pct", "quantile", "q") and len(args) == 2 and args[1].kind == "num":
            return args[1].args[0] * (100 if name in ("quantile", "q") else 1)
        return None

    def statistic(name: str, args: list[Node]) -> Value | None:
        found = statistic_of(name, args)
        return None if found is None else bound(found)

    def statistic_of(name: str, args: list[Node]) -> Value | None:
        if not args or args[0].kind != "var" or args[0].args[0] not in arrays or name not in ARRAY_ARGUMENTS and name not in ("length", "len", "l"):
            return None
        array = args[0].args[0]
        table = g.group(array)[1].filter(F.col(f"h_{array}"))
        v = _value(g, array).num
        if name in ("length", "len", "l"):
            return Value(table.select(F.count("*").cast("double")).scalar(), "num")
        if name in _STATISTICS and len(args) == 1:
            return Value(F.coalesce(table.select(_STATISTICS[name](v).cast("double")).scalar(), F.lit(0.0)), "num")
        of = quantile_of(Node("call", (name, args)), array)
        if of is not None:
            # all quantiles of an array that END asks for are one plan, which runs once
            wanted = sorted({of, *(q for n in g.tree.end for x in n.walk() if (q := quantile_of(x, array)) is not None)})
            found = aggregate.exact_quantiles(table.select(v.alias("x")), "x", {f"q{k}": q for k, q in enumerate(wanted)})
            return Value(F.coalesce(found.select(F.struct(*found.columns)).scalar()[f"q{wanted.index(of)}"], F.lit(0.0)), "num")
        if name == "iqm" and len(args) == 1:
            return Value(F.coalesce(aggregate.interquartile_mean(table.select(v.alias("x")), "x").select("iqm").scalar(), F.lit(0.0)), "num")
        return None

    def unset(name: str) -> Value:
        if name in SPECIAL or name in arrays:
            raise Unlowered(name)
        return literal("")

    def scope(variables: dict[str, Value], read=None) -> Scope:  # noqa: ANN001
        nothing = F.array().cast("array<string>")
        return Scope(literal(""), lambda: nothing, lambda: F.lit(0), g.known | variables, tree=g.tree, array_read=read, aggregate=statistic, unset=unset)

    def global_values(as_scalar: bool) -> dict[str, Value]:
        pick = (lambda c: scalars.select(c).scalar()) if as_scalar else F.col
        out = {n: _value(g, n, pick(f"v_{n}"), pick(f"h_{n}")) for n, o in g.found.items() if o.keys is None}
        nr = Value(pick("v_NR"), "num")
        return out | {"NR": nr, "FNR": nr}

    def needed(nodes: list[Node]) -> dict[str, Value]:
        used = {x.args[0] for n in nodes for x in n.walk() if x.kind == "var"}
        return {k: bound(v) for k, v in global_values(True).items() if k in used}

    loops = [n for n in g.tree.end if n.kind == "forin"]
    if any(written_names(x for n in loop.args[3] for x in n.walk()) for loop in loops):
        raise Unlowered("a loop over keys that sets variables")
    if loops and written_names(x for n in g.tree.end if n.kind != "forin" for x in n.walk()):
        raise Unlowered("variables set between loops")
    outputs: list[DataFrame] = []
    pending: list[Node] = []

    def flush() -> None:
        if not pending:
            return
        state = State(scope(global_values(False)), g.source.ofs, rows=scalars)
        at.append(state)
        for n in pending:
            if statement(state, n, None, g.source.fs) is not None:
                raise Unlowered("next in END")
        if state.lines:
            structs = F.array(*[F.struct(F.lit(k).alias("place"), line.alias("line")) for k, line in enumerate(state.lines)])
            outputs.append(state.rows.select(F.inline(structs)).filter("line is not null").select(F.lit(len(outputs)).cast("long").alias("nr"), "place", F.lit(0.0).alias("n"), F.lit("").alias("s"), "line"))
        pending.clear()

    for n in g.tree.end:
        if n.kind != "forin":
            pending.append(n)
            continue
        flush()
        var, array, mode, body = n.args
        if array not in arrays:
            raise Unlowered(f"loop over {array}")
        group, table = g.group(array)
        table = table.filter(F.col(f"h_{array}"))
        count = len(g.found[array].keys)
        key = F.concat_ws("\x1c", *[F.col(f"k{i}") for i in range(count)])
        table = table.withColumn("_key", key)

        def read(name: str, keys: list[Node], group=group, var=var) -> Value:  # noqa: ANN001
            if name not in arrays or [ungrouped(k) for k in keys] != [Node("var", (var,))]:
                raise Unlowered(f"cell of {name}")
            if (g.found[name].rows, g.found[name].keys) != group:
                raise Unlowered("cell of another array")
            return _value(g, name)

        state = State(scope({}, read), g.source.ofs, rows=table)
        at.append(state)
        state.scope.variables |= needed(body) | {var: Value(F.col("_key"), "str")}
        for b in body:
            if statement(state, b, None, g.source.fs) is not None:
                raise Unlowered("next in END")
        number, text, sign = F.lit(0.0), F.lit(""), -1.0 if mode.startswith("r") else 1.0
        if mode in ("nsort", "rnsort"):
            number, text = coerce.to_number(F.col("_key")) * sign, F.col("_key")
        elif mode in ("val", "rval"):
            v = _value(g, array)
            number, text = (v.num if v.kind == "num" else coerce.to_number(v.str)) * sign, F.col("_key")
        elif mode == "sort":
            text = F.col("_key")
        elif mode == "rsort":
            if len(g.tree.end) > 1:
                raise Unlowered("falling text order among other output")
            number, text = F.lit(-1.0), F.col("_key")
        structs = F.array(*[F.struct(F.lit(k).alias("place"), line.alias("line")) for k, line in enumerate(state.lines)])
        if not state.lines:
            continue
        outputs.append(state.rows.select(number.alias("n"), text.alias("s"), F.inline(structs)).filter("line is not null").select(F.lit(len(outputs)).cast("long").alias("nr"), "place", "n", "s", "line"))
    flush()
    if not outputs:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, outputs)


# --- END on the machine, over the aggregates -------------------------------------------------------------------------


def end_machine(g: Gathering, spark: SparkSession) -> DataFrame:
    """Runs END in one task over (name, key, text, number) rows of the aggregates."""
    from .machine import Machine

    scalars = g.scalars()
    rows = [scalars.select(F.lit("NR").alias("name"), F.lit(None).cast("string").alias("key"), F.lit("").alias("text"), F.col("v_NR").alias("number"))]
    for name, one in g.found.items():
        table = scalars if one.keys is None else g.group(name)[1]
        v = _value(g, name)
        key = F.lit(None).cast("string") if one.keys is None else F.concat_ws("\x1c", *[F.col(f"k{i}") for i in range(len(one.keys))])
        numeric = v.kind != "str"
        rows.append(table.filter(F.col(f"h_{name}")).select(F.lit(name).alias("name"), key.alias("key"), (F.lit(None).cast("string") if numeric else v.column).alias("text"), (v.num if numeric else F.lit(None).cast("double")).alias("number")))
    tree = Tree(begin=g.tree.begin, end=g.tree.end, functions=g.tree.functions)
    options = {"variables": dict(g.source.variables), "fs": g.source.fs, "ofs": g.source.ofs, "columns": list(g.source.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(tree, **options)
        m.begin()
        for batch in batches:
            for name, key, text, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = number if number is not None else text
                if key is None:
                    m.vars[name] = v
                    if name == "NR":
                        m.vars["FNR"] = v
                else:
                    m.arrays.setdefault(name, {})[key] = v
        m.tree = Tree(end=tree.end, functions=tree.functions)
        m.pending = iter(())
        m.begin = lambda: None
        lines = "".join(s for target, s in m.run(()) if target is None).split("\n")
        if lines and lines[-1] == "":
            lines.pop()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array([0] * len(lines), pa.int32()), pa.array([0.0] * len(lines)), pa.array([""] * len(lines), pa.string()), pa.array(lines, pa.string())], ["nr", "place", "n", "s", "line"])

    return reduce(DataFrame.union, rows).coalesce(1).mapInArrow(run, RESULT)


def accumulated(tree: Tree, source: Source, spark: SparkSession) -> tuple[str, DataFrame]:
    """How END ran (accumulate or accumulate, then machine) and the output."""
    if not tree.end or tree.begin_file or tree.end_file:
        raise Unlowered("no END")
    tree, limit = without_exit(tree)
    if limit is not None:
        source.rows = source.rows.filter(F.col("nr") <= limit)
    if any(n.kind in ("getline",) or (n.kind == "field" and n.args[0] == Node("num", (0.0,))) or (n.kind == "print" and not n.args[0]) for b in tree.end for n in b.walk()):
        raise Unlowered("END uses the last record")
    g = Gathering(tree, source)
    try:
        return "accumulate", end_plan(g, spark)
    except Unlowered:
        if any(n.kind in ("print", "printf") and n.args[1] for b in tree.end for n in b.walk()):
            raise
        return "accumulate, then machine", end_machine(g, spark)
