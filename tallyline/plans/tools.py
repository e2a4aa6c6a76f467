"""Queries over what stands around programs: descriptions, explanations, layout, errors, side outputs, and invariants of
what is drawn at random."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cli
from ..describe import describe, suggest
from ..functions import jsons
from ..lang import Program
from ..lang.explain import explain
from ..lang.formatting import formatted
from ..lang.machine import Machine
from ..lang.syntax import ProgramError, parse
from ..operators import sets
from ..repl import Session
from ..sources import readers
from ..sources.scratch import scratch
from ..sources.writers import write_delimited, write_lines
from .registry import Tables, on_tables


def _rows(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    """SQL for stated rows."""
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


def _machine(program: str, **options) -> list[tuple[str, str]]:  # noqa: ANN003
    """(target, text) of what a program without input writes; its standard output has the target ""."""
    return [(target or "", text) for target, text in Machine(parse(program), **options).run(())]


# --- values ---------------------------------------------------------------------------------------------------------


@on_tables("scf_09_escapes", "SELECT n_name || chr(9) || '[' || n_nationkey || chr(92) || ']\"' AS line FROM nation")
def _(t: Tables) -> DataFrame:
    return Program(r'{ printf "%s\t[%d\\]\"\n", $n_name, $n_nationkey }').on(t.spark, t.nation, "n_nationkey").lines


@on_tables("jsn_03_broken_json", "SELECT event_id, '' AS cut, '' AS bare, json_extract_string(props, '$.k') AS whole FROM events")
def _(t: Tables) -> DataFrame:
    cut, bare = F.expr("left(props, length(props) - 1)"), F.concat(F.lit("k: "), "event_type")
    return t.events.select("event_id", jsons.jpath(cut, ".k").alias("cut"), jsons.jpath(bare, ".k").alias("bare"), jsons.jpath(F.col("props"), ".k").alias("whole"))


# --- control and side outputs -----------------------------------------------------------------------------------------


@on_tables("ctl_02_begin_end", "SELECT 'from the start' AS line UNION ALL SELECT count(*) || ' suppliers' FROM supplier")
def _(t: Tables) -> DataFrame:
    return Program('BEGIN { print "from the start" } { n++ } END { print n, "suppliers" }').on(t.spark, t.supplier, "s_suppkey").lines


@on_tables("ctl_02_file_hooks", "SELECT 'regions ' || count(*) AS line FROM region UNION ALL SELECT 'nations ' || count(*) FROM nation")
def _(t: Tables) -> DataFrame:
    paths = []
    for name, column in (("regions", "r_name"), ("nations", "n_name")):
        paths.append(scratch(t.spark, name))
        write_lines(getattr(t, name[:-1]).select(F.col(column).alias("line")).coalesce(1), paths[-1])
    program = 'BEGINFILE { n = 0; what = FILENAME ~ /regions/ ? "regions" : "nations" } { n++ } ENDFILE { print what, n }'
    return Program(program).run(t.spark, paths).lines


_SIDES = [("", "kept\n"), ("/dev/stderr", "aside\n"), ("a.txt", "one\ntwo\n"), ("", "after\n")]


@on_tables("snk_06_07_targets", _values([(target, text.strip()) for target, text in _SIDES], "target, text"))
def _(t: Tables) -> DataFrame:
    program = 'BEGIN { print "kept"; print "aside" > "/dev/stderr"; print "one" > "a.txt"; print "two" > "a.txt"; close("a.txt"); fflush(); print "after" }'
    merged: list[list[str]] = []
    for target, text in _machine(program):
        if merged and merged[-1][0] == target:
            merged[-1][1] += text
        else:
            merged.append([target, text])
    return _rows(t, [(a, b.strip()) for a, b in merged], "target string, text string")


@on_tables("snk_08_system", _values([("said by a command",), ("status 3",)], "line"))
def _(t: Tables) -> DataFrame:
    out = _machine('BEGIN { system("echo said by a command"); print "status", system("exit 3") }', commands=True)
    return _rows(t, [(x,) for x in "".join(s for _, s in out).splitlines()], "line string")


@on_tables("dgn_01_dump", _values([("dump: array depth (2 elements)",), ("  [ebb] 3",), ("  [flood] 11",), ("dump: string calm",)], "line"))
def _(t: Tables) -> DataFrame:
    out = _machine('BEGIN { depth["flood"] = 11; depth["ebb"] = 3; dump(depth, "log"); dump("calm", "log") }')
    return _rows(t, [(x,) for target, s in out if target == "log" for x in s.splitlines()], "line string")


# --- tools ----------------------------------------------------------------------------------------------------------


@on_tables("tol_01_describe", _values([("c_custkey", "Int"), ("c_name", "String"), ("c_acctbal", "Float"), ("c_mktsegment", "String")], "name, kind"))
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "customers") + ".csv"
    write_delimited(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return _rows(t, [(c.name, c.kind) for c in describe(t.spark, path).columns], "name string, kind string")


@on_tables("tol_02_suggest", "SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """The suggested count by a text column, run as suggested."""
    schema = describe(t.spark, f"{t.folder}/customer.parquet")
    program = next(p for what, p in suggest(schema) if what == "count by c_mktsegment")
    lines = Program(program).on(t.spark, t.customer, "c_custkey").lines
    return lines.select(F.split("line", " ", 2)[1].alias("k"), F.split("line", " ", 2)[0].cast("long").alias("n"))


_EXPLAINED = [
    ("!met[$1]++", "distinct by $1"),
    ("{ n[$2]++ } END { for (k in n) print k, n[k] }", "count by $2"),
    ("{ h[$1] += $3 } END { for (k in h) print k, h[k] }", "sum of $3 by $1"),
    ("/ebb/, /flood/", "print records: /ebb/ to /flood/"),
    ("last 4", "print records: the last 4"),
    ("END { print NR }", "count records"),
]


@on_tables("tol_03_explain", _values(_EXPLAINED, "program, said"))
def _(t: Tables) -> DataFrame:
    return _rows(t, [(p, explain(p)) for p, _ in _EXPLAINED], "program string, said string")


_LAYOUT = [("{n[$1]++}END{for(k in n)print k,n[k]}", "{ n[$1]++ } END { for (k in n) { print k, n[k] } }"), ("NR==2", "NR == 2")]


@on_tables("tol_04_format", _values(_LAYOUT, "program, laid_out"))
def _(t: Tables) -> DataFrame:
    return _rows(t, [(p, " ".join(formatted(p).split())) for p, _ in _LAYOUT], "program string, laid_out string")


_DIALOGUE = [("BEGIN { knots = 12; port[2] = 5 }", ""), ("BEGIN { print knots * port[2] }", "60"), ('toupper("ahoy")', "AHOY"), (":vars", "knots = 12; port = array of 1"), (":reset", ""), (":vars", "")]


@on_tables("tol_05_repl", _values(_DIALOGUE, "said, answer"))
def _(t: Tables) -> DataFrame:
    s = Session()
    return _rows(t, [(line, "; ".join(sorted(s.run(line).splitlines()))) for line, _ in _DIALOGUE], "said string, answer string")


@on_tables("tol_06_cli", "SELECT n_regionkey || ' ' || count(*) AS line FROM nation GROUP BY n_regionkey")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "nations")
    write_lines(t.nation.select(F.concat_ws(",", "n_nationkey", "n_regionkey").alias("line")), path)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main(["-F", ",", "{ n[$2]++ } END { for (k in n) print k, n[k] }", path])
    return _rows(t, [(x,) for x in out.getvalue().splitlines()], "line string")


_ERRORS = [("{ print", 1, 8), ("BEGIN { x = }", 1, 13), ("{\n  a[ }", 2, 6), ("/x", 1, 1)]


@on_tables("err_01_located", _values([(p, line, place) for p, line, place in _ERRORS], "program, line, place"))
def _(t: Tables) -> DataFrame:
    def where(program: str) -> tuple[str, int, int]:
        try:
            parse(program)
        except ProgramError as e:
            line, place, *_ = str(e).split(":")
            return program, int(line), int(place)
        return program, 0, 0

    return _rows(t, [where(p) for p, *_ in _ERRORS], "program string, line int, place int")


# --- invariants of what has no one result -----------------------------------------------------------------------------


@on_tables("smp_01_sample_invariant", "SELECT least(100, count(*)) AS n, least(100, count(*)) AS own FROM orders")
def _(t: Tables) -> DataFrame:
    """As many as asked for, no row twice, and only rows of the table."""
    drawn = sets.sample(t.orders, 100, F.col("o_orderkey"), 42).select("o_orderkey")
    return drawn.join(t.orders.select(F.col("o_orderkey").alias("k")), F.col("o_orderkey") == F.col("k"), "left_semi").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("own"))


@on_tables("smp_02_shuffle_invariant", "SELECT c_custkey FROM customer")
def _(t: Tables) -> DataFrame:
    return sets.shuffled(t.customer, F.col("c_custkey"), 7).select("c_custkey")


@on_tables("smp_03_bernoulli_invariant", "SELECT true AS within, 0 AS strangers FROM (SELECT 1)")
def _(t: Tables) -> DataFrame:
    """Its share within five deviations of the rate, and only rows of the table."""
    drawn = sets.bernoulli(t.orders, 0.2, F.col("o_orderkey"), 42).select(F.col("o_orderkey").alias("k"))
    n, all_rows = F.count("k"), t.orders.select(F.count("*")).scalar()
    strangers = drawn.join(t.orders, F.col("k") == F.col("o_orderkey"), "left_anti").select(F.count("*")).scalar()
    return drawn.agg((F.abs(n - 0.2 * all_rows) <= 5 * F.sqrt(0.16 * all_rows)).alias("within"), F.first(strangers).cast("int").alias("strangers"))


@on_tables("mth_07_rand_invariant", "SELECT true AS bounds, true AS again, true AS middle")
def _(t: Tables) -> DataFrame:
    """From 0 up to 1, the same after the same seed, and even on average."""
    draw = lambda: [float(x) for x in "".join(s for _, s in _machine("BEGIN { srand(5); for (k = 0; k < 2000; k++) print rand() }")).split()]
    one, two = draw(), draw()
    return _rows(t, [(all(0 <= x < 1 for x in one), one == two, abs(sum(one) / len(one) - 0.5) < 0.05)], "bounds boolean, again boolean, middle boolean")


@on_tables("src_17_variable", _values([("HARBOUR_OF_TEST", "Emden 4")], "name, value"))
def _(t: Tables) -> DataFrame:
    import os

    os.environ["HARBOUR_OF_TEST"] = "Emden 4"
    return readers.environment(t.spark, ["HARBOUR_OF_TEST"])
