"""What a program does in a few words, and how it will run."""

from __future__ import annotations

from .formatting import expression
from .lower import _seen, rule_nodes
from .syntax import Node, Rule, Tree, parse, ungrouped

WIDTH = 60
_STATISTICS = {"mean": "mean", "avg": "mean", "median": "median", "med": "median", "stddev": "standard deviation", "sd": "standard deviation", "variance": "variance", "var": "variance", "p": "percentile", "percentile": "percentile", "pct": "percentile", "quantile": "quantile", "q": "quantile", "iqm": "interquartile mean", "sum": "sum", "hist": "histogram", "plot": "chart", "plotbox": "chart"}


def short(text: str, width: int = WIDTH) -> str:
    return text if len(text) <= width else f"{text[: width - 1]}…"


def _keys(nodes: list[Node]) -> str:
    return ", ".join(expression(k) for k in nodes)


def _lookup(tree: Tree) -> str | None:
    first = tree.rules[0] if tree.rules else None
    if first is None or not first.patterns or expression(ungrouped(first.patterns[0])) not in ("NR == FNR", "FNR == NR") or len(tree.rules) < 2:
        return None
    second = tree.rules[1]
    p = ungrouped(second.patterns[0]) if second.patterns else None
    if p is not None and p.kind == "in":
        return f"{'join' if second.body else 'matching rows'} by {_keys(p.args[0])}"
    if p is not None and p.kind == "unary" and p.args[0] == "!" and ungrouped(p.args[1]).kind == "in":
        return f"rows without a match by {_keys(ungrouped(p.args[1]).args[0])}"
    return "lookup from the first file"


def _aggregation(tree: Tree) -> str | None:
    found = []
    for r in tree.rules:
        for n in rule_nodes(r):
            target, value = (n.args[2], None) if n.kind == "step" else (n.args[1], n.args[2]) if n.kind == "assign" and n.args[0] == "+" else (None, None)
            if target is None or target.kind not in ("index", "var"):
                continue
            what = "count" if value is None else f"sum of {expression(value)}"
            if value is None and r.kind == "when" and r.patterns and target.kind == "var":
                what = f"count of {_pattern(r)}"
            found.append(f"{what} by {_keys(target.args[1])}" if target.kind == "index" else what)
    return ", ".join(dict.fromkeys(found)) if found and tree.end else None


def _pattern(r: Rule) -> str:
    if r.kind == "range":
        return f"{expression(r.patterns[0])} to {expression(r.patterns[1])}"
    if r.kind == "last":
        return f"the last {expression(r.patterns[0])}"
    p = ungrouped(r.patterns[0])
    if p.kind == "binary" and p.args[0] == "==" and p.args[1] == Node("binary", ("%", Node("var", ("NR",)), p.args[1].args[2] if p.args[1].kind == "binary" else None)):
        return f"every {expression(p.args[1].args[2])} records"
    return expression(p)


def _rule(r: Rule) -> str:
    prints = [n for n in r.body or [] for n in n.walk() if n.kind in ("print", "printf")]
    if r.body is None:
        what = "print records"
    elif prints:
        what = f"print {', '.join(expression(a) for a in prints[0].args[0]) or 'records'}"
    else:
        what = "; ".join(expression(n.args[0]) for n in r.body if n.kind == "expr") or "act"
    return what if r.kind == "always" else f"{what} where {_pattern(r)}" if r.kind == "when" and "every" not in _pattern(r) else f"{what}: {_pattern(r)}"


def explain(source: str, width: int = WIDTH) -> str:
    """By idiom: distinct, join, statistics, count, aggregation, and else rule by rule."""
    return short(_explained(parse(source)), width)


def _explained(tree: Tree) -> str:
    for r in tree.rules:
        if r.kind == "when" and (keys := _seen(r.patterns[0])):
            return f"distinct by {_keys(keys)}"
    if found := _lookup(tree):
        return found
    called = [_STATISTICS[n.args[0]] for b in tree.end for n in b.walk() if n.kind == "call" and n.args[0] in _STATISTICS]
    if called:
        return f"{', '.join(dict.fromkeys(called))} of records"
    if not tree.rules and [expression(a) for n in tree.end if n.kind == "print" for a in n.args[0]] == ["NR"]:
        return "count records"
    if found := _aggregation(tree):
        return found
    parts = [_rule(r) for r in tree.rules]
    if not parts and tree.begin:
        parts = ["generate output without input"]
    if not parts and tree.end:
        parts = ["print the last record" if tree.end[0] == Node("print", ([], None)) else "act after the last record"]
    return "; ".join(parts)
