"""The sequential machine: one record after the other, for programs whose state has no relational form.

Trees become Python closures once. Output is collected as (target, text): target None is standard output. Commands run
only where the caller allows them.
"""

from __future__ import annotations

import os
import random
import subprocess
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from .syntax import Node, ProgramError, Tree
from .values import NOTHING, arithmetic, compare, number, regex, smart_key, text, truthy

Expr = Callable[[], Any]


class Next(Exception):  # noqa: N818
    pass


class NextFile(Exception):  # noqa: N818
    pass


class Exit(Exception):  # noqa: N818
    pass


class Break(Exception):  # noqa: N818
    pass


class Continue(Exception):  # noqa: N818
    pass


class Return(Exception):  # noqa: N818
    def __init__(self, value: Any):
        self.value = value


class Machine:
    DEPTH = 200

    def __init__(self, tree: Tree, variables: dict[str, str] | None = None, fs: str = " ", ofs: str = " ", columns: list[str] | None = None, arguments: list[str] | None = None, commands: bool = False, opener: Callable[[str], Iterable[str]] | None = None, shared: Machine | None = None):
        self.tree, self.commands, self.opener = tree, commands, opener
        self.vars: dict[str, Any] = {"FS": fs, "OFS": ofs, "RS": "\n", "ORS": "\n", "SUBSEP": "\x1c", "OFMT": "%.6g", "CONVFMT": "%.6g", "NR": 0.0, "FNR": 0.0, "NF": 0.0, "FILENAME": "", "RSTART": 0.0, "RLENGTH": -1.0}
        self.vars |= variables or {}
        self.arrays: dict[str, dict[str, Any]] = {"ENVIRON": dict(os.environ), "ARGV": {str(i): a for i, a in enumerate(arguments or [])}}
        self.vars["ARGC"] = float(len(arguments or []))
        self.histograms: dict[str, dict[str, float]] = {}
        self.out: list[tuple[str | None, str]] = []
        self.record, self.fields = "", []
        self.split_done = True
        self.raw = ""
        self.code = 0
        self.depth = 0
        self.random = random.Random(0)
        self.seed: Any = 0.0
        self.regexes: dict[str, Any] = {}
        self.readers: dict[str, Iterator[str]] = {}
        self.timers: dict[str, float] = {"": time.perf_counter()}
        self.pending: Iterator[tuple[str, str, list[str] | None]] | None = None
        self.ranges: dict[int, bool] = {}
        if columns:
            self.arrays["HDR"] = {str(i): c for i, c in enumerate(columns, 1)} | {c: str(i) for i, c in enumerate(columns, 1)}
            for i, c in enumerate(columns, 1):
                if c.isidentifier():
                    self.vars.setdefault(c, float(i))
        self.columns = {c: i for i, c in enumerate(columns or [], 1)}
        if shared is not None:  # goes on with another machine's variables
            self.vars, self.arrays, self.random = shared.vars, shared.arrays, shared.random
        self.array_names = _array_names(tree) | (set(shared.arrays) if shared else set())
        self.functions = {name: (names, self.block(body)) for name, (names, body) in tree.functions.items()}
        self.begin, self.end = self.block(tree.begin), self.block(tree.end)
        self.begin_file, self.end_file = self.block(tree.begin_file), self.block(tree.end_file)
        self.rules = [(r, [self.pattern(p) for p in r.patterns], self.block(r.body) if r.body is not None else None) for r in tree.rules]

    # records

    def set_record(self, record: str, fields: list[str] | None = None) -> None:
        self.record, self.split_done = record, fields is not None
        self.fields = fields or []
        self.vars["NF"] = float(len(self.fields)) if fields is not None else None

    def need_fields(self) -> list[str]:
        if not self.split_done:
            self.fields = self.split_text(self.record, text(self.vars["FS"]))
            self.split_done = True
            self.vars["NF"] = float(len(self.fields))
        return self.fields

    def split_text(self, s: str, sep: str) -> list[str]:
        if sep == " ":
            return s.split()
        if s == "":
            return []
        return s.split(sep) if len(sep) == 1 else self.compiled(sep).split(s)

    def field(self, n: int) -> str:
        if n == 0:
            return self.record
        fields = self.need_fields()
        if n < 0:
            n += len(fields) + 1
            if n <= 0:
                return self.record
        return fields[n - 1] if n <= len(fields) else ""

    def set_field(self, n: int, value: str) -> None:
        if n == 0:
            self.set_record(value)
            return
        fields = self.need_fields()
        if n < 0:
            n += len(fields) + 1
        fields.extend([""] * (n - len(fields)))
        fields[n - 1] = value
        self.joined()

    def joined(self) -> None:
        self.vars["NF"] = float(len(self.fields))
        self.record = text(self.vars["OFS"]).join(self.fields)

    def compiled(self, pattern: str) -> Any:
        if pattern not in self.regexes:
            self.regexes[pattern] = regex(pattern)
        return self.regexes[pattern]

    # running

    def run(self, records: Iterable[tuple[str, str, list[str] | None]]) -> list[tuple[str | None, str]]:
        """Runs over (file name, record, fields or None); returns the output."""
        t = self.tree
        self.pending = iter(records)
        try:
            self.begin()
            if t.rules or t.end or t.begin_file or t.end_file:
                self.consume()
        except Exit:
            pass
        try:
            for k, (r, patterns, body) in enumerate(self.rules):
                if r.kind == "last":
                    n = int(number(patterns[0]()))
                    for name, record, fields in (self.held.get(k, []))[-n:] if n > 0 else []:
                        self.set_record(record, list(fields) if fields is not None else None)
                        try:
                            self.act(body)
                        except Next:
                            pass
            self.end()
        except Exit:
            pass
        return self.out

    held: dict[int, list[tuple[str, str, list[str] | None]]]

    def consume(self) -> None:
        self.held = {}
        current: str | None = None
        skipped: str | None = None
        for name, record, fields in self.pending:
            if name != current:
                if current is not None:
                    self.end_file()
                current, skipped = name, None
                self.vars["FILENAME"], self.vars["FNR"] = name, 0.0
                self.begin_file()
            if name == skipped:
                continue
            self.vars["NR"] = number(self.vars["NR"]) + 1
            self.vars["FNR"] = number(self.vars["FNR"]) + 1
            self.set_record(record, list(fields) if fields is not None else None)
            try:
                self.rules_on(name, record, fields)
            except Next:
                pass
            except NextFile:
                skipped = name
        if current is not None:
            self.end_file()

    def rules_on(self, name: str, record: str, fields: list[str] | None) -> None:
        self.raw = record
        for k, (r, patterns, body) in enumerate(self.rules):
            if r.kind == "always" or (r.kind == "when" and truthy(patterns[0]())):
                self.act(body)
            elif r.kind == "range":
                if self.ranges.get(k):
                    self.ranges[k] = not truthy(patterns[1]())
                    self.act(body)
                elif truthy(patterns[0]()):
                    self.ranges[k] = True
                    self.act(body)
            elif r.kind == "last":
                kept = self.held.setdefault(k, [])
                kept.append((name, record, fields))
                limit = max(1, int(number(patterns[0]())))
                if len(kept) > 2 * limit:
                    del kept[:-limit]

    def act(self, body: Callable[[], None] | None) -> None:
        if body is None:
            self.emit(None, self.record + text(self.vars["ORS"]))
        else:
            body()

    def emit(self, target: str | None, s: str) -> None:
        self.out.append((target, s))

    # statements

    def block(self, body: list[Node] | None) -> Callable[[], None]:
        steps = [self.statement(n) for n in body or []]
        if len(steps) == 1:
            return steps[0]

        def run() -> None:
            for s in steps:
                s()

        return run

    def statement(self, n: Node) -> Callable[[], None]:
        return getattr(self, f"do_{n.kind}")(*n.args)

    def do_block(self, body: list[Node]) -> Callable[[], None]:
        return self.block(body)

    def do_expr(self, e: Node) -> Callable[[], None]:
        f = self.expr(e)

        def run() -> None:
            f()

        return run

    def do_print(self, args: list[Node], redirect: tuple[str, Node] | None) -> Callable[[], None]:
        if len(args) == 1 and args[0].kind == "var" and args[0].args[0] in self.array_names and redirect is None:
            return self.print_array(args[0].args[0])
        parts, to = [self.expr(a) for a in args], self.target(redirect)

        def run() -> None:
            v = self.vars
            if parts:
                s = text(v["OFS"]).join(text(p(), v["OFMT"]) for p in parts)
            else:
                s = self.record
            self.send(to, s + text(v["ORS"]))

        return run

    def print_array(self, name: str) -> Callable[[], None]:
        def run() -> None:
            a, end = self.arrays.get(name, {}), text(self.vars["ORS"])
            sequential = all(str(i) in a for i in range(1, len(a) + 1))
            rows = [text(a[str(i)]) for i in range(1, len(a) + 1)] if sequential else sorted(a, key=smart_key)
            for r in rows:
                self.emit(None, r + end)

        return run

    def do_printf(self, args: list[Node], redirect: tuple[str, Node] | None) -> Callable[[], None]:
        parts, to = [self.expr(a) for a in args], self.target(redirect)

        def run() -> None:
            values = [p() for p in parts]
            self.send(to, self.sprintf(values))

        return run

    def sprintf(self, values: list[Any]) -> str:
        from ..functions.printf import sprintf, unescape

        return sprintf(unescape(text(values[0])), [v if isinstance(v, float) else text(v) for v in values[1:]], number, text) if values else ""

    def target(self, redirect: tuple[str, Node] | None) -> tuple[str, Expr] | None:
        return (redirect[0], self.expr(redirect[1])) if redirect else None

    def send(self, to: tuple[str, Expr] | None, s: str) -> None:
        if to is None:
            self.emit(None, s)
            return
        kind, name = to[0], text(to[1]())
        if kind == "|" and not self.commands:
            raise PermissionError("pipes to commands aren't allowed here")
        if name == "/dev/stdout":
            self.emit(None, s)
        else:
            self.emit(f"{kind if kind == '|' else ''}{name}", s)

    def do_if(self, test: Node, then: list[Node], other: list[Node]) -> Callable[[], None]:
        t, a, b = self.expr(test), self.block(then), self.block(other)

        def run() -> None:
            if truthy(t()):
                a()
            else:
                b()

        return run

    def looped(self, body: Callable[[], None]) -> bool:
        """Runs a body; true if it broke out."""
        try:
            body()
        except Break:
            return True
        except Continue:
            pass
        return False

    def do_while(self, test: Node, body: list[Node]) -> Callable[[], None]:
        t, b = self.expr(test), self.block(body)

        def run() -> None:
            while truthy(t()) and not self.looped(b):
                pass

        return run

    def do_do(self, body: list[Node], test: Node) -> Callable[[], None]:
        t, b = self.expr(test), self.block(body)

        def run() -> None:
            while not self.looped(b) and truthy(t()):
                pass

        return run

    def do_for(self, first: Node | None, test: Node | None, step: Node | None, body: list[Node]) -> Callable[[], None]:
        a = self.statement(first) if first else None
        t = self.expr(test) if test else None
        s = self.statement(step) if step else None
        b = self.block(body)

        def run() -> None:
            if a:
                a()
            while (t is None or truthy(t())) and not self.looped(b):
                if s:
                    s()

        return run

    def do_forin(self, name: str, array: str, mode: str, body: list[Node]) -> Callable[[], None]:
        b = self.block(body)

        def run() -> None:
            a = self.arrays.get(array, {})
            for k in self.ordered(a, mode):
                self.vars[name] = k
                if self.looped(b):
                    return

        return run

    def ordered(self, a: dict[str, Any], mode: str) -> list[str]:
        if mode in ("sort", "rsort"):
            return sorted(a, reverse=mode == "rsort")
        if mode in ("nsort", "rnsort"):
            return sorted(sorted(a), key=number, reverse=mode == "rnsort")
        if mode in ("val", "rval"):
            return sorted(sorted(a), key=lambda k: smart_key(text(a[k])), reverse=mode == "rval")
        return list(a)

    def _raise(self, error: type[Exception]) -> Callable[[], None]:
        def run() -> None:
            raise error

        return run

    def do_next(self) -> Callable[[], None]:
        return self._raise(Next)

    def do_nextfile(self) -> Callable[[], None]:
        return self._raise(NextFile)

    def do_break(self) -> Callable[[], None]:
        return self._raise(Break)

    def do_continue(self) -> Callable[[], None]:
        return self._raise(Continue)

    def do_exit(self, code: Node | None) -> Callable[[], None]:
        c = self.expr(code) if code else None

        def run() -> None:
            if c:
                self.code = int(number(c()))
            raise Exit

        return run

    def do_return(self, value: Node | None) -> Callable[[], None]:
        v = self.expr(value) if value else None

        def run() -> None:
            raise Return(v() if v else None)

        return run

    def do_delete(self, name: str, keys: list[Node] | None) -> Callable[[], None]:
        k = self.key(keys) if keys else None

        def run() -> None:
            if k is None:
                self.arrays.pop(name, None)
                self.histograms.pop(name, None)
            else:
                self.arrays.get(name, {}).pop(k(), None)

        return run

    # expressions

    def pattern(self, n: Node) -> Expr:
        if n.kind == "re":
            found = self.compiled(n.args[0]).search
            return lambda: 1.0 if found(self.raw) else 0.0
        return self.expr(n)

    def expr(self, n: Node) -> Expr:
        return getattr(self, f"ex_{n.kind}")(*n.args)

    def ex_num(self, value: float) -> Expr:
        return lambda: value

    def ex_str(self, value: str) -> Expr:
        return lambda: value

    def ex_re(self, source: str) -> Expr:
        found = self.compiled(source).search
        return lambda: 1.0 if found(self.record) else 0.0

    def ex_group(self, e: Node) -> Expr:
        return self.expr(e)

    def ex_var(self, name: str) -> Expr:
        if name == "NF":
            return lambda: float(len(self.need_fields()))
        if name == "length" and name not in self.vars:
            return lambda: float(len(self.record))
        get = self.vars.get
        return lambda: get(name)

    def key(self, keys: list[Node]) -> Callable[[], str]:
        parts = [self.expr(k) for k in keys]
        if len(parts) == 1:
            one = parts[0]
            return lambda: text(one(), self.vars["CONVFMT"])
        return lambda: text(self.vars["SUBSEP"]).join(text(p(), self.vars["CONVFMT"]) for p in parts)

    def ex_index(self, name: str, keys: list[Node]) -> Expr:
        k = self.key(keys)
        return lambda: self.arrays.get(name, {}).get(k())

    def ex_field(self, e: Node) -> Expr:
        n = self.place(e)
        return lambda: self.field(n())

    def place(self, e: Node) -> Callable[[], int]:
        if e.kind == "num":
            n = int(e.args[0])
            return lambda: n
        if e.kind in ("str", "var") and self.columns:
            name = e.args[0]
            if name in self.columns:
                n = self.columns[name]
                return lambda: n
            if e.kind == "str" or (name not in self.vars and not _assigned(self.tree, name)):
                raise ProgramError(1, 1, f"no column {name!r}")
        f = self.expr(e)

        def run() -> int:
            v = f()
            if isinstance(v, str) and v in self.columns:
                return self.columns[v]
            return int(number(v))

        return run

    def ex_unary(self, op: str, e: Node) -> Expr:
        f = self.expr(e) if not (op == "!" and e.kind == "re") else self.pattern(e)
        if op == "!":
            return lambda: 0.0 if truthy(f()) else 1.0
        return (lambda: -number(f())) if op == "-" else (lambda: number(f()))

    def ex_binary(self, op: str, a: Node, b: Node) -> Expr:
        x, y = self.expr(a), self.expr(b)
        if op in ("<", "<=", ">", ">=", "==", "!="):
            return lambda: 1.0 if compare(op, x(), y()) else 0.0
        return lambda: arithmetic(op, number(x()), number(y()))

    def ex_and(self, a: Node, b: Node) -> Expr:
        x, y = self.expr(a), self.expr(b)
        return lambda: 1.0 if truthy(x()) and truthy(y()) else 0.0

    def ex_or(self, a: Node, b: Node) -> Expr:
        x, y = self.expr(a), self.expr(b)
        return lambda: 1.0 if truthy(x()) or truthy(y()) else 0.0

    def ex_cond(self, c: Node, a: Node, b: Node) -> Expr:
        t, x, y = self.expr(c), self.expr(a), self.expr(b)
        return lambda: x() if truthy(t()) else y()

    def ex_default(self, a: Node, b: Node) -> Expr:
        x, y = self.expr(a), self.expr(b)

        def run() -> Any:
            v = x()
            return y() if v is None or v is NOTHING or v == "" else v

        return run

    def ex_try(self, e: Node) -> Expr:
        f = self.expr(e)

        def run() -> Any:
            v = f()
            return NOTHING if v is None or v == "" else v

        return run

    def ex_fence(self, e: Node) -> Expr:
        f = self.expr(e)

        def run() -> Any:
            v = f()
            return "" if v is NOTHING else v

        return run

    def ex_match(self, negated: bool, a: Node, b: Node) -> Expr:
        x, found = self.expr(a), self.searcher(b)
        return lambda: 1.0 if bool(found(text(x()))) != negated else 0.0

    def searcher(self, e: Node) -> Callable[[str], Any]:
        if e.kind == "re":
            return self.compiled(e.args[0]).search
        f = self.expr(e)
        return lambda s: self.compiled(text(f())).search(s)

    def ex_in(self, keys: list[Node], name: str) -> Expr:
        k = self.key(keys)
        return lambda: 1.0 if k() in self.arrays.get(name, {}) else 0.0

    def ex_concat(self, a: Node, b: Node) -> Expr:
        x, y = self.expr(a), self.expr(b)

        def run() -> Any:
            u = x()
            v = y()
            if u is NOTHING or v is NOTHING:
                return NOTHING
            f = self.vars["CONVFMT"]
            return text(u, f) + text(v, f)

        return run

    def setter(self, target: Node) -> tuple[Expr, Callable[[Any], None]]:
        """Functions that read and write a place; its key or number is worked out once for both."""
        if target.kind == "var":
            name = target.args[0]

            def put(v: Any) -> None:
                v = "" if v is NOTHING else v
                if name == "NF":
                    fields = self.need_fields()
                    n = max(0, int(number(v)))
                    self.fields = (fields + [""] * n)[:n]
                    self.joined()
                else:
                    self.vars[name] = v

            return self.ex_var(name), put
        if target.kind == "index":
            name, k = target.args[0], self.key(target.args[1])
            held: list[str] = []

            def get() -> Any:
                held[:] = [k()]
                return self.arrays.get(name, {}).get(held[-1])

            def put_cell(v: Any) -> None:
                self.arrays.setdefault(name, {})[held.pop() if held else k()] = "" if v is NOTHING else v

            return get, put_cell
        if target.kind == "field":
            n = self.place(target.args[0])
            places: list[int] = []

            def get_field() -> Any:
                places[:] = [n()]
                return self.field(places[-1])

            def put_field(v: Any) -> None:
                self.set_field(places.pop() if places else n(), text(v, self.vars["CONVFMT"]))

            return get_field, put_field
        raise ProgramError(1, 1, "not a place to assign to")

    def ex_assign(self, op: str, target: Node, value: Node) -> Expr:
        get, put = self.setter(target)
        f = self.expr(value)
        if not op:

            def run() -> Any:
                v = f()
                put(v)
                return v

            return run

        def update() -> Any:
            old = number(get())
            v = arithmetic(op, old, number(f()))
            put(v)
            return v

        return update

    def ex_step(self, op: str, prefix: bool, target: Node) -> Expr:
        get, put = self.setter(target)
        by = 1.0 if op == "++" else -1.0

        def run() -> Any:
            old = number(get())
            put(old + by)
            return old + by if prefix else old

        return run

    def ex_getline(self, target: Node | None, source: Node | None, command: Node | None) -> Expr:
        put = self.setter(target)[1] if target else None
        f = self.expr(source or command) if source or command else None

        def run() -> float:
            if f is None:
                for name, record, fields in self.pending or ():
                    self.vars["NR"] = number(self.vars["NR"]) + 1
                    self.vars["FNR"] = number(self.vars["FNR"]) + 1
                    self.vars["FILENAME"] = name
                    if put:
                        put(record)
                    else:
                        self.set_record(record, list(fields) if fields is not None else None)
                    return 1.0
                return 0.0
            name = text(f())
            try:
                reader = self.reader(name, command is not None)
            except OSError:
                return -1.0
            record = next(reader, None)
            if record is None:
                return 0.0
            if put:
                put(record)
            else:
                self.set_record(record)
            return 1.0

        return run

    def reader(self, name: str, command: bool) -> Iterator[str]:
        key = f"{'|' if command else ''}{name}"
        if key not in self.readers:
            if command:
                if not self.commands:
                    raise PermissionError("commands aren't allowed here")
                done = subprocess.run(["sh", "-c", name], capture_output=True, text=True, check=False)
                self.readers[key] = iter(done.stdout.splitlines())
            else:
                self.readers[key] = iter(self.opened(name))
        return self.readers[key]

    def opened(self, name: str) -> Iterable[str]:
        if self.opener:
            return self.opener(name)
        with open(name, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()

    # calls

    def ex_call(self, name: str, args: list[Node]) -> Expr:
        from .builtins import ARRAY_FIRST, PURE, STATEFUL

        if name in STATEFUL and not (name in self.tree.functions and name not in ARRAY_FIRST):
            return STATEFUL[name](self, args)
        if name in self.tree.functions:
            parts = [self.expr(a) for a in args]
            return lambda: self.invoke(name, [p() for p in parts])
        if name in PURE:
            f, parts = PURE[name], [self.expr(a) for a in args]
            return lambda: f(*[p() for p in parts])
        raise ProgramError(1, 1, f"no function {name!r}")

    def invoke(self, name: str, values: list[Any]) -> Any:
        from .builtins import PURE, STATEFUL

        if name not in self.functions:
            if name in PURE:
                return PURE[name](*values)
            if name in STATEFUL:
                return STATEFUL[name](self, [Node("str", (text(v),)) for v in values])()
            raise ProgramError(1, 1, f"no function {name!r}")
        names, body = self.functions[name]
        if self.depth >= self.DEPTH:
            raise RecursionError(f"{name} calls itself too deeply")
        saved = {n: self.vars.get(n) for n in names}
        for i, n in enumerate(names):
            self.vars[n] = values[i] if i < len(values) else None
        self.depth += 1
        try:
            body()
        except Return as r:
            return r.value
        finally:
            self.depth -= 1
            self.vars |= saved
        return None


def _assigned(tree: Tree, name: str) -> bool:
    return any(n.kind in ("assign", "step") and any(isinstance(a, Node) and a.kind == "var" and a.args[0] == name for a in n.args) or (n.kind == "forin" and n.args[0] == name) for n in tree.nodes()) or any(name in names for names, _ in tree.functions.values())


def _array_names(tree: Tree) -> set[str]:
    from .builtins import ARRAY_ARGUMENTS

    out = set()
    for n in tree.nodes():
        if n.kind == "index" or n.kind == "delete":
            out.add(n.args[0])
        elif n.kind in ("in", "forin"):
            out.add(n.args[1])
        elif n.kind == "call":
            for place in ARRAY_ARGUMENTS.get(n.args[0], ()):
                if place < len(n.args[1]) and n.args[1][place].kind == "var" and n.args[0] not in ("min", "max", "rev", "reverse", "length", "len", "l"):
                    out.add(n.args[1][place].args[0])
    return out
