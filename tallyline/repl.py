"""An interactive loop over the sequential machine: variables and arrays stay between lines."""

from __future__ import annotations

from typing import TextIO

from .cli import completed
from .lang.machine import Machine
from .lang.syntax import ProgramError, Tree, parse
from .lang.values import text


class Session:
    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.machine = Machine(Tree())
        self.hidden = set(self.machine.vars)

    def run(self, line: str) -> str:
        """The output of one line: a program, a bare call, or :vars, :reset."""
        line = line.strip()
        if line == ":reset":
            self.reset()
            return ""
        if line == ":vars":
            shown = {k: text(v) for k, v in self.machine.vars.items() if k not in self.hidden} | {k: f"array of {len(a)}" for k, a in self.machine.arrays.items() if k not in ("ENVIRON", "ARGV")}
            return "".join(f"{k} = {v}\n" for k, v in sorted(shown.items()))
        try:
            tree = parse(completed(line))
            if not (tree.begin or tree.end or tree.rules):
                return ""
            old = self.machine
            made = Machine(Tree(tree.begin, tree.end, functions=old.tree.functions | tree.functions, rules=tree.rules), shared=old)
            self.machine = made
            out = made.run([("", "", None)] if tree.rules else [])
            return "".join(s for target, s in out if target is None)
        except (ProgramError, PermissionError, RecursionError) as e:
            return f"error: {e}\n"


def loop(lines: TextIO, out: TextIO) -> None:
    s = Session()
    for line in lines:
        if line.strip() in (":q", ":quit"):
            return
        out.write(s.run(line))
        out.flush()
