"""The command line: programs over files, and tools that run nothing."""

from __future__ import annotations

import argparse
import os
import re
import sys

from .lang.builtins import PURE, STATEFUL
from .lang.syntax import ProgramError, parse

_CALL = re.compile(r"\s*([A-Za-z_]\w*)\s*\(.*\)\s*", re.DOTALL)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyline", description="Pattern-action programs on Spark.")
    p.add_argument("-F", dest="fs", default=" ", help="input field separator")
    p.add_argument("-O", dest="ofs", default=" ", help="output field separator")
    p.add_argument("-t", dest="tab", action="store_true", help="tab-separated output")
    p.add_argument("-v", dest="variables", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("-f", dest="files", action="append", default=[], help="read the program from a file")
    p.add_argument("-i", dest="mode", choices=["text", "csv", "tsv", "json", "parquet"])
    p.add_argument("-H", dest="header", action="store_true", help="the first record names columns")
    p.add_argument("-d", "--describe", action="store_true")
    p.add_argument("-S", "--suggest", action="store_true")
    for name in ("repl", "highlight", "format", "explain"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--commands", action="store_true", help="allow programs to run commands (in one task)")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--version", action="version", version="tallyline 0.1.0")
    p.add_argument("words", nargs="*")
    return p


def completed(source: str) -> str:
    """A bare call prints its result for each record, or once if it looks at none."""
    m = _CALL.fullmatch(source)
    if not m or (m[1] not in PURE and m[1] not in STATEFUL):
        return source
    tree = parse(f"{{ print {source} }}")
    reads = any(n.kind == "field" or (n.kind == "var" and n.args[0] in ("NR", "NF", "FNR", "FILENAME")) for n in tree.nodes()) or source.rstrip().endswith("()")
    return f"{{ print {source} }}" if reads else f"BEGIN {{ print {source} }}"


def split_words(words: list[str], from_files: bool) -> tuple[str | None, list[str]]:
    """The program and its files; a path may come first, and files alone are printed."""
    if from_files or not words:
        return None, words
    if os.path.exists(words[0]):
        rest = [w for w in words[1:] if not os.path.exists(w)]
        if len(rest) == 1:
            return rest[0], [w for w in words if w != rest[0]]
        if not rest:
            return "{ print }", words
    return words[0], words[1:]


def main(argv: list[str] | None = None) -> int:
    o = arguments().parse_intermixed_args(argv)
    source, paths = split_words(o.words, bool(o.files))
    if o.files:
        parts = []
        for name in o.files:
            with open(name, encoding="utf-8") as f:
                parts.append(f.read())
        source = "\n".join(parts)
    try:
        return _run(o, source, paths)
    except ProgramError as e:
        print(f"tallyline: {e}", file=sys.stderr)
        return 2
    except (OSError, PermissionError, ValueError) as e:
        print(f"tallyline: {e}", file=sys.stderr)
        return 1


def _run(o: argparse.Namespace, source: str | None, paths: list[str]) -> int:
    from .lang.explain import explain
    from .lang.formatting import formatted, highlighted

    if o.highlight or o.format:
        print(highlighted(source or "") if o.highlight else formatted(source or ""), end="\n" if o.highlight else "")
        return 0
    if o.explain:
        print(explain(source or ""))
        return 0
    if o.repl:
        from .repl import loop

        loop(sys.stdin, sys.stdout)
        return 0
    if source is None and not (o.describe or o.suggest):
        arguments().print_usage(sys.stderr)
        return 2
    if not (o.describe or o.suggest):
        parse(completed(source))  # errors before Spark starts
    from .session import session

    spark = session(o.master)
    spark.sparkContext.setLogLevel("ERROR")
    if o.describe or o.suggest:
        from .describe import describe, suggest

        for path in o.words:
            schema = describe(spark, path)
            print(schema.text(path))
            for what, program in suggest(schema) if o.suggest else ():
                print(f"\n  # {what}\n  {program}")
        return 0
    from .lang import Program

    given = dict(v.split("=", 1) for v in o.variables)
    program = Program(completed(source), o.fs, "\t" if o.tab else o.ofs, o.mode, o.header, given, o.commands)
    tree = program.tree
    if not paths and (tree.rules or tree.end):
        from .lang.machine import Machine

        m = Machine(tree, variables=given, fs=o.fs, ofs=program.ofs, commands=o.commands)
        for target, text in m.run(("", line.rstrip("\n"), None) for line in sys.stdin):
            print(text, end="", file=sys.stdout if target is None else sys.stderr)
        return m.code
    for row in program.run(spark, paths).ordered().toLocalIterator():
        print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
