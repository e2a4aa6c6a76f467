"""Tokens and syntax trees of pattern-action programs.

A tree node is a ``Node``: a kind, and its parts in ``args``. Expressions:

num(value) str(value) re(source) var(name) index(name, [keys]) field(expr) unary(op, e) binary(op, a, b) and(a, b)
or(a, b) cond(c, a, b) default(a, b) try(e) fence(e) match(negated, text, pattern) in([keys], name) concat(a, b)
assign(op, target, value) step(op, prefix, target) call(name, [args]) getline(target, file, command)

Statements: expr(e) print([args], redirect) printf([args], redirect) if while do for forin block next nextfile
exit return break continue delete; a redirect is (kind, target) or None.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class ProgramError(ValueError):
    """A located syntax error: ``line:column: message``."""

    def __init__(self, line: int, column: int, message: str):
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column = line, column


@dataclass(frozen=True)
class Token:
    kind: str  # num str re name func key op newline end
    text: str
    line: int
    column: int
    value: Any = None


@dataclass
class Node:
    kind: str
    args: tuple = ()

    def walk(self):  # noqa: ANN201
        """This node and all below it."""
        yield self
        stack = list(self.args)
        while stack:
            x = stack.pop(0)
            if isinstance(x, Node):
                yield from x.walk()
            elif isinstance(x, (list, tuple)):
                stack = [*x, *stack]


@dataclass
class Rule:
    """kind: always, when, range, last; ``body`` None prints the record."""

    kind: str
    patterns: tuple[Node, ...]
    body: list[Node] | None


@dataclass
class Tree:
    begin: list[Node] = field(default_factory=list)
    end: list[Node] = field(default_factory=list)
    begin_file: list[Node] = field(default_factory=list)
    end_file: list[Node] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    functions: dict[str, tuple[list[str], list[Node]]] = field(default_factory=dict)

    def nodes(self):  # noqa: ANN201
        blocks = [self.begin, self.end, self.begin_file, self.end_file, *(b for _, b in self.functions.values())]
        for block in blocks:
            for n in block:
                yield from n.walk()
        for r in self.rules:
            for n in (*r.patterns, *(r.body or ())):
                yield from n.walk()


KEYWORDS = frozenset("BEGIN END BEGINFILE ENDFILE function func if else while do for in break continue next nextfile exit return delete print printf getline every last".split())
_PLAIN = re.compile(
    r"(?P<space>[ \t\r]+|\\\r?\n|\#[^\n]*)|(?P<newline>\n)"
    r"|(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>\*\*=|\+\+|--|\*\*|&&|\|\||\?\?|==|!=|<=|>=|>>|!~|\+=|-=|\*=|/=|%=|\^=|[-+*/%^<>=!~?:,;(){}\[\]$|@])"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "/": "/", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, start = 0, 1, 0
    while at < len(source):
        column = at - start + 1
        c = source[at]
        if c == '"':
            text, at = _string(source, at + 1, line, column)
            out.append(Token("str", text, line, column, text))
            continue
        if c == "/" and _regex_may_start(out):
            text, at = _regex(source, at + 1, line, column)
            out.append(Token("re", text, line, column, text))
            continue
        m = _PLAIN.match(source, at)
        if not m:
            raise ProgramError(line, column, f"unexpected character {c!r}")
        at = m.end()
        kind = m.lastgroup
        text = m[0]
        if kind == "newline" or (kind == "space" and text.endswith("\n")):
            if kind == "newline":
                out.append(Token("newline", "\n", line, column))
            line, start = line + 1, at
        elif kind == "num":
            out.append(Token("num", text, line, column, float(int(text, 16)) if text[:2].lower() == "0x" else float(text)))
        elif kind == "name":
            if text in KEYWORDS:
                out.append(Token("key", text, line, column))
            else:
                out.append(Token("func" if source[at : at + 1] == "(" else "name", text, line, column))
        elif kind == "op":
            out.append(Token("op", text, line, column, column > 1 and source[column - 2 + start] in " \t"))
    out.append(Token("end", "", line, at - start + 1))
    return out


def _regex_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    return not (last.kind in ("num", "str", "name", "func") or (last.kind == "op" and last.text in (")", "]", "$", "++", "--")))


def _string(source: str, at: int, line: int, column: int) -> tuple[str, int]:
    out = []
    while at < len(source) and source[at] != '"':
        c = source[at]
        if c == "\n":
            break
        if c == "\\" and at + 1 < len(source):
            at += 1
            c = _ESCAPES.get(source[at], "\\" + source[at])
        out.append(c)
        at += 1
    if at >= len(source) or source[at] != '"':
        raise ProgramError(line, column, "string without end")
    return "".join(out), at + 1


def _regex(source: str, at: int, line: int, column: int) -> tuple[str, int]:
    out, in_class = [], False
    while at < len(source) and (source[at] != "/" or in_class):
        c = source[at]
        if c == "\n":
            break
        if c == "\\" and at + 1 < len(source):
            out.append("/" if source[at + 1] == "/" else source[at : at + 2])
            at += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append(c)
        at += 1
    if at >= len(source) or source[at] != "/":
        raise ProgramError(line, column, "regular expression without end")
    return "".join(out), at + 1


#: Binary operators by how tightly they bind; concatenation binds at CONCAT.
BINDS = {"||": 10, "&&": 20, "in": 30, "~": 40, "!~": 40, "<": 50, "<=": 50, "==": 50, "!=": 50, ">": 50, ">=": 50, "+": 70, "-": 70, "*": 80, "/": 80, "%": 80, "**": 100, "^": 100}
CONCAT = 60
UNARY = 90
ASSIGNMENTS = frozenset("= += -= *= /= %= **= ^=".split())
MODIFIERS = {"sort": "sort", "asc": "sort", "rsort": "rsort", "desc": "rsort", "nsort": "nsort", "numasc": "nsort", "rnsort": "rnsort", "numdesc": "rnsort", "val": "val", "valasc": "val", "rval": "rval", "valdesc": "rval"}


class Parser:
    def __init__(self, source: str):
        self.all = tokens(source)
        self.at = 0
        self.no_in = self.no_greater = False

    # tokens

    @property
    def now(self) -> Token:
        return self.all[self.at]

    def fail(self, message: str) -> ProgramError:
        return ProgramError(self.now.line, self.now.column, message)

    def sees(self, *texts: str) -> bool:
        return self.now.kind in ("op", "key") and self.now.text in texts

    def take(self, text: str) -> bool:
        if self.sees(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.sees(text):
            raise self.fail(f"expected {text!r}, found {self.now.text or self.now.kind!r}")
        self.at += 1
        return self.all[self.at - 1]

    def lines(self) -> None:
        while self.now.kind == "newline":
            self.at += 1

    def ends(self) -> None:
        while self.now.kind == "newline" or self.sees(";"):
            self.at += 1

    # programs

    def program(self) -> Tree:
        tree = Tree()
        self.ends()
        while self.now.kind != "end":
            self.item(tree)
            self.ends()
        return tree

    def item(self, tree: Tree) -> None:
        for word, block in (("BEGIN", tree.begin), ("END", tree.end), ("BEGINFILE", tree.begin_file), ("ENDFILE", tree.end_file)):
            if self.take(word):
                self.lines()
                block.extend(self.block())
                return
        if self.sees("function", "func"):
            self.at += 1
            name = self.now.text
            self.at += 1
            self.need("(")
            names: list[str] = []
            while not self.take(")"):
                names.append(self.now.text)
                self.at += 1
                self.take(",")
                self.lines()
            self.lines()
            tree.functions[name] = (names, self.block())
            return
        if self.sees("{"):
            tree.rules.append(Rule("always", (), self.block()))
            return
        if self.take("every"):
            n = self.expression()
            test = Node("binary", ("==", Node("binary", ("%", Node("var", ("NR",)), n)), Node("num", (0.0,))))
            tree.rules.append(Rule("when", (test,), self.body()))
            return
        if self.take("last"):
            tree.rules.append(Rule("last", (self.expression(),), self.body()))
            return
        first = self.expression()
        if self.take(","):
            self.lines()
            tree.rules.append(Rule("range", (first, self.expression()), self.body()))
        else:
            tree.rules.append(Rule("when", (first,), self.body()))

    def body(self) -> list[Node] | None:
        return self.block() if self.sees("{") else None

    # statements

    def block(self) -> list[Node]:
        self.need("{")
        out: list[Node] = []
        self.ends()
        while not self.take("}"):
            if self.now.kind == "end":
                raise self.fail("block without end")
            out.append(self.statement())
            self.ends()
        return out

    def inner(self) -> list[Node]:
        self.lines()
        if self.sees("{"):
            return self.block()
        if self.take(";"):
            return []
        return [self.statement()]

    def statement(self) -> Node:
        if self.sees("{"):
            return Node("block", (self.block(),))
        for word in ("next", "nextfile", "break", "continue"):
            if self.take(word):
                return Node(word)
        if self.take("exit") or self.take("return"):
            word = self.all[self.at - 1].text
            bare = self.now.kind in ("newline", "end") or self.sees(";", "}")
            return Node(word, (None if bare else self.expression(),))
        if self.take("delete"):
            name = self.now.text
            self.at += 1
            keys = self.keys() if self.take("[") else None
            return Node("delete", (name, keys))
        if self.take("if"):
            test = self.test()
            then = self.inner()
            mark = self.at
            self.ends()
            if self.take("else"):
                return Node("if", (test, then, self.inner()))
            self.at = mark
            return Node("if", (test, then, []))
        if self.take("while"):
            test = self.test()
            return Node("while", (test, self.inner()))
        if self.take("do"):
            body = self.inner()
            self.ends()
            self.need("while")
            return Node("do", (body, self.test()))
        if self.take("for"):
            return self.loop()
        return self.simple()

    def test(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def loop(self) -> Node:
        self.need("(")
        if self.now.kind in ("name", "func") and self.all[self.at + 1].text == "in" and self.all[self.at + 2].kind == "name" and self.all[self.at + 3].text == ")":
            name, array = self.now.text, self.all[self.at + 2].text
            self.at += 4
            mode = ""
            if self.take("@"):
                mode = MODIFIERS.get(self.now.text, "")
                if not mode:
                    raise self.fail(f"unknown order @{self.now.text}")
                self.at += 1
            return Node("forin", (name, array, mode, self.inner()))
        first = None if self.sees(";") else self.simple()
        self.need(";")
        self.lines()
        test = None if self.sees(";") else self.expression()
        self.need(";")
        self.lines()
        step = None if self.sees(")") else self.simple()
        self.need(")")
        return Node("for", (first, test, step, self.inner()))

    def simple(self) -> Node:
        if self.sees("print", "printf"):
            word = self.now.text
            self.at += 1
            return self.printing(word)
        return Node("expr", (self.expression(),))

    def printing(self, word: str) -> Node:
        args: list[Node] = []
        before, self.no_greater = self.no_greater, True
        if not (self.now.kind in ("newline", "end") or self.sees(";", "}", ">", ">>", "|")):
            if self.sees("(") and self._whole_list():
                self.at += 1
                self.no_greater = False
                args = self.arguments(")")
                self.no_greater = True
            else:
                args.append(self.expression())
                while self.take(","):
                    self.lines()
                    args.append(self.expression())
        self.no_greater = before
        redirect = None
        for kind in (">", ">>", "|"):
            if self.take(kind):
                redirect = (kind, self.concatenation())
                break
        return Node(word, (args, redirect))

    def _whole_list(self) -> bool:
        """Whether the parenthesis here holds a list that ends the statement's arguments."""
        depth, k, comma = 0, self.at, False
        while k < len(self.all):
            t = self.all[k]
            if t.kind == "op":
                depth += (t.text in "([{") - (t.text in ")]}")
                comma = comma or (t.text == "," and depth == 1)
                if depth == 0:
                    after = self.all[k + 1]
                    return comma and (after.kind in ("newline", "end") or (after.kind == "op" and after.text in (";", "}", ">", ">>", "|")))
            k += 1
        return False

    # expressions

    def arguments(self, close: str) -> list[Node]:
        out: list[Node] = []
        before, self.no_greater = self.no_greater, False
        inside, self.no_in = self.no_in, False
        self.lines()
        while not self.take(close):
            out.append(self.expression())
            self.lines()
            if not self.sees(close):
                self.need(",")
                self.lines()
        self.no_greater, self.no_in = before, inside
        return out

    def keys(self) -> list[Node]:
        return self.arguments("]")

    def expression(self) -> Node:
        """Assignment, the conditional and ``??``, all from the right."""
        left = self.operators(0)
        if self.now.kind == "op" and self.now.text in ASSIGNMENTS and left.kind in ("var", "index", "field"):
            op = self.now.text
            self.at += 1
            self.lines()
            return Node("assign", (op[:-1].replace("^", "**"), left, self.expression()))
        if self.take("??"):
            self.lines()
            return Node("default", (left, self.expression()))
        if self.sees("?"):
            self.at += 1
            self.lines()
            then = self.expression()
            self.lines()
            self.need(":")
            self.lines()
            return Node("cond", (left, then, self.expression()))
        return left

    def concatenation(self) -> Node:
        return self.operators(CONCAT)

    def _conditional_follows(self) -> bool:
        """Whether the ``?`` here has a ``:`` of its own."""
        depth, k = 0, self.at + 1
        while k < len(self.all):
            t = self.all[k]
            if t.kind == "end" or (t.kind == "newline" and depth == 0 and self.all[k - 1].text not in ("?", ":")):
                return False
            if t.kind == "op":
                if t.text in "([{":
                    depth += 1
                elif t.text in ")]}":
                    depth -= 1
                    if depth < 0:
                        return False
                elif depth == 0 and t.text in (";", ","):
                    return False
                elif depth == 0 and t.text == ":":
                    return True
            k += 1
        return False

    def operators(self, least: int) -> Node:
        left = self.prefix()
        while True:
            t = self.now
            if t.kind == "op" and t.text == "?" and not self._conditional_follows():
                self.at += 1
                left = Node("try", (left,))
                continue
            if t.kind == "op" and t.text == "|" and self.all[self.at + 1].text == "getline" and least <= CONCAT:
                self.at += 2
                left = Node("getline", (self.getline_target(), None, left))
                continue
            word = t.text if t.kind in ("op", "key") else ""
            bind = BINDS.get(word)
            if bind is not None and not (word == "in" and self.no_in) and not (word == ">" and self.no_greater):
                if bind < least:
                    return left
                if word in ("**", "^"):
                    self.at += 1
                    left = Node("binary", ("**", left, self.operators(bind)))
                    continue
                self.at += 1
                if word == "in":
                    left = Node("in", ([left], self.name()))
                    continue
                if word in ("&&", "||"):
                    self.lines()
                right = self.operators(bind + 1)
                if word in ("&&", "||"):
                    left = Node("and" if word == "&&" else "or", (left, right))
                elif word in ("~", "!~"):
                    left = Node("match", (word == "!~", left, right))
                else:
                    left = Node("binary", (word, left, right))
                continue
            if CONCAT >= least and self.starts_operand():
                left = Node("concat", (left, self.operators(CONCAT + 1)))
                continue
            return left

    def starts_operand(self) -> bool:
        t = self.now
        if t.kind in ("num", "str", "name", "func", "re"):
            return True
        return t.kind == "op" and t.text in ("$", "(", "!", "++", "--")

    def name(self) -> str:
        if self.now.kind not in ("name", "func"):
            raise self.fail("expected a name")
        self.at += 1
        return self.all[self.at - 1].text

    def getline_target(self) -> Node | None:
        return self.postfix() if self.now.kind == "name" or self.sees("$") else None

    def prefix(self) -> Node:
        t = self.now
        if t.kind == "op" and t.text in ("-", "+", "!"):
            self.at += 1
            if t.text == "!":
                return Node("unary", ("!", self.operators(UNARY)))
            return Node("unary", (t.text, self.operators(UNARY)))
        if t.kind == "op" and t.text in ("++", "--"):
            self.at += 1
            return Node("step", (t.text, True, self.postfix()))
        return self.postfix()

    def postfix(self) -> Node:
        e = self.primary()
        if e.kind in ("var", "index", "field") and self.sees("++", "--"):
            op = self.now.text
            self.at += 1
            return Node("step", (op, False, e))
        return e

    def primary(self) -> Node:
        t = self.now
        self.at += 1
        if t.kind == "num":
            return Node("num", (t.value,))
        if t.kind == "str":
            return Node("str", (t.value,))
        if t.kind == "re":
            return Node("re", (t.value,))
        if t.kind == "func" and self.sees("("):
            self.at += 1
            return Node("call", (t.text, self.arguments(")")))
        if t.kind in ("name", "func"):
            if self.take("["):
                return Node("index", (t.text, self.keys()))
            return Node("var", (t.text,))
        if t.kind == "op" and t.text == "$":
            if self.sees("-"):
                self.at += 1
                return Node("field", (Node("unary", ("-", self.primary())),))
            if self.sees("++", "--"):
                return Node("field", (self.prefix(),))
            return Node("field", (self.primary(),))
        if t.kind == "op" and t.text == "(":
            items = self.arguments(")")
            if len(items) > 1:
                self.need("in")
                return Node("in", (items, self.name()))
            if not items:
                raise self.fail("empty parentheses")
            return Node("fence", (items[0],)) if any(n.kind == "try" for n in items[0].walk()) else items[0] if items[0].kind in ("num", "str", "var", "field") else Node("group", (items[0],))
        if t.kind == "key" and t.text == "getline":
            target = self.getline_target()
            source = self.operators(CONCAT + 1) if self.take("<") else None
            return Node("getline", (target, source, None))
        self.at -= 1
        raise self.fail(f"unexpected {t.text or t.kind!r}")


def parse(source: str) -> Tree:
    return Parser(source).program()


def ungrouped(node: Node) -> Node:
    while node.kind == "group":
        node = node.args[0]
    return node
