"""Schema discovery: format, header and column types from the first lines, and programs that suit them."""

from __future__ import annotations

import csv
import io
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .sources import readers

SAMPLE = 100
_INT, _FLOAT = re.compile(r"[+-]?\d{1,18}"), re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


@dataclass
class Column:
    name: str
    kind: str  # Int, Float, String
    samples: list[str] = field(default_factory=list)
    distinct: int = 0  # of the values seen that aren't empty
    seen: int = 0

    @classmethod
    def of(cls, name: str, values: list[str], kind: str | None = None) -> Column:
        return cls(name, kind or kind_of(values), values[:3], len({v for v in values if v}), len(values))

    @property
    def groups(self) -> bool:
        """Whether values come again, so that counting by them tells something."""
        return self.seen <= 2 or self.distinct < self.seen


@dataclass
class Schema:
    format: str  # csv, tsv, json, text, parquet
    header: bool
    columns: list[Column]

    def spark(self) -> StructType:
        kinds = {"Int": LongType(), "Float": DoubleType(), "String": StringType()}
        return StructType([StructField(c.name, kinds[c.kind]) for c in self.columns])

    def text(self, path: str = "") -> str:
        out = [f"{path or 'input'}: {self.format}{', header' if self.header else ''}, {len(self.columns)} columns"]
        wide = max((len(c.name) for c in self.columns), default=0)
        out += [f"  {i:>3} {c.name:<{wide}} {c.kind:<6} {', '.join(c.samples[:3])}" for i, c in enumerate(self.columns, 1)]
        return "\n".join(out)


def kind_of(values: list[str]) -> str:
    """Int or Float if all values that aren't empty read as one, String otherwise and for none."""
    filled = [v for v in values if v.strip()]
    if filled and all(_INT.fullmatch(v.strip()) for v in filled):
        return "Int"
    return "Float" if filled and all(_FLOAT.fullmatch(v.strip()) for v in filled) else "String"


def format_of(lines: list[str]) -> str:
    """json if most lines are objects; else tsv or csv by a separator that every line has as often; else text."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        return "text"
    if lines[0].lstrip()[:1] in ("{", "[") and sum(x.lstrip().startswith("{") for x in lines) * 2 > len(lines):
        return "json"
    tabs, commas = [x.count("\t") for x in lines], [x.count(",") for x in lines]
    if tabs[0] and len(set(tabs)) == 1 and tabs[0] >= commas[0]:
        return "tsv"
    return "csv" if commas[0] and (len(set(commas)) == 1 or any('"' in x for x in lines)) else "text"


def has_header(rows: list[list[str]]) -> bool:
    """A first row of names: none is a number, and later cells hold numbers or the names are short and unique."""
    if not rows or any(kind_of([c]) != "String" or not c.strip() for c in rows[0]):
        return False
    if any(kind_of([c]) != "String" for r in rows[1:] for c in r):
        return True
    names = [c.lower() for c in rows[0]]
    return len(rows) > 1 and len(set(names)) == len(names) and all(len(c) < 40 for c in names)


def sniff(lines: list[str], kind: str | None = None) -> Schema:
    lines = [x for x in lines if x.strip()][:SAMPLE]
    kind = kind or format_of(lines)
    if kind == "json":
        rows = [r for x in lines if isinstance(r := _loaded(x), dict)]
        names = list(dict.fromkeys(k for r in rows for k in r))
        text = lambda v: v if isinstance(v, str) else json.dumps(v)
        values = {n: [text(r[n]) for r in rows if r.get(n) is not None] for n in names}
        return Schema("json", True, [Column.of(n, v) for n, v in values.items()])
    if kind in ("csv", "tsv"):
        rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter="," if kind == "csv" else "\t"))
    else:
        rows = [x.split() for x in lines]
    header = kind != "text" and has_header(rows)
    width = max((len(r) for r in rows), default=0)
    names = rows[0] if header else [f"${i}" for i in range(1, width + 1)]
    body = rows[1:] if header else rows
    columns = []
    for i in range(max(width, len(names))):
        values = [r[i] for r in body if i < len(r)]
        columns.append(Column.of(names[i] if i < len(names) else f"${i + 1}", values))
    return Schema(kind, header, columns)


def _loaded(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def describe(spark: SparkSession, path: str) -> Schema:
    """From at most ``SAMPLE`` lines; Parquet from its own schema."""
    kind = readers.format_of(path)
    if kind == "parquet":
        rows = spark.read.parquet(path)
        kinds = {"bigint": "Int", "int": "Int", "smallint": "Int", "tinyint": "Int", "double": "Float", "float": "Float"}
        some = rows.limit(SAMPLE).collect()
        return Schema("parquet", True, [Column.of(n, [str(r[n]) for r in some], kinds.get(k, "String")) for n, k in rows.dtypes])
    lines = [r["value"] for r in readers.lines(spark, path).limit(SAMPLE).collect()]
    return sniff(lines, None if kind == "text" else kind)


def suggest(schema: Schema, path: str = "FILE") -> list[tuple[str, str]]:
    """(what it does, program) for the columns at hand."""
    named = schema.header or schema.format == "parquet"
    place = {c.name: (f"${c.name}" if c.name.isidentifier() else f'$"{c.name}"') if named else f"${i}" for i, c in enumerate(schema.columns, 1)}
    numbers = [c for c in schema.columns if c.kind != "String"]
    texts = [c for c in schema.columns if c.kind == "String" and c.groups]
    out = []
    if texts:
        t = min(texts, key=lambda c: c.distinct)
        sample = t.samples[0] if t.samples else ""
        out.append((f"rows where {t.name} is {sample!r}", f'{place[t.name]} == "{sample}"'))
        out.append((f"count by {t.name}", f"{{ n[{place[t.name]}]++ }} END {{ for (k in n) @rval print n[k], k }}"))
        out.append((f"distinct {t.name}", f"!seen[{place[t.name]}]++ {{ print {place[t.name]} }}"))
    if numbers:
        v = numbers[-1]
        out.append((f"sum and mean of {v.name}", f"{{ s += {place[v.name]} }} END {{ print s, s / NR }}"))
        out.append((f"five numbers of {v.name}", f"{{ a[NR] = {place[v.name]} }} END {{ print min(a), p(a, 25), median(a), p(a, 75), max(a) }}"))
        if texts:
            out.append((f"sum of {v.name} by {t.name}", f"{{ s[{place[t.name]}] += {place[v.name]} }} END {{ for (k in s) @sort print k, s[k] }}"))
    return out[:6]
