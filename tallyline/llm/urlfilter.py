"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression on host and path together. Each rule names the literal tokens that any URL it fits must
hold; corpus counts over all URLs tell which of them is rarest, and the rule is filed under that one. The tokens of a
URL fetch the rules filed under them, and only those run their regular expression. The longest rule that fits decides.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; without a rule the verdict is
``default``; very long URLs are judged whole; of rules of equal length the greater name decides, of equally rare tokens
the smaller; repeated rows get a row each; an empty table gives an empty result; extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TOKEN = re.compile("[0-9A-Za-z]+")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are whole tokens of every string that it fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, name: str) -> Rule:
    """A rule ``host/path`` for the host and its subdomains and for paths that start with the path."""
    head, _, tail = name.rpartition("/")
    last = TOKEN.findall(head) if TOKEN.search(tail) else TOKEN.findall(name)  # a path may go on after its last token
    return Rule(name, verdict, rf"\A(?:[^/]*\.)?{re.escape(name)}", tuple(last))


RULES = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def token_counts(parts: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many rows of ``parts`` (column target) each of ``tokens`` occurs; as many rows as tokens at most."""
    # an Arrow table, whose size Spark knows: broadcast if that is small
    names = parts.sparkSession.createDataFrame(pa.table({"token": pa.array(sorted(tokens), pa.string())}))
    seen = parts.select(F.explode(F.array_distinct(F.regexp_extract_all("target", F.lit(TOKEN.pattern), F.lit(0)))).alias("token"))
    return {r["token"]: r["n"] for r in seen.join(names, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")).collect()}


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest token, and those without any token."""
    by: dict[str, list[int]] = {}
    rest = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            by.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
        else:
            rest.append(k)
    return by, rest


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``urls`` (page_id, url)."""
    parts = urls.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("target", F.concat("host", "path"))
    tokens = {t for r in rules for t in r.tokens}
    by, rest = index(rules, token_counts(parts, tokens) if tokens else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            names, verdicts = [], []
            for target in batch.column(3).to_pylist():
                candidates = {k for t in set(TOKEN.findall(target)) for k in by.get(t, ())}
                fit = [rules[k] for k in (*candidates, *rest) if compiled[k].search(target)]
                best = max(fit, key=lambda r: (len(r.name), r.name), default=None)
                names.append(best.name if best else None)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, h, p, v) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""
