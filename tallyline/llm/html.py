"""Main text of web pages by paths that the pages of a host agree on.

Each page scores its containers: paragraphs credit the container that holds them and, by half, the one around it; link
text counts against it. The generalised path of the best one (tags with their classes, digits left out) is the page's
vote. Votes are summed for each host in Spark; paths with ``SHARE`` of a host's votes win, most voted first, and every
page is extracted again from the first winning path that it has; a page without any uses its own best.

Elements that never hold main text (``nav``, ``footer``, ...) are left out, as are those whose class, id or role says so
in full ("cookie-notice"). A block whose name only holds such a word ("content-sidebar-wrap", "post-comments") is put to
the vote as well: it stays if it holds most of the text on most of the host's pages that have it.

Each page is parsed once for the votes and once for its text. The host's paths are a small table that Spark broadcasts
if it measures it small; else pages are joined by host, and adaptive execution splits a large host.

Defined cases: null or empty html gives an empty text; a null URL counts as host ""; broken markup is read as far as it
goes (missing end tags are implied); very long pages are read whole; of paths with equally many votes the smaller comes
first; repeated rows vote and are returned each; an empty table gives an empty result; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .urlfilter import host_of

#: The share of a host's votes that a path needs.
SHARE = 0.01

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|title|object|canvas|audio|video|annotation|annotation-xml)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>"
    r"|<[!?][^>]*>|<[!?/a-zA-Z][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements without content, elements that stand in a line of text, and text blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
INLINE |= frozenset("math mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption summary".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, and words in class, id or role, that never hold main text.
AWAY = frozenset("nav footer aside form button dialog menu".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus dialog footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: First words that say that something else is there or not; last words that name a place for what stands before them.
STATES = frozenset("has have no not with without".split())
PLACES = frozenset("area bar block box buttons container form inner item items links list panel section wrap wrapper".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())


class Element:
    __slots__ = ("hard", "links", "main", "parent", "path", "score", "softs", "tag")

    def __init__(self, tag: str, path: str, parent: Element | None, hard: bool, main: bool, softs: tuple[str, ...]):
        self.tag, self.path, self.parent, self.hard, self.main, self.softs = tag, path, parent, hard, main, softs
        self.score, self.links = 0.0, 0


#: An element, its own stretch of text, and the number of the block that it belongs to.
Run = tuple[Element, str, int]


def _names(attrs: str, pattern: re.Pattern[str]) -> list[str]:
    return [w for m in pattern.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split()]


_MAIN_PATH = re.compile(r"(?:.*>|^>)(?:article|main)(?:\.[^>]*)?(?=>|\Z)", re.DOTALL)


def _says_away(name: str) -> tuple[bool, bool]:
    """Whether a class, id or role says in full, and whether it says in part, that something is no main text."""
    words = _WORD.findall(name)
    head = [*words]
    while len(head) > 1 and head[-1] in PLACES:
        head.pop()
    if not words or (words[0] in STATES and len(words) > 1):
        return False, False
    return all(w in AWAY_WORDS for w in head), words[0] in AWAY_WORDS or head[-1] in AWAY_WORDS


def parsed(html: str) -> list[Run]:
    """The stretches of text of a page in order, but for those in elements that never hold main text."""
    root = Element("", "", None, False, False, ())
    stack, out, block, at = [root], [], 0, 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and not stack[-1].hard:
            out.append((stack[-1], html[at : m.start()], block))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "br" and not stack[-1].hard:
                out.append((stack[-1], " ", block))
            elif tag not in INLINE:
                block += 1
            continue
        if m["close"] or m["close2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    block += any(e.tag not in INLINE for e in stack[k:])
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # an end tag of a line doesn't close blocks
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "td", "th", "tr"):
            closes = ("p",) if tag in CLOSES_P else (tag, "p", "td", "th") if tag == "tr" else (tag, "p")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    block += 1
                    break
                if stack[k].tag not in INLINE and stack[k].tag != "p":
                    break
        up, attrs = stack[-1], m["attrs"] or ""
        names = _names(attrs, _NAMES) if "=" in attrs else []
        inside = up.main or tag in MAIN
        said = [_says_away(n) for n in names] if tag not in ("body", "html", "article", "main") else []
        hard = up.hard or tag in AWAY or (tag == "header" and not inside) or any(full for full, _ in said)
        path, softs = up.path, up.softs
        if tag not in INLINE:
            classes = sorted({re.sub(r"\d+", "", c) for c in _names(attrs, _CLASS)}) if "=" in attrs else []
            path = f"{path}>{'.'.join([tag, *classes])}"
            block += 1
            if tag not in TEXT and any(part for _, part in said):
                softs = (*softs, path)
        words = {w for n in names for w in _WORD.findall(n)}
        stack.append(Element(tag, path, up, hard, inside or bool(words & MAIN_WORDS), softs))
    if len(html) > at and not stack[-1].hard:
        out.append((stack[-1], html[at:], block))
    return out


def _container(e: Element) -> Element:
    while e.tag in INLINE or e.tag in TEXT:
        e = e.parent
    return e


def _linked(e: Element) -> bool:
    while e.tag in INLINE:
        if e.tag == "a":
            return True
        e = e.parent
    return False


def stays(runs: list[Run]) -> dict[str, bool]:
    """For each path that is put to the vote, whether it holds most of the page's text."""
    total, of = 0, {}
    for e, raw, _ in runs:
        n = len(raw.strip())
        total += n
        for s in e.softs:
            of[s] = of.get(s, 0) + n
    return {s: 2 * n > total for s, n in of.items()}


def best_path(runs: list[Run], kept: Collection[str] = ()) -> str | None:
    """The path of the container that scores best, or of the article or main element around it; None without any text.

    Of the blocks that are put to the vote only those at the paths ``kept`` count.
    """
    found: dict[int, Element] = {}
    for e, raw, _ in runs:
        n = len(raw.strip())
        if not n or any(s not in kept for s in e.softs):
            continue
        holder = _container(e)
        if _linked(e):
            holder.links += n
            found[id(holder)] = holder
            continue
        gain = n + 20 * raw.count(",")
        for share in (1.0, 0.5, 0.25):
            holder.score += gain * share
            found[id(holder)] = holder
            if holder.parent is None:
                break
            holder = _container(holder.parent)
    if not found:
        return None

    def value(e: Element) -> float:
        kind = 1.5 if e.tag in MAIN else 0.5 if e.tag in ("body", "html", "") else 1.25 if e.main else 1.0
        return kind * e.score * e.score / (e.score + 2 * e.links + 1)

    by: dict[str, float] = {}
    for e in found.values():
        by[e.path] = by.get(e.path, 0.0) + value(e)
    best = max(by, key=lambda p: (by[p], p))
    return m[0] if (m := _MAIN_PATH.match(best)) else best  # what else the article holds beside its best container


def extract(runs: list[Run], path: str, kept: Collection[str] = ()) -> str:
    """The text blocks of all elements at ``path``: white space to one blank, blocks joined by an empty line."""
    blocks: list[list[str]] = []
    last, deeper = None, path + ">"
    for e, raw, block in runs:
        if (e.path == path or e.path.startswith(deeper)) and not any(s.startswith(deeper) and s not in kept for s in e.softs):
            if block != last:
                last = block
                blocks.append([])
            blocks[-1].append(raw)
    texts = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def main_text(html: str, paths: list[str], kept: Collection[str] = ()) -> str:
    """The text at the first of the host's ``paths`` that the page has, else at the page's own best."""
    runs = parsed(html)
    there = {e.path for e, _, _ in runs}
    for path in paths:
        if any(p == path or p.startswith(path + ">") for p in there) and (text := extract(runs, path, kept)):
            return text
    own = {s for s, stay in stays(runs).items() if stay}
    best = best_path(runs, own)
    return "" if best is None else extract(runs, best, own)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, soft, yes and no: how many pages of the host have their best container at the path, or, of paths put
    to the vote (soft), how many say that it stays and how many that it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: dict[tuple[str, str, bool], list[int]] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = parsed(page or "")
                soft = stays(runs)
                best = best_path(runs, {s for s, stay in soft.items() if stay})
                for path, is_soft, yes in [*((s, True, stay) for s, stay in soft.items()), *([(best, False, True)] if best is not None else [])]:
                    told.setdefault((host, path, is_soft), [0, 0])[not yes] += 1
            columns = list(zip(*((*k, *v) for k, v in told.items()), strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "soft", "yes", "no"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    voted = rows.mapInArrow(run, "host string, path string, soft boolean, yes long, no long")
    return voted.groupBy("host", "path", "soft").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def winners(voted: DataFrame, share: float = SHARE) -> DataFrame:
    """host, its winning paths, most voted first, and the paths put to the vote that stay: few of each, by ``share``."""
    total = voted.filter("not soft").groupBy(F.col("host").alias("_host")).agg(F.sum("yes").alias("_total"))
    enough = voted.join(total, F.col("host") == F.col("_host")).filter(F.col("yes") >= share * F.col("_total"))
    ranked = F.transform(F.array_sort(F.collect_list(F.when(~F.col("soft"), F.struct((-F.col("yes")).alias("n"), "path")))), lambda x: x["path"])
    return enough.groupBy("host").agg(ranked.alias("paths"), F.collect_list(F.when(F.col("soft") & (F.col("yes") > F.col("no")), F.col("path"))).alias("kept"))


def extracted(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text of each page, from the paths that its host agrees on."""
    # written, so that its size is known before the pages are read: a small one is broadcast, and no page is shuffled
    agreed = written(winners(written(votes(pages), "page-votes"), share).withColumnRenamed("host", "_host"), "page-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, p or [], set(k or ())) if h else "" for h, p, k in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    joined = rows.join(agreed, host_of(F.col("url")) == F.col("_host"), "left")
    return joined.select("page_id", "url", "html", "paths", "kept").mapInArrow(run, "page_id long, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
