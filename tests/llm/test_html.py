"""HTML extraction: page kinds, broken markup, the vote of a host, and the tables' own articles."""

import re
from html import unescape
from html.parser import HTMLParser

import pytest

from tallyline.llm import html
from tallyline.llm.html import best_path, extract, main_text, parsed

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var x="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept them all, please, now.</div>
<div class="wrap-3"><div class="content post-{n}"><h1>Title {n}</h1><p>First &eacute;l&egrave;ve &lt;tag&gt;,  with
 <b>bold</b> and <a href="x">link</a>, and more words here.<p>Second<br>line, unclosed, goes on.
<div class="ad">Buy now</div><ul><li>item one<li>item two</ul><!-- gone --><form><input><label>mail</label></form></div>
<aside>Related things</aside><div id="comments"><p>A reader says a lot, and more, and more, and more, and more.</p></div></div>
<footer><p>(c) 2020, all rights, reserved, forever.</p></footer></body></html>"""

TEXT = "Title 7\n\nFirst élève <tag>, with bold and link, and more words here.\n\nSecond line, unclosed, goes on.\n\nitem one\n\nitem two"


def test_a_page():
    page = PAGE.format(n=7)
    runs = parsed(page)
    assert extract(runs, best_path(runs)) == TEXT
    assert best_path(runs).endswith("div.wrap->div.content.post-")


@pytest.mark.parametrize(("page", "expected"), [("", ""), ("plain words", "plain words"), ("<p>a &amp;lt; b</p>", "a &lt; b"), ("<article><p>one<p>two</article", "one\n\ntwo"), ("<script>x", ""), ("<!-- open <p>x", ""), ("<article>a < b</article>", "a < b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<article><h1>t</h1><p><b>x<br><p>y</p><p>z</article><footer>f</footer>", "t\n\nx\n\ny\n\nz"), ('<article><p title="a > b">x</p></article>', "x"), ("<article><p " + 'a="' * 50 + ">x</article>", None)])
def test_odd_markup(page, expected):
    got = main_text(page, [])
    assert expected is None or got == expected


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>text</p>" + "</div>" * 3000
    assert main_text(deep, []) == "text"
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    assert main_text(long, []).count("word") == 40000


def test_the_host_decides(spark):
    odd = '<html><body><div class="content"><p>Short text.</p></div><div class="list"><p>Longer teaser text, with many, many words, that would win, on this page alone.</p></div></body></html>'
    usual = '<html><body><div class="content"><p>A long article, with words, and more words, and more, and so on, and on.</p></div><div class="list"><p>x</p></div></body></html>'
    rows = [(i, "http://h.org/x", usual, 1) for i in range(5)] + [(9, "http://H.org/y", odd, 1), (10, None, odd, 1), (11, "http://h.org/z", None, 1), (12, "http://h.org/z", "", 1), (None, "http://h.org", usual, 1), (9, "http://H.org/y", odd, 1)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[9] == "Short text." and by[10].startswith("Longer teaser") and by[11] == by[12] == ""
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark, folder):
    got = {r["page_id"]: r for r in html.op5_html(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_a_wrapper_keeps_the_rest_of_the_article():
    page = "<html><body><article><h1>Title</h1><p>lead</p><div class='entry-content'><p>" + "long text, with words, " * 30 + "end</p></div></article><div class='list'><p>other</p></div></body></html>"
    got = main_text(page, [])
    assert got.startswith("Title\n\nlead\n\nlong text") and got.endswith("end")
    assert best_path(parsed(page)).endswith(">article")


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-comments", "sidebar-right", "content has-sidebar"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_layout_classes_around_an_article(name, tag):
    page = f"<body><div class='{name}'><{tag}><h1>Title</h1><p>Some text, with words, and a few more of them.</p><div class='comments-area'><article><p>A reader, at length, says, more.</p></article></div></{tag}><div class='sidebar'><p>aside</p></div></div></body>"
    assert main_text(page, []) == "Title\n\nSome text, with words, and a few more of them."


@pytest.mark.parametrize("between", ["<svg-icon name='x'></svg-icon>", "<svg viewBox='0'/>", "<svg viewBox='0 0 1 1'><title>t</title><path/></svg>", "<video-player></video-player>", "<title-card></title-card>", "<select-box>", "<math/>", "<script>a</script>", "<style-guide/>"])
def test_elements_between_paragraphs(between):
    assert main_text(f"<article><p>One, first.</p>{between}<p>Two, second.</p></article>", []) == "One, first.\n\nTwo, second."


@pytest.mark.parametrize(("page", "expected"), [
    ("<article><p class='ad-hoc'>An ad hoc remark, kept.</p><p>Text, more.</p></article>", "An ad hoc remark, kept.\n\nText, more."),
    ("<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> is, well, c.</p></article>", "The sum a+b is, well, c."),
    ("<div class='post'><p>Text, more, and more of it here.</p><div class='post-comments'><p>Reader.</p></div><div class='ad-slot-top'><p>Buy</p></div></div>", "Text, more, and more of it here."),
])
def test_names_in_part(page, expected):
    assert main_text(page, []) == expected


def test_the_host_decides_on_names(spark):
    """A block whose name is in doubt stays where it holds most of the text on most pages of the host."""
    page = lambda own, text: f"<body><div class='post'><p>{own}</p></div><div class='related-work'><p>{text}</p></div></body>"
    long, short = "Long text, with words, " * 8 + "end.", "Short, text."
    rows = [(i, "http://a.org/", page(short, long)) for i in range(3)] + [(3, "http://a.org/", page(long, short))] + [(10 + i, "http://b.org/", page(long, short)) for i in range(3)] + [(13, "http://b.org/", page(short, long))]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == long and got[3] == short and got[10] == long and got[13] == short


def test_all_layouts_of_a_host(spark):
    """Seven layouts on one host: each page is read by the one that it has."""
    page = lambda k, i: f"<body><div class='layout-{'abcdefg'[k]}'><p>Text {i}, of layout, {k}.</p></div><div class='teasers'><p>Teaser, longer than all of the text, on this page, and so on, and on, by far.</p></div></body>" if (k, i) == (6, 0) else f"<body><div class='layout-{'abcdefg'[k]}'><p>Text {i}, of layout, {k}.</p></div></body>"
    rows = [(10 * k + i, "http://h.org/", page(k, i)) for k in range(7) for i in range(9 - k)]
    got = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[10 * k + i] == f"Text {i}, of layout, {k}." for k in range(7) for i in range(9 - k))


class Tree(HTMLParser):
    """A second reading of a page: a plain tree of the library's own parser, of which the article is read."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [[]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "div", "ul", "li"):
            if "p" in self.open and tag != "li":
                del self.open[self.open.index("p") :]
            self.blocks.append([])
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("meta", "img"):
            self.open.append("away" if dict(attrs).get("class") == "ad" else tag)

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "ul", "li"):
            self.blocks.append([])
        if tag in self.open or (tag == "div" and "away" in self.open):
            while self.open.pop() not in (tag, "away"):
                pass

    def handle_data(self, data):
        if "article" in self.open and not {"script", "style", "nav", "footer", "away"} & set(self.open):
            self.blocks[-1].append(data)


def test_query_against_a_tree(spark, folder):
    got = {r["page_id"]: r["text"] for r in html.op5_html(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        texts = (" ".join("".join(b).split()) for b in Tree(r["html"]).blocks)
        assert got[r["page_id"]] == "\n\n".join(t for t in texts if t)
