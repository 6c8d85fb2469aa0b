"""Main text of web pages by removal of site templates.

Every page is parsed into elements, and each block element is hashed with all that is in it (tags, texts and order, without attributes) under
its host. Spark counts on how many pages of the host a subtree stands, copies of one article (pages with one heading) counted once; what stands on
TEMPLATE_PAGES of them or more is the site's template and is deleted. Of the rest, markup that names its part of the page decides: elements
for navigation, page frames, forms and scripts go, those whose role, class or id says menu, advert, notice, sidebar or comment go, and
where a page says which part is the article, that part is taken.

Inside a marked article only frames (FRAMES) can be template, never its paragraphs and headings: sites print the same passage in several
articles. An element around the article is never deleted.

Counting is one narrow map and an aggregation of digests; the templates are sent to the tasks while there are at most SENT_TEMPLATES of
them, else each page is given its own by two joins on digests. Texts are moved in the second case only.

Character references are decoded, white space (as str.split has it) becomes one space, blocks are joined by one space. Broken markup is read
leniently: unclosed elements end with those around them, stray end tags and a cut tag at the end are ignored, an unclosed comment, script or style
runs to the end.

Defined cases: a null or empty page has an empty text; a null url, or one without a host, is of the host of that kind; rows that are equal are extracted each and count
as one page; html of any length is read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, hot_keys, look_up

#: Pages of a host, with different headings, on which a subtree is template.
TEMPLATE_PAGES = 5
SENT_TEMPLATES = 200_000
BATCH = 500

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of the text.
_PARTS = frozenset("head nav aside footer form button select dialog menu noscript template svg canvas audio video object header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert newsletter "
    "subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead copyright comment comments respond "
    "reply replies disqus share sharing social related recommended recommendations widget toolbar".split()
)
_HEADERS = frozenset(["header", "masthead", "banner"])
_CONTENT = frozenset("content article articlebody story entry post main maincontent".split())
#: Elements of an article that can be template.
FRAMES = frozenset("div section aside header footer nav form fieldset details center".split())
#: Start tags that end open elements: the elements, and those that they do not reach beyond.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "body": ({"head"}, {"html"}),
}
_P = ({"p"}, {"table", "td", "th", "button", "object", "caption"})

_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Page:
    """The elements of a page in order, each with its parent, its names and the digest of its subtree, and the texts with their elements."""

    def __init__(self, html: str, host: str) -> None:
        self.tags, self.parents, self.attributes, self.digests = ["html"], [-1], [""], [b""]
        self.texts: list[tuple[int, str]] = []
        self._key = blake2b(host.encode(), digest_size=16).digest()
        self._stack, self._inside, self._open = [0], [[]], Counter()
        self._read(html)
        self._close(0)
        self.names = [self._names(a) for a in self.attributes]

    @staticmethod
    def _names(attributes: str) -> tuple[str, frozenset[str]]:
        role, words = "", set()
        for name, value in _NAMES.findall(attributes):
            value = value.strip("\"'").lower()
            if name.lower() == "role":
                role = value.strip()
            else:
                words.update(_SPLIT.split(value))
        return role, frozenset(words)

    def _close(self, depth: int) -> None:
        """Ends the open elements from depth on."""
        while len(self._stack) > depth:
            node, parts = self._stack.pop(), self._inside.pop()
            tag, said = self.tags[node], " ".join("".join(p for p in parts if isinstance(p, str)).split())
            below = [p for p in parts if isinstance(p, bytes)]
            if said or below:
                self.digests[node] = blake2b(b"\0".join([tag.encode(), *(p if isinstance(p, bytes) else p.encode() for p in parts if not isinstance(p, str) or p.strip())]), digest_size=16, key=self._key).digest()
            self._open[tag] -= 1
            if self._stack:
                if self.digests[node]:
                    self._inside[-1].append(self.digests[node])
                if tag not in _INLINE:
                    self.texts.append((self._stack[-1], " "))

    def _end(self, ended: set[str], limits: set[str]) -> None:
        """Ends the outermost of the open elements ended that are nearer than limits."""
        if any(self._open[t] > 0 for t in ended):
            at = None
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tags[self._stack[depth]]
                if tag in ended:
                    at = depth
                elif tag in limits:
                    break
            if at is not None:
                self._close(at)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        if tag not in _INLINE:
            self._end(*_P)
            self.texts.append((self._stack[-1], " "))
        if tag == "br":
            self._inside[-1].append(" ")
        if tag in _VOID:
            return
        self._inside.append([])
        self.parents.append(self._stack[-1])
        self._stack.append(len(self.tags))
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.digests.append(b"")
        self._open[tag] += 1

    def _stop(self, tag: str) -> None:
        if self._open[tag] > 0:
            for depth in range(len(self._stack) - 1, 0, -1):
                here = self.tags[self._stack[depth]]
                if here == tag:
                    self._close(depth)
                    return
                if tag in _INLINE and here not in _INLINE:
                    return

    def _say(self, text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            self.texts.append((self._stack[-1], text))
            self._inside[-1].append(text)

    def _read(self, html: str) -> None:
        at = 0
        while (m := _TOKEN.search(html, at)) is not None:
            self._say(html[at : m.start()])
            at = m.end()
            if (tag := (m[2] or "").lower()) and m[1]:
                self._stop(tag)
            elif tag in _RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                if tag == "title" and self._open["svg"] <= 0:
                    self._start(tag, m[3])
                    self._say(html[at : end.start() if end else len(html)])
                    self._stop(tag)
                at = end.end() if end else len(html)
            elif tag and tag != "html":
                self._start(tag, m[3])
        self._say(html[at:])

    def heading(self) -> str:
        """The first main heading, or the title."""
        for tag in ("h1", "title"):
            if tag in self.tags:
                first = self.tags.index(tag)
                last = next((k for k in range(first + 1, len(self.tags)) if self.parents[k] < first), len(self.tags))
                if said := " ".join("".join(t for n, t in self.texts if first <= n < last).split()):
                    return said
        return ""

    def _suspects(self) -> list[str]:
        """What an element is by its own markup, if it is no part of the text: part or word."""
        out = []
        for tag, (role, words) in zip(self.tags, self.names, strict=True):
            part = tag in _PARTS or tag == "title" or role in _ROLES
            out.append("part" if part else "word" if words & _WORDS and tag not in _HEADINGS and tag != "body" and tag != "main" else "")
        return out

    def _main(self, suspects: list[str]) -> tuple[list[int], bool]:
        """The outermost elements that hold the article, and whether the page marks them as such."""
        n = range(1, len(self.tags))
        under = {kind: [False] * len(self.tags) for kind in ("part", "word")}  # by an element above
        for kind, flags in under.items():
            for k in n:
                p = self.parents[k]
                flags[k] = flags[p] or suspects[p] == kind
        marked = [
            [k for k in n if self.tags[k] == "article"],
            [k for k in n if self.tags[k] == "main" or self.names[k][0] == "main"],
            [k for k in n if self.tags[k] not in _INLINE and self.tags[k] not in _HEADINGS and self.tags[k] != "body" and self.names[k][1] & _CONTENT],
        ]
        for number, found in enumerate(marked):
            clear = [k for k in found if not suspects[k] and not under["part"][k]]
            clear = [k for k in clear if not under["word"][k]] or clear or (found if number < 2 else [])
            if clear:
                wanted, inside = set(clear), [False] * len(self.tags)
                for k in n:
                    inside[k] = inside[self.parents[k]] or k in wanted
                return [k for k in clear if not inside[self.parents[k]]], number < 2
        return [0], False

    def text(self, is_template) -> tuple[str, int]:  # noqa: ANN001
        """The main text, and the number of template subtrees that are deleted. is_template judges a digest."""
        suspects = self._suspects()
        chosen, marked = self._main(suspects)
        main, around, headed = set(chosen), set(), set()
        for k in chosen:
            while k >= 0 and k not in around:
                around.add(k)
                k = self.parents[k]
        for k, tag in enumerate(self.tags):
            if tag in _HEADINGS:
                while k > 0 and k not in headed:
                    headed.add(k)
                    k = self.parents[k]
        gone, inside, deleted = [False] * len(self.tags), [False] * len(self.tags), 0
        for k, tag in enumerate(self.tags):
            up = self.parents[k]
            inside[k] = k in main or (up >= 0 and inside[up])
            if up >= 0 and gone[up]:
                gone[k] = True
            elif k in around:
                continue
            elif tag not in _INLINE and not (marked and inside[k] and tag not in FRAMES) and self.digests[k] and is_template(self.digests[k]):
                gone[k] = True
                deleted += 1
            elif suspects[k]:
                role, words = self.names[k]
                title = inside[k] and k in headed and not (words & _WORDS) - _HEADERS and (tag == "header" or tag not in _PARTS) and role not in _ROLES - _HEADERS
                gone[k] = not title
        return " ".join("".join(t for n, t in self.texts if t == " " or (inside[n] and not gone[n])).split()), deleted


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct block subtrees of each page, and the page's heading."""
    for b in batches:
        out: list[tuple[bytes, bytes, bytes]] = []
        for digest, host, html in zip(b.column("digest").to_pylist(), b.column("host").to_pylist(), b.column("html"), strict=True):
            page = Page(html.as_py(), host)
            said = page.heading()
            lead = blake2b(said.encode(), digest_size=8).digest() if said else digest
            out += [(s, lead, digest) for s in {d for t, d in zip(page.tags, page.digests, strict=True) if d and t not in _INLINE and t not in ("html", "body", "title")}]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 3, names=["subtree", "lead", "digest"])


def _extract(sent):  # noqa: ANN001, ANN202
    """The text of each page, by the templates that were sent or, without them, by those of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, deleted = [], []
            own = [None] * b.num_rows if sent is not None else b.column("templates").to_pylist()
            for host, html, templates in zip(b.column("host").to_pylist(), b.column("html"), own, strict=True):
                known = sent.value if sent is not None else frozenset(templates or ())
                text, n = Page(html.as_py() or "", host).text(known.__contains__)
                texts.append(text)
                deleted.append(n)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_templates"])

    return run


def _rows(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.withColumns({"host": _host(), "digest": F.unhex(F.md5(F.col("html").cast("binary")))})


def site_templates(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = TEMPLATE_PAGES) -> DataFrame:
    """subtree (digest under its host) and n_pages of the subtrees that recur."""
    rows = _rows(pages, page_id, url, html).where("html != ''")
    found = rows.select("digest", "host", "html").mapInArrow(_subtrees, "subtree binary, lead binary, digest binary")
    return found.groupBy("subtree").agg(F.count_distinct("lead").alias("n_pages")).where(F.col("n_pages") >= least)


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = TEMPLATE_PAGES, sent_templates: int = SENT_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars and n_templates (deleted template subtrees) of each page."""
    spark, rows = pages.sparkSession, _rows(pages, page_id, url, html)
    out = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long, n_templates long"
    with arrow_rows(spark, BATCH):
        templates = cut(site_templates(pages, page_id=page_id, url=url, html=html, least=least), "templates")
        if templates.count() <= sent_templates:
            sent = spark.sparkContext.broadcast(frozenset(bytes(r.subtree) for r in templates.select("subtree").collect()))
            return cut(rows.select("page_id", "url", "host", "html").mapInArrow(_extract(sent), out), "texts")
        found = rows.where("html != ''").select("digest", "host", "html").mapInArrow(_subtrees, "subtree binary, lead binary, digest binary").select("digest", "subtree")
        common = look_up(found, templates.select("subtree"), "subtree", hot_keys(templates, "subtree", "n_pages", rows.count()))
        own = cut(common.groupBy("digest").agg(F.collect_set("subtree").alias("templates")), "page-templates")
        joined = rows.join(own.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "host", "html", "templates")
        return cut(joined.mapInArrow(_extract(None), out), "texts")
