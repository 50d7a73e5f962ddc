"""Main text of web pages by line-block distribution.

A page's markup is stripped into lines, one for each block of the page.
Lines of menus, headers, footers, sidebars, notices, adverts, forms and reader
comments (told by element, role, class or id) count no characters, nor do
lines of links. Sums of the counts over sliding windows of ``width`` lines rise
at a surge, where a passage begins, and fall to nothing at a dive, where it
ends; the lines between are kept. Where the page itself marks its article, lines
outside of it count nothing and every passage inside is kept; elsewhere a passage
must reach ``surge`` characters in a window, or the page's largest window if none does.

Character references are decoded, white space inside a block becomes one space,
and blocks are joined by an empty line in page order. Nothing is dropped or
capped for its length. One pass over the table without a shuffle; a task holds one
batch of pages. A null or empty page gives an empty text; ids and addresses are
carried as they are, null or repeated; other columns do not matter. Markup cut
off or left open ends where its parent does, at the end of the page at the latest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from shiftwise.llm.common import field, map_arrow

# --- Fixed values: elements of HTML by what they do -----------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
# elements and roles whose text is not the article's
ASIDE = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head map menu nav noscript object option search "
    "select svg template video".split()
)
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# words of a class or id that name such a part
NAMED = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "overlay pager pagination popup promo promotion recommended recommendations related replies reply respond share sharing "
    "sidebar signup skip social sponsor sponsored sponsors subscribe teaser toolbar topbar widget widgets".split()
)
# ... even of an <article>: others' words and other articles
FOREIGN = frozenset(
    "ad ads advert advertisement comment comments promo recommended related replies reply sponsored teaser".split()
)
# --------------------------------------------------------------------------------

_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_ARTICLE = re.compile(r"(?:^|\s)(?:article|(?:article|post|entry|story)[-_]?(?:body|content|text))(?:\s|$)", re.I)
_MAIN = re.compile(r"(?:^|\s)main(?:[-_]?content)?(?:\s|$)", re.I)

ARTICLE, MAIN = 2, 1  # how surely an element marks the main text


def _describe(name: str, attributes: str, within: int) -> tuple[bool, int]:
    """Whether an element stands aside from the article, and how it marks it."""
    mark = ARTICLE if name == "article" else MAIN if name == "main" else 0
    aside = name in ASIDE or (name == "header" and not within)
    if not attributes or name in ("html", "body"):
        return aside and name not in ("html", "body"), mark
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if not found:
        return aside, mark
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(names)}
    if mark:
        return bool(words & FOREIGN), mark
    role = found.get("role", "").lower()
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
    if found.get("itemprop", "").lower() == "articlebody" or _ARTICLE.search(names):
        mark = ARTICLE
    elif role == "main" or _MAIN.search(names):
        mark = MAIN
    named = bool(words & NAMED) or ("header" in words and not within and not mark)
    return aside or hidden or role in ASIDE_ROLES or (named and not mark), mark


class _Page:
    """Open elements and the lines so far: (text, counted characters, mark, heading)."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, int]] = []  # element, aside, mark
        self.aside = 0
        self.marks = [0, 0, 0]  # open elements by how they mark the main text
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.heading = ""
        self.lines: list[tuple[str, int, int, str]] = []

    def mark(self) -> int:
        return ARTICLE if self.marks[ARTICLE] else MAIN if self.marks[MAIN] else 0

    def add(self, text: str) -> None:
        if not self.aside:
            text = unescape(text)
            self.text.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def flush(self) -> None:
        """Ends a line; what stands aside is a line without characters."""
        text = " ".join("".join(self.text).split())
        if text:
            size = len(text) - text.count(" ")
            counted = 0 if 2 * self.linked > size else len(text)
            self.lines.append((text, counted, self.mark(), self.heading))
        elif self.aside:
            self.lines.append(("", 0, 0, ""))
        self.text, self.linked = [], 0

    def close(self, at: int) -> None:
        """Closes the open elements from ``at`` on."""
        for name, aside, mark in self.open[at:]:
            self.aside -= aside
            self.marks[mark] -= 1
            self.links -= name == "a"
        del self.open[at:]

    def start(self, name: str, attributes: str) -> None:
        if name == "br" or name in CELL:
            self.text.append(" ")
        if name in BLOCK:
            self.flush()
            self.heading = name if name in ("h1", "h2", "h3", "h4", "h5", "h6") else ""
        for i in range(len(self.open) - 1, -1, -1):  # what this start ends
            other = self.open[i][0]
            if other == "p" and name in BLOCK or other == "li" and name == "li" or other == "head" and name not in HEAD:
                self.close(i)
            elif other in BLOCK and other != "li" or other == "li" and name != "li":
                break
            elif name not in BLOCK and other != "head":
                break
        if name in VOID:
            return
        aside, mark = _describe(name, attributes, self.marks[ARTICLE] + self.marks[MAIN])
        self.open.append((name, aside, mark))
        self.aside += aside
        self.marks[mark] += 1
        self.links += name == "a"

    def end(self, name: str) -> None:
        block = name in BLOCK
        if block:
            self.flush()
            self.heading = ""
        if name == "br":
            self.text.append(" ")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                return self.close(i)
            if not block and self.open[i][0] in BLOCK:
                return None  # an inline end does not reach past its block
        return None


def page_lines(html: str) -> list[tuple[str, int, int, str]]:
    """The lines of a page without markup: text, counted characters, mark, heading."""
    page, at, size = _Page(), 0, len(html)
    while at < size:
        left = html.find("<", at)
        if left < 0 or html.find(">", left) < 0:
            page.add(html[at:] if left < 0 or not re.match(r"<[a-zA-Z/!?]", html[left : left + 2]) else html[at:left])
            break
        if left > at:
            page.add(html[at:left])
        if html.startswith("<!--", left):
            stop = html.find("-->", left + 2)
            at = size if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), left):
            at = html.find(">", left) + 1
            continue
        tag = _TAG.match(html, left) or _LOOSE_TAG.match(html, left)
        if tag is None:
            if html.startswith("</", left):
                at = html.find(">", left) + 1
            else:  # a sign of its own
                page.add("<")
                at = left + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            page.end(name)
        elif name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else size
        else:
            page.start(name, tag[3])
    page.flush()
    return page.lines


def passages(counts: list[int], width: int, least: int) -> list[tuple[int, int]]:
    """Surges and dives: (first, last) lines of the passages in which the window
    sums stay above nothing and reach ``least`` somewhere."""
    out: list[tuple[int, int]] = []
    begin = last = -1
    top = total = 0
    for i, n in enumerate([*counts, *[0] * width]):
        total += n - (counts[i - width] if i >= width else 0)  # the window that ends here
        if n and begin < 0:
            begin, top = i, 0
        if begin >= 0:
            top = max(top, total)
            last = i if n else last
            if not total:
                if top >= least:
                    out.append((begin, last))
                begin = -1
    return out


def main_text(html: str | None, width: int = 3, surge: int = 80) -> str:
    """The main text of a page, its blocks joined by empty lines."""
    if not html:
        return ""
    lines = page_lines(html)
    mark = max((x[2] for x in lines if x[0]), default=0)
    if mark:
        inside = [i for i, x in enumerate(lines) if x[0] and x[2] == mark]
        if not any(lines[i][3] for i in inside):  # the title may stand above its article
            titles = [i for i, x in enumerate(lines) if x[0] and x[3] == "h1" and x[2] < mark]
            inside = [*(titles if len(titles) == 1 and titles[0] < inside[0] else []), *inside]
        chosen = set(inside)
        counts = [len(x[0]) if i in chosen else 0 for i, x in enumerate(lines)]
        least = 1
    else:
        chosen = {i for i, x in enumerate(lines) if x[0]}
        counts = [x[1] for x in lines]
        windows = [sum(counts[i : i + width]) for i in range(len(counts))]
        least = min(surge, max(windows, default=0))
    kept = [lines[i][0] for a, z in passages(counts, width, max(1, least)) for i in range(a, z + 1) if i in chosen]
    return "\n\n".join(kept)


def extract(pages: DataFrame, width: int = 3, surge: int = 80) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), width, surge) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = [field(pages, "page_id", "long"), field(pages, "url", "string"), field(pages, "html", "string")]
    return map_arrow(pages.select(*columns), run, "page_id long, url string, text string, n_chars long")
