"""HTML extraction by composite text density.

Every DOM node gets its characters and tags, and those inside links; the density of a node is characters
a tag, adjusted by how its links compare with the page's.  A node's score is the sum of its
children's densities, and the node with the greatest score is the content.  Its way to the body gives the threshold, the least
density on that way: what hangs on the way is content too if it is at least that dense and not mostly links, and so is what stands between such parts, and
headings right before them.  Inside the content nothing is dropped but lists and sections that are mostly links and less dense than the threshold,
and, where no tag says where the article begins and ends, sparse sections at its edges.

Tags have roles: scripts, styles, menus, footers, sidebars, dialogs and a page's own header are never text.
Names (class, id) are evidence only: characters of an element that names itself a menu, an advert, a notice or reader comments count as link
characters, as those of a form do, so its density falls below the threshold.  Names are compared as whole words.  An element that holds the article or main,
or (adverts and comments aside) most of the text around it, shows that its name means something else, and is measured as it is.

Defined results: null or empty html, or a page without text, gives an empty string; of equally good nodes the first counts; bytes after unclosed markup
are read as far as they go; repeated rows are extracted one by one; pages of any size are read whole, in time that grows with
their length, without recursion; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm.common import need, slices, trimmed

#: HTML element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template xmp svg object video audio canvas noembed noframes select datalist".split())
NEVER = set("nav footer aside button menu dialog".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 header hgroup".split())
#: Blocks that group others; a paragraph, a heading or a table cell is not one.
GROUPS = set("address center details dir div dl fieldset form main ol section table ul header".split())
ENDS_P = BLOCK - {"body", "html", "br", "button", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_LIMITS = set("table td th button caption # article section div".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
BARRIERS = {"article", "main", "body"}
#: Names of what is not the article, whole words of a class or id.
NAMES = set(
    "sponsor sponsors promo promos promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login related recommended recommendations share sharing social widget pagination pager toolbar".split()
)
#: Names that size alone does not refute: there may be more of these than of the article.
FIRM = set("ad ads adv advert adverts advertisement advertising sponsored comment comments commentlist disqus replies respond".split())
#: Words of place or kind that may be joined to a name by hyphens or underscores; any other word makes the class another one.
PLACES = set("site page post top bottom left right primary secondary global bar box list link links section container wrapper wrap block area inner item items button buttons thread posts articles main".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]|$))""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_TEXT, _NAMED, _FIRM, _NEVER = range(4)


def _named(value: str) -> int:
    """Whether a class or id has a word that is a name, alone or joined to names and places."""
    mark = _TEXT
    for word in value.lower().split():
        parts = [p for p in re.split("[_-]+", word) if p and not p.isdigit()]
        if all(p in NAMES or p in FIRM or p in PLACES for p in parts):
            mark = max(mark, _FIRM if any(p in FIRM for p in parts) else _NAMED if any(p in NAMES for p in parts) else _TEXT)
    return mark


def _mark(attributes: str) -> int:
    """What an element's attributes say of it: nothing, that it names itself something else than text, or that it is not shown."""
    mark = _TEXT
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name == "style" and _HIDDEN.search(value):
            return _NEVER
        if name in ("class", "id"):
            mark = max(mark, _named(value))
    return mark


class Dom:
    """Nodes as parallel lists in page order; node 0 is the root.

    Open elements are found by tag through the places where each tag is open, so a stray end tag costs no walk over the open ones.
    """

    def __init__(self, page: str):
        self.tag, self.up, self.never, self.mark, self.link = ["#"], [-1], [False], [_TEXT], [False]
        #: (node, text) and (node, None) for a block's border, in page order
        self.text: list[tuple[int, str | None]] = []
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of open elements that are not inline
        self.inside: list[int] = []  # of open articles, mains and bodies
        self._push(0)
        pos, n = 0, len(page)
        while pos < n:
            m = _TOKEN.search(page, pos)
            if not m:
                self.text.append((self.stack[-1], page[pos:]))
                break
            if m.start() > pos:
                self.text.append((self.stack[-1], page[pos : m.start()]))
            pos = m.end()
            closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self.text.append((self.stack[-1], None))
            if closing:
                self._close(tag)
                continue
            if tag in RAW:
                if not (attributes or "").endswith("/") or tag != "svg":
                    end = _RAW_END[tag].search(page, pos)
                    pos = end.end() if end else n
                continue
            if tag in ("html", "head", "body") and self.open[tag]:
                continue
            if tag in ENDS_P:
                self._imply({"p"}, P_LIMITS)
            if tag == "body" and self.open["head"]:
                self._cut(self.open["head"][-1])
            if tag in CLOSES:
                self._imply(CLOSES[tag], LIMITS[tag])
            node, parent = len(self.tag), self.stack[-1]
            mark = _mark(attributes) if attributes and tag not in ("html", "body", "article", "main") else _TEXT
            # a header inside an article is the article's own
            never = tag in NEVER or tag == "header" and not (self.open["article"] or self.open["main"]) or tag == "label" and self.open["form"]
            self.tag.append(tag)
            self.up.append(parent)
            self.never.append(self.never[parent] or bool(never) or mark == _NEVER)
            self.mark.append(max(mark, _NAMED) if tag in ("form", "fieldset") else mark)
            self.link.append(self.link[parent] or tag == "a")
            if tag not in VOID:
                self._push(node)

    def _push(self, node: int) -> None:
        at, tag = len(self.stack), self.tag[node]
        self.stack.append(node)
        self.open[tag].append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in BARRIERS:
            self.inside.append(at)

    def _cut(self, at: int) -> None:
        """Closes the element at place `at` of the open ones and all inside it."""
        for node in self.stack[at:]:
            self.open[self.tag[node]].pop()
        del self.stack[at:]
        for places in (self.blocks, self.inside):
            while places and places[-1] >= at:
                places.pop()

    def _last(self, tags: set[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def _imply(self, close: set[str], limits: set[str]) -> None:
        at = self._last(close)
        if at > self._last(limits):
            self._cut(at)

    def _close(self, tag: str) -> None:
        at = self._last({tag})
        if not at or tag in INLINE and self.blocks[-1] > at:
            return
        if tag not in BARRIERS and tag not in ("html", "div", "section") and self.inside and self.inside[-1] > at:
            return
        self._cut(at)

    def name(self, sizes: list[int]) -> list[bool]:
        """Which nodes lie in elements whose names are believed: those that hold neither the article nor most of the text around them."""
        n = len(self.tag)
        held = [0] * n
        for (node, _), size in zip(self.text, sizes, strict=True):
            if not self.never[node]:
                held[node] += size
        for i in range(n - 1, 0, -1):
            held[self.up[i]] += held[i]
        core, around = 0, set()
        for tag in ("main", "article"):
            best = max((i for i in range(n) if self.tag[i] == tag), key=held.__getitem__, default=0)
            if best and held[best] and (not core or 2 * held[best] >= held[core]):
                core = best
            while best > 0 and held[best]:
                best = self.up[best]
                around.add(best)
        inside, out = [i == core for i in range(n)], [False] * n
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.up[i]]
            large = inside[i] and 2 * held[i] > held[core]
            out[i] = out[self.up[i]] or i not in around and (self.mark[i] == _FIRM or self.mark[i] == _NAMED and not large)
        return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    dom = Dom(page)
    n, up, tag, never = len(dom.tag), dom.up, dom.tag, dom.never
    sizes = [sum(map(len, (entities.unescape(text) if "&" in text else text).split())) if text else 0 for _, text in dom.text]
    named = dom.name(sizes) if any(dom.mark) else [False] * n
    chars, links, tags, link_tags = [0] * n, [0] * n, [1] * n, [int(tag[i] == "a" or named[i]) for i in range(n)]
    all_chars = all_links = 0
    for (node, _), size in zip(dom.text, sizes, strict=True):
        linked = dom.link[node] or named[node]
        all_chars += size
        all_links += size * linked
        if not never[node]:
            chars[node] += size
            links[node] += size * linked
    own = chars[:]
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = up[i]
        if not never[i] or never[p]:
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            link_tags[p] += link_tags[i]
    if not chars[0]:
        return ""
    page_share = all_links / max(1, all_chars)

    def density(i: int) -> float:
        c, lc, t, lt = chars[i], links[i], tags[i], link_tags[i]
        if not c or never[i]:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + page_share * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(base + 1)

    dense = list(map(density, range(n)))
    total = [0.0] * n
    for i in range(1, n):
        total[up[i]] += dense[i]
    for i in range(n):  # text of its own counts as a child
        if own[i] and not never[i]:
            total[i] += min(dense[i], float(own[i]))
    best = max(range(n), key=lambda i: (total[i], -i))
    way, i = [best], best
    while i > 0 and tag[i] not in ("body", "html"):
        i = up[i]
        way.append(i)
    least = min(dense[x] for x in way)
    children = defaultdict(list)
    for x in range(1, n):
        if not never[x]:
            children[up[x]].append(x)
    linky = [2 * links[x] >= chars[x] for x in range(n)]
    keep = [False] * n
    keep[best] = True
    top = max((k for k, x in enumerate(way) if tag[x] == "article"), default=-1)
    article = set(way[: top + 1])  # what is on the way inside an article
    for at, below in zip(way[1:], way, strict=False):
        row = children[at]
        good = [k for k, x in enumerate(row) if x == below or (dense[x] >= least > 0 or at in article) and not linky[x]]
        first, last = min(good), max(good)
        while first and (tag[row[first - 1]] in HEADINGS or tag[row[first]] not in GROUPS and tag[row[first - 1]] not in GROUPS):
            first -= 1
        while last + 1 < len(row) and tag[row[last]] not in GROUPS and tag[row[last + 1]] not in GROUPS:
            last += 1
        for x in row[first : last + 1]:
            keep[x] = keep[x] or x not in way and not linky[x]
    if not any(tag[x] in ("article", "main") for x in way):  # no tag tells where the article ends: sparse sections at the edges of the best node are not its text
        row = children[best]
        good = [k for k, x in enumerate(row) if dense[x] >= least and not linky[x] or tag[x] not in GROUPS]
        if good and not own[best]:
            for x in [*row[: min(good)], *row[max(good) + 1 :]]:
                never[x] = True
    for x in range(1, n):
        keep[x] = keep[x] or keep[up[x]]
        # inside the content: what is mostly links, groups several of them, and is sparse
        drop = named[x] or tag[x] in GROUPS and link_tags[x] > 1 and 10 * links[x] >= 9 * chars[x]
        never[x] = never[x] or never[up[x]] or bool(chars[x]) and x not in way and drop and dense[x] < least
    blocks, now = [], []
    for node, text in dom.text:
        if text is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif keep[node] and not never[node]:
            now.append(entities.unescape(text) if "&" in text else text)
    if now:
        blocks.append("".join(now))
    return " ".join(filter(None, (" ".join(b.split()) for b in blocks)))


def main_text(df: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of df (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    base = need(df, "page_id", "url", "html")
    return base.mapInArrow(trimmed(run), f"page_id {base.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
