"""Main text of web pages by composite text density.

Every block of the DOM gets a density: its characters per tag, damped by the share of those characters that sit in links
and by the share of link text in the whole body. Inline markup other than links is part of its block and no tag. A block's
density sum is the sum over its children; its own text counts as a child without tags. The block with the largest sum is
the core of the article; the smallest density on its path up to the body is the threshold, and every subtree that reaches
it contributes its own maximum-sum block, whole. From what is chosen, blocks under the threshold that are mostly links are
taken away, unless all of it is mostly links. A short advert without links can't be told from a short paragraph by
density, and stays if it lies inside what is chosen. The names of article and main elements decide nothing here. Markup
that can only be page furniture (menus, forms, scripts, adverts, notices, reader comments) is pruned before the densities
are computed. An element that only its class or id names as furniture isn't pruned if no article or main lies elsewhere
and it holds all of the page's article, main and h1 elements, or most of the text outside links: there the densities decide.

Defined cases: null or empty html gives an empty text; html without a body counts as all body; unclosed and stray tags
are tolerated; a page whose text lies only in furniture gives an empty text; repeated rows are computed alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import short_batches

# Element names of the HTML standard, by role, and words that name page furniture in class, id or role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE_TAGS = frozenset("head nav footer aside form button select option input menu dialog svg canvas object audio video figure-controls script style noscript template iframe textarea title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are part of a text even where they are a link: not taken away by themselves.
ITEMS = frozenset("h1 h2 h3 h4 h5 h6 header li dt dd tr td th caption figcaption".split())
LIST_SCOPES = frozenset("ul ol dl table menu article section div body".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets footer masthead topbar toolbar pagination pager share sharing social"
    " comment comments commentlist disqus respond replies related recommended newsletter subscribe signup login search form copyright toc".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element can only be page furniture: by element, role or visibility."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in FURNITURE_ROLES:
            return True
    return False


def is_named_furniture(tag: str, attributes: str) -> bool:
    """Whether a name in class or id consists of furniture words only, as ad-1 and cookie-notice, but not has-sidebar, do."""
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in (a or b or c).lower().split():
                words = NAME_PART.findall(token)
                if words and all(w in FURNITURE_WORDS for w in words):
                    return True
    return False


class _Tree:
    """Flat node lists in document order; a child always has a larger index than its parent."""

    def __init__(self) -> None:
        self.tag, self.parent, self.dropped = ["body"], [-1], [False]
        self.in_article, self.in_link = [False], [False]
        self.named: list[int] = []  # what only a class or id names as furniture
        self.runs: list[tuple[int, int, str]] = []  # node, block, raw text
        self.block = 0

    def add(self, tag: str, parent: int, attributes: str) -> int:
        article = self.in_article[parent] or tag in ("article", "main")
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(self.dropped[parent] or is_furniture(tag, attributes, article))
        self.in_article.append(article)
        self.in_link.append(self.in_link[parent] or tag == "a")
        if not self.dropped[-1] and is_named_furniture(tag, attributes):
            self.named.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def prune_named(self) -> None:
        """Drops what is named as furniture, but for what holds the article."""
        if not self.named:
            return
        n, names = len(self.tag), set(self.named)
        inner = [-1] * n  # the innermost named element that a node lies in
        for k in range(1, n):
            inner[k] = k if k in names else inner[self.parent[k]]
        plain, marks = [0] * n, [0] * n  # in a subtree: text outside links; articles, mains and h1 with such text
        for k, _, s in self.runs:
            if not self.in_link[k]:
                plain[k] += len(s) - s.count(" ")
        own = {k: [0, 0] for k in (-1, *self.named)}  # articles and mains, h1, by the innermost named element
        for k in range(n - 1, 0, -1):
            if self.tag[k] in ("article", "main", "h1") and plain[k]:
                marks[k] += 1
                own[inner[k]][self.tag[k] == "h1"] += 1
            plain[self.parent[k]] += plain[k]
            marks[self.parent[k]] += marks[k]
        outside = {-1: (0, 0)}  # the same outside a named element, but for what lies in others that don't hold it
        for k in self.named:
            up = inner[self.parent[k]]
            articles, titles = outside[k] = outside[up][0] + own[up][0], outside[up][1] + own[up][1]
            bulk = 2 * plain[k] > plain[0] if not titles else 5 * plain[k] > 4 * plain[0]
            self.dropped[k] = bool(articles) or not (bulk or marks[k] and not titles)
        for k in range(1, n):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]]
        self.runs = [x for x in self.runs if not self.dropped[x[0]]]


def _parse(page: str) -> _Tree:
    tree, stack, at, end = _Tree(), [0], 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b and not tree.dropped[stack[-1]]:
            tree.runs.append((stack[-1], tree.block, page[a:b]))

    def close_to(depth: int) -> None:
        if any(tree.tag[k] not in INLINE for k in stack[depth:]):
            tree.block += 1
        del stack[depth:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                text(m.start() + 9, at - 3)
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[depth]] == tag:
                    close_to(depth)
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[depth]] == "p":
                    close_to(depth)
                    break
                if tree.tag[stack[depth]] not in INLINE:
                    break
        if tag in CLOSED_BY_SAME:
            for depth in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[depth]] in CLOSED_BY_SAME[tag]:
                    close_to(depth)
                    break
                if tree.tag[stack[depth]] in LIST_SCOPES:
                    break
        if tag not in INLINE:
            tree.block += 1
        if tag in ("article", "section", "main", "nav", "header", "footer", "aside") and tree.tag[stack[-1]] == "head":
            stack.pop()
        node = tree.add(tag, stack[-1], m[3])
        if tag in VOID or m[3].endswith("/") and tag in ("path", "rect", "circle", "use"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        stack.append(node)
    tree.prune_named()
    return tree


def _link_adjusted(c: float, t: float, lc: float, lt: float, body_ratio: float) -> float:
    """Characters per tag, times a logarithm that falls as links take over the node."""
    if c <= 0:
        return 0.0
    t, plain = max(t, 1.0), max(c - lc, 1.0)
    base = math.log(c / plain * lc + body_ratio * c + math.e)
    value = max(c / max(lc, 1.0) * t / max(lt, 1.0), 1.0)
    return c / t * math.log(value) / math.log(base) if base > 1.0 else c / t


class _Densities:
    """Characters, tags, links, density and density sum of every node. Inline markup but links is part of its block, no tag."""

    def __init__(self, tree: _Tree, runs: list[tuple[int, int, str]]) -> None:
        n, tag, parent = len(tree.tag), tree.tag, tree.parent
        self.block = [0] * n  # the node itself, or the block that an inline node lies in
        self.above = [-1] * n  # the block around it
        for k in range(1, n):
            self.above[k] = self.block[parent[k]]
            self.block[k] = self.above[k] if tag[k] in INLINE else k
        chars, tags, link_chars, link_tags, direct = ([0] * n for _ in range(5))
        for k, _, s in runs:
            size = len(s) - s.count(" ")
            chars[k] += size
            if tree.in_link[k]:
                link_chars[k] += size
            else:
                direct[self.block[k]] += size
        for k in range(n - 1, 0, -1):
            if not tree.dropped[k]:
                p = parent[k]
                chars[p] += chars[k]
                link_chars[p] += link_chars[k]
                tags[p] += tags[k] + (tag[k] not in INLINE or tag[k] == "a")
                link_tags[p] += link_tags[k] + (tag[k] == "a")
        self.chars, self.link_chars = chars, link_chars
        ratio = link_chars[0] / chars[0] if chars[0] else 0.0
        self.density = [_link_adjusted(chars[k], tags[k], link_chars[k], link_tags[k], ratio) if not tree.dropped[k] else 0.0 for k in range(n)]
        # a block's own text is a child like any other, without tags in it
        self.total = [float(x) for x in direct]
        for k in range(1, n):
            if self.block[k] == k:
                self.total[self.above[k]] += self.density[k]
        self.best = list(range(n))  # of each subtree, the block with the largest sum; ties go to the one that comes first
        for k in range(n - 1, 0, -1):
            if self.block[k] == k:
                p = self.above[k]
                if (self.total[self.best[k]], -self.best[k]) > (self.total[self.best[p]], -self.best[p]):
                    self.best[p] = self.best[k]

    def threshold(self) -> float:
        """The least density on the way from the core up to the body."""
        k = self.best[0]
        least = self.density[k]
        while k:
            k = self.above[k]
            least = min(least, self.density[k])
        return least


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    tree = _parse(page)
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    runs = [(k, b, _html.unescape(s)) for k, b, s in tree.runs]
    found = _Densities(tree, runs)
    if not found.chars[0]:
        return ""
    density, threshold = found.density, found.threshold()
    chosen, titled = [False] * n, [x == "h1" for x in tag]
    for k in range(n):
        if found.block[k] == k and not tree.dropped[k] and density[k] >= threshold and found.chars[k]:
            chosen[found.best[k]] = True
    for k in range(n - 1, 0, -1):
        titled[parent[k]] = titled[parent[k]] or titled[k]
    linked = [2 * found.link_chars[k] > found.chars[k] for k in range(n)]
    textual = [chosen[k] and not linked[k] for k in range(n)]  # lies in a chosen node that is not mostly links
    for k in range(1, n):
        p = parent[k]
        if textual[p] and linked[k] and density[k] < threshold and not (tag[k] in INLINE or tag[k] in ITEMS or titled[k]):
            chosen[k] = False
        elif chosen[p]:
            chosen[k], textual[k] = True, textual[k] or textual[p]
    blocks: dict[int, list[str]] = {}
    for k, b, s in runs:
        if chosen[k]:
            blocks.setdefault(b, []).append(s)
    lines = (BLANK.sub(" ", "".join(x)).strip() for _, x in sorted(blocks.items()))
    return " ".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. Narrow: no shuffle; pages stream through in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    ids = pages.schema["page_id"].dataType.simpleString()
    return short_batches(pages).select("page_id", "url", html_col).mapInArrow(run, f"page_id {ids}, url string, text string, n_chars bigint")
