"""HTML extraction by tag-path ratios.

A page's text is cut into blocks; inline elements count with the text around them. Each block has the path of its block
elements from the root. For a path the text length, the punctuation and the link text of its blocks are aggregated, and
for every path above it those of all blocks below: mean length times one more than the mean punctuation is a ratio. A
path's ratio is smoothed over those of the paths above it, nearer ones weighing more, and fused with two signals: text
that is all links counts little, and being below an ``article`` or ``main`` element counts much. Paths whose fused ratio is at least
SHARE of the page's length-weighted mean are content, with the headings of what follows them. Elements that name
themselves as no content (menus, headers, footers, sidebars, forms, adverts, notices, comments, scripts and styles) go
before that with all below them, and take no part in the ratios.

Paths are numbered by their parent and tag, and a tag looks at the innermost block only, so that work grows with the
page's length, however deep its elements nest.

Defined cases: null and empty html give an empty text; unclosed and wrongly nested tags close as browsers do for blocks;
a tag that never ends is text; a quoted value of over QUOTED characters ends at the next ``>`` ; white space inside a block
is one space, also for ``br``; blocks are joined by a line end; equal pages each give a row; pages of any length are read
whole, inside one task's memory.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame, functions as F

from harborscan.llm.common import map_arrow

QUOTED = 4096
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|title|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"]{{0,{QUOTED}}}+\"|'[^']{{0,{QUOTED}}}+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<|[^<]+",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements, and words of a class, id or role, that are no content.
AWAY = frozenset("head nav header footer aside form button select menu dialog".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "sidebar sidenav rail aside widget widgets footer foot header masthead topbar toolbar comment comments respond reply replies disqus discussion share sharing social related recommended newsletter subscribe signup login search form contentinfo complementary".split()
)
#: A path is content from this share of the page's weighted mean on.
SHARE = 0.25
#: What being below an article is worth, what link text is worth, and how much less a path counts with each step up.
PRIOR, LINKS, STEP = 64.0, 0.05, 0.6
#: Steps up over which a path is smoothed.
REACH = 6
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")


def _is_away(tag: str, attributes: str) -> bool:
    if tag in AWAY:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    return any(w in AWAY_WORDS for m in _NAMED.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()))


class Page:
    """The text nodes of a page that no element rules out, and its paths.

    nodes: (text, path, block, whether inside a link). paths: (parent, tag, whether below an article) by number; 0 is the root.
    """

    def __init__(self, html: str):
        self.nodes: list[tuple[str, int, int, bool]] = []
        self.paths: list[tuple[int, str, bool]] = [(-1, "", False)]
        numbers: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, path, ruled out, inside a link
        blocks: list[int] = [0]  # places of block elements on the stack
        opened: dict[str, int] = {}
        block = 0

        def close(at: int) -> None:
            for tag, *_ in stack[at:]:
                opened[tag] -= 1
            del stack[at:]
            while blocks[-1] >= len(stack):
                blocks.pop()

        end = html.rfind(">") + 1
        for m in _TOKEN.finditer(html, 0, end):
            tag = m[3] or m[6]
            if tag is None:
                if not (m[0][0] == "<" and len(m[0]) > 1) and not stack[-1][2]:
                    self.nodes.append((unescape(m[0]), stack[-1][1], block, stack[-1][3]))
                continue
            tag, attributes = tag.lower(), (m[4] if m[3] else m[7]) or ""
            if m[2] or m[5]:
                if opened.get(tag):
                    at = len(stack) - 1
                    while stack[at][0] != tag:
                        at -= 1
                    close(at)
                block += tag in BLOCK
                continue
            if tag == "br":
                if not stack[-1][2]:
                    self.nodes.append((" ", stack[-1][1], block, stack[-1][3]))
                continue
            if tag in BLOCK:
                block += 1
                for ended in ("p",) if tag not in ("li", "dd", "dt", "tr", "td", "th") else ("p", tag):
                    if stack[blocks[-1]][0] == ended:
                        close(blocks[-1])
            if tag in VOID or attributes.rstrip().endswith("/"):
                continue
            _, path, away, link = stack[-1]
            if tag in BLOCK:
                known = numbers.setdefault((path, tag), len(self.paths))
                if known == len(self.paths):
                    self.paths.append((path, tag, self.paths[path][2] or tag in ("article", "main")))
                path = known
                blocks.append(len(stack))
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, path, away or _is_away(tag, attributes), link or tag == "a"))
        if end < len(html) and not stack[-1][2]:
            self.nodes.append((unescape(html[end:]), stack[-1][1], block, stack[-1][3]))

    def units(self) -> dict[tuple[int, int], list]:
        """(block, path) -> [text, characters inside links]: a block's own text, in page order."""
        out: dict[tuple[int, int], list] = {}
        for text, path, block, link in self.nodes:
            unit = out.setdefault((block, path), ["", 0])
            unit[0] += text
            unit[1] += len(text.strip()) * link
        return {k: u for k, u in out.items() if u[0].strip()}


def fused_ratios(page: Page, units: dict[tuple[int, int], list]) -> dict[int, float]:
    """The fused ratio of each path that has text of its own."""
    n = len(page.paths)
    length, marks, count, linked = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    own_length: dict[int, float] = {}
    own_linked: dict[int, float] = {}
    for (_, path), (text, links) in units.items():
        size = len(text.strip())
        length[path] += size
        marks[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
        own_length[path] = own_length.get(path, 0.0) + size
        own_linked[path] = own_linked.get(path, 0.0) + links
    own = {path: length[path] / count[path] * (1 + marks[path] / count[path]) for path in own_length}
    for path in range(n - 1, 0, -1):  # a path's number is above its parent's
        up = page.paths[path][0]
        for sums in (length, marks, count):
            sums[up] += sums[path]
    out = {}
    for path in own_length:
        total = weight = 0.0
        at, w = path, 1.0
        for _ in range(REACH):
            if at < 0 or page.paths[at][1] in ("", "html", "body") and at != path:
                break
            total += w * math.log(own[at] if at == path else length[at] / count[at] * (1 + marks[at] / count[at]))
            weight += w
            at, w = page.paths[at][0], w * STEP
        share = min(1.0, own_linked[path] / own_length[path])
        prior = PRIOR if page.paths[path][2] else 1.0 - (1.0 - LINKS) * share
        out[path] = math.exp(total / weight) * prior
    return out


def content_paths(page: Page, units: dict[tuple[int, int], list], share: float = SHARE) -> set[int]:
    """The paths that the threshold keeps, and headings right before them."""
    if not units:
        return set()
    fused = fused_ratios(page, units)
    order = [(path, len(text.strip())) for (_, path), (text, _) in units.items()]
    plain = {p: f / (PRIOR if page.paths[p][2] else 1.0) for p, f in fused.items()}
    bar = share * sum(plain[p] * n for p, n in order) / sum(n for _, n in order)
    kept = {p for p, f in fused.items() if f >= bar}
    for (path, _), (following, _) in zip(order, order[1:]):
        if following in kept and re.fullmatch("h[1-6]", page.paths[path][1]):
            kept.add(path)
    return kept


def main_text(html: str | None, share: float = SHARE) -> str:
    page = Page(html or "")
    kept = content_paths(page, page.units(), share)
    blocks: dict[int, list[str]] = {}
    for text, path, block, _ in page.nodes:
        if path in kept or not text.strip():
            blocks.setdefault(block, []).append(text)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in blocks.values()) if t)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def each(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield {"page_id": b.column(0), "url": b.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, each, "page_id long, url string, text string, n_chars long")
