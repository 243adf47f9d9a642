"""Main text of web pages by tag-path ratios.

Text nodes that play the same part on a page share their path of tags from the
root. For each path the operator sums text length, punctuation and link text
over its nodes; the ratios per node tell prose from menus and captions. Each
node's path ratio is smoothed over its neighbours in page order and fused with
the unsmoothed one. Marks (tags such as ``nav``, roles, class words, titles of
boxes) only weigh the ratio: a mark whose words are all of that kind much, one
among other words ("related-work") little; a mark on an element that holds the
page's articles, or on a page without any most of its prose, weighs nothing.
Paths that reach a share of the mean ratio select their nodes as content.

What was not selected (headings, short items, links in the text) follows the
least element around it that holds content: it is kept if most of that element's
text is content, but for boxes of links alone. If the page has articles (or a
main element) that hold half of the content, what is outside them, but for
titles beside them, weighs a tenth, and the selection is made anew.

One narrow pass over the pages; no shuffle, and a page is the unit of memory. All
steps take time in proportion to the page, however deep its elements are nested.

Defined results: null, empty and text-free pages give an empty string; markup
that is cut off or wrongly nested never fails; repeated rows give repeated
results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.columns import giving_back, text_slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[/a-zA-Z][^<>]*+\Z""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟؛।]")

# The element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
# Elements that their kind ends if still open, up to the nearest of the bounds.
ENDS = {"p": ({"p"}, {"body"}), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th", "p"}, {"tr"}), "th": ({"td", "th", "p"}, {"tr"}), "option": ({"option"}, {"select"})}

# Elements, roles and words of class and id that mark what isn't the article.
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
ASIDE_WORDS = frozenset("alert toast paywall captcha ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations trending popular widget pagination pager skip hidden".split())
#: Words that go with any of those and say nothing by themselves.
PLAIN_WORDS = frozenset("area article articles bar block body bottom box button buttons card cards col column container content div entry fixed form group header holder inner item items left link links list main media message module outer page panel post posts primary region right row secondary section side site small stories story sticky thread top unit user users wrap wrapper".split())
#: Titles of boxes that aren't the article, as a whole text.
BOX_TITLE = re.compile(r"(?:most |also )?(?:popular|trending|read|viewed)(?: now| stories| posts| articles)?|(?:latest|recent|related|recommended|more|similar|popular|trending|other) (?:posts?|articles?|stories|news|comments?|reading|links|content)|(?:you (?:may|might) also like|read (?:more|next)|more from .{1,40}|recommended(?: for you)?|related|share(?: this(?: (?:article|post|story))?)?|follow us|advertisement|sponsored(?: content)?|subscribe(?: to .{1,40})?|sign up.{0,40}|(?:our )?newsletter|(?:[0-9]+ )?comments?|leave a (?:comment|reply)|tags|categories|search|archives?)\W*", re.I)
STRONG, WEAK, OUTSIDE = 0.01, 0.5, 0.1  # weights of marks, and of what is outside the articles
SHARE = 0.15  # of the mean ratio that a content path reaches
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 summary legend caption dt".split())
_BOXES = frozenset("div section aside ul ol dl table".split())


class _Node:
    __slots__ = ("tag", "parent", "path", "mark", "link", "head", "inside", "weight", "chars", "linked", "heads", "goals", "titled", "title", "content", "plain", "near", "root", "box")

    def __init__(self, tag: str, parent: "_Node | None", path: int, mark: float) -> None:
        self.tag, self.parent, self.path, self.mark = tag, parent, path, mark
        self.link = tag == "a" or bool(parent and parent.link)
        self.head = tag in _HEADINGS or bool(parent and parent.head)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.chars = self.linked = self.heads = self.goals = self.titled = self.content = self.plain = 0
        self.title: str | None = None
        self.weight, self.near, self.root, self.box = 1.0, None, None, False


def _mark(tag: str, attrs: str, inside: bool) -> float:
    """Weight of what the element says of itself; ``inside``: it stands in an article. 0: it isn't shown."""
    weight = STRONG if tag in ASIDE_TAGS or tag == "header" and not inside else 1.0
    if not attrs:
        return weight
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
        if name == "role" and value.lower() in ASIDE_ROLES or name == "aria-hidden" and value.lower() == "true":
            weight = STRONG
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token)}
                said = words & ASIDE_WORDS or ({"header"} & words if not inside else set())
                if said:
                    weight = min(weight, STRONG if not words - ASIDE_WORDS - PLAIN_WORDS - {w for w in words if w.isdigit()} else WEAK)
    return weight


def parse(page: str) -> tuple[list[_Node], list[tuple[_Node, int, str]]]:
    """(elements, parents before children; (innermost element, block number, text) of each text node, references decoded)."""
    root = _Node("", None, 0, 1.0)
    elements, out, paths, still = [root], [], {}, {}
    now, block, at = root, 0, 0
    size = len(page)

    def add(text: str) -> None:
        if text:
            out.append((now, block, entities.unescape(text)))

    def close(to: _Node) -> None:
        # up to, and without, the element ``to``
        nonlocal now
        while now is not to:
            still[now.tag] -= 1
            now = now.parent

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attrs = name.lower(), m[1] or m[4], (m[3] or m[6] or "").strip()
        if closing:
            if still.get(tag):
                node = now
                while node.tag != tag:
                    # an inline end tag doesn't reach beyond its block
                    if node.tag in BLOCK and tag not in BLOCK:
                        node = root
                        break
                    node = node.parent
                if node is not root:
                    close(node.parent)
            if tag in BLOCK:
                block += 1
            elif tag == "br":
                out.append((now, block, " "))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag in ("noscript", "template", "select", "svg", "math", "object") and not end:
                continue
            at = end.end() if end else size
            continue
        if tag in ENDS:
            kinds, bounds = ENDS[tag]
            node, last = now, None
            while node is not root and node.tag not in bounds and node.tag not in ("table", "article", "section", "div"):
                if node.tag in kinds:
                    last = node
                node = node.parent
            if last is not None:
                close(last.parent)
        elif tag in BLOCK and now.tag == "p":
            close(now.parent)
        if tag in BLOCK:
            block += 1
        if tag == "br":
            out.append((now, block, " "))
        if tag not in VOID:
            path = paths.setdefault((now.path, tag), len(paths) + 1)
            now = _Node(tag, now, path, _mark(tag, attrs, now.inside))
            still[tag] = still.get(tag, 0) + 1
            elements.append(now)
    return elements, out


def _weigh(elements: list[_Node], nodes: list[tuple[_Node, int, str]]) -> None:
    """Sums of each element, and its weight: its marks and those around it, but for marks that the rest of the page refutes."""
    for node, _, text in nodes:
        n = sum(map(str.isalnum, text))
        if not n:
            continue
        node.chars += n
        node.linked += n * node.link
        node.heads += n * node.head
        up = node
        while up is not None and up.title is None:  # each element's first text: every element is passed once
            up.title = text
            up = up.parent
    for e in reversed(elements):
        e.titled += e.tag == "h1" and e.chars > 0 and e.parent.tag not in ("header", "nav")
        e.goals += e.tag in ("article", "main") and e.chars > 0 and not (e.parent and e.parent.inside)
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
            e.parent.heads += e.heads
            e.parent.goals += e.goals
            e.parent.titled += e.titled
    page = elements[0]
    prose = page.chars - page.linked
    for e in elements:
        mark = e.mark
        if e.tag in ("div", "section", "aside") and e.title is not None and e.title.strip() and BOX_TITLE.fullmatch(e.title.strip()):
            mark = min(mark, STRONG)
        if 0 < mark < 1:
            # holds all articles; without any, most of the prose and the title, or hardly anything is left without it
            own = e.chars - e.linked
            holds = e.goals == page.goals if page.goals else e.tag not in ("nav", "footer", "header") and 2 * own > prose and (e.titled > 0 or 4 * own > 3 * prose and not page.titled)
            mark = 1.0 if holds else mark
        e.weight = mark * (e.parent.weight if e.parent else 1.0)


def path_scores(nodes: list[tuple[_Node, int, str]]) -> np.ndarray:
    """Fused and weighted ratio of each node's path."""
    sums: dict[tuple[int, float], list[float]] = {}
    keys = []
    for node, _, text in nodes:
        key = (node.path, node.weight)
        keys.append(key)
        s = sums.setdefault(key, [0, 0, 0, 0])
        n = len(text.strip())
        s[0] += n
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += n * node.link
        s[3] += n > 0
    ratio = {}
    for key, (length, marks, linked, count) in sums.items():
        share = linked / length if length else 0.0
        k = max(count, 1)
        ratio[key] = math.log1p(length / k) * math.log1p(1 + marks / k) * (1 - share)
    raw = np.array([ratio[key] for key in keys])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = np.convolve(np.pad(raw, 2, mode="edge"), kernel / kernel.sum(), "valid") if len(raw) else raw
    return np.sqrt(raw * smooth) * np.array([w for _, w in keys])


def select(nodes: list[tuple[_Node, int, str]], score: np.ndarray) -> np.ndarray:
    """Which nodes are content: those that reach a share of the mean score of a character, marked ones aside."""
    length = np.array([len(text.strip()) for _, _, text in nodes], float)
    full = length * np.array([node.weight >= WEAK * WEAK for node, _, _ in nodes])
    if not full.any():
        return np.zeros(len(nodes), bool)
    return (score >= SHARE * (score * full).sum() / full.sum()) & (score > 0) & (length > 0)


def _count(elements: list[_Node], nodes: list[tuple[_Node, int, str]], chosen: np.ndarray) -> None:
    """Characters of content, and of all that isn't marked, in each element."""
    for e in elements:
        e.content = e.plain = 0
    for (node, _, text), ok in zip(nodes, chosen.tolist(), strict=True):
        n = len(text.strip())
        node.content += n * ok
        node.plain += n * (node.weight >= WEAK * WEAK)
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.content += e.content
            e.parent.plain += e.plain


def _lower_outside(elements: list[_Node]) -> bool:
    """If all outermost articles (or main elements) that aren't marked hold half of the content, weigh the rest less."""
    for tag in ("article", "main"):
        tops = []
        for e in elements:
            e.root = e.parent.root if e.parent else None
            if e.root is None and e.tag == tag and e.weight >= WEAK and e.chars:
                e.root = e
                tops.append(e)
        if tops and 2 * sum(t.content for t in tops) >= elements[0].content:
            beside = {id(t.parent) for t in tops}
            for e in elements:
                # a title beside the article, or in the main element around it, belongs to it
                if e.root is None and e.tag == "h1" and (e.inside or id(e.parent) in beside):
                    e.root = e
                elif e.root is None and e.parent is not None and e.parent.root is not None:
                    e.root = e.parent.root
                if e.root is None:
                    e.weight *= OUTSIDE
            return True
    return False


def main_text(page: str | None) -> str:
    """The article of a page: one line per block."""
    elements, nodes = parse(page or "")
    _weigh(elements, nodes)
    chosen = select(nodes, path_scores(nodes))
    _count(elements, nodes, chosen)
    if _lower_outside(elements):
        chosen = select(nodes, path_scores(nodes))
        _count(elements, nodes, chosen)
    for e in elements:
        up = e.parent
        e.near = e if e.content else up.near if up else None
        loose = e.root is None and (e.near is None or e.near.tag in ("", "html", "body"))
        own = e.chars - e.heads
        alone = own > 0 and e.linked >= 0.8 * own
        # a list of links in the flow of the article is part of it, a box of links isn't
        e.box = bool(up and up.box) or e.tag in _BOXES and not e.content and alone and (loose or e.tag == "div")
    blocks: dict[int, list[str]] = {}
    for (node, block, text), ok in zip(nodes, chosen.tolist(), strict=True):
        if not ok:
            if node.weight < WEAK * WEAK or node.box:
                continue
            near = node.near
            if node.root is None and (near is None or 2 * near.content < near.plain or node.link and near.tag in ("", "html", "body")):
                continue
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in text_slices(batch, "html"):
                texts = [main_text(p) for p in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(giving_back(run), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
