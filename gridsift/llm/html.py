"""Main text of web pages by tag-path ratios (operator 2).

A page becomes blocks of text, each with its path of tags from the root. For every path the length of its text and its
punctuation are added up as ratios to its blocks, lowered by the share of link text, smoothed over the paths that are
neighbours on the page, fused to one score, weighted by what tags, class and id say, and compared with a threshold. Paths
above it are content. They lie in an article or a range of the page, where other paths are content too unless they
are menus (short blocks of links) or are clearly marked as something else; headings that adjoin belong to it.
Elements that by their own name or role are never text of an article (nav, aside, script ...) are left out, as is a form,
unless it holds most of the page's text. All steps take time in proportion to the page, however deep its elements.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm.common import in_small_batches, table

# Fixed values of HTML: element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIP = frozenset("head script style noscript template title textarea iframe noembed noframes object svg math canvas audio video select option button fieldset nav aside footer menu dialog".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 header hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary center hr".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "li", "dt", "dd"} | {"nav", "aside", "footer", "form", "fieldset", "menu", "dialog"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARIA = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that speak against a part of an article; header ones do not in names such as post-header.
CONTENT_WORDS = frozenset("content main article story post entry".split())  # as whole names they outweigh those that speak against it
HEADER_WORDS, PAGE_WORDS = frozenset("header banner masthead".split()), frozenset("site page top main global nav".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu menubar topnav breadcrumb breadcrumbs sidebar sidenav aside rail widget widgets "
    "footer foot colophon masthead header topbar cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay comment comments commentlist respond disqus reply replies discussion thread remarks "
    "share sharing social related recommended recommendations pagination pager toolbar search searchform form hidden skip copyright legal disclaimer".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
MARKS = re.compile(r"(?:class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，،]")
#: Words that only say what kind of part it is: with these alone, a name says as much as without.
KINDS = frozenset("area bar block body box buttons column container form inner item items lane layer links list main outer panel posts region rows section slot text top bottom left right view wrap wrapper zone".split())
#: Share of a score that is left where class or id speak against a part, by how clearly they do: not, as one word of a longer name, as a whole name.
LEFT = (1.0, 0.8, 0.3)
#: A punctuation mark counts as much as so many characters.
MARKED = 5
#: A path through an article or main element scores so many times more.
ARTICLE = 3.0
#: And one whose blocks have a heading beside them.
HEADED = 2.0
#: Paths are content from this share of the mean score of the page's text on, in which text weighs by its score; blocks with more link text than LINKS are menus if they are shorter than SHORT.
ENOUGH, LINKS, SHORT = 0.6, 0.5, 60
#: A form that holds this share of the page's text is no form, but a frame of the page.
FRAME = 0.5


def judged(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is never text of an article, and how clearly its class and id speak against it (see LEFT)."""
    if tag in SKIP:
        return True, 0
    if not attrs or attrs.isspace():
        return False, 0
    against, content = 0, False
    for m in MARKS.finditer(attrs):
        name, value = m[0].split("=")[0].strip().lower(), m[1] or m[2] or m[3] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "role" and value.lower() in ARIA:
            return True, 0
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            content = content or not CONTENT_WORDS.isdisjoint(value.lower().split())
            for token in value.split():
                parts = [x.lower() for x in PARTS.findall(token)]
                found = NOT_ARTICLE.intersection(parts)
                if len(parts) > 1 and found <= HEADER_WORDS and not PAGE_WORDS.intersection(parts):
                    continue  # the header of something on the page
                if found:
                    against = max(against, 2 if all(x in NOT_ARTICLE or x in KINDS for x in parts) else 1)
    return False, 0 if content else against


class Node:
    __slots__ = ("tag", "parent", "skip", "against", "depth", "path", "link", "article", "header", "form", "block", "headed", "place", "end", "held")

    def __init__(self, tag: str, parent: Node | None, skip: bool, against: int, paths: dict[tuple, int], nodes: list[Node]):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.against = max(against, parent.against) if parent else against
        self.depth = parent.depth + 1 if parent else 0
        self.path = paths.setdefault((parent.path if parent else None, tag, self.against), len(paths))  # a number: paths share their beginnings
        self.link = tag == "a" or parent is not None and parent.link
        self.article = self if tag in ("article", "main") else parent.article if parent else None  # the innermost
        self.header = tag == "header" or parent is not None and parent.header
        self.form = (parent.form if parent else None) or (self if tag == "form" else None)
        self.block = self if tag in BLOCK or tag in SKIP or tag == "form" or parent is None else parent.block
        self.place = self.end = len(nodes)  # elements in it are numbered from place to end
        self.headed, self.held = False, 0.0
        if parent is not None and tag in HEADINGS:
            parent.headed = True
        nodes.append(self)


def blocks_of(page: str) -> tuple[list[tuple[Node, list[tuple[Node, str]]]], list[Node]]:
    """The page's blocks in order, each with the element that makes it and its text nodes; and all elements, parents first."""
    paths: dict[tuple, int] = {}
    nodes: list[Node] = []
    root = Node("", None, False, 0, paths, nodes)
    here, at = root, 0
    opened: dict[str, list[Node]] = defaultdict(list)  # of each name, the elements that are open
    blocks: list[tuple[Node, list[tuple[Node, str]]]] = []
    run: list[tuple[Node, str]] = []

    def end_block() -> None:
        nonlocal run
        if run:
            blocks.append((run[0][0].block, run))
            run = []

    def leave(node: Node) -> None:
        nonlocal here
        x = here
        while x is not node.parent:
            if x.block is x:
                end_block()
            opened[x.tag].pop()
            x = x.parent
        here = node.parent

    def find(names: tuple[str, ...], barrier: tuple[str, ...] = ()) -> Node | None:
        """The innermost open element of these names, if none of the barrier's is open within it."""
        inner = max((opened[n][-1] for n in names if opened[n]), key=lambda x: x.depth, default=None)
        return inner if inner and all(not opened[b] or opened[b][-1].depth < inner.depth for b in barrier) else None

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not here.skip:
            run.append((here, page[at : m.start()]))
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            if m[0].startswith("<![CDATA[") and not here.skip:
                run.append((here, m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if tag == "br":
                run.append((here, " "))
            elif tag == "p" and find(("p",), ("article", "section", "div", "body")) is None:
                end_block()
            elif (x := find((tag,), () if tag in BLOCK or tag in SKIP or tag == "form" else ("td", "th", "table"))) is not None:
                leave(x)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag in ("br", "wbr", "img", "input") and run:
                run.append((here, " " if tag != "wbr" else ""))
            continue
        if tag in CLOSES_P and (x := find(("p",), ("table", "article", "section", "div", "body", "button"))) is not None:
            leave(x)
        if tag in SIBLINGS and (x := find(SIBLINGS[tag], BARRIER[tag])) is not None:
            leave(x)
        if tag == "body" and (x := find(("head",))) is not None:
            leave(x)
        if tag in BLOCK or tag in SKIP or tag == "form":
            end_block()
        skip, against = judged(tag, m[3] or "")
        label = tag in ("label", "legend") and here.form is not None
        here = Node(tag, here, here.skip or skip or label, against, paths, nodes)
        opened[tag].append(here)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            leave(here)
    if at < len(page) and not here.skip:
        run.append((here, page[at:]))
    end_block()
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.end = max(node.parent.end, node.end)
    return blocks, nodes


class Paths:
    """Sums and decisions for the paths of a page's blocks (node, words, length of link text)."""

    def __init__(self, blocks: list[tuple[Node, str, int]]):
        chars, links, marks, count = (defaultdict(int) for _ in range(4))
        self.marked, weight = set(), {}
        for node, words, linked in blocks:
            p = node.path
            chars[p] += len(words)
            links[p] += min(linked, len(words))
            marks[p] += len(PUNCTUATION.findall(words))
            count[p] += 1
            beside = node.parent is not None and node.parent.headed
            weight[p] = max(weight.get(p, 0), LEFT[node.against] * (ARTICLE if node.article else 1) * (HEADED if beside else 1))
            if node.against == 2:
                self.marked.add(p)
        order = list(chars)  # paths in page order
        share = {p: links[p] / chars[p] for p in order}
        ratio = [(chars[p] - links[p]) / count[p] * (1 + MARKED * marks[p] / chars[p]) * (1 - share[p]) for p in order]
        smooth = [(2 * r + (ratio[i - 1] if i else r) + (ratio[i + 1] if i + 1 < len(ratio) else r)) / 4 for i, r in enumerate(ratio)]
        self.score = {p: (r * s) ** 0.5 * weight[p] for p, r, s in zip(order, ratio, smooth, strict=True)}
        mass = sum(self.score[p] * chars[p] for p in order)
        limit = ENOUGH * sum(self.score[p] ** 2 * chars[p] for p in order) / mass if mass else 0
        self.content = {p for p in order if self.score[p] >= limit and self.score[p] > 0}
        self.menus = {p for p in order if share[p] > LINKS and chars[p] < SHORT * count[p]}

    def fits(self, node: Node) -> bool:
        """Whether a block in the midst of content belongs to it."""
        return node.path in self.content or node.path not in self.marked and (node.path not in self.menus or node.tag in HEADINGS)


def content_root(blocks: list[tuple[Node, str, int]], nodes: list[Node], paths: Paths) -> Node | None:
    """The smallest element that holds most of the content paths' text, weighed by their scores, or the article that it is in; of equally deep ones there can't be two."""
    for node, words, _ in blocks:
        if node.path in paths.content:
            node.held += len(words) * paths.score[node.path]
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.held += node.held
    total = nodes[0].held
    if not total:
        return None
    top = max((x for x in nodes if 2 * x.held > total), key=lambda x: x.depth)
    return top.article or top


def main_text(page: str | None) -> str:
    """The article's text: one line per block, white space within a block as one space. None or no article: ''."""
    if not page:
        return ""
    runs, nodes = blocks_of(page)
    blocks = []
    in_form: dict[Node, int] = defaultdict(int)
    for node, run in runs:
        words = " ".join(entities.unescape("".join(t for _, t in run)).split())
        if words:
            blocks.append((node, words, sum(len(t.strip()) for n, t in run if n.link)))
            in_form[node.form] += len(words)
    forms = {f for f, n in in_form.items() if f is not None and n < FRAME * sum(in_form.values())}
    blocks = [b for b in blocks if b[0].form not in forms]
    paths = Paths(blocks)
    root = content_root(blocks, nodes, paths)
    if root is None:
        return ""
    inside = [root.place <= node.place <= root.end for node, _, _ in blocks]
    if root.article is root:
        taken = [i for i, (node, _, _) in enumerate(blocks) if inside[i] and paths.fits(node)]
    else:  # content paths, all of the element that holds most of them, and headings before
        free = [paths.fits(node) and not node.header for node, _, _ in blocks]
        whole = root.tag not in ("", "html", "body")
        seeds = [i for i, (node, _, _) in enumerate(blocks) if free[i] and (node.path in paths.content or whole and inside[i])]
        if not seeds:
            return ""
        low, high = seeds[0], seeds[-1]
        while low and free[low - 1] and blocks[low - 1][0].tag in HEADINGS:
            low -= 1
        taken = [i for i in range(low, high + 1) if free[i]]
    return "\n".join(blocks[i][1] for i in taken)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row per row of pages; each page is judged by itself, in one pass without a shuffle.

    pages needs page_id, url and html; other columns are ignored, whatever they are called. Null or empty html: empty text. Markup without
    an article: empty text. Plain text without markup: that text. Pages of any length and depth are taken whole, in time in proportion to their length. Of elements that hold most of the
    text, the deepest counts; paths of equal score are all content or none. Repeated rows give repeated results. An empty table gives an empty result.
    """
    plain = in_small_batches(pages.select("page_id", "url", "html"))
    return plain.mapInArrow(_extracted, f"page_id {plain.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
