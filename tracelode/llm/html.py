"""HTML extraction by tag-path ratios.

A page is read once into blocks of text (what stands between the starts and ends of block elements), each with its root-to-leaf
path of block elements and their classes. Per path, text length and punctuation are added up and divided by the number of blocks;
the ratios of both are smoothed over the page's order (a path counts as its neighbours do) and fused as the geometric mean.

What elements and classes say (menus, page headers, footers, sidebars, forms, notices, adverts, reader comments and the like) are only
weights of these ratios:
1. The content node. Paths whose weighted ratio (MARKED for each tag that is no part of an article, and once for marks) is below LEAST_RATIO of the best one are left out; the
   content is the element lowest in the tree that holds MOST_TEXT of the text of the paths that are left. Where those with the fewest
   marks hold LEAST_SHARE of that text or more, only they count, so that long comments don't take an article's place. From there it grows to
   the elements around it as long as these have blocks of the paths that are left beside it, with no mark in between: anywhere in an
   article, elsewhere only paragraphs and headings of their own, so that a title and a lead stay with a long section.
2. Its parts. Of the blocks in it those stay whose ratio is LEAST_INSIDE of the best one in it or more, weighed by the marks between the
   content and them (INSIDE each; a mark on a paragraph, list item or heading itself only PARAGRAPH). So a form or a strangely named
   element around the whole article costs nothing, but an advert or a comment in the article does. Elements that are a menu, footer or
   sidebar by their tag weigh INSIDE wherever they are.

Text: character references are decoded, white space inside a block (a line break element too) becomes one blank, blocks are trimmed
and joined in page order by an empty line; nothing else is dropped or capped. Time and memory are linear in the page, however deep.

Cases: null html is empty; a page without text gives the empty string; unclosed elements, quotes and comments end where browsers end
them, at the latest with the page; repeated rows give equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import common as C

#: Part of the best fused ratio that a path needs; weight of a neighbour in smoothing; part of the text that the content holds.
LEAST_RATIO, NEIGHBOUR, MOST_TEXT = 0.12, 0.25, 0.7
#: Part of the text of the chosen paths that those with the fewest marks must hold to be the only ones that count.
LEAST_SHARE = 0.05
#: Weight of a mark on the path; part of the best ratio needed in the content; weight of a mark in it, and of one on a paragraph.
MARKED, LEAST_INSIDE, INSIDE, PARAGRAPH = 0.1, 0.001, 0.0002, 0.5

RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body head address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no part of an article; FORM ones may be around it.
NEVER = frozenset("head nav header footer aside menu dialog select button label search".split())
FORM = frozenset("form fieldset".split())
PARAGRAPHS = frozenset("p li dt dd blockquote pre td th figcaption caption h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class or id that mark what isn't part of an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside rail comment comments disqus respond reply replies discussion menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer bottom legal cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup signin login register paywall share sharing social related recommended recommendations teaser widget tags login search copyright disclaimer hidden skip".split()
)
#: What a start tag ends if it is open: the elements that can't hold it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table select article section div body html main".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>"
    r"|<[a-zA-Z/!?][^>]*+>"
    r"|<[a-zA-Z/!?][^>]*+\Z"
)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


class Element:
    """holder: the next block element, itself included; never, marks, soft: how many elements from the root down to this one are no
    part of an article by their tag, are marked (or forms), and are marked paragraphs; end: the last element in it; mass, near, own: the
    text of chosen blocks in it, how many of them no mark stands between, and how many are its own paragraphs."""

    __slots__ = ("name", "path", "parent", "holder", "block", "at", "end", "depth", "article", "never", "marks", "soft", "mass", "near", "own")

    def __init__(self, name: str, parent: Element | None, block: bool, at: int, marked: bool) -> None:
        self.name, self.parent, self.block, self.at, self.end, self.mass = name, parent, block, at, at, 0
        self.near, self.own = 0, 0
        self.holder = self if block or parent is None else parent.holder
        up = parent
        self.depth = up.depth + block if up else 0
        self.article = name == "article" or up is not None and up.article
        bad = name in NEVER and not (name == "header" and self.article)
        marked = marked and name not in ("html", "body", "article", "main")
        self.never = (up.never if up else 0) + bad
        self.marks = (up.marks if up else 0) + (name in FORM or marked and not bad and name not in PARAGRAPHS)
        self.soft = (up.soft if up else 0) + (marked and name in PARAGRAPHS)
        self.path = up.path if up else 0


def _marks(rest: str) -> tuple[str, bool]:
    """The class of a tag for its path, and whether it marks what isn't part of an article."""
    if "=" not in rest and "hidden" not in rest:
        return "", False
    found = [a or b or c for a, b, c in _MARK.findall(rest)]
    marked = bool(_HIDDEN.search(rest)) or any(w.lower() in MARKS for x in found for w in _WORD.findall(x)) or any(x.lower() in ("complementary", "contentinfo", "banner") for x in found)
    return found[0].strip() if found else "", marked


def blocks(html: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """The page's blocks of text in order, each with the block element that holds it; and all elements in the order they begin."""
    root = Element("", None, True, 0, False)
    stack, elements = [root], [root]
    open_: dict[str, int] = defaultdict(int)  # elements on the stack by name
    paths: dict[tuple[int, str, str], int] = {}
    out: list[tuple[Element, str]] = []
    text: list[str] = []

    def close() -> None:
        if text:
            s = " ".join(unescape("".join(text)).split())
            text.clear()
            if s:
                out.append((stack[-1].holder, s))

    def cut(k: int) -> None:
        last = elements[-1].at
        for e in stack[k:]:
            e.end = last
            open_[e.name] -= 1
        del stack[k:]

    at = 0
    while (m := _TOKEN.search(html, at)) is not None:
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if open_[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                if any(e.block for e in stack[k:]):
                    close()
                cut(k)
            elif name in BLOCK:
                close()
            continue
        rest = m["rest"]
        if name in RAW:
            if not rest.endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I).search(html, at)
                at = end.end() if end else len(html)
            text.append(" ")
            continue
        if name in ("br", "hr", "wbr", "img", "input"):
            if name == "hr":
                close()
            elif name != "wbr":
                text.append(" ")
            continue
        if name in VOID:
            continue
        block = name in BLOCK
        if block:
            close()
            ends = ENDS.get(name, frozenset()) | (HEADING if name in HEADING else frozenset()) | {"p"}
            if any(open_[e] for e in ends):
                for k in range(len(stack) - 1, 0, -1):
                    e = stack[k].name
                    if e in ends:
                        cut(k)
                        if e == "p":
                            break
                    elif e in SCOPE:
                        break
        if not rest.endswith("/") or block:
            kind, marked = _marks(rest)
            e = Element(name, stack[-1], block, len(elements), marked)
            if block:
                e.path = paths.setdefault((e.path, name, kind), len(paths) + 1)
            elements.append(e)
            stack.append(e)
            open_[name] += 1
    text.append(html[at:])
    close()
    cut(0)
    return out, elements


def _smooth(x: list[float]) -> list[float]:
    n = len(x)
    return [(x[i] + NEIGHBOUR * ((x[i - 1] if i else 0.0) + (x[i + 1] if i + 1 < n else 0.0))) / (1 + NEIGHBOUR * ((i > 0) + (i + 1 < n))) for i in range(n)]


def ratios(found: list[tuple[Element, str]]) -> dict[int, float]:
    """The fused ratio of each path: text length and punctuation per block, both smoothed over the page."""
    length, marks, n = defaultdict(float), defaultdict(float), defaultdict(int)
    for e, s in found:
        length[e.path] += len(s)
        marks[e.path] += len(_PUNCTUATION.findall(s))
        n[e.path] += 1
    by_length = _smooth([length[e.path] / n[e.path] for e, _ in found])
    by_marks = _smooth([marks[e.path] / n[e.path] for e, _ in found])
    fused: dict[int, float] = defaultdict(float)
    for (e, _), a, b in zip(found, by_length, by_marks):
        fused[e.path] += math.sqrt(a * (b + 0.1))
    return {p: v / n[p] for p, v in fused.items()}


def content_of(found: list[tuple[Element, str]], elements: list[Element], fused: dict[int, float]) -> Element:
    """The element lowest in the tree that holds most of the text of the chosen paths, grown to what stands beside it."""
    penalty = lambda e: min(9, e.never) + min(1, e.marks)
    weighted = [fused[e.path] * MARKED ** penalty(e) for e, _ in found]
    least = LEAST_RATIO * max(weighted)
    chosen = [(e, len(s)) for (e, s), w in zip(found, weighted) if w >= least]
    by_penalty: dict[int, int] = defaultdict(int)
    for e, n in chosen:
        by_penalty[penalty(e)] += n
    held, most = 0, 0
    for most in sorted(by_penalty):
        held += by_penalty[most]
        if held >= LEAST_SHARE * sum(by_penalty.values()):
            break
    chosen = [(e, n) for e, n in chosen if penalty(e) <= most]
    total = sum(n for _, n in chosen)
    for e, n in chosen:
        e.mass += n
        e.near += 1
        if e.name in PARAGRAPHS and e.parent is not None and (e.parent.holder.never, e.parent.holder.marks) == (e.never, e.marks):
            e.parent.holder.own += 1
    for e in reversed(elements[1:]):  # parents begin before their children
        e.parent.mass += e.mass
        if (e.parent.never, e.parent.marks) == (e.never, e.marks):
            e.parent.near += e.near
    content = max((e for e in elements if e.block and e.mass >= MOST_TEXT * total), key=lambda e: e.depth)
    if content.name in PARAGRAPHS and content.parent is not None:
        content = content.parent.holder  # one long paragraph: its heading and neighbours belong to it
    up, below = content.parent, content
    grown = content
    while up is not None and up.name not in ("", "html", "body") and below.name not in ("article", "main"):
        same = (up.never, up.marks) == (below.never, below.marks)
        beside = up.near - (below.near if same else 0)
        if up.block and (beside if up.article or up.name == "main" else up.own and beside):
            grown = up
        up, below = up.parent, up
    return grown


def extract(html: str) -> str:
    found, elements = blocks(html)
    if not found:
        return ""
    fused = ratios(found)
    content = content_of(found, elements, fused)
    inside = [(e, s) for e, s in found if content.at <= e.at <= content.end]
    least = LEAST_INSIDE * max(fused[e.path] for e, _ in inside)
    weight = lambda e: INSIDE ** min(9, e.never + e.marks - content.marks) * PARAGRAPH ** min(9, e.soft - content.soft)
    return "\n\n".join(s for e, s in inside if fused[e.path] * weight(e) >= least)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.decode()) for h in C.blobs(batch["html"])]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    C.bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(C.table(spark, sf_dir, "pages"))
