"""Main text of web pages by tag-path ratios.

Each block of text has the path of its open elements. Per path a page sums text length, link text
and punctuation; the ratios of length and of punctuation to blocks are smoothed over the page's
blocks with a Gaussian kernel, fused by their product, and paths over a share of the mean are
content. The element that holds the content is the main text: the article (or main) with half of it,
else the smallest with nearly all. Inside it only link lists at its start and end go, and elements
that are or name themselves boilerplate; tables, quotes and captions stay. A name decides nothing
for html, body, main and article, nor for an element around most of the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+>?", re.DOTALL)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?¡¿。，、；：！？]")
#: Elements whose content is no markup; that have no end; that stay in a block; that never hold main text.
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
OUTSIDE = frozenset("head nav footer aside form menu dialog button select datalist template svg math object canvas audio video map".split())
#: Words of class, id and role that mark boilerplate; words that may follow them in such a name; that take their meaning away in front; names for parts of a page.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies disqus footer login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pagination popup promo promoted promotion recommended related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
FOLLOWS = frozenset("area articles bar block bottom box button buttons container content footer form group header holder icon icons inner item items left link links list main menu module nav outer panel post posts primary region right row secondary section slot stories text thread title top unit widget wrap wrapper".split())
NEGATED = frozenset("has is no non not with without hide".split())
WHOLE = frozenset(("html", "body", "main", "article"))
#: Start tags that end an open element of the same kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KERNEL = [math.exp(-k * k / 2) for k in (-2, -1, 0, 1, 2)]
#: Share of the mean score that a content path reaches; shares of its text that an article and another element hold; share of the page's text around which a name decides nothing.
THRESHOLD, ARTICLE, HOLDS, MOST = 0.5, 0.5, 0.9, 0.5


def names_boilerplate(value: str) -> bool:
    """Whether a class, id or role has a name like `sidebar`, `post-comments` or `shareButtons`; not `no-sidebar`, `share-price`, `modal-open`."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or words[0] in NEGATED:
            continue
        k = next((i for i, w in enumerate(words) if w in NAMES), len(words))
        if k < len(words) and all(w in NAMES or w in FOLLOWS or w.isdigit() for w in words[k:]):
            return True
    return False


class Element:
    """An open element; `path` numbers its (parent's path, name), so that long paths take no room. outside: by its kind; named: by a name."""

    __slots__ = ("depth", "inside", "named", "outside", "parent", "path", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None, paths: dict[tuple[int, str], int]):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.outside = tag in OUTSIDE or tag == "header" and not self.inside
        self.named = False
        name = tag
        if attributes.strip():
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role"):
                    self.named |= tag not in WHOLE and (names_boilerplate(value) or not self.inside and "header" in value.lower().split())
                    if key == "class" and value.strip():
                        name += "." + value.split()[0].lower()
                value = value.lower()
                self.outside |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
        self.outside |= parent is not None and parent.outside
        self.path = paths.setdefault((parent.path if parent else -1, name), len(paths))


class Block:
    __slots__ = ("element", "linked", "marks", "size", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked
        self.size, self.marks = len(text), len(PUNCTUATION.findall(text))


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, white space joined."""
    paths: dict[tuple[int, str], int] = {}
    top = Element("#", "", None, paths)
    opened: Counter[str] = Counter()
    found: list[Block] = []
    pieces: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if pieces and (text := " ".join("".join(pieces).split())):
            found.append(Block(top, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw)
            pieces.append(raw)
            if links:
                linked += len(raw.strip())

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and (end := re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)):
                at = end.end()
            elif not m[1]:
                at = len(page)
        elif tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 0 if m[1] else 1
        else:
            flush()
            links = 0
            if m[1]:
                while opened[tag]:  # an end without its start changes nothing
                    opened[top.tag] -= 1
                    last, top = top.tag, top.parent
                    if last == tag:
                        break
            elif tag not in VOID:
                for closes in ENDS.get(tag, ()) or ("p",):
                    if top.tag == closes:
                        opened[closes] -= 1
                        top = top.parent
                if not m[3].endswith("/") or tag in ("p", "div"):
                    top = Element(tag, m[3], top, paths)
                    opened[tag] += 1
    text(page[at:])
    flush()
    return found


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Those of the main text."""
    kept = inside_page(blocks)
    if not kept:
        return []
    sums: dict[int, list[float]] = {}  # by path: text without links, punctuation, blocks, all text, links
    for b in kept:
        total = sums.setdefault(b.element.path, [0, 0, 0, 0, 0])
        for k, x in enumerate((max(0, b.size - 2 * b.linked), b.marks, 1, b.size, b.linked)):
            total[k] += x
    ratio = lambda k: smooth([sums[b.element.path][k] / sums[b.element.path][2] for b in kept])
    score: dict[int, float] = {}
    for b, length, marks in zip(kept, ratio(0), ratio(1), strict=True):
        score[b.element.path] = max(score.get(b.element.path, 0.0), length * (1 + marks))
    linked = {p for p, x in sums.items() if 2 * x[4] > x[3]}
    able = {p: x for p, x in score.items() if p not in linked and x > 0}
    if not able:  # nothing but links
        return []
    least = THRESHOLD * sum(score[b.element.path] for b in kept) / len(kept)
    chosen = {p for p, x in able.items() if x >= least} or {max(able, key=lambda p: able[p])}
    content = [k for k, b in enumerate(kept) if b.element.path in chosen]
    best = container([kept[k] for k in content])
    known = {id(best): True}
    inner = [k for k, b in enumerate(kept) if within(b.element, best, known)]
    own = [k for k in inner if kept[k].element.path in chosen]
    return [kept[k] for k in inner if kept[k].element.path not in linked or own[0] < k < own[-1]]


def inside_page(blocks: list[Block]) -> list[Block]:
    """Blocks in no element that is boilerplate by its kind or, unless it is around most of the text, by its name."""
    known: dict[int, bool] = {}
    for b in blocks:  # outside by kind, inherited
        lineage(b.element, known, lambda e: e.outside)
    blocks = [b for b in blocks if not known[id(b.element)]]
    weight, elements = weights(blocks, lambda b: max(0, b.size - 2 * b.linked))
    whole = {id(up) for e in elements.values() if e.tag in ("article", "main", "h1") for up in above(e)}
    total = sum(max(0, b.size - 2 * b.linked) for b in blocks)
    around = lambda e: weight[id(e)] > MOST * total and (id(e) in whole or weight[id(e)] >= HOLDS * total)
    named: dict[int, bool] = {}
    for b in blocks:
        lineage(b.element, named, lambda e: e.named and not around(e))
    return [b for b in blocks if not named[id(b.element)]]


def above(element: Element) -> Iterator[Element]:
    """The elements around one."""
    while element.parent:
        element = element.parent
        yield element


def lineage(element: Element, known: dict[int, bool], test) -> None:
    """Notes for an element and those around it whether a test holds for it or for one around it."""
    way: list[Element] = []
    up: Element | None = element
    while up and id(up) not in known:
        way.append(up)
        up = up.parent
    found = known[id(up)] if up else False
    for e in reversed(way):
        found = known[id(e)] = found or test(e)


def weights(blocks: list[Block], of) -> tuple[dict[int, int], dict[int, Element]]:
    """The weight of the blocks in each element, whatever the depth, and the elements."""
    elements: dict[int, Element] = {}
    weight: dict[int, int] = {}
    for b in blocks:
        weight[id(b.element)] = weight.get(id(b.element), 0) + of(b)
        up: Element | None = b.element
        while up and id(up) not in elements:
            elements[id(up)] = up
            up = up.parent
    for e in sorted(elements.values(), key=lambda e: -e.depth):  # from the leaves up
        weight.setdefault(id(e), 0)
        if e.parent:
            weight[id(e.parent)] = weight.get(id(e.parent), 0) + weight[id(e)]
    return weight, elements


def container(content: list[Block]) -> Element:
    """The outermost article or main with half of the content, else the deepest element that holds nearly all, or the article around that."""
    weight, elements = weights(content, lambda b: b.size)
    total = sum(b.size for b in content)
    articles = [e for e in elements.values() if e.tag in ("article", "main") and weight[id(e)] >= ARTICLE * total]
    if articles:
        return min(articles, key=lambda e: (e.depth, -weight[id(e)]))
    best = max((e for e in elements.values() if weight[id(e)] >= HOLDS * total), key=lambda e: e.depth)
    for up in above(best):
        if up.tag in ("article", "main"):
            return up
    return best.parent if best.parent and best.parent.parent and best.tag in ("p", "li", "td", "blockquote") else best


def within(element: Element, other: Element, known: dict[int, bool]) -> bool:
    """Whether an element lies in another; known: what earlier calls found, and that the other one does."""
    way, up = [], element
    while up and id(up) not in known:
        way.append(id(up))
        up = up.parent
    found = up is not None and known[id(up)]
    known.update(dict.fromkeys(way, found))
    return found


def smooth(values: list[float]) -> list[float]:
    """A Gaussian mean over neighbours; the page's ends repeat."""
    n, norm = len(values), sum(KERNEL)
    return [sum(w * values[min(max(i + k - 2, 0), n - 1)] for k, w in enumerate(KERNEL)) / norm for i in range(n)]


def extract_text(page: str | None) -> str:
    """The main text: one line a block; empty for null or a page without any."""
    return "\n".join(b.text for b in main_blocks(blocks_of(page))) if page else ""


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row of pages (key, url, text, n_chars): its main text and the code points of that.

    Null html is empty, and has an empty text, as has a page of nothing but boilerplate or links. A
    null key or url is kept. Repeated rows get equal results, paths of equal score stand or fall
    together; an empty table gives an empty one. Broken markup ends where the page ends. A page is
    taken whole, whatever its length, in time linear in it and its depth. Other columns are not
    looked at.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # bounds what a task holds of texts
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array([extract_text(x.as_py()) for x in part.column("html")], pa.string())], ["key", "url", "text"])

    found = rows.mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, url string, text string")
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
