"""Main text of web pages by tree scoring.

A page becomes a tree.  Each paragraph passes points for its length and commas
to all elements it stands in, discounted by the share of its text that is
links.  The lowest article or main with more than half of the page's points is
kept whole; without one, the lowest container with more than half of them.  With
it go those siblings, of it and of the wrappers around it, that read like more of
the article.  Elements that are never article text, by their kind or by what all
words of a class or id or their role say, are left out first, unless next to
nothing is left then; a form is, unless it holds more than half of the page's text.

Defined results: null or empty html, and pages without any block of text, give
the empty string; markup that ends early is read to its end; other columns are
ignored; repeated rows give a result each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: What holds no text to read, and what by its kind is no article.
_MARKUP = frozenset("script style textarea title xmp iframe noembed noframes noscript head template select svg math canvas object video audio".split())
_ASIDE_TAGS = frozenset("nav footer aside button dialog menu".split())
#: Controls that only hold a label, and the block elements that end one left open.
_CONTROLS = frozenset("button select option".split())
_ENDS_CONTROLS = frozenset("address article blockquote dl figure h1 h2 h3 h4 h5 h6 main ol p pre section table ul".split())
_BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption footer nav aside form".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, up to the given ancestors.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices notification alert newsletter subscribe signup share sharing social related recommended recommendations comment comments disqus reply replies respond popup modal overlay widget widgets toolbar pagination pager skip hidden login search tags meta byline".split())
#: Words that add nothing to what another word of a name says.
_NEUTRAL_WORDS = frozenset("area bar block body bottom box buttons col column container content div entry form full global group holder icons inline inner item items js left line link links list main middle mobile module outer page panel part post posts region right row section shell site slot small sticky strip text title top unit user view wrap wrapper".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Elements that are parts of a text and never its container.
_PARTS = frozenset("p pre li ul ol dl dt dd blockquote table tbody thead tfoot tr th caption figure figcaption details summary".split()) | _HEADING
_TOPS = frozenset("body html #root".split())
#: Share of the container's points that a sibling needs which does not look like text.
_SIBLING_SHARE = 0.2
#: Share of links from which on a sibling is a list of links.
_LINKED = 0.25
#: Characters from which on a run of text outside paragraphs reads like one.
_LONG = 80
#: Characters outside links under which what names leave is doubted, and how many times as much prose there must be then.
_LEAST_LEFT, _FAR_MORE = 100, 10


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "points")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.points = 0.0


def parse(page: str) -> Element:
    root = Element("#root", "", None)
    here, at = root, 0
    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = max(found.end(), found.start() + 1)
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            up = here
            while up.parent is not None and up.tag != name:
                if up.tag in ("td", "th", "table", "article", "body") and name in ("p", "li", "span", "b", "i", "a", "em", "strong"):
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                here = up.parent
            continue
        here = _make_room(here, name)
        element = Element(name, found[3] or "", here)
        here.children.append(element)
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            element.children.append(page[at:stop])
            at = stop
            here = element if end else here
        elif name not in _VOID and not element.attributes.rstrip().endswith("/"):
            here = element
        elif name not in _VOID and name in _BLOCK:
            here = element
    return root


def _make_room(here: Element, name: str) -> Element:
    """Closes what a start tag ends without saying so."""
    if name in _ENDS_CONTROLS:
        up = here
        while up.parent is not None and up.tag not in _BLOCK:
            if up.tag in _CONTROLS:
                here = up.parent
            up = up.parent
    if name in _BLOCK:
        up = here
        while up.parent is not None and (up.tag not in _BLOCK or up.tag == "p"):
            if up.tag == "p":
                here = up.parent
                break
            up = up.parent
    if name in _CLOSES:
        ends, within = _CLOSES[name]
        up = here
        while up.parent is not None and up.tag not in within:
            if up.tag in ends:
                here = up.parent
            up = up.parent
    return here


def _attributes(element: Element) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(element.attributes):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def _wrapping_forms(root: Element) -> set[int]:
    """Forms that hold more than half of the page's text: some frameworks put each page into one. Others are dropped.

    Sizes are summed from the leaves up, over a stack of its own; controls and what is never text add nothing.
    """
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack.extend(c for c in element.children if not isinstance(c, str) and c.tag not in _MARKUP and c.tag not in _CONTROLS)
    if not any(e.tag == "form" for e in order):
        return set()
    size: dict[int, int] = {}
    for element in reversed(order):
        own = sum(len(c.strip()) if isinstance(c, str) else size.get(id(c), 0) for c in element.children)
        size[id(element)] = own
    return {id(e) for e in order if e.tag == "form" and 2 * size[id(e)] > size[id(root)] and size[id(e)] >= _LEAST_LEFT}


#: How much is left out: by names too, by kinds, or only what holds no text to read.
_BY_NAME, _BY_KIND, _BY_MARKUP = 2, 1, 0


def _left_out(element: Element, by: int, forms: set[int]) -> bool:
    tag = element.tag
    if tag in _MARKUP:
        return True
    if by == _BY_MARKUP:
        return False
    if tag in _ASIDE_TAGS or tag == "form" and id(element) not in forms:
        return True
    if tag == "header":
        up = element.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    if by != _BY_NAME or tag in ("html", "body", "article", "main", "#root") or id(element) in forms or not element.attributes.strip():
        return False
    said = _attributes(element)
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", said.get("style", ""), re.I):
        return True
    if said.get("role", "").lower() in _ASIDE_ROLES:
        return True
    return any(_names_aside(name) for name in f"{said.get('class', '')} {said.get('id', '')}".split())


def _names_aside(name: str) -> bool:
    """Whether a class or id says so in all of its words: ``post-meta`` does, ``meta-analysis`` doesn't."""
    words = [w.lower() for w in _SPLIT_NAME.split(name) if w and not w.isdigit()]
    return any(w in _ASIDE_WORDS for w in words) and all(w in _ASIDE_WORDS or w in _NEUTRAL_WORDS for w in words)


class _Block:
    __slots__ = ("text", "links", "owner")

    def __init__(self, text: str, links: int, owner: Element):
        self.text, self.links, self.owner = text, links, owner


def _blocks(root: Element, by: int, forms: set[int]) -> list[_Block]:
    """Runs of text between block boundaries, in page order; the walk keeps its own stack, so deep pages are fine."""
    out: list[_Block] = []
    parts: list[str] = []
    links = 0
    owner = root

    def close() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(_Block(text, min(links, len(text)), owner))
        parts, links = [], 0

    stack: list[tuple[Element, int, int]] = [(root, 0, 0)]
    while stack:
        element, i, in_link = stack.pop()
        if i == 0 and element.tag in _BLOCK:
            close()
            owner = element
        if i < len(element.children):
            stack.append((element, i + 1, in_link))
            child = element.children[i]
            if isinstance(child, str):
                parts.append(child)
                if in_link:
                    links += len(child.strip())
            elif child.tag == "br":
                parts.append(" ")
            elif not _left_out(child, by, forms):
                stack.append((child, 0, in_link or child.tag == "a"))
        elif element.tag in _BLOCK:
            close()
            owner = element.parent
            while owner is not None and owner.tag not in _BLOCK and owner.parent is not None:
                owner = owner.parent
            owner = owner or root
    close()
    return out


def _container(root: Element) -> Element:
    """The lowest article or main with more than half of the root's points, or the lowest other container with them."""
    half, here, marked = root.points / 2, root, None
    while True:
        if here.tag in ("article", "main"):
            marked = here
        down = next((c for c in here.children if not isinstance(c, str) and c.points > half), None)
        if down is None:
            break
        here = down
    if marked is not None:
        return marked
    while here.parent is not None and here.tag in _PARTS:
        here = here.parent
    return here


def main_blocks(page: str) -> list[str]:
    root = parse(page)
    forms = _wrapping_forms(root)
    found = _blocks(root, _BY_NAME, forms)
    for by in (_BY_KIND, _BY_MARKUP):
        if sum(len(b.text) - b.links for b in found) >= _LEAST_LEFT:
            break
        # names, then kinds, that leave next to nothing of a page of prose are not to be believed
        every = _blocks(root, by, forms)
        most = _FAR_MORE * max(_LEAST_LEFT, sum(len(b.text) for b in found))
        if by == _BY_KIND and not found or sum(len(b.text) - b.links for b in every if len(b.text) >= _LONG) >= most:
            found = every
    if not found:
        return []
    size: dict[int, list[int]] = {}
    prose: set[int] = set()  # elements that hold a part of a text
    worth = [(1 + b.text.count(",") + len(b.text) / 100) * (1 - b.links / len(b.text)) for b in found]
    linked = not any(worth)  # nothing but links: they count by their length
    for block, points in zip(found, worth, strict=True):
        reads = block.owner.tag in _PARTS or len(block.text) >= _LONG
        above: Element | None = block.owner
        while above is not None:
            above.points += len(block.text) if linked else points
            mine = size.setdefault(id(above), [0, 0])
            mine[0] += len(block.text)
            mine[1] += block.links
            if reads:
                prose.add(id(above))
            above = above.parent

    def density(element: Element) -> float:
        return size[id(element)][1] / size[id(element)][0]

    best = _container(root)
    marked = best.tag in ("article", "main")

    def reads_on(other: Element, least: float) -> bool:
        if density(other) < _LINKED and (other.tag in ("p", *_HEADING) or not marked and id(other) in prose):
            return True
        return other.points * (1 - density(other)) >= least

    kept: set[int] = set()
    bare: set[int] = set()  # elements whose own text is kept, but not all of their children
    if best.tag in _TOPS:
        inner = [c for c in best.children if not isinstance(c, str) and id(c) in size]
        top = max((c.points for c in inner), default=0.0)
        bare.add(id(best))
        kept.update(id(c) for c in inner if c.tag in _TOPS or reads_on(c, top * _SIBLING_SHARE))
    else:
        kept.add(id(best))
        here = best
        while here.parent is not None:
            below, here = here, here.parent
            kept.update(id(c) for c in here.children if not isinstance(c, str) and id(c) in size and c is not below and reads_on(c, best.points * _SIBLING_SHARE))
            if not marked:
                bare.add(id(here))
            if here.tag in _TOPS or here.tag in ("article", "main"):
                break

    def stays(block: _Block) -> bool:
        if id(block.owner) in bare:
            near = block.owner is best or block.owner.tag not in _TOPS or len(block.text) >= _LONG
            return near and block.links < _LINKED * len(block.text) or linked
        up: Element | None = block.owner
        while up is not None:
            if id(up) in kept:
                return True
            up = up.parent
        return False

    return [b.text for b in found if stays(b)]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(main_blocks(page)) if page else "" for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points); one row per row of ``pages``."""
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(wanted, _extracted, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
