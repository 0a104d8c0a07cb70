"""Main-text extraction from HTML by tag-path ratios."""

from __future__ import annotations

import html
import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(?:[a-zA-Z][^\s/>]*|/[a-zA-Z]|[!?])")
_ATTRS = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

# HTML's element kinds, and the words that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "caption", "html", "legend", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
HIDDEN = frozenset("select option noscript template svg canvas audio video iframe head script style title textarea datalist".split())
APART = frozenset("nav footer aside button menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | {"p", "blockquote", "pre", "dd", "figcaption"}  # an inline element in them is part of their sentence
GROUPS = frozenset("article body center div fieldset form html main section td".split()) | APART | {"header", ""}
WHOLE_PAGE = frozenset(["body", "html", ""])
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DOUBTFUL_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "recommendations comment comments disqus respond reply replies footer masthead widget popup modal overlay toolbar login signin signup skip".split()
)
LAYOUT_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons col column container content entry foot form global group holder icon icons inner item items left link links "
    "list main module off page panel post posts primary right row secondary section site slot start end text thread title top unit wrap wrapper zone".split()
)
SIBLING_ENDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "optgroup")}
SAME_AS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass(frozen=True)
class Settings:
    """width: of the Gaussian over neighbouring blocks. cut: share of the ratios' standard deviation that a path's fused
    score must reach. faint: and share of the best path's. share: part of the selected text that the content element must
    hold. hold: part of an element's text that must be selected for the rest of it to be taken too. bonus: factor on the
    score of text in an article or main. doubt: factor on that of text in a marked subtree. most: part of the page's
    scored text from which a subtree marked by words isn't marked any more. beside: how many times as long as the selected blocks
    are on average a block of an unselected path may be to be taken with them."""

    width: float = 1.0
    cut: float = 0.5
    faint: float = 0.55
    share: float = 0.8
    hold: float = 0.15
    bonus: float = 1.5
    doubt: float = 0.15
    most: float = 0.5
    beside: float = 2.0


@dataclass(slots=True)
class _Element:
    tag: str
    path: int  # number of the tag path from the root, equal for equal paths
    number: int
    parent: "_Element | None"
    skipped: bool  # never shown
    mark: int  # of this element alone: 0 none, 1 doubtful by its words or as a form or header, 2 apart by its tag or role
    container: int  # number of the outermost article or main around it, -1 without


@dataclass(slots=True)
class _Block:
    element: _Element
    text: str


@dataclass(slots=True)
class _Stack:
    """The open elements, with the places of each tag and of block elements, so that no look-up walks the stack."""

    open: list[_Element]
    places: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[int] = field(default_factory=list)

    def push(self, e: _Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.open))
        if e.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(e)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            e = self.open.pop()
            self.places[e.tag].pop()
            if e.tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        best = 0
        for t in tags:
            if (own := self.places.get(t)) and own[-1] > best:
                best = own[-1]
        return best


def _told(token: str, layout: frozenset[str]) -> tuple[bool, bool]:
    """Whether a class or id says that this isn't the article, and whether that it is a header: by a word for it, alone or
    with words of layout only."""
    words = [w for w in re.split(r"[^a-z]+", _CAMEL.sub(" ", token).lower()) if w]
    fits = all(w in DOUBTFUL_WORDS or w in layout or w == "header" for w in words)
    return fits and any(w in DOUBTFUL_WORDS for w in words), fits and "header" in words


def _marks(attrs: str) -> tuple[str, int, bool, bool]:
    """The class's words for the path; whether attributes tell that this isn't the article (as _Element.mark); whether
    that it is a header; whether it is hidden. An id is often made from a heading, so all its words must be telling ones."""
    found, mark, header, hidden = "", 0, False, False
    for name, a, b, c, bare in _ATTR.findall(attrs):
        key, value = (name or bare).lower(), a or b or c
        if key in ("class", "id"):
            for token in value.split() if key == "class" else [value]:
                apart, head = _told(token, LAYOUT_WORDS if key == "class" else frozenset())
                mark, header = max(mark, int(apart)), header or head
            if key == "class":
                found = ".".join(w for w in re.split(r"[^a-z]+", value.lower()) if w)
        elif key == "role":
            mark = 2 if value.lower() in APART_ROLES else mark
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(html.unescape(value).lower()):
            hidden = True
    return found, mark, header, hidden


def blocks_of(page: str) -> list[_Block]:
    """The page's text blocks in order, each with the element that holds it. White space inside is one space.

    One scan forward: every look ahead either ends behind what it passed or, at the page's end, isn't tried again.
    """
    stack, out, held, count = _Stack([_Element("", 0, 0, None, False, 0, -1)]), [], [], 0
    paths: dict[tuple[int, str], int] = {}
    quotes = True  # whether a > inside quotes still belongs to its tag; not after a quote that never ended

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(_Block(stack.open[-1], text))
            held.clear()

    def pop_to(k: int) -> None:
        flush()
        stack.cut(k)

    at = 0
    while at < len(page):
        m = _OPEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at, mark_up = m.end(), m[0]
        if mark_up[1] in "!?":
            cdata = page.startswith("<![CDATA[", m.start())
            end = "-->" if page.startswith("--", at) else "]]>" if cdata else ">"
            stop = page.find(end, at)
            if cdata:
                held.append(html.escape(page[m.start() + 9 : stop if stop >= 0 else len(page)]))
            at = stop + len(end) if stop >= 0 else len(page)
            continue
        if mark_up[1] == "/":
            stop = page.find(">", at)
            if stop < 0:
                break
            words = page[at - 1 : stop].split(maxsplit=1)
            tag, at = words[0].rstrip("/").lower(), stop + 1
            k = stack.last(tag)
            if tag in BLOCK or k and (stack.open[k].mark or stack.open[k].skipped != stack.open[k - 1].skipped):
                pop_to(k) if k else flush()
            elif k and not (stack.blocks and stack.blocks[-1] > k):
                stack.cut(k)
            continue
        tag = mark_up[1:].lower()
        if page[at : at + 1] == ">":
            stop = at + 1
        else:
            whole = _ATTRS.match(page, at) if quotes else None
            stop = whole.end() if whole else page.find(">", at) + 1
            quotes = whole is not None
        if not stop:
            break  # the page ends inside a tag
        attrs, at = page[at : stop - 1], stop
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in CLOSES_P and (k := stack.last("p", "button", "table")) and stack.open[k].tag == "p":
            pop_to(k)
        if ends := SIBLING_ENDS.get(tag):
            k = stack.last(*SAME_AS.get(tag, (tag,)))
            if k > stack.last(*ends):
                pop_to(k)
        words, mark, header, hidden = _marks(attrs) if attrs and _TELLING.search(attrs) else ("", 0, False, False)
        parent = stack.open[-1]
        inside = parent.container >= 0
        skipped = parent.skipped or tag in HIDDEN or hidden and tag not in ("body", "html")
        if tag in APART:
            mark = 2
        elif tag == "form" or not inside and (tag == "header" or header):
            mark = max(mark, 1)
        if tag in HEADINGS or tag in ("body", "html", "main") or mark == 1 and tag not in BLOCK and stack.blocks and stack.open[stack.blocks[-1]].tag in RUNNING:
            mark = 0
        if tag in BLOCK or skipped and not parent.skipped or mark:
            flush()
        count += 1
        container = parent.container if inside else count if tag in ("article", "main") and not skipped else -1
        if attrs and tag not in BLOCK and attrs.rstrip().endswith("/"):
            continue
        path = paths.setdefault((parent.path, f"{tag}.{words}.{mark}" if words or mark else tag), len(paths) + 1)
        stack.push(_Element(tag, path, count, parent, skipped, mark, container))
    flush()
    return out


def path_ratios(blocks: list[_Block]) -> list[tuple[float, float]]:
    """For each block the ratios of its tag path: characters and punctuation marks, each by the path's blocks."""
    total: dict[int, list[int]] = {}
    for b in blocks:
        own = total.setdefault(b.element.path, [0, 0, 0])
        own[0] += len(b.text)
        own[1] += len(PUNCTUATION.findall(b.text))
        own[2] += 1
    return [(n / k, p / k) for n, p, k in (total[b.element.path] for b in blocks)]


def smoothed(ratios: list[float], settings: Settings) -> list[float]:
    """Ratios smoothed by a Gaussian over their neighbours in the page."""
    reach = math.ceil(3 * settings.width)
    weight = [math.exp(-(d**2) / (2 * settings.width**2)) for d in range(-reach, reach + 1)]
    whole, n = sum(weight), len(ratios)
    out = []
    for k in range(n):
        if reach <= k < n - reach:
            out.append(sum(map(operator.mul, weight, ratios[k - reach : k + reach + 1])) / whole)
        else:
            own = weight[max(0, reach - k) : reach + n - k]
            out.append(sum(map(operator.mul, own, ratios[max(0, k - reach) : k + reach + 1])) / sum(own))
    return out


def fused(texts: list[float], marks: list[float]) -> list[float]:
    """The ratios of text and punctuation as one: their product, with one mark more."""
    return [n * (p + 1) for n, p in zip(texts, marks)]


class _Tree:
    """The elements above a page's blocks. Numbers grow downwards, so sums go up by descending numbers."""

    def __init__(self, blocks: list[_Block]) -> None:
        self.own: dict[int, _Element] = {}
        for b in blocks:
            e = b.element
            while e is not None and e.number not in self.own:
                self.own[e.number] = e
                e = e.parent
        self.down = sorted(self.own)
        self.depth: dict[int, int] = {}
        self.group: dict[int, int] = {}  # the innermost grouping element around, or itself
        for n in self.down:
            e = self.own[n]
            self.depth[n] = self.depth[e.parent.number] + 1 if e.parent else 0
            self.group[n] = n if e.tag in GROUPS else self.group[e.parent.number]

    def sums(self, blocks: list[_Block], values: list[float]) -> dict[int, float]:
        """The values of all blocks under each element, summed."""
        out = dict.fromkeys(self.down, 0.0)
        for b, v in zip(blocks, values):
            out[b.element.number] += v
        for number in reversed(self.down):
            if (e := self.own[number].parent) is not None:
                out[e.number] += out[number]
        return out

    def under(self, tops: set[int]) -> set[int]:
        """Numbers of the elements in the subtrees of tops."""
        out: set[int] = set()
        for number in self.down:
            parent = self.own[number].parent
            if number in tops or parent is not None and parent.number in out:
                out.add(number)
        return out


def _path_means(blocks: list[_Block], scores: list[float]) -> list[float]:
    """For each block the mean score of all blocks on its tag path."""
    total: dict[int, list[float]] = {}
    for b, x in zip(blocks, scores):
        own = total.setdefault(b.element.path, [0.0, 0])
        own[0] += x
        own[1] += 1
    return [total[b.element.path][0] / total[b.element.path][1] for b in blocks]


def main_text(page: str | None, settings: Settings = Settings()) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none.

    Text that is never shown is out; a page whose text is all in navigation, footers and the like has none. The ratios of
    text and punctuation of every tag path are smoothed over the page and fused; markup is one more factor: text in an
    article or main scores higher, text in subtrees that tag, role, class or id mark as no article lower, unless such a
    subtree even so holds most of the page's scored text. Paths whose mean score reaches a share of the ratios' standard
    deviation, and of the best path's score, are selected. The content element is
    the deepest grouping element with most of the selected text, and with it the article or main around it and sibling
    articles that hold selected text; where selected paths hold enough of its text, its other blocks, as headings and
    list items, are taken too, but marked ones and those much longer than the selected: a long text that its path's ratios
    don't select is no heading. Elsewhere a block is taken if its path's own ratio, without its
    neighbours', reaches the threshold.
    """
    s = settings
    blocks = [b for b in blocks_of(page or "") if not b.element.skipped]
    tree, sizes = _Tree(blocks), [len(b.text) for b in blocks]
    fixed = tree.under({n for n, e in tree.own.items() if e.mark == 2})
    if all(b.element.number in fixed for b in blocks):
        return ""
    ratios = path_ratios(blocks)
    raw = fused([n for n, _ in ratios], [p for _, p in ratios])
    plain = fused(smoothed([n for n, _ in ratios], s), smoothed([p for _, p in ratios], s))
    marked = {n for n, e in tree.own.items() if e.mark}

    def factors() -> list[float]:
        doubted = tree.under(marked)
        return [(s.bonus if b.element.container >= 0 else 1) * (s.doubt if b.element.number in doubted else 1) for b in blocks]

    factor = factors()
    held = tree.sums(blocks, [x * f * n for x, f, n in zip(plain, factor, sizes)])
    if most := {n for n in marked if tree.own[n].mark == 1 and held[n] >= s.most * held[0]}:
        marked -= most
        factor = factors()
    scores = _path_means(blocks, [x * f for x, f in zip(plain, factor)])
    mean = sum(plain) / len(plain)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in plain) / len(plain))
    cut = min(max(scores), max(s.cut * deviation, s.faint * max(scores)))
    chosen = [x >= cut for x in scores]
    selected = tree.sums(blocks, [n * c for n, c in zip(sizes, chosen)])
    best = max((n for n in tree.down if selected[n] >= s.share * selected[0] and tree.own[n].tag in GROUPS), key=lambda n: (tree.depth[n], -n))
    if tree.own[best].container >= 0:
        best = tree.own[best].container
    top = tree.own[best]
    tops = {best}
    if top.tag == "article":
        near = {id(top.parent), id(top.parent.parent or top.parent)}
        tops |= {n for n, e in tree.own.items() if e.container == n and e.tag == "article" and selected[n] and near & {id(e.parent), id(e.parent.parent or e.parent)}}
    elif top.tag in WHOLE_PAGE:  # of the page itself only what stands there directly, and groups with text of their own
        tops = {tree.group[b.element.number] for b, c, x, f in zip(blocks, chosen, raw, factor) if c and x * f >= cut}
    else:
        marked -= {n for n in marked if tree.own[n].tag == "header"}
    length = tree.sums(blocks, [n if f >= 1 else 0 for n, f in zip(sizes, factor)])
    tops = {n for n in tops if tree.own[n].tag in WHOLE_PAGE or selected[n] >= s.hold * length[n]}
    bare = {n for n in tops if tree.own[n].tag in WHOLE_PAGE}
    inside, doubted = tree.under(tops - bare), tree.under(marked)

    picked = [n for n, c in zip(sizes, chosen) if c]
    usual = sum(picked) / len(picked)

    def taken(b: _Block, c: bool, own: float) -> bool:
        n = b.element.number
        if n in inside or tree.group[n] in bare:
            return c or n not in doubted and len(b.text) <= s.beside * usual
        return c and own >= cut

    return "\n".join(b.text for b, c, x, f in zip(blocks, chosen, raw, factor) if taken(b, c, x * f))


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html).

    A page is read whole and by itself, so there is no shuffle; memory is one Arrow batch and one page's blocks. Null or
    empty html gives an empty text; unclosed, mis-nested and cut-off markup is read as browsers do, to the page's end;
    repeated rows are extracted each; an empty table gives no rows; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h, settings) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
