"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root to its
element. Elements that are boilerplate by their own name, role or class (menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, comments) go first. For
each tag path, text length and punctuation are added up over the path's blocks and
divided by their number. In page order these ratios are smoothed over neighbouring
blocks, weighted by how much of the path two blocks share. Both ratios are fused into
one score with the path's share of link text, and paths above a multiple of the scores'
standard deviation hold content. The element around the content decides the rest: short
paragraphs, headings and list items of the article stay whatever their own path's score.

Pages are independent: rows are read, cut and scored where they are, nothing is shuffled,
and memory is that of a batch of pages. All steps are linear in the page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: which elements have no content, hold raw text, run within a line,
# end an open paragraph, or end an open element of the same kind.
VOID = set("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes xmp title textarea".split())
INLINE = set("""abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt rtc ruby
    s samp small strike strong sub sup time tt u var""".split())
NESTED_INLINE = {"a", "span"}
ENDS_P = set("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul""".split())
SCOPE = set("html body table caption td th button object template".split())
ENDS_SAME = {  # a new element -> open elements it ends, and elements that shield these
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "a": ({"a"}, ENDS_P | SCOPE),
}
IN_HEAD = set("base link meta title style script noscript template head".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption a span caption address".split())

# Fixed values of this operator: elements, roles and words of class or id that are no article.
DROP_TAGS = set("""head script style noscript template iframe noframes object svg canvas audio video map form fieldset button
    select datalist textarea input nav menu footer aside dialog""".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
COMMENTS = set("comment comments commentlist disqus respond reply replies".split())
HINTS = COMMENTS | set("""nav navigation navbar menu submenu breadcrumb breadcrumbs pagination pager
    header masthead topbar footer colophon copyright sidebar aside widget widgets related recommended recommendations
    cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe paywall toast
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion
    form search login signup share sharing social""".split())
NEGATED = set("no not has with without open closed enabled disabled count".split())
OF_ARTICLE = set("article entry post story content section".split())
#: Elements below this depth count as part of the one above them, as in browsers.
DEEPEST = 512
PUNCTUATION = re.compile("[.,;:!?…¿¡。，、；：！？؟،]")

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<open>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW | {"noscript"}}
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Element:
    parent: int
    tag: str
    path: int  # number of its tag path
    depth: int
    dropped: bool  # by its own tag, until _drop_parts has decided
    comments: bool
    region: str  # "article" or "main" where it is one


@dataclass
class Block:
    element: int
    pieces: list[str] = field(default_factory=list)
    link: int = 0
    text: str = ""


def _words(token: str) -> list[str]:
    return [w.lower() for part in re.split(r"[-_:]+", token) for w in CAMEL.split(part) if w]


def _hint(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether class, id or role name a part that is no article; whether that is comments."""
    if tag in ("html", "body"):
        return False, False
    found, comments = attributes.get("role", "").lower() in DROP_ROLES, False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = _words(token)
        hits = [w for w in words if w.rstrip("0123456789") in HINTS]
        if not hits or NEGATED & set(words) or (hits == ["header"] and OF_ARTICLE & set(words)):
            continue
        if tag in ("article", "main") and len(hits) < len(words):
            continue
        found, comments = True, comments or bool(COMMENTS & set(hits))
    return found, comments


class Page:
    """Elements and text blocks of one page, cut as browsers do for unclosed tags."""

    def __init__(self, source: str):
        self.elements = [Element(-1, "", 0, 0, False, False, "")]
        self.hinted: list[int] = []
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [0]
        self.open_tags: dict[str, int] = defaultdict(int)
        self.flat: dict[str, int] = defaultdict(int)  # open elements too deep for one of their own
        self.block: Block | None = None
        self._cut(source)

    def _cut(self, source: str) -> None:
        at = 0
        while at < len(source):
            token = TOKEN.search(source, at)
            if token is None:
                self._text(source[at:])
                break
            if token.start() > at:
                self._text(source[at:token.start()])
            at = token.end()
            if token["open"]:
                tag = token["open"].lower()
                self._start(tag, token["attrs"])
                if tag in RAW:
                    end = RAW_END[tag].search(source, at)
                    at = end.end() if end else len(source)
                    self._end(tag)
            elif token["close"]:
                self._end(token["close"].lower())
            elif token["cdata"]:
                self._text(token["cdata"])
        for b in self.blocks:
            b.text = " ".join(html.unescape("".join(b.pieces)).split())
            b.pieces = []
        self.blocks = [b for b in self.blocks if b.text]

    def _text(self, text: str) -> None:
        top = self.elements[self.stack[-1]]
        if top.tag == "head" and not text.isspace():
            self._pop_to(len(self.stack) - 1)
        if self.block is None:
            if text.isspace():
                return
            at = self.stack[-1]
            while self.elements[at].tag in NESTED_INLINE:
                at = self.elements[at].parent
            self.block = Block(at)
            self.blocks.append(self.block)
        elif self._inside_drop():
            return
        self.block.pieces.append(text)
        if self.open_tags["a"]:
            self.block.link += len(text)

    def _inside_drop(self) -> bool:
        """Text of a dropped inline element (an advert in a span) inside a block that stays."""
        top = self.elements[self.stack[-1]]
        return top.tag in NESTED_INLINE and top.dropped and not self.elements[self.block.element].dropped

    def _start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            return
        if tag == "br" or tag == "wbr":
            if tag == "br" and self.block:
                self.block.pieces.append("\n")
            return
        if tag in ("html", "body") and self.open_tags[tag]:
            return
        if self.open_tags["head"] and tag not in IN_HEAD:
            self._close({"head"}, set())
        if tag in ENDS_P and self.open_tags["p"]:
            self._close({"p"}, SCOPE)
        if tag in ENDS_SAME and any(self.open_tags[t] for t in ENDS_SAME[tag][0]):
            self._close(*ENDS_SAME[tag])
        if tag not in NESTED_INLINE and tag not in ("img", "input", "embed"):
            self.block = None
        if tag in VOID:
            return
        if len(self.stack) > DEEPEST:
            self.flat[tag] += 1
            return
        attributes: dict[str, str] = {}
        if "=" in attrs:
            for name, *value in ATTRIBUTE.findall(attrs):
                attributes.setdefault(name.lower(), "".join(value))
        parent = self.elements[self.stack[-1]]
        hinted, comments = _hint(tag, attributes)
        region = "article" if tag == "article" or attributes.get("role") == "article" else "main" if tag == "main" or attributes.get("role") == "main" else ""
        drop = tag in DROP_TAGS or (tag == "header" and not self.open_tags["article"] and not self.open_tags["main"])
        label = f"{tag}.{re.sub('[0-9]+', '', attributes.get('class', ''))}" if tag not in NESTED_INLINE else tag
        path = self.paths.setdefault((parent.path, label), len(self.paths) + 1)
        self.elements.append(Element(self.stack[-1], tag, path, parent.depth + 1, drop, comments or parent.comments, region))
        number = len(self.elements) - 1
        if hinted or tag == "form":
            self.hinted.append(number)
            if tag in NESTED_INLINE:
                self.elements[number].dropped = True
        self.stack.append(number)
        self.open_tags[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in INLINE or tag in ("html", "body"):
            return
        if tag not in NESTED_INLINE:
            self.block = None
        if self.flat[tag]:
            self.flat[tag] -= 1
        elif self.open_tags[tag]:
            self._close({tag}, SCOPE if tag not in SCOPE else {"html", "body", "table"} - {tag})

    def _close(self, tags: set[str], shields: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.elements[self.stack[k]].tag
            if tag in tags:
                return self._pop_to(k)
            if tag in shields:
                return None
        return None

    def _pop_to(self, k: int) -> None:
        for number in self.stack[k:]:
            self.open_tags[self.elements[number].tag] -= 1
        del self.stack[k:]


def _drop_parts(page: Page) -> None:
    """Sets ``dropped`` for all that lies in a part that is no article. A hinted part, or a
    form, stays if it holds most of the page's text and an article or main element: a
    layout named after its sidebar, a form around the page."""
    elements, size = page.elements, [0] * len(page.elements)
    out = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        out[k] = out[e.parent] or (e.dropped and e.tag != "form")
    for b in page.blocks:
        if not out[b.element]:
            size[b.element] += max(0, len(b.text) - b.link)
    holds = [bool(e.region) and not e.comments for e in elements]
    for k in range(len(elements) - 1, 0, -1):  # children come after their parents
        size[elements[k].parent] += size[k]
        holds[elements[k].parent] |= holds[k]
    hinted = {k for k in page.hinted if elements[k].comments or not holds[k] or 2 * size[k] <= size[0]}
    for k, e in enumerate(elements[1:], 1):
        e.dropped = elements[e.parent].dropped or k in hinted or (e.dropped and e.tag != "form")


def _smoothed(values: list[float], blocks: list[Block], page: Page, radius: int = 2) -> list[float]:
    """Gaussian weights over neighbours in page order, times the share of equal path steps."""
    chains = []
    for b in blocks:
        chain, at = [], b.element
        while at > 0 and len(chain) < 64:  # the steps next to the text tell paths apart
            chain.append(page.elements[at].path)
            at = page.elements[at].parent
        chains.append(set(chain))
    weight = [math.exp(-d * d / 2) for d in range(radius + 1)]
    out = []
    for i in range(len(values)):
        total = over = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            near = weight[abs(i - j)] * len(chains[i] & chains[j]) / max(1, len(chains[i] | chains[j])) if i != j else 1.0
            total, over = total + near * values[j], over + near
        out.append(total / over)
    return out


def _scores(page: Page, blocks: list[Block]) -> list[float]:
    """The fused, smoothed tag-path ratio of each block."""
    number, text, marks, link = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        path = page.elements[b.element].path
        number[path] += 1
        text[path] += len(b.text)
        link[path] += min(b.link, len(b.text))
        marks[path] += len(PUNCTUATION.findall(b.text))
    paths = [page.elements[b.element].path for b in blocks]
    length = _smoothed([(text[p] - link[p]) / number[p] for p in paths], blocks, page)
    punctuation = _smoothed([marks[p] / number[p] for p in paths], blocks, page)
    fused = [math.sqrt(a * m) * (1 - link[p] / max(1, text[p])) for a, m, p in zip(length, punctuation, paths)]
    return fused if any(fused) else [a * (1 - link[p] / max(1, text[p])) for a, p in zip(length, paths)]


def _content(page: Page, spread: float = 0.5, most: float = 0.85) -> list[Block]:
    elements = page.elements
    _drop_parts(page)
    blocks = [b for b in page.blocks if not elements[b.element].dropped]
    if not blocks:
        return []
    scores = _scores(page, blocks)
    mean = sum(scores) / len(scores)
    threshold = spread * math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    chosen = [s > 0 and s >= threshold for s in scores]

    weight, kinds = [0] * len(elements), {"article": [False] * len(elements), "main": [False] * len(elements)}
    for b, ok in zip(blocks, chosen):
        weight[b.element] += len(b.text) * ok
    for k in range(len(elements) - 1, 0, -1):
        weight[elements[k].parent] += weight[k]
    for kind, inside in kinds.items():  # an article or main element with most of the content: all of it, and nothing else
        for k in range(1, len(elements)):
            inside[k] = inside[elements[k].parent] or (elements[k].region == kind and weight[k] > 0)
        if 2 * sum(len(b.text) for b, ok in zip(blocks, chosen) if ok and inside[b.element]) > weight[0]:
            return [b for b in blocks if inside[b.element]]
    if not weight[0]:  # link text alone: only an article element tells that it is the main text
        return [b for b in blocks if any(elements[k].region for k in _ancestors(elements, b.element))]

    body, heavy = 0, {}  # the innermost container of nearly all content
    for k in range(1, len(elements)):
        if weight[k] >= most * weight[0] and elements[k].tag not in PARAGRAPHS:
            heavy[elements[k].parent] = k  # one child at most
    while body in heavy:
        body = heavy[body]
    inside = [k == body for k in range(len(elements))]
    for k in range(1, len(elements)):
        inside[k] |= inside[elements[k].parent]
    around = set(_ancestors(elements, body))
    first = next(i for i, b in enumerate(blocks) if inside[b.element] and chosen[i])
    kept = []
    for i, (b, ok) in enumerate(zip(blocks, chosen)):
        holder = b.element
        while elements[holder].tag in PARAGRAPHS:
            holder = elements[holder].parent
        if inside[b.element]:
            if ok or (weight[holder] and 2 * b.link < len(b.text)):
                kept.append(b)
        elif i < first and elements[b.element].tag in ("h1", "h2") and {holder, elements[holder].parent} & around:
            kept.append(b)  # the title before the body
    return kept


def _ancestors(elements: list[Element], at: int) -> Iterator[int]:
    while at > 0:
        yield at
        at = elements[at].parent


def main_text(source: str | None) -> str:
    """The main text of one page: blocks in page order, white space and joins one space."""
    return " ".join(b.text for b in _content(Page(source or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for every row; ``n_chars`` counts code points.

    Null or empty html, or a page without main text: empty text. Text that is no markup
    is one block. Repeated rows each keep their row; null ids and urls are carried; other
    columns are not read. Empty table: no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source) for source in batch.column(2).to_pylist()]
            counts = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts],
                                             names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
