"""HTML extraction: flat text blocks, classified by a decision tree.

A page is read as a flat list of text blocks, cut at block-level tags. A CART tree trained on the
labelled pages below decides which blocks are content, from the word count and link density of the
block and of its neighbours, and from what its open elements say: a page region, the article (or that
the page has it elsewhere, or none), a heading, and names in class, id and role that consist of words
for page furniture or for comments. A name alone decides nothing but comments: in an article, a block
so named still is content if it is long and stands among text.

Defined results: null or empty html, and pages without content, give an empty text; tags are read as
HTML does, so quotes count only around whole attribute values, and a tag, comment or quote that is never
closed reaches to the end; unclosed and stray elements are read as browsers mostly do; very long pages
are read whole, in time in proportion to their length; repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Elements that end a block, that hide text, and that never have content.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template iframe svg head title select textarea button audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same group closes.
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
REGIONS = frozenset("nav footer aside header form menu dialog".split())
#: Words for page furniture and for reader comments in names; words that may stand beside them.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header login menu modal nav navbar navigation "
    "newsletter notice overlay pagination popup promo promotion share sharing sidebar signup social sponsor sponsored subscribe toc toolbar widget".split()
)
COMMENTS = frozenset("comment comments discussion disqus feedback reply replies respond responses".split())
BESIDE = frozenset("area bar block bottom box button buttons col column container content form inner item items left link links list main message outer page panel reader right row section site slot text thread top unit user visitor wrap wrapper".split())
#: A comment, a declaration, a stray end, or a tag with its attributes; each reaches to the end of the page if it isn't closed, so no character is read twice.
_TAG = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"([^\s/=>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)))?")
_MARKS = re.compile(r"class|id|role|hidden|style", re.I)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LONG_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
_ZEROS = re.compile(r"&#([xX]?)0{2,}")

FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "region", "furniture name", "comment name", "article", "heading")
#: The labelled table. Each line is a page of blocks: words, words in links, marks, 1 for content.
#: Marks: r region, n furniture name, c comment name, m in the article, h heading. Neighbours follow from the order.
LABELLED = (
    ((1, 1, "r", 0), (1, 1, "r", 0), (2, 2, "r", 0), (8, 0, "n", 0), (9, 0, "mh", 1), (40, 0, "m", 1), (18, 2, "m", 1), (3, 0, "m", 1), (75, 4, "m", 1), (12, 1, "r", 0)),
    ((4, 1, "r", 0), (20, 0, "n", 0), (6, 0, "mh", 1), (60, 0, "m", 1), (1, 0, "mn", 0), (30, 0, "m", 1), (5, 0, "mn", 0), (9, 0, "m", 1), (35, 0, "mn", 1), (50, 0, "m", 1), (3, 3, "mn", 0), (15, 0, "r", 0)),
    ((30, 0, "m", 1), (14, 0, "mn", 1), (22, 1, "m", 1), (20, 0, "mn", 1), (16, 0, "mn", 1), (45, 0, "m", 1), (6, 6, "m", 0), (5, 5, "m", 0), (7, 7, "m", 0), (20, 0, "mc", 0), (45, 0, "mc", 0), (3, 1, "mc", 0)),
    ((1, 1, "", 0), (1, 1, "", 0), (2, 2, "", 0), (3, 0, "", 0), (2, 2, "", 0), (7, 0, "h", 1), (55, 1, "", 1), (12, 0, "", 1), (80, 3, "", 1), (6, 0, "", 1), (33, 0, "", 1)),
    ((64, 2, "", 1), (21, 0, "", 1), (2, 0, "h", 0), (8, 8, "", 0), (7, 7, "", 0), (9, 9, "", 0), (6, 0, "", 0), (3, 3, "", 0)),
    ((4, 0, "", 1),),
    ((10, 0, "", 1), (8, 0, "", 1), (3, 0, "", 1), (26, 0, "", 1)),
    ((2, 0, "h", 1), (5, 0, "", 1), (40, 0, "", 1)),
    ((5, 0, "", 0), (30, 0, "", 0), (11, 0, "mh", 1), (70, 0, "m", 1), (44, 5, "m", 1), (25, 0, "", 0), (4, 0, "", 0), (2, 2, "", 0)),
    ((3, 3, "r", 0), (8, 0, "h", 1), (60, 0, "m", 1), (12, 0, "m", 1), (28, 0, "m", 1), (3, 0, "h", 0), (18, 0, "", 0), (6, 6, "", 0)),
    ((7, 0, "mh", 1), (50, 0, "m", 1), (30, 0, "mr", 0), (5, 5, "mr", 0), (65, 2, "m", 1), (3, 0, "mr", 0), (2, 0, "mr", 0), (9, 0, "mr", 0), (20, 0, "m", 1), (70, 0, "r", 0)),
    ((2, 0, "m", 1), (1, 0, "m", 1), (6, 0, "m", 1), (2, 2, "m", 1), (4, 0, "m", 1), (5, 0, "m", 1), (1, 1, "m", 1), (30, 0, "m", 1), (8, 6, "m", 1), (12, 0, "m", 1)),
    ((4, 0, "mh", 1), (3, 3, "m", 0), (2, 2, "m", 0), (3, 3, "m", 0), (4, 4, "m", 0), (55, 0, "m", 1), (48, 0, "m", 1)),
    ((52, 0, "m", 1), (30, 0, "c", 0), (4, 1, "c", 0), (90, 0, "c", 0), (2, 0, "ch", 0), (14, 0, "c", 0), (10, 0, "r", 0), (35, 0, "r", 0)),
    ((25, 0, "n", 0), (6, 0, "n", 0), (90, 2, "", 1), (120, 2, "n", 1), (100, 0, "", 1), (18, 0, "n", 0), (40, 0, "c", 0), (5, 5, "n", 0)),
    ((1, 0, "n", 0), (60, 0, "m", 1), (2, 0, "mn", 0), (7, 0, "mn", 0), (26, 0, "m", 1), (4, 2, "mn", 0), (80, 1, "m", 1), (10, 0, "n", 0), (33, 0, "n", 0)),
    ((1, 1, "r", 0), (200, 3, "m", 1), (150, 0, "m", 1), (20, 0, "mr", 0), (300, 9, "m", 1), (100, 0, "mc", 0), (8, 0, "r", 0)),
    ((20, 0, "m", 1), (2, 2, "m", 1), (21, 0, "m", 1), (3, 3, "m", 1), (45, 0, "m", 1), (1, 1, "m", 0), (2, 2, "m", 0), (1, 1, "m", 0)),
    ((25, 0, "m", 1), (2, 2, "m", 1), (30, 0, "m", 1), (4, 4, "m", 1), (18, 0, "m", 1), (1, 1, "m", 1), (15, 0, "m", 1), (6, 6, "m", 1), (60, 0, "m", 1), (9, 8, "m", 1), (22, 0, "m", 1)),
    ((40, 0, "m", 1), (6, 6, "m", 0), (8, 8, "m", 0), (30, 0, "m", 1), (2, 2, "m", 0), (5, 5, "m", 0), (16, 0, "m", 1), (9, 9, "m", 0), (7, 7, "m", 0), (80, 0, "m", 1)),
    ((19, 0, "m", 1), (1, 1, "m", 0), (2, 2, "m", 0), (4, 4, "m", 0), (1, 1, "m", 0), (12, 0, "r", 0)),
    ((1, 1, "", 0), (1, 1, "", 0), (4, 0, "", 0), (1, 1, "", 0), (5, 0, "h", 1), (20, 0, "", 1), (38, 0, "", 1), (2, 0, "", 1), (19, 0, "", 1)),
    ((3, 0, "", 0), (2, 2, "", 0), (1, 1, "", 0), (4, 0, "h", 1), (9, 0, "", 1), (24, 0, "", 1), (3, 0, "", 1), (17, 0, "", 1), (1, 1, "", 0), (1, 1, "", 0)),
    ((2, 2, "", 0), (3, 3, "", 0), (14, 0, "h", 1), (22, 0, "", 1), (16, 3, "", 1), (35, 0, "", 1), (9, 0, "", 1), (41, 2, "", 1), (5, 4, "", 0), (2, 2, "", 0)),
)


def _rows(blocks: list[tuple[int, int, int, int, int, int, int]]) -> list[tuple]:
    """FEATURES of each block of a page, given (words, linked words, region, furniture, comment, in the article, heading)."""
    shape = [(0, 0.0), *((b[0], b[1] / b[0]) for b in blocks), (0, 0.0)]
    has = any(b[5] for b in blocks)
    where = lambda inside: 2 if inside else 0 if has else 1  # noqa: E731  in the article, outside it, or there is none
    return [(*shape[k + 1], *shape[k], *shape[k + 2], *map(int, b[2:5]), where(b[5]), int(b[6])) for k, b in enumerate(blocks)]


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A CART tree by Gini impurity: a leaf's label, or (feature, threshold, tree at or below, tree above)."""
    label = int(2 * y.sum() >= len(y))
    if depth == 0 or len(set(y.tolist())) < 2:
        return label
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            gini = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, float(cut), low
    if best is None:
        return label
    _, f, cut, low = best
    return f, cut, _grow(x[low], y[low], depth - 1), _grow(x[~low], y[~low], depth - 1)


def train(table=LABELLED, depth: int = 8):
    x, y = [], []
    for page in table:
        x += _rows([(words, linked, *(m in marks for m in "rncmh")) for words, linked, marks, _ in page])
        y += [label for *_, label in page]
    return _grow(np.array(x, dtype=float), np.array(y, dtype=float), depth)


def _is_content(tree, row: tuple) -> bool:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return bool(tree)


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:
        text = _ZEROS.sub(r"&#\1", _LONG_NUMBER.sub("\ufffd", text))
    return unescape(text)


def _marked(attributes: str, inner: bool) -> tuple[bool, bool, bool]:
    """What an element's own attributes say: (furniture name, comment name, hidden). ``inner``: names of furniture don't count."""
    furniture = comment = hidden = False
    if not _MARKS.search(attributes):
        return furniture, comment, hidden
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = set(_PART.findall(_CAMEL.sub(" ", token).lower()))
                if parts and parts <= FURNITURE | COMMENTS | BESIDE:
                    comment = comment or not parts.isdisjoint(COMMENTS)
                    furniture = furniture or not (inner or parts.isdisjoint(FURNITURE))
        elif name == "hidden":
            hidden = hidden or value.strip().lower() != "false"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "style":
            hidden = hidden or [x.lower() for x in _DISPLAY.findall(unescape(value))][-1:] == ["none"]
    return furniture, comment, hidden


def blocks(html: str) -> list[tuple[str, tuple]]:
    """(text, (words, words in links, region, furniture name, comment name, in the article, heading)) of each flat text block."""
    out: list = []
    nothing = (False,) * 5
    stack: list[tuple] = []  # tag, region, furniture, comment, main, hidden
    open_tags: Counter = Counter()
    region = furniture = comment = main = hidden = False
    text: list[str] = []
    in_links, heading, at, end, links = [], False, 0, len(html), 0

    def flush() -> None:
        nonlocal text, in_links, heading
        if text:
            words = "".join(text).split()
            if words:
                out.append((" ".join(words), (len(words), len("".join(in_links).split()), region, furniture, comment, main, heading)))
            text, in_links = [], []
        heading = False

    def pop() -> str:
        nonlocal region, furniture, comment, main, hidden
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        region, furniture, comment, main, hidden = stack[-1][1:] if stack else nothing
        return tag

    while at < end:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece and not hidden:
            piece = _decoded(piece)
            text.append(piece)
            if links:
                in_links.append(piece + " ")
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not hidden:
            text.append(" ")
        if m[1]:
            if tag == "a":
                links = 0
            if open_tags[tag] > 0:
                while pop() != tag:
                    pass
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("path", "rect", "circle", "line"):
            continue
        if tag == "a":
            links = 1
            continue
        if tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
            close = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES:
            while stack and stack[-1][0] in CLOSES[tag]:
                pop()
        # a header inside the article is the article's own
        region = region or tag in REGIONS and not (main and tag == "header")
        if attributes:
            own = _marked(attributes, tag in ("article", "main", "html", "body"))
            furniture, comment, hidden = furniture or own[0], comment or own[1] and tag not in ("html", "body"), hidden or own[2]
        main, hidden = main or tag in ("article", "main"), hidden or tag in HIDDEN
        stack.append((tag, region, furniture, comment, main, hidden))
        open_tags[tag] += 1
        heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
    flush()
    return out


def main_text(html: str | None, tree) -> str:
    found = blocks(html or "")
    return "\n".join(text for (text, _), row in zip(found, _rows([shape for _, shape in found])) if _is_content(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h, tree) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, table=LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree, kinds = train(table), {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_arrow(pages.select("page_id", "url", "html"), lambda b: _extract(b, tree), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5(pages: DataFrame) -> DataFrame:
    return extract(pages)
