"""Main text of HTML pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its word count and link
density, by those of its neighbours, and by the kind of element it stands in. The tree is trained
here, on a small labelled table of such blocks. Accepted blocks are joined in page order.

What stands in menus, footers, adverts and the like is judged piece by piece, so an advert inside a
paragraph leaves the paragraph. A class or id that names such a thing does not count for an element
that only wraps the article beside it: one with the word of a wrapper in its name, or a form, is set
free by the main element (or, for a form, the heading) found inside it.

A null or empty page gives the empty text; broken markup (unclosed or stray tags and quotes, a page
that ends inside a tag or a comment) never fails and costs time in proportion to the page. Each row
is handled on its own, whatever its other columns; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Element names.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template svg canvas object iframe audio video textarea title head select option button".split())
PLAIN = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names and class words of elements that hold no main text.
AROUND = frozenset("nav header footer aside form menu dialog search fieldset".split())
WRAPPER_WORDS = re.compile(r"(?:^|[\s_-])(?:has|with|no|wrap|wrapper|container|layout|page|site|row|grid|columns?|main|content)(?:$|[\s_-])", re.I)
ADVERT_WORDS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsbygoogle|sponsor\w*|promo\w*|hidden)(?:$|[\s_-])", re.I)
HEAD_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|page)[_-]header(?:$|[\s_-])", re.I)
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"nav\w*|menu\w*|breadcrumb\w*|sidebar|side|widget\w*|footer|foot|header|masthead|toolbar|topbar|share|sharing|social|related|recommend\w*|comment\w*|"
    r"disqus|replies|respond|login|signup|search|pagination|pager|skip|hidden|copyright|tags)(?:$|[\s_-])",
    re.I,
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset("article main".split())
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text)(?:$|[\s_-])", re.I)

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
# a quote opens a value only right after the equals sign, and only if it is closed again
_ATTR = re.compile(r"[\s/=]*+([^\s=>/][^\s=>/]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_TAG_END = re.compile(r"[\s/=]*+>")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "around", "main", "page_has_main")
# Labelled blocks for training: the features in order, then 1 for main text.
LABELLED = (
    # pages that mark their article
    (6, 0.0, 8, 1.0, 12, 0.0, 0, 1, 1, 1), (12, 0.0, 6, 0.0, 80, 0.0, 0, 1, 1, 1), (80, 0.02, 12, 0.0, 45, 0.0, 0, 1, 1, 1),
    (1, 0.0, 60, 0.0, 70, 0.0, 0, 1, 1, 1), (2, 0.0, 1, 0.0, 3, 0.0, 0, 1, 1, 1), (3, 1.0, 40, 0.0, 50, 0.0, 0, 1, 1, 1),
    (5, 1.0, 0, 0.0, 5, 1.0, 0, 1, 1, 1), (30, 0.4, 3, 0.0, 9, 0.3, 0, 1, 1, 1), (150, 0.0, 90, 0.0, 4, 0.5, 0, 1, 1, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 1, 0), (9, 0.0, 1, 1.0, 7, 0.0, 1, 0, 1, 0),
    (14, 0.1, 120, 0.0, 0, 0.0, 1, 0, 1, 0), (60, 0.0, 30, 0.0, 20, 0.0, 1, 0, 1, 0), (40, 0.0, 70, 0.0, 55, 0.0, 1, 1, 1, 0),
    (8, 0.5, 50, 0.0, 44, 0.0, 1, 1, 1, 0), (2, 0.0, 30, 0.0, 40, 0.0, 1, 1, 1, 0), (90, 0.0, 15, 0.0, 33, 0.0, 1, 0, 1, 0),
    (4, 0.0, 0, 0.0, 20, 0.0, 0, 0, 1, 0), (25, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0), (70, 0.0, 1, 0.0, 30, 0.0, 0, 0, 1, 0), (3, 1.0, 4, 1.0, 8, 0.0, 0, 0, 1, 0),
    (35, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1, 0), (12, 0.0, 70, 0.0, 9, 0.0, 0, 0, 1, 0), (50, 0.0, 8, 0.0, 0, 0.0, 0, 0, 1, 0), (6, 0.0, 25, 0.0, 16, 0.0, 0, 0, 1, 0),
    (90, 0.0, 55, 0.0, 62, 0.0, 0, 0, 1, 0), (2, 0.0, 45, 0.0, 38, 0.0, 0, 0, 1, 0), (18, 0.1, 14, 0.2, 22, 0.1, 0, 0, 1, 0), (28, 0.0, 5, 0.0, 5, 0.0, 0, 0, 1, 0),
    # pages that mark nothing but menus and the like
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1), (45, 0.05, 4, 0.0, 60, 0.0, 0, 0, 0, 1), (20, 0.0, 70, 0.0, 30, 0.0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 55, 0.0, 0, 0, 0, 1), (4, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (1, 0.0, 25, 0.0, 48, 0.0, 0, 0, 0, 1),
    (9, 0.1, 65, 0.0, 0, 0.0, 0, 0, 0, 1), (16, 0.2, 20, 0.1, 22, 0.0, 0, 0, 0, 1), (110, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (5, 0.8, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (10, 0.7, 60, 0.0, 2, 1.0, 0, 0, 0, 0),
    (3, 1.0, 70, 0.0, 4, 1.0, 0, 0, 0, 0), (25, 0.9, 1, 1.0, 50, 0.0, 0, 0, 0, 0), (6, 0.6, 9, 0.9, 4, 0.7, 0, 0, 0, 0), (12, 0.9, 44, 0.0, 61, 0.0, 0, 0, 0, 0),
    # a few words between links are labels of menus, not text; between texts they are
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (6, 0.0, 2, 0.9, 5, 1.0, 0, 0, 0, 0), (3, 0.2, 6, 1.0, 4, 0.8, 0, 0, 0, 0),
    (5, 0.0, 9, 1.0, 1, 1.0, 0, 0, 0, 0), (7, 0.1, 2, 1.0, 3, 0.9, 0, 0, 0, 0), (35, 0.0, 4, 1.0, 6, 1.0, 0, 0, 0, 1), (80, 0.1, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (3, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 1), (5, 0.0, 30, 0.1, 40, 0.0, 0, 0, 0, 1), (22, 0.0, 5, 1.0, 2, 0.9, 0, 0, 0, 1), (15, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 1),
    (1, 0.0, 0, 0.0, 50, 0.0, 0, 0, 0, 1), (4, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1), (3, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1), (6, 0.0, 5, 0.0, 30, 0.0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 8, 0.0, 0, 0, 0, 1), (5, 0.0, 3, 0.0, 12, 0.1, 0, 0, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0, 1), (6, 0.0, 1, 1.0, 90, 0.0, 0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 40, 0.0, 1, 0, 0, 0), (8, 0.0, 50, 0.0, 0, 0.0, 1, 0, 0, 0), (2, 0.0, 60, 0.0, 1, 1.0, 1, 0, 0, 0), (75, 0.0, 66, 0.0, 58, 0.0, 1, 0, 0, 0),
)


def train(rows=LABELLED, depth: int = 8):
    """A decision tree by Gini impurity: nested ``(feature, threshold, below, above)``, leaves 0 or 1."""
    table = np.array(rows, float)

    def grow(part: np.ndarray, left: int):
        label = part[:, -1]
        if left == 0 or label.min() == label.max():
            return int(label.mean() >= 0.5)
        best = None
        for feature in range(part.shape[1] - 1):
            values = np.unique(part[:, feature])
            for threshold in (values[1:] + values[:-1]) / 2:
                below = part[:, feature] < threshold
                impurity = sum(side.sum() * p * (1 - p) for side in (below, ~below) for p in [label[side].mean()])
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, feature, float(threshold), below)
        if best is None:
            return int(label.mean() >= 0.5)
        return best[1], best[2], grow(part[best[3]], left - 1), grow(part[~best[3]], left - 1)

    return grow(table, depth)


def accept(tree, features) -> bool:
    """The tree's verdict on one block."""
    while not isinstance(tree, int):
        feature, threshold, below, above = tree
        tree = below if features[feature] < threshold else above
    return bool(tree)


def attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes of a tag from ``at`` on, the place after the tag, and whether it closes itself."""
    found: dict[str, str] = {}
    while not (end := _TAG_END.match(page, at)):
        one = _ATTR.match(page, at)
        if not one:
            return found, len(page), False
        found.setdefault(one[1].lower(), one[2] or one[3] or one[4] or "")
        at = one.end()
    return found, end.end(), "/" in end[0]


class _Reader:
    """The open elements of a page and the pieces of the block that is being read."""

    def __init__(self) -> None:
        self.found: list = []  # blocks as lists of (text, words, linked words, around, soft, main)
        self.parts: list = []
        self.stack: list = []  # (name, around, soft, main, raw)
        self.places: dict[str, list[int]] = {}  # where the elements of a name stand in the stack
        self.walls: list[int] = []  # where block elements stand, and those but paragraphs
        self.hard: list[int] = []
        self.around = self.main = self.raw = self.links = 0
        self.soft: list[list] = []  # open elements whose name or class alone speaks against them: [set free, kind]

    def put(self, text: str) -> None:
        if text and not self.raw:
            self.parts.append((text, self.links > 0, self.around > 0, self.soft[-1] if self.soft else None, self.main > 0))

    def close(self) -> None:
        if self.parts:
            self.found.append(self.parts)
            self.parts = []

    def push(self, name: str, around: bool, soft: list | None, main: bool, raw: bool) -> None:
        at = len(self.stack)
        self.stack.append((name, around, soft, main, raw))
        self.places.setdefault(name, []).append(at)
        if name in BLOCK:
            self.walls.append(at)
            if name != "p":
                self.hard.append(at)
        if soft:
            self.soft.append(soft)
        self.around, self.main, self.raw, self.links = self.around + around, self.main + main, self.raw + raw, self.links + (name == "a")

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, around, soft, main, raw = self.stack.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.walls.pop()
                if name != "p":
                    self.hard.pop()
            if soft:
                self.soft.pop()
            self.around, self.main, self.raw, self.links = self.around - around, self.main - main, self.raw - raw, self.links - (name == "a")

    def end(self, name: str) -> None:
        """An end tag; one of an inline element does not reach out of the block that holds it."""
        places = self.places.get(name)
        if places and (name in BLOCK or not self.walls or self.walls[-1] < places[-1]):
            self.pop(places[-1])

    def end_before(self, name: str) -> None:
        """A paragraph or list item ends the one before it, unless another block lies between."""
        places = self.places.get(name)
        if places and not (self.hard and self.hard[-1] > places[-1]):
            self.pop(places[-1])

    def free(self, name: str, role: str | None) -> None:
        """A main element sets free what wraps it."""
        for soft in self.soft:
            if name == "main" or role == "main" or soft[1] == "form" or (soft[1] == "wrapper" and name in ("article", "div", "section")):
                soft[0] = True


def _open(reader: _Reader, name: str, attrs: dict[str, str]) -> None:
    hint, role = f"{attrs.get('class', '')} {attrs.get('id', '')}", attrs.get("role")
    aside = bool(ASIDE_WORDS.search(hint)) and not HEAD_WORDS.search(hint)
    inline = name not in BLOCK
    marked = name in MAIN or role in ("main", "article")
    main = marked or name in ("div", "section") and bool(MAIN_WORDS.search(hint)) and not aside
    around = name in AROUND and name != "form" and not (name == "header" and reader.main) or role in ASIDE_ROLES - {"form"} or "hidden" in attrs or attrs.get("aria-hidden") == "true"
    around = around or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""))) or inline and bool(ADVERT_WORDS.search(hint))
    soft = None
    if name == "form" or role == "form":
        soft = [False, "form"]
    elif aside and not inline and name not in ("body", "html", "article", "main"):
        soft = [False, "wrapper" if WRAPPER_WORDS.search(hint) else "aside"]
    if marked and not aside or name == "h1" and any(s[1] == "form" for s in reader.soft):
        reader.free(name, role)
    reader.push(name, around, soft, main and not (soft and soft[1] == "aside"), name in RAW)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Flat blocks in page order: ``(text, words, linked words, around, main)``."""
    reader, at = _Reader(), 0
    while (start := page.find("<", at)) >= 0:
        tag = _NAME.match(page, start)
        if not tag:
            other = _OTHER.match(page, start)
            reader.put(page[at : other.start() if other else start + 1])
            at = other.end() if other else start + 1
            continue
        reader.put(page[at:start])
        name = tag[2].lower()
        attrs, at, closed = attributes(page, tag.end())
        if name in BLOCK:
            reader.close()
        if tag[1]:
            reader.end(name)
            continue
        if name in ("p", "li"):
            reader.end_before(name)
        if name in VOID or closed:
            continue
        _open(reader, name, attrs)
        if name in PLAIN:  # nothing in it is a tag but its end
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            reader.put(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
    reader.put(page[at:])
    reader.close()
    out = []
    for parts in reader.found:
        pieces = [(text, linked, around or bool(soft and not soft[0]), main) for text, linked, around, soft, main in parts]
        inside = [p for p in pieces if not p[2]]
        shown = inside if any(p[0].strip() for p in inside) else pieces
        words = entities.unescape("".join(p[0] for p in shown)).split()
        if words:
            out.append((" ".join(words), len(words), sum(len(p[0].split()) for p in shown if p[1]), shown is not inside, any(p[3] for p in shown)))
    return out


def main_text(page: str | None, tree) -> str:
    """Accepted blocks of a page, joined by one space."""
    found = blocks(page or "")
    marked = any(main and not around for *_, around, main in found)  # what a footer or a comment holds marks no article
    size = [(0, 0.0), *((words, min(1.0, linked / words)) for _, words, linked, _, _ in found), (0, 0.0)]
    taken = []
    for i, (text, _, _, around, main) in enumerate(found):
        if accept(tree, (*size[i + 1], *size[i], *size[i + 2], around, main, marked)):
            taken.append(text)
    return " ".join(taken)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html column, plus ``text`` and ``n_chars``; no shuffle."""
    tree = train()
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kept = pages.select(*others, F.col(html_col).cast("string").alias("_html"))

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(lambda p: main_text(p, tree))

    return kept.select(*others, text_of("_html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
