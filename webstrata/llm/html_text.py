"""Main text of web pages by two-pass block rules.

A page is cut at block-level tags into blocks of text. First pass: each block gets a score
from its stop-word density, length and link density; a block with a score above 0 is good,
below 0 bad, and else undecided. Short blocks and headings are undecided whatever their
words. Second pass: an undecided block takes the label of the nearest decided blocks; where
the two sides differ the nearer one counts, at equal distance the good one. A heading goes
with what follows it. Without decided blocks an undecided one is good.

What the markup says only shifts this:

* Blocks in marked elements (navigation, footers, forms, reader comments, adverts, hidden
  elements and the like; see `_mark`) are lowered below everything, or by one for a weak
  mark, and don't vote. Marks never empty a page: where all text of a page is marked, the
  outermost marks are void, then the next, until the densities find something.
* `article` and `main` are a prior. They bound the text unless over PRIOR times as much
  unmarked text that isn't links stands outside them; within, a side that is good decides.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.shared import small_batches
from webstrata.llm.textbytes import portions

SHORT_CHARS = 70
LONG_CHARS = 210
LINK_DENSITY = 0.34
STOP_DENSITY = 0.12
PRIOR = 3

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have in is it of on or that the this to was were which with you
    aber als am an auch auf aus bei das dass dem den der des die ein eine einer es für hat im in ist mit nicht sich sie sind und von wie zu zum zur
    au aux avec ce cette dans de des du elle en est et il la le les ne pas pour par plus que qui sa se son sur un une
    al como con del el en es la las lo los más no para pero por que se su sus un una y""".split()
)

#: Tags whose contents are never text of the page.
_SILENT = frozenset("script style template noscript iframe object svg math select textarea button title head".split())
#: Tags whose contents are raw text up to the matching end tag.
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: Tags that hold boilerplate wherever they stand; the first ones lose that if their end tag is missing.
_OPEN_BOILER = frozenset("nav menu header dialog aside".split())
_BOILER = frozenset("nav footer aside form menu dialog search".split())
#: Roles that say the same.
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert".split())
#: Tags that begin or end a block.
_BLOCK = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = frozenset(["article", "main"])
#: What may stand in a head, and elements that end when one of their kind begins.
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_KIND = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
#: Words of class and id attributes that mark boilerplate.
_MARKS = frozenset(
    """ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted menu nav navbar navigation breadcrumb breadcrumbs
    sidebar side aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay
    comment comments commentlist disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login search widget
    pagination pager copyright legal disclaimer skip complementary contentinfo logo branding""".split()
)
#: Marks that an article's own head may have.
_OWN_MARKS = frozenset(("header", "masthead"))
#: Words beside which a mark is weak, and words that turn one off.
_CONTENT_WORDS = frozenset("article body content copy entry main page post story text wrap wrapper container layout".split())
_NEGATIONS = frozenset("no not non without hide has have with is".split())

#: A token's begin; the attributes of tags are read by _Tags.
_HEAD = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)", re.S | re.I)
_SPECIAL = re.compile(r"""[>"']""")
_ODD = re.compile(r"</?[a-zA-Z][^<>]*(>|\Z)", re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_RELEVANT = re.compile(r"class|\bid\b|role|hidden|style", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_PLAIN_WORD = re.compile(r"[^\s.,;:!?\"'()]+")
_SPLIT = re.compile(r"[-_:.]+")


@dataclass
class _Mark:
    """A marked element: does it lower its blocks below everything, or by one?"""

    strong: bool


@dataclass
class Block:
    text: str
    linked: int
    part: int
    marks: tuple = ()
    heading: bool = False
    label: str = ""
    votes: bool = field(default=False)


def _word_mark(token: str, inside: bool) -> str | None:
    """Does a class or id mark boilerplate: strong, weak or not at all? A compound is named by its
    last word or, if no other word speaks of content, by its first; elsewhere a mark is weak."""
    parts = [p for p in _SPLIT.split(_CAMEL.sub(r"\1-\2", token).lower()) if p]
    hits = [p in _MARKS and not (inside and p in _OWN_MARKS) for p in parts]
    if not any(hits) or any(p in _NEGATIONS for p in parts):
        return None
    content = any(p in _CONTENT_WORDS for p in parts)
    if hits[-1] and (len(parts) <= 2 or not content) or hits[0] and not content:
        return "strong"
    return "weak"


def _mark(tag: str, attrs: str, inside: bool) -> str | None:
    """The mark of an element by its tag, role, class, id and whether it is hidden."""
    if tag in _BOILER or tag == "header" and not inside:
        return "strong"
    if tag in ("html", "body") or not attrs or not _RELEVANT.search(attrs):
        return None
    found = None
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return "strong"
        if name == "role" and _ROLES.intersection(value.lower().split()):
            return "strong"
        if name in ("class", "id"):
            for token in value.split():
                mark = _word_mark(token, inside) if tag not in _PARTS else "strong" if token.lower() in _MARKS else None
                if mark == "strong":
                    return mark
                found = found or mark
    return found


class _Tags:
    """Where the tags of a page end: at the first `>` outside quotes. Quoted values may have any
    length. Each quote is followed once, so the whole page takes linear time."""

    def __init__(self, page: str):
        self.page = page
        self.known: dict[int, int] = {}  # an opening quote: where its tag ends
        self.plain = (0, -1)  # no special character stands between these two places

    def end(self, at: int) -> int:
        """The place of the `>` that ends a tag with attributes from `at` on, -1 if there is none."""
        if not self.plain[0] <= at <= self.plain[1]:
            self.plain = (at, self._special(at))
        q, way = self.plain[1], []
        while q < len(self.page) and self.page[q] != ">" and q not in self.known:
            way.append(q)
            close = self.page.find(self.page[q], q + 1)
            q = self._special(close + 1) if close >= 0 else len(self.page)
        found = self.known[q] if q in self.known else q if q < len(self.page) else -1
        self.known.update(dict.fromkeys(way, found))
        return found

    def _special(self, at: int) -> int:
        m = _SPECIAL.search(self.page, at)
        return m.start() if m else len(self.page)


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, attributes) of each token; kinds: open and close (of the tag that is the
    value), cdata, break (raw text, and tags with an open quote) and none."""
    tags, at = _Tags(page), 0
    while m := _HEAD.search(page, at):
        start, at = m.span()
        if not m["tag"]:
            yield start, at, "cdata" if m["cdata"] else "none", m["cdata"] or "", ""
            continue
        end, tag = tags.end(at), m["tag"].lower()
        if end < 0:
            odd = _ODD.match(page, start)
            at = odd.end() if odd else start + 1
            if odd:
                yield start, at, "break" if odd[1] else "none", "", ""
        elif not m["end"] and tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, end + 1)
            at = close.end() if close else len(page)
            yield start, at, "break", "", ""
        else:
            yield start, end + 1, "close" if m["end"] else "open", tag, page[at:end]
            at = end + 1


class _Frame:
    """An open block element, with the inline elements that are open in it."""

    __slots__ = ("tag", "marks", "own", "part", "heading", "silent", "inline", "open")

    def __init__(self, tag: str, marks: tuple, own: _Mark | None, part: int, heading: bool, silent: bool):
        self.tag, self.marks, self.own, self.part, self.heading, self.silent = tag, marks, own, part, heading, silent
        self.inline: list[tuple[str, tuple, bool]] = []  # tag, marks outside it, is it a link
        self.open: dict[str, int] = {}


def cut(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    words: list[str] = []
    linked: list[str] = []
    frames = [_Frame("", (), None, 0, False, False)]
    open_blocks: Counter = Counter()
    marks: tuple = ()
    parts, links, at = 0, 0, 0

    def text(s: str, plain: bool = False) -> None:
        if s and not frames[-1].silent:
            s = s if plain or "&" not in s else _html.unescape(s)
            words.append(s)
            if links:
                linked.append(s)

    def flush() -> None:
        if words:
            top = frames[-1]
            body = " ".join("".join(words).split())
            if body:
                out.append(Block(body, len(" ".join("".join(linked).split())), top.part, marks, top.heading))
            words.clear()
            linked.clear()

    def pop(closed: bool) -> None:
        nonlocal marks, links
        top = frames.pop()
        open_blocks[top.tag] -= 1
        if top.inline:
            links -= sum(x[2] for x in top.inline)
        if not closed and top.own and top.tag in _OPEN_BOILER:
            top.own.strong = False
        marks = top.marks

    for start, end, kind, tag, attrs in _tokens(page):
        if start > at:
            text(page[at:start])
        at = end
        if kind == "cdata":
            text(tag, plain=True)
        elif kind == "break":
            flush()
        if kind not in ("open", "close"):
            continue
        block = tag in _BLOCK or tag in _SILENT
        if block:
            flush()
        if tag in _VOID:
            continue
        if kind == "close":
            if block:
                if open_blocks[tag] > 0:
                    while frames[-1].tag != tag:
                        pop(False)
                    pop(True)
            elif frames[-1].open.get(tag, 0) > 0:
                top, name = frames[-1], ""
                while name != tag:
                    name, before, link = top.inline.pop()
                    top.open[name] -= 1
                    links -= link
                    if before is not marks:
                        flush()
                    marks = before
            continue
        if attrs.endswith("/") and tag not in ("a", "p", "div", "span"):
            continue
        if frames[-1].tag == "head" and tag not in _IN_HEAD:
            flush()
            pop(False)
        if block:
            if frames[-1].tag == "p" and tag in _BLOCK:
                pop(False)
            if (own_kind := _KIND.get(tag)) and _KIND.get(frames[-1].tag) == own_kind:
                pop(False)
        top = frames[-1]
        mark = _mark(tag, attrs, top.part > 0)
        if block:
            own = _Mark(mark == "strong") if mark else None
            part = top.part
            if tag in _PARTS:
                parts += 1
                part = parts
            frames.append(_Frame(tag, marks, own, part, tag in _HEADINGS or top.heading and tag not in _PARTS, top.silent or tag in _SILENT))
            open_blocks[tag] += 1
            if own:
                marks = (*marks, own) if len(marks) < 8 else marks
        else:
            link = tag == "a" and "href" in attrs.lower()
            links += link
            top.inline.append((tag, marks, link))
            top.open[tag] = top.open.get(tag, 0) + 1
            if mark:
                flush()
                marks = (*marks, _Mark(mark == "strong")) if len(marks) < 8 else marks
    if at < len(page):
        text(page[at:])
    flush()
    while len(frames) > 1:
        pop(False)
    return out


def stop_density(text: str) -> float:
    ws = _PLAIN_WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, ws)) / max(1, len(ws))


def _score(b: Block, weak: int, prior: bool) -> int:
    """The first pass over an unmarked or weakly marked block."""
    n = len(b.text)
    if b.linked > LINK_DENSITY * n:
        return -1 - (b.linked >= n and n < SHORT_CHARS) + prior - weak
    if n < SHORT_CHARS or b.heading:
        return -1 if b.text.startswith("©") and not prior else 0
    if stop_density(b.text) < STOP_DENSITY:
        return 0 if prior else -(weak > 0)
    return (2 if n >= LONG_CHARS else 1) - weak


def _strong(b: Block, void: int) -> bool:
    return any(m.strong for m in b.marks[void:])


def _labels(blocks: list[Block], void: int) -> None:
    """Both passes, with the outermost `void` marks of each block not counted."""
    free = [not _strong(b, void) for b in blocks]
    plain = lambda b: len(b.text) if b.linked <= LINK_DENSITY * len(b.text) else 0
    inside = sum(plain(b) for b, f in zip(blocks, free) if f and b.part)
    outside = sum(plain(b) for b, f in zip(blocks, free) if f and not b.part)
    bounded = inside > 0 and PRIOR * inside >= outside
    for b, f in zip(blocks, free):
        part = b.part if bounded else 0
        b.votes = False
        if not f or bounded and not b.part and not b.heading:
            b.label = "bad"
            continue
        score = _score(b, sum(not m.strong for m in b.marks[void:]), part > 0)
        b.label = "good" if score > 0 else "bad" if score < 0 else "undecided"
        b.votes = score != 0
    # nearest votes of the same part, on both sides; a heading outside the parts looks into what follows it
    scope = [b.part if bounded else 0 for b in blocks]
    left: list[tuple[int, str] | None] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(blocks):
        left.append(last.get(scope[i]))
        if b.votes:
            last[scope[i]] = (i, b.label)
    last, found, following = {}, [b.label for b in blocks], None
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label == "undecided":
            before, after = left[i], last.get(scope[i])
            if bounded and not b.part:
                found[i] = "good" if following == "good" else "bad"
            elif b.heading and after:
                found[i] = after[1]
            else:
                sides = [(abs(i - x[0]), x[1] != "good", x[1]) for x in (before, after) if x]
                if scope[i] and any(not s[1] for s in sides) or not sides:
                    found[i] = "good" if sides or not void else "bad"
                else:
                    found[i] = min(sides)[2]
        if b.votes:
            last[scope[i]] = (i, b.label)
        if free[i]:
            following = found[i]
    for b, label in zip(blocks, found):
        b.label = label


def classify(blocks: list[Block]) -> list[Block]:
    """Label every block good or bad; see the module's text."""
    deepest = max((len(b.marks) for b in blocks), default=0)
    for void in range(deepest + 1):
        _labels(blocks, void)
        if any(b.label == "good" for b in blocks):
            return blocks
        if void == 0:
            plain = [b for b in blocks if not _strong(b, 0) and b.linked <= LINK_DENSITY * len(b.text) and not b.text.startswith("©")]
            if plain:
                for b in plain:
                    b.label = "good"
                return blocks
    return blocks


def main_text(page: str | None) -> str:
    """The main text of a page, its good blocks joined by one space; null and empty pages have none."""
    if not page:
        return ""
    return " ".join(b.text for b in classify(cut(page)) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: page_id, url, text, n_chars. Narrow: no shuffle.

    Null and empty html give an empty text; broken markup, open comments and cut tags are
    read up to the end; pages, attributes and raw texts may have any length, in linear time.
    An empty table gives no rows; repeated rows give a row each; other columns, whatever
    their names, are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
