"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. It tells three things: which lines are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments (by element, role, or a class or id that is made of
words for these alone; headings and paragraphs are never left out so), which have no length because they are links, and
where the edge of a container stands, which is BLOCK empty lines. Edges within lists, tables, figures, and around a
container inside one that holds text itself are none. Where <article> or <main> hold most of a page's text, lines outside
have no length and edges inside are none.

Over windows of BLOCK lines the lengths are summed. Where the sums are not zero, lines form a stretch; it surges if a sum
reaches SURGE, or half the page's largest sum if that is less. Text is kept whole from the first line with a length of the
first surging stretch to the last of the last one (the dive), with the headings right before it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import appended, table, with_columns, without

BLOCK = 3
#: A surge needs this many characters in a window, or half the page's largest sum if that is less.
SURGE = 86

_RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split())
_CONTAINERS = _BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr blockquote pre".split())
#: Containers that stand within a text, or hold the whole page: their edges end no window.
_INNER = frozenset("html body center ul ol dir dl dt dd li tr table tbody thead tfoot figure figcaption details summary hgroup hr".split())
_SPACED = frozenset("br td th".split())
_DROPPED = frozenset("head nav footer aside form button select menu dialog object canvas audio video search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
_DROP_WORDS = _COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended widget widgets pagination pager login search skip-link".split()
)
#: Words that stand beside these in the name of a box without making it another thing.
_BOX_WORDS = frozenset("area bar block box btn buttons container content form inner item items left links list main outer page panel posts right section site slot stories thread top bottom unit wrap wrapper".split())
_HEAD_WORDS = frozenset("header masthead banner".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that no class, id or role leaves out.
_KEPT = frozenset("html body main p h1 h2 h3 h4 h5 h6".split())
#: Elements whose links are text of an article; elsewhere a line of links is a list of them.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd td th".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for n in _RAW}
#: Dropped elements that an article inside is freed from.
_WRAPPERS = frozenset("div span section form".split())
#: Elements that end an open element of the same kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _names(value: str, words: frozenset[str], whole: bool) -> bool:
    """Whether a class or id is one of the words, or (unless `whole`) made of them and of words for boxes alone."""
    if value in words:
        return True
    parts = re.split(r"[-_]+", value)
    return not whole and any(p in words for p in parts) and all(p in words or p in _BOX_WORDS or p in _HEAD_WORDS or p.isdigit() for p in parts)


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in _DROPPED or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    words = _COMMENT_WORDS if name == "article" else _DROP_WORDS - _HEAD_WORDS if in_article else _DROP_WORDS
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in _KEPT:
            continue
        if key == "role" and value.strip() in _ROLES and not (in_article and value.strip() == "banner"):
            return True
        # The id of a section in an article is an anchor, made of the words of a heading.
        anchor = key == "id" and in_article and name == "section"
        if key in ("class", "id") and any(_names(x, _COMMENT_WORDS if anchor else words, anchor) for x in value.split()):
            return True
    return False


@dataclass
class Line:
    text: str
    #: Inside <article> or <main>.
    article: bool
    #: Characters in links.
    linked: int
    heading: bool
    prose: bool
    #: The innermost container that ends windows; -1 if there is none.
    box: int


class Page:
    """The lines of a page, in time in proportion to its length."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        #: Parents of the containers, by number.
        self.parents: list[int] = []
        self._ends: list[int] = []
        self._parts: list[str] = []
        self._linked = 0
        # (element, dropped, in article, container)
        self._stack: list[tuple[str, bool, bool, int]] = []
        self._open: Counter[str] = Counter()
        self._held = 0  # dropped elements that keep even an article dropped
        self._dropped = self._article = False
        self._box = -1
        self._read(page)

    def around(self, a: int, b: int) -> bool:
        """Whether container a is b or around it."""
        return a >= 0 and a <= b and self._ends[b] <= self._ends[a]

    def together(self, a: Line, b: Line) -> bool:
        return a.box == b.box or self.around(a.box, b.box) or self.around(b.box, a.box)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        self._parts.clear()
        if text:
            opened = self._open
            self.lines.append(Line(text, self._article, self._linked, any(opened[h] for h in _HEADINGS), any(opened[e] for e in _PROSE), self._box))
        self._linked = 0

    def _text(self, s: str) -> None:
        if s and not self._dropped:
            s = html.unescape(s)
            self._parts.append(s)
            if self._open["a"]:
                self._linked += len(s.strip())

    def _leave(self, to: int) -> None:
        for name, dropped, *_, box in reversed(self._stack[to:]):
            self._open[name] -= 1
            self._held -= dropped and name not in _WRAPPERS
            if box >= 0:
                self._ends[box] = len(self._ends) - 1
                self._box = self.parents[box]
        del self._stack[to:]
        self._dropped, self._article = self._stack[-1][1:3] if self._stack else (False, False)

    def _enter(self, name: str, attributes: str) -> None:
        whole = name in ("article", "main")
        # An article inside an unclosed advert or notice is an article all the same.
        freed = whole and self._dropped and not self._held and not _dropped(name, attributes, False)
        drop = not freed and (self._dropped or _dropped(name, attributes, self._article))
        self._article = (self._article or whole) and not drop
        self._dropped = drop
        box = -1
        if name in _CONTAINERS and name not in _INNER:
            box = len(self.parents)
            self.parents.append(self._box)
            self._ends.append(1 << 62)
            self._box = box
        self._stack.append((name, drop, self._article, box))
        self._open[name] += 1
        self._held += drop and name not in _WRAPPERS

    def _read(self, page: str) -> None:
        at = 0
        stack, opened = self._stack, self._open
        while m := _TAG.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if name in _BLOCKS:
                self._flush()
            elif name in _SPACED and not self._dropped:
                self._parts.append(" ")
            if closing:
                if opened[name]:
                    self._leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                continue
            if name in _RAW and not attributes.endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in _VOID:
                continue
            ends = ({"p"} if name in _BLOCKS else set()) | _ENDS.get(name, set())
            if any(opened[e] for e in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        self._leave(k)
                        break
                    if stack[k][0] in _CONTAINERS:
                        break
            self._enter(name, attributes)
        self._text(page[at:])
        self._flush()


def kept(lengths: list[int], block: int = BLOCK, surge: int = SURGE) -> tuple[int, int] | None:
    """[first, stop) of the lines between the first surge and the last dive; None if no line has a length."""
    sums = [sum(lengths[i : i + block]) for i in range(len(lengths))]
    least = min(surge, max(sums, default=0) // 2 + 1)
    found: tuple[int, int] | None = None
    at = 0
    while at < len(sums):
        stop = at
        while stop < len(sums) and sums[stop]:
            stop += 1
        if stop > at and max(sums[at:stop]) >= least:
            some = [i for i in range(at, stop) if lengths[i]]
            found = (found[0] if found else some[0], some[-1] + 1)
        at = stop + 1
    return found


def main_text(page: str | None) -> str:
    """The blocks between surge and dive points, joined by an empty line."""
    read = Page(page or "")
    lines = read.lines
    plain = [len(x.text) if 2 * x.linked < len(x.text) else 0 for x in lines]
    held = [(len(x.text) if x.prose else plain[i]) if x.article else 0 for i, x in enumerate(lines)]
    inside = 2 * sum(held) > sum(map(max, zip(plain, held, strict=True)))
    lengths: list[int] = []
    rows: list[int] = []  # the line of every length, -1 for the empty lines of an edge
    for i, n in enumerate(held if inside else plain):
        if i and not inside and not read.together(lines[i - 1], lines[i]):
            lengths += [0] * BLOCK
            rows += [-1] * BLOCK
        lengths.append(n)
        rows.append(i)
    span = kept(lengths)
    if not span:
        return ""
    first, last = rows[span[0]], rows[span[1] - 1]
    while first and lines[first - 1].heading and (lines[first - 1].article or not inside):
        first -= 1
    return "\n\n".join(x.text for x in lines[first : last + 1])


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with text (empty if the page has none) and n_chars.

    A null page is an empty one. Repeated pages come out alike; broken and cut markup is read as far as it goes; input
    columns named text or n_chars are replaced, all others carried. No shuffle.
    """
    base = without(df, [c for c in ("text", "n_chars") if c != html_col])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(html_col)]
            yield with_columns(batch.drop_columns([html_col]), {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return base.mapInArrow(extracted, appended(base.drop(html_col), "text string, n_chars long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
