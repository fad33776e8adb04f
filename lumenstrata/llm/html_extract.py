"""Main-text extraction from HTML.

The standard library's parser streams events; text is gathered into one line
per block together with the number of tags and of linked characters in it.
Zones that can't be article text (menus, forms, adverts, comments, ...) are
left out by element name or by class, id and role names; a name that says so
only in part makes its element suspect, and so do some whole names.  The
clusters below decide about suspect elements: one that holds most of the page's
content stays.  The lines' ratios of
text to tags are smoothed with a Gaussian and clustered by a threshold; the
clusters select the outermost container (article, main, or the body) that holds
the most content; every line of it, of the containers inside it and of the parts
beside it in one element is kept in page order.  A page without a container
loses the lines of links, but for paragraphs, outside its clusters at either end.

Defined results: null, empty and text-free pages give an empty text; repeated
pages are extracted alike; unclosed and badly nested elements are tolerated.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, map_text

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul head td th option select".split()
)
NEVER = frozenset("script style noscript template head title nav footer aside iframe object svg canvas button select textarea input dialog menu audio video".split())
CONTAINERS = frozenset(["article", "main"])
CLOSES_P = BLOCK - {"td", "th", "option", "body", "html"}
SECTIONING = frozenset("article main section div body html table ul ol dl td th li blockquote".split())
#: Tokens of class, id and role that mark a zone without article text.
BAD_TOKENS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors sidebar side widget widgets nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs header masthead footer foot copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending pagination pager comment comments commentlist respond discussion disqus "
    "replies reply complementary contentinfo search toolbar skip hidden legal disclaimer paywall".split()
)
#: Those of them that make even an article element no main text.
BAD_ARTICLES = frozenset("ad ads advert promo sponsored comment comments reply replies related teaser".split())
#: Words that make a compound name of a zone say no more than its other words do.
NEUTRAL = frozenset("site page main top bottom left right box block slot list wrap wrapper container area bar section link links button buttons item items unit post article js primary secondary global".split())
#: Tokens of zones that are no main text, however much text they hold.
FIRM_TOKENS = BAD_ARTICLES | frozenset(
    "adv adverts advertisement advertising adsense banner promotion sponsor sponsors cookie cookies consent gdpr newsletter popup modal overlay commentlist respond disqus hidden skip".split()
)
#: Tokens of zones of reader comments, in which an article is a comment.
COMMENT_TOKENS = frozenset("comment comments commentlist respond discussion disqus replies reply".split())
#: Tokens that make an element of any further name suspect; how much of the page's content it holds then decides.
SUSPECT_TOKENS = (BAD_TOKENS | BAD_ARTICLES) - frozenset("side nav header head footer foot copyright alert notice notices login search toolbar skip hidden legal disclaimer paywall modal overlay menu respond complementary contentinfo".split())
#: Text blocks, whose ids are often made from a title.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p li ul ol dl dt dd pre blockquote table tbody tr td th figure figcaption section".split())
#: Elements that group blocks, which a name in part makes suspect.
GROUPS = frozenset("div section ul ol dl form".split())
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: How an element is marked: by a part of its name, so that content can overrule it, so that it can't, or as not shown.
SUSPECT, LOOSE, FIRM, HIDDEN = 1, 2, 3, 4


class _Line:
    __slots__ = ("text", "tags", "linked", "zone", "mark", "prose")

    def __init__(self, text, tags, linked, zone, mark, prose):
        self.text, self.tags, self.linked, self.zone, self.mark, self.prose = text, tags, linked, zone, mark, prose


class _Events(HTMLParser):
    """Turns parser events into lines; ``zone`` is the innermost container (0: none), ``mark`` the innermost marked element (0: none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[tuple[str, bool, int, int, int]] = []  # element, left out, zone, number, mark
        self.open: dict[str, list[int]] = {}  # places in the stack by element, and of what bounds a paragraph or a stray end tag
        self.marks: list[tuple[int, int, int]] = [(0, 0, HIDDEN)]  # the mark around each mark, its zone, how it is marked
        self.comments: list[int] = []  # places in the stack of zones of reader comments
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.links = 0
        self.zones: list[int] = [0]  # the container around each container
        self.hosts: list[int] = [0]  # the element around it, by number
        self.elements = 0

    def _bad(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def _zone(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def _push(self, tag, *rest):
        for key in (tag, *self._bounds(tag)):
            self.open.setdefault(key, []).append(len(self.stack))
        self.stack.append((tag, *rest))

    @staticmethod
    def _bounds(tag) -> list[str]:
        return ["/section"] * (tag in SECTIONING) + ["/container"] * (tag in ("article", "main", "body"))

    def _cut(self, i: int):
        """Close all elements from a place of the stack on."""
        for tag, *_ in reversed(self.stack[i:]):
            for key in (tag, *self._bounds(tag)):
                self.open[key].pop()
        del self.stack[i:]
        while self.comments and self.comments[-1] >= i:
            self.comments.pop()

    def _last(self, key: str) -> int:
        places = self.open.get(key)
        return places[-1] if places else -1

    def _mark(self) -> int:
        return self.stack[-1][4] if self.stack else 0

    def flush(self):
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append(_Line(text, self.tags, self.linked, self._zone(), self._mark(), self._last("p") > self._last("/section")))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self._close_p()
        elif tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links += 1
        if tag in VOID:
            return
        inside = self.comments or max(self._last(e) for e in ("template", *CONTAINERS)) >= 0
        if tag in CONTAINERS and (self._bad() or self._mark() and self.marks[self._mark()][2] > SUSPECT) and not inside and not self._marked(tag, attrs, 0)[0]:
            i = len(self.stack)
            while i and (self.stack[i - 1][1] or self.stack[i - 1][4]):  # an unclosed menu or banner before the article
                i -= 1
            self._cut(i)
        zone, bad, mark = self._zone(), self._bad(), self._mark()
        if not bad:
            marked, comments = self._marked(tag, attrs, zone)
            if comments:
                self.comments.append(len(self.stack))
            marked = marked or LOOSE * (tag == "form")
            bad = tag in NEVER or (tag == "header" and not zone) or marked == HIDDEN
            if marked and not bad:
                self.marks.append((mark, zone, marked))
                mark = len(self.marks) - 1
            if tag in CONTAINERS and not bad:
                self.zones.append(zone)
                self.hosts.append(self.stack[-1][3] if self.stack else 0)
                zone = len(self.zones) - 1
        self.elements += 1
        self._push(tag, bad, zone, self.elements, mark)

    @staticmethod
    def _marked(tag, attrs, zone) -> tuple[int, bool]:
        """0, or how firmly the element's own attributes mark it as a zone without article text; and whether as one of reader comments."""
        if tag in ("html", "body", "main"):
            return 0, False
        tokens_of, mark, comments = BAD_ARTICLES if tag == "article" else BAD_TOKENS, 0, False
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return HIDDEN, False
                continue
            if name in ("class", "id", "role"):
                for whole in [value.lower()] if name == "id" else value.lower().split():
                    if name == "id" and zone and tag in TITLED:
                        bad = {whole} & BAD_ARTICLES if tag == "section" else set()
                    elif name == "id" and zone:
                        bad = {whole} & tokens_of
                    else:
                        tokens = set(_TOKEN.findall(whole))
                        bad = tokens & tokens_of if tokens <= tokens_of | NEUTRAL else set()
                        if not bad and tokens & SUSPECT_TOKENS and tag in GROUPS:
                            mark = max(mark, SUSPECT)
                            comments |= bool(tokens & COMMENT_TOKENS)
                    if zone:
                        bad -= {"header"}
                    if bad:
                        mark = max(mark, FIRM if bad & FIRM_TOKENS else LOOSE)
                        comments |= bool(bad & COMMENT_TOKENS)
            elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return HIDDEN, False
        return mark, comments

    def _close_p(self):
        i = self._last("p")
        if i > self._last("/section"):
            self._cut(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag == "a" and self.links:
            self.links -= 1
        if tag in VOID:
            return
        i = self._last(tag)
        if i < 0 or i < self._last("/container") and tag not in ("main", "body", "html", "article"):
            return  # a stray end tag closes nothing outside its container
        self._cut(i)

    def handle_data(self, data):
        if not self._bad():
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str) -> _Events:
    try:
        p = _Events()
        p.feed(html)
        p.close()
    except AssertionError:  # a malformed marked section: take its opening as text
        p = _Events()
        p.feed(html.replace("<![", "&lt;!["))
        p.close()
    p.flush()
    return p


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a kernel of three sigmas, normalised at the ends."""
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - r), min(len(values), i + r + 1)
        k = kernel[a - i + r : b - i + r]
        out.append(sum(x * y for x, y in zip(values[a:b], k)) / sum(k))
    return out


def content_lines(lines: list[_Line], sigma: float = 1.0) -> list[bool]:
    """Threshold clustering of the smoothed text-to-tag ratios: a line is content above the midpoint of two one-dimensional means."""
    ratios = smooth([(len(x.text) - x.linked) / (1 + x.tags) for x in lines], sigma)
    low, high = min(ratios), max(ratios)
    for _ in range(20):
        cut = (low + high) / 2
        a, b = [x for x in ratios if x <= cut], [x for x in ratios if x > cut]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    cut = (low + high) / 2
    return [x >= cut for x in ratios]


def unmarked(page: _Events, sigma: float) -> list[_Line]:
    """The lines outside marked elements, or inside such as hold most of the page's content.

    A mark outside the containers stands where a container holds text.
    """
    if len(page.marks) == 1:
        return page.lines
    loose = any(how < FIRM for _, _, how in page.marks[1:])
    stands = [False] + [True] * (len(page.marks) - 1)
    if loose and page.lines:
        content = content_lines(page.lines, sigma)
        total, mass = 0, [0] * len(page.marks)
        contained = any(x.zone and not x.mark for x in page.lines)
        for x, c in zip(page.lines, content):
            if c:
                n = len(x.text) - x.linked
                total += n
                mass[x.mark] += n
        for m in range(len(mass) - 1, 0, -1):  # a mark stands behind the one around it
            mass[page.marks[m][0]] += mass[m] if page.marks[m][0] else 0
        for m, (_, zone, how) in enumerate(page.marks):
            stands[m] = bool(m) and (how >= FIRM or 2 * mass[m] <= total or not zone and contained)
    for m in range(1, len(stands)):
        stands[m] = stands[m] or stands[page.marks[m][0]]
    return [x for x in page.lines if not stands[x.mark]]


def extract(html: str | None, sigma: float = 1.0) -> list[str]:
    """The main text's blocks in page order."""
    page = parse(html) if html else None
    lines = unmarked(page, sigma) if page else []
    if not lines:
        return []
    content = content_lines(lines, sigma)
    outer = [0] * len(page.zones)
    for z in range(1, len(outer)):  # a container stands behind the one around it
        outer[z] = outer[page.zones[z]] or z
    mass: dict[int, int] = {}
    chars: dict[int, int] = {}
    for x, c in zip(lines, content):
        z = outer[x.zone]
        mass[z] = mass.get(z, 0) + (len(x.text) - x.linked if c else 0)
        chars[z] = chars.get(z, 0) + len(x.text)
    zones = [z for z in mass if z]
    if zones:  # the outermost container with the most content text, the first of equals, and the parts beside it, with all their lines
        host = lambda z: page.hosts[z]
        best = max(zones, key=lambda z: (mass[z], chars[z], -z))
        if mass.get(0, 0) <= 2 * mass[best]:  # else the containers are asides of a text that stands in none
            return [x.text for x in lines if x.zone and host(outer[x.zone]) == host(best)]
    # no container: all but the lines of links before and behind the content
    good = [k for k, (x, c) in enumerate(zip(lines, content)) if x.prose or c and x.linked < len(x.text) or 2 * x.linked <= len(x.text)]
    return [x.text for x in lines[good[0] : good[-1] + 1]] if good else []


def extract_main_text(pages: DataFrame, html: str = "html", sigma: float = 1.0) -> DataFrame:
    """Add ``main_text`` (blocks joined by two newlines) and ``main_blocks`` (their number)."""
    names = fresh(pages.columns, "main_text", "main_blocks")

    def make():
        def each(texts, _):
            blocks = [extract(t.decode() if t is not None else None, sigma) for t in texts]
            return [pa.array(["\n\n".join(b) for b in blocks], pa.string()), [len(b) for b in blocks]]

        return each

    return map_text(pages, [(names[0], T.StringType()), (names[1], T.LongType())], html, make)
