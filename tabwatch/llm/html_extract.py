"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing,
threshold clustering.

The standard library's parser streams its events into lines: runs of text between
block-level tags, each with its tag count and the containers it stands in. A line's
ratio is text length by tags. The ratios, smoothed along the page by a Gaussian, are
split at a threshold (a share of their deviation); lines above it are content seeds.
The seeds elect the regions: the ``article`` elements that hold some (all of them, so
sibling articles stay together), the ``main`` element where articles hold too little of
its seeds, or else the deepest container that holds all seeds and their headings. All
lines of the regions are the text, blocks joined by an empty line, but for those inside navigation, forms, adverts, notices, comments and
the like, which are known by element, role, class or id and are no seeds either. A
class that names a notice, an advert or a sharing box is enough outside headings; a
class or id with an ordinary word (related, social) is backed by a second one in the
same class, or by a text-to-tag ratio below the seeds'; without, the element stays. Ids
of headings, sections and articles, often made from titles, are not read. An ``article``
or ``main`` ends the forms around it and menus and asides that are never closed.

Defined results: null html, and html without text, give an empty text; line breaks
within a block (``br`` too) are white space; unclosed and stray tags are tolerated;
a heading (h1, h2) in the header of an article belongs to it; repeated rows are
extracted each. Work is per page and in one pass, so a page's memory is its own size.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import field, map_batches, slices, text_strings

SIGMA, RADIUS = 1.0, 3
#: Seeds lie above this share of the deviation of the smoothed ratios.
THRESHOLD = 0.5
#: Share of the seed text of a main element that its articles must hold to be preferred.
MOST = 0.8

# HTML's elements by kind, and words that mark boilerplate in class, id and role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
DROPPED = frozenset("head title script style noscript template nav aside footer form button select option textarea iframe svg canvas object audio video dialog menu label fieldset".split())
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
MARKS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promotion promoted
nav navbar navigation navi menu menubar breadcrumb breadcrumbs pagination pager toolbar
footer foot copyright contentinfo colophon masthead banner sidebar sidebars aside complementary rail
notice notices cookie cookies consent gdpr disclaimer alert popup modal overlay dialog paywall
comment comments commentlist respond disqus reply replies discussion
share sharing social related recommended recommendations teaser trending newsletter subscribe subscription signup login search searchbox form widget tracking hidden skip""".split())
#: Marks that need no backing: as classes, or as ids without other words.
PLAIN = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsored
nav navbar menubar breadcrumb breadcrumbs pagination footer contentinfo colophon masthead sidebar sidebars comment comments commentlist disqus""".split())
#: Marks that need no backing as classes, but for headings.
NAMED = frozenset("""notice notices cookie cookies consent gdpr disclaimer alert popup modal overlay paywall copyright banner
sponsor sponsors promo promotion promoted share sharing newsletter subscribe subscription signup teaser trending widget breadcrumbs pager toolbar""".split())
#: What an article or main element ends, where no end tag follows.
LEFT_OPEN = frozenset("nav aside footer menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
UNREAD = HEADINGS | frozenset("html body main section article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


class Lines(HTMLParser):
    """Collects [text pieces, tags, containers, dropped?, in a header?, heading?] per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, container number (-1: none), 1 dropped | 2 header | 4 marked by an ordinary word | number of that mark << 3
        self.parents: list[int] = []  # of each container
        self.kinds: list[str] = []
        self.around: list[int] = []  # the marked element around each marked one
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.text: list[str] = []
        self.tags, self.flags, self.container, self.heading = 0, 0, -1, False
        self.ended: dict[str, int] = {}  # end tags seen of what may be left open

    def cut(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.tags, self.container, self.flags, self.heading))
            self.text = []
        self.tags = 0

    def settle(self) -> None:
        """Take flags, container and heading from the open elements."""
        top = self.stack[-1] if self.stack else ("", -1, 0)
        self.container, self.flags = top[1], top[2]
        self.heading = any(t in ("h1", "h2") for t, _, _ in self.stack[-4:])

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
            if tag == "body":
                self.close_to(("head",), ())
            if any(t == "p" for t, _, _ in self.stack[-6:]):
                self.close_to(("p",), ("td", "th", "table", "button", "object"))
        if tag in ("article", "main"):
            for k, (t, _, _) in enumerate(self.stack):
                if t == "form" or t in LEFT_OPEN and len(re.findall(f"</{t}", self.rawdata, re.IGNORECASE)) <= self.ended.get(t, 0):
                    del self.stack[k:]
                    self.settle()
                    break
        if tag in CLOSED_BY:
            self.close_to(tuple(CLOSED_BY[tag][0].split()), CLOSED_BY[tag][1])
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append(" ")
            return
        _, container, flags = self.stack[-1] if self.stack else ("", -1, 0)
        if tag in DROPPED:
            flags |= 1
        elif tag == "header":
            flags |= 2
        if attrs:
            found = self.marked(tag, attrs)
            flags |= found & 3
            if found & 4 and (tag in BLOCKS or tag in DROPPED):
                self.around.append(flags >> 3 if flags & 4 else -1)
                flags = flags & 3 | 4 | len(self.around) - 1 << 3
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.kinds) - 1
            for name, value in attrs:
                if name == "role" and value == "main":
                    self.kinds[-1] = "main"
        self.stack.append((tag, container, flags))
        if tag in BLOCKS or tag in DROPPED:
            if tag not in BLOCKS:
                self.cut()
                self.tags = 1
            self.settle()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    @staticmethod
    def marked(tag, attrs) -> int:
        out = 0
        for name, value in attrs:
            value = value or ""
            if name == "id" and tag in UNREAD:
                continue
            if name in ("class", "id"):
                words = [w.lower() for w in WORDS(value)]
                if tag in ("html", "body", "article", "main"):  # pages' and articles' own classes say what they hold, except comments
                    hit, plain = set(), tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "sponsored"}.isdisjoint(words)
                else:
                    hit = MARKS.intersection(words)
                    plain = not PLAIN.isdisjoint(words) and (name == "class" or len(hit) == len(set(words)))
                    plain = plain or name == "class" and tag not in HEADINGS and not NAMED.isdisjoint(words)
                    if "header" in words:
                        out |= 2
                if plain or name == "class" and len(hit) > 1:
                    out |= 1
                elif hit and tag not in HEADINGS:
                    out |= 4
            elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out |= 1
        return out

    def close_to(self, tags: tuple, limits: tuple) -> None:
        """Close the innermost open element of ``tags``, unless one of ``limits`` is inside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self.cut()
                del self.stack[k:]
                self.settle()
                return
            if self.stack[k][0] in limits:
                return

    def handle_endtag(self, tag):
        block = tag in BLOCKS
        if tag in LEFT_OPEN:
            self.ended[tag] = self.ended.get(tag, 0) + 1
        if block:
            self.tags += 1
            self.cut()
        elif tag == "br":
            self.text.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                dropped = tag in DROPPED and not block
                if dropped:
                    self.cut()
                del self.stack[k:]
                if block or dropped:
                    self.settle()
                break
            if not block and self.stack[k][0] in BLOCKS:
                break  # a stray inline end tag closes no block
        if not block:
            self.tags += 1

    def handle_data(self, data):
        self.text.append(data)


def smooth(values: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(values, radius), kernel / kernel.sum(), "valid")


def ratios(lines: list) -> np.ndarray:
    return smooth(np.array([len(x[0]) / max(1, x[1]) if not x[3] else 0.0 for x in lines]))


def backed(page: Lines) -> list:
    """Lines whose marks by ordinary words are settled: dropped if an element's text-to-tag
    ratio, without what is dropped in it anyway, is below that of seeds."""
    if not page.lines:
        return []
    limit = THRESHOLD * float(np.std(ratios(page.lines)))
    size, tags = [0] * len(page.around), [0] * len(page.around)
    for text, n, _, flags, _ in page.lines:
        mark = flags >> 3 if flags & 5 == 4 else -1
        while mark >= 0:
            size[mark] += len(text)
            tags[mark] += n
            mark = page.around[mark]
    low = []
    for k, outer in enumerate(page.around):  # outer ones come first
        low.append(size[k] < limit * max(1, tags[k]) or outer >= 0 and low[outer])
    return [(text, n, box, flags & 3 | (1 if flags & 4 and low[flags >> 3] else 0), heading) for text, n, box, flags, heading in page.lines]


def headed(lines: list, seeds: list) -> list:
    """The seeds and the headings right before them."""
    known, out = {id(x) for x in seeds}, []
    for x in reversed(lines):
        if id(x) in known or out and out[-1] is after and x[4] and not x[3] & 1:
            out.append(x)
        after = x
    return out


def common(boxes: list[int], parents: list[int]) -> int:
    """The deepest container around all of ``boxes``, -1 if there is none."""
    region = boxes[0]
    for box in boxes[1:]:
        while box != region:  # containers are numbered from outside in
            if box > region:
                box = parents[box]
            else:
                region = parents[region]
    return region


def articles(page: Lines, mass: dict[int, int]) -> list[int]:
    """The article or main elements that are the text, from the seed text of each container;
    none if no such element holds seeds."""
    def outer(boxes: list[int]) -> list[int]:
        chosen: list[int] = []
        for b in sorted(boxes):  # outer ones come first
            around = page.parents[b]
            while around >= 0 and around not in chosen:
                around = page.parents[around]
            if around < 0:
                chosen.append(b)
            elif mass[b] == mass[around]:  # of nested ones with equal text, the inner
                chosen[chosen.index(around)] = b
        return chosen

    named = outer([b for b in mass if page.kinds[b] == "article"])
    mains = [b for b in mass if page.kinds[b] == "main"]
    if not mains:
        return named
    best = max(mains, key=lambda b: (mass[b], b))
    own = [b for b in named if common([b, best], page.parents) == best]
    if not own and any(common([b, best], page.parents) == b for b in named):
        return named  # the main element is in an article
    return own if sum(mass[b] for b in own) >= MOST * mass[best] else [best]


def extract(html: str) -> str:
    """The main text of a page, blocks joined by an empty line."""
    page = Lines()
    page.feed(html)
    page.close()
    page.cut()
    if page.around:
        page.lines = backed(page)
    lines = [x for x in page.lines if not x[3] & 1 and (not x[3] & 2 or x[4])]
    if not lines:
        return ""
    ratio = ratios(page.lines)
    limit = THRESHOLD * float(np.std(ratio))
    seeds = [x for x, r in zip(page.lines, ratio.tolist(), strict=True) if not x[3] and r >= limit] or lines
    mass = {}
    for text, _, box, _, _ in seeds:
        while box >= 0:
            mass[box] = mass.get(box, 0) + len(text)
            box = page.parents[box]
    regions = articles(page, mass) or [common([x[2] for x in headed(page.lines, seeds)], page.parents)]
    article = regions[0] >= 0 and page.kinds[regions[0]] in ("article", "main")
    known = dict.fromkeys(regions, True) | {-1: -1 in regions}  # whether a container is in a region

    def inside(box: int) -> bool:
        path = []
        while box not in known:
            path.append(box)
            box = page.parents[box]
        known.update(dict.fromkeys(path, known[box]))
        return known[box]

    return "\n\n".join(x[0] for x in lines if inside(x[2]) and (article or not x[3] & 2))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    fields = [field("page_id", "bigint"), field("url", "string"), field("text", "string")]

    def work():
        def on_batch(batch: pa.RecordBatch):
            html = text_strings(batch, "html")
            for i, j in slices(html):
                yield [batch.column("page_id").slice(i, j - i), batch.column("url").slice(i, j - i), [extract(x) if x else "" for x in html[i:j]]]

        return on_batch

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(base, fields, work).withColumn("n_chars", F.length("text").cast("bigint"))
