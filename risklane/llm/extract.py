"""Main text of web pages from streamed parser events and text-to-tag ratios.

The standard library's parser streams a page as events; lines end at block tags. Each line has its text and its number
of tags; their ratio, smoothed by a Gaussian over the neighbouring lines, is split into two clusters by a threshold
(Weninger and Hsu, "Text Extraction from the Web via Text-to-Tag Ratio"). The lines above the threshold choose the
regions: every article element that holds some, a main element whole if it holds some outside its articles, and the innermost
container of those in neither. All lines of the regions are given in page order, short ones too, but for those inside elements
that are no part of an article by their name, role or class, and, where no element names the region, lines below the threshold
that are mostly links.

A class or id only hints: an element that a hint (or a form tag) bars is let in, with the elements around it, if it holds ``MOSTLY``
times the text of all that no bar holds, most of it unlinked and at a ratio of content. What readers wrote is let in only
where the page has nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Elements by their meaning.
SILENT = {"script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "title", "head", "math"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "fieldset", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "nobr"}
REGIONS = {"article", "main", "section", "div", "td", "body"}
# Parts of class and id names, and roles, of what is not the article.
HINTS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
            "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar "
            "navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond share "
            "sharing social related recommended recommendations teaser widget login signup search toolbar pagination "
            "pager skip hidden paywall".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
# Those that may stand at the head of an article as part of it.
HEADS = {"header", "masthead"}
# Those that bar a whole article element: what others wrote, and pointers to other articles.
NOT_ARTICLES = {"comment", "comments", "reply", "replies", "teaser", "related", "promo", "ad", "ads", "advert", "sponsored"}
# Words of what readers wrote; tags that bar no more than a hint does; how much text lifts a bar, and at what ratio of text to tags.
READERS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
SOFT = {"form", "fieldset"}
MOSTLY, DENSE = 4, 20
# Parts of a class name that speak of an element's layout and not of what it holds ("with-sidebar", "hidden-xs").
LAYOUT = re.compile(r"^(?:no|with|has|without|not|show|is)[-_]|^(?:hidden|visible)[-_](?:xs|sm|md|lg|xl|xxl|print|phone|tablet|desktop|mobile)\b")
# Spread of the Gaussian, in lines.
SIGMA = 1.0
# Clusters whose means are nearer than by a factor of two are one: a page of nothing but its article.
APART = float(np.log(2))
UNFINISHED = re.compile(r"<[!?/a-zA-Z]")
PIECES = re.compile(r"[^a-z0-9]+")


class Line:
    __slots__ = ("text", "tags", "bar", "barred", "linked", "place")

    def __init__(self, text: str, tags: int, bar: int, linked: int, place: int) -> None:
        self.text, self.tags, self.bar, self.linked, self.place = text, tags, bar, linked, place
        self.barred = bar >= 0


class Bar(NamedTuple):
    """An element that bars its lines: the bar around it (-1: none), whether a hint alone bars it, and whether readers wrote it."""

    above: int
    soft: bool
    readers: bool


class Reader(HTMLParser):
    """Lines of a page, as the parser streams its events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool, int]] = []      # name, innermost bar (-1: none), silent, container number
        self.open: Counter[str] = Counter()                    # names on the stack
        self.names, self.parents, self.story = ["body"], [-1], [False]     # containers; a parent's number is the smaller one
        self.place = 0                                         # the innermost open container
        self.bars: list[Bar] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.loose = -1         # the bar of a paragraph or list item that is barred by itself; their ends may be missing

    def _bar(self) -> int:
        return self.loose if self.loose >= 0 else self.stack[-1][1] if self.stack else -1

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self._bar(), self.linked, self.place))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _new_bar(self, tag: str, attrs: dict[str, str | None]) -> int:
        """The number of the bar that an element sets up, or that of the one around it."""
        around = self.stack[-1][1] if self.stack else -1
        if tag in ("html", "body", "main"):
            return around
        names = [name for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split() if not LAYOUT.match(name)]
        words = {word for name in names for word in PIECES.split(name)}
        inside = self.story[self.place]
        hinted = words & (NOT_ARTICLES if tag == "article" else HINTS - HEADS if inside else HINTS)
        hard = tag != "article" and (
            tag in ASIDE - SOFT or tag == "header" and not inside or "hidden" in attrs
            or (attrs.get("aria-hidden") or "").lower() == "true" or (attrs.get("role") or "").lower() in ROLES
            or "display:none" in (attrs.get("style") or "").replace(" ", "").lower())
        if not (hard or hinted or tag in SOFT):
            return around
        self.bars.append(Bar(around, not hard, bool(words & READERS)))
        return len(self.bars) - 1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections that are no HTML are skipped up to their end, whatever they hold."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "body":       # whatever stayed open in the head ends here
            while self.stack and self.stack[-1][0] in ("head", "title"):
                self._pop()
        if tag not in INLINE:
            self._end_line()
        if tag not in VOID and tag not in INLINE:
            around = self.stack[-1][1] if self.stack else -1
            bar = self._new_bar(tag, dict(attrs)) if tag in ("p", "li") else -1
            self.loose = bar if bar != around else -1
        if tag in VOID or tag in ("p", "li", "html"):
            return
        if tag == "a":
            self.links += 1
        silent = bool(self.stack) and self.stack[-1][2] or tag in SILENT
        bar, number = self._new_bar(tag, dict(attrs)), -1
        if tag in REGIONS and tag != "body":
            number = len(self.names)
            self.names.append(tag)
            self.parents.append(self.place)
            self.story.append(self.story[self.place] or tag in ("article", "main"))
            self.place = number
        self.stack.append((tag, bar, silent, number))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT or tag in ("a",):
            self.handle_endtag(tag)

    def _pop(self) -> None:
        name, _, _, number = self.stack.pop()
        self.open[name] -= 1
        if number >= 0:
            self.place = self.parents[number]
        if name == "a":
            self.links -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
            self.loose = -1
        self.tags += 1
        if tag in ("p", "li", "html", "body") or not self.open[tag]:
            return
        if tag in INLINE:       # an inline end does not close a block around it
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == tag:
                    if all(entry[0] in INLINE for entry in self.stack[at:]):
                        while len(self.stack) > at:
                            self._pop()
                    return
                if self.stack[at][0] not in INLINE:
                    return
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        if UNFINISHED.match(self.rawdata):      # a tag or comment that the page breaks off in is no text
            self.rawdata = ""
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean of neighbouring values, weights scaled to one at the ends too."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (np.convolve(ratios, kernel, "full") / np.convolve(np.ones(len(ratios)), kernel, "full"))[reach:reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Middle between the means of two clusters (one-dimensional 2-means from the extremes); the least value if they are one."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(below) or not len(above):
            break
        means = float(below.mean()), float(above.mean())
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2 if high - low >= APART else float(values.min())


def lift_bars(lines: list[Line], bars: list[Bar]) -> None:
    """Let in what only hints bar, where it is most of the page."""
    chains: list[list[int] | None] = []         # soft bars from the element outwards; None if one of them is not soft
    for number, bar in enumerate(bars):
        above = chains[bar.above] if bar.above >= 0 else []
        chains.append(None if above is None or not bar.soft else [number, *above][:LIFTED])
    text, tags, linked = ([0] * len(bars) for _ in range(3))
    free = 0
    for line in lines:
        if line.bar < 0:
            free += len(line.text)
        else:
            text[line.bar] += len(line.text)
            tags[line.bar] += max(1, line.tags)
            linked[line.bar] += line.linked
    lifted: set[int] = set()
    for number in sorted(range(len(bars)), key=lambda n: -text[n]):
        chain = chains[number]
        if chain is None or number in lifted or not text[number] or len(chain) == LIFTED:
            continue
        readers = any(bars[n].readers for n in chain if n not in lifted)
        if text[number] >= MOSTLY * free and text[number] >= DENSE * tags[number] and 2 * linked[number] <= text[number] \
                and not (readers and free):
            free += sum(text[n] for n in chain if n not in lifted)
            lifted.update(chain)
    for line in lines:
        # The bars around a lifted one are lifted too.
        line.barred = line.bar >= 0 and line.bar not in lifted


# Bars around each other that may be lifted together.
LIFTED = 64


class Places:
    """The containers of a page. A parent's number is the smaller one, so one pass over the numbers serves any chain of them."""

    def __init__(self, reader: Reader) -> None:
        self.names, self.parents = reader.names, reader.parents

    def outermost(self, wanted: Callable[[int], bool]) -> list[int | None]:
        """For every container, the outermost one around it (itself included) that is wanted."""
        found: list[int | None] = []
        for number, parent in enumerate(self.parents):
            above = found[parent] if parent >= 0 else None
            found.append(above if above is not None else number if wanted(number) else None)
        return found

    def around(self, lines: Iterable[Line]) -> list[int]:
        """How many of the lines each container holds."""
        count = [0] * len(self.parents)
        for line in lines:
            count[line.place] += 1
        for number in range(len(count) - 1, 0, -1):
            count[self.parents[number]] += count[number]
        return count

    def shared(self, lines: list[Line]) -> int:
        """The innermost container of all the lines."""
        return max(number for number, held in enumerate(self.around(lines)) if held == len(lines))

    def widened(self, place: int, own: list[Line]) -> int:
        """The outermost container around a region in which every further line is text and no mere link: a heading or an end beside it."""
        held, linked = self.around(own), self.around(line for line in own if 2 * line.linked > len(line.text))
        while place > 0 and linked[self.parents[place]] == linked[place] and held[self.parents[place]] <= 2 * held[place]:
            place = self.parents[place]
        return place


def main_text(html: str | None) -> str:
    """Text of the article, its blocks joined by line feeds; empty if there is none."""
    reader = Reader()
    reader.feed(html or "")
    lines = reader.finish()
    lift_bars(lines, reader.bars)
    own = [line for line in lines if not line.barred]
    if not own:
        return ""
    ratios = np.array([0.0 if line.barred else len(line.text) / max(1, line.tags) * (1 - min(1.0, line.linked / len(line.text)))
                       for line in lines])
    values = smoothed(np.log1p(ratios))
    cut = threshold(values)
    content = [line for line, value in zip(lines, values) if not line.barred and value >= cut] or own
    # What the neighbours alone lift over the threshold is no content beside an article.
    held = set(content)
    core = [line for line, high in zip(lines, np.log1p(ratios) >= cut) if high and line in held]

    places = Places(reader)
    articles = places.outermost(lambda n: reader.names[n] == "article")
    outside = places.around(line for line in core if articles[line.place] is None)
    named = places.outermost(lambda n: reader.names[n] == "article" or reader.names[n] == "main" and outside[n] > 0)
    stories = {named[line.place] for line in content} - {None}
    if stories:
        with_stories = places.around(line for line in own if named[line.place] in stories)
        apart = places.outermost(lambda n: not with_stories[n])
        groups: dict[int | None, list[Line]] = {}
        for line in core:
            if named[line.place] is None:
                groups.setdefault(apart[line.place], []).append(line)
        alone = set(groups.pop(None, []))
        regions = {places.shared(group) for group in groups.values()}
    else:
        alone, regions = set(), {places.widened(places.shared(content), own)}
    inside = places.outermost(lambda n: n in regions)

    def given(line: Line, value: float) -> bool:
        if line.barred:
            return False
        return named[line.place] in stories or line in alone or \
            inside[line.place] is not None and not (2 * line.linked > len(line.text) and value < cut)

    return "\n".join(line.text for line, value in zip(lines, values) if given(line, value))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``, repeated rows included.

    A null or empty page, and one without text of its own, has an empty text. Broken markup is read as far as the parser can make sense
    of it, and never ends the job; time is in proportion to the page, however deep its elements nest. An empty table gives an
    empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(html) for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": found,
                                "n_chars": [len(text) for text in found]})

    return df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")) \
        .mapInPandas(texts, "page_id bigint, url string, text string, n_chars bigint")
