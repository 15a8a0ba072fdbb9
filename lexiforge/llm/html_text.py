"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: a line ends where a block element begins or ends.  For
each line the text-to-tag ratio is the number of its characters outside links over the number of its tags, one at least.
Lines inside elements that are boilerplate by their nature (menus, page headers, footers, sidebars, forms, hidden ones) or
blocks named so have ratio 0; a name on a heading or a paragraph is weak evidence and divides its ratio by ``NAMED``.

The ratios are smoothed with a Gaussian window.  A threshold, found by clustering the logarithms of the smoothed ratios
in two, marks the core lines, unless they owe it to neighbours on one side only.  Lines whose own ratio is not under the
share ``SHARE`` of the threshold, as logarithms, are open as well, which tells short paragraphs from menus.  The region is made of the
article and main elements, if they hold half of the core's text, and else of every container that has an open line for at
least half of its text, so that the shortest lines inside it stay; lines straight in the body stay if they are open.

Defined results: null and empty pages give an empty text; whatever cannot be parsed as markup (unknown marked sections,
unfinished tags) is passed over as a browser would; repeated rows are handled alike; an own column ``text`` is replaced;
other columns pass unused.  A page is worked on whole by one task, in memory of a small multiple of its size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiforge.llm.common import table

#: Elements whose text is never shown or never main text.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option datalist textarea button".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div body td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names, as whole words of class or id, of what is not main text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|submenu|breadcrumbs?|crumbs?|header|masthead|footer|foot|copyright|legal|sidebar|side|aside|widget|related|recommended|recommendations|more-stories|share|sharing|social|follow|"
    r"subscribe|subscription|newsletter|signup|sign-up|login|cookies?|consent|gdpr|notice|notices|banner|alert|popup|modal|overlay|toast|ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|"
    r"comment|comments|commentlist|comment-list|respond|reply|replies|disqus|discussion|pagination|pager|tags|tagcloud|search|searchform|form|toolbar|skip-link|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Blocks of one paragraph, for which a name is weak evidence, and what their ratio is divided by.
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figcaption td th".split())
NAMED = 4
#: In an article these words name its own head.
OWN_HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.IGNORECASE)
#: Elements that a start tag ends, if one of them is open within the nearest block of the given kinds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

SMOOTHING = 1.0
SHARE = 2 / 3


@dataclass
class Line:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    tags: int = 0
    dull: bool = False
    named: bool = False
    path: tuple[int, ...] = ()

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Lines(HTMLParser):
    """Collects the lines of a page from parser events.  Open elements are a stack of (tag, dull, silent, number, named)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.tags: dict[int, str] = {}
        self.links = 0
        self.line = Line()

    def _break(self) -> None:
        if self.line.parts:
            self.lines.append(self.line)
        self.line = Line(path=tuple(n for tag, _, _, n, _ in self.stack if tag in CONTAINERS), dull=bool(self.stack and self.stack[-1][1]), named=bool(self.stack and self.stack[-1][4]))

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata[i : i + 3] == "<![" and self.rawdata[i : i + 9].upper() != "<![CDATA[":
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def unknown_decl(self, data: str) -> None:
        pass

    def _pop(self, at: int) -> None:
        for tag, *_ in self.stack[at:]:
            self.links -= tag == "a"
        del self.stack[at:]

    def _last(self, tags, within=()) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in within:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag not in INLINE
        if tag in CLOSES and (at := self._last(*CLOSES[tag])) >= 0:
            self._pop(at)
        if tag in ENDS_P and (at := self._last({"p"}, CONTAINERS | BOILERPLATE | {"li", "td", "th", "blockquote"})) >= 0:
            self._pop(at)
        if tag not in VOID:
            dull, silent = self.stack[-1][1:3] if self.stack else (False, False)
            named = self.stack[-1][4] if self.stack else False
            if not dull:
                values = {k: v or "" for k, v in attrs}
                known = f"{values.get('class', '')} {values.get('id', '')}"
                inside = self._last({"article", "main"}) >= 0
                by_name = tag not in ("html", "body", "article", "main") and bool(NAMES.search(OWN_HEAD.sub(" ", known) if inside else known))
                dull = (
                    (tag in BOILERPLATE and not (tag == "header" and inside)) or values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true"
                    or bool(re.search(r"display\s*:\s*none", values.get("style", ""), re.IGNORECASE)) or (by_name and tag not in LEAVES and tag not in INLINE)
                )
                named = named or by_name
            number = len(self.tags)
            self.tags[number] = tag
            self.stack.append((tag, dull, silent or tag in SILENT, number, named))
            self.links += tag == "a"
        if block and tag not in SILENT:
            self._break()
        elif self.stack and self.stack[-1][1] != self.line.dull:
            self._break()
        self.line.tags += 1

    def handle_endtag(self, tag: str) -> None:
        at = self._last({tag})
        if at >= 0:
            self._pop(at)
        if (tag not in INLINE and tag not in SILENT) or bool(self.stack and self.stack[-1][1]) != self.line.dull:
            self._break()
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        self.line.parts.append(data)
        if self.links > 0:
            self.line.link_chars += len("".join(data.split()))


def smoothed(x: np.ndarray, side: int = 0, sigma: float = SMOOTHING) -> np.ndarray:
    """``x`` under a Gaussian window of three standard deviations either way, or only back (-1) or ahead (1); weights are
    renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    window[:reach] *= side >= 0  # a convolution turns the window round: its first half weighs what comes after
    window[reach + 1 :] *= side <= 0
    weight = np.convolve(np.ones(len(x)), window)[reach : reach + len(x)]
    return np.convolve(x, window)[reach : reach + len(x)] / weight


def split_in_two(x: np.ndarray) -> float:
    """The threshold between two clusters of the numbers ``x``, by two-means from their ends."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        middle = (low + high) / 2
        below, above = x[x <= middle], x[x > middle]
        if not len(above) or not len(below):
            break
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str) -> str:
    """The main text of a page: its content blocks in page order, joined by one space."""
    page = Lines()
    page.feed(html)
    page.close()
    page._break()
    lines = [(line, text) for line in page.lines if (text := line.text())]
    if not lines:
        return ""
    plain = np.array([max(0, len(text) - text.count(" ") - line.link_chars) for line, text in lines])
    size = np.array([len(text) for _, text in lines])
    tags = np.array([max(1, line.tags) * (NAMED if line.named else 1) for line, _ in lines])
    shown = np.array([not line.dull for line, _ in lines])
    ratio = np.where(shown, plain / tags, 0.0)
    if not ratio.any():
        return ""
    level = np.log1p(smoothed(ratio))
    high = split_in_two(level) if level.max() > level.min() else level.max() - 1
    own = np.log1p(ratio)
    between = np.log1p(np.minimum(smoothed(ratio, -1), smoothed(ratio, 1))) > high
    core = shown & (level > high) & (ratio > 0) & ((own > SHARE * high) | between)
    if not core.any():
        core = shown & (ratio > 0)
    linked = 2 * plain < size - np.array([text.count(" ") for _, text in lines])
    stays = shown & _region(page, [line.path for line, _ in lines], size, shown, core, core | (shown & (own > SHARE * high) & ~linked))
    return " ".join(text for (_, text), stay in zip(lines, stays, strict=True) if stay)


def _region(page: Lines, paths: list[tuple[int, ...]], size: np.ndarray, shown: np.ndarray, core: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Which lines lie in the region that the content is taken from."""
    all_, good, held = {}, {}, {}  # characters of a container's shown, open and core lines
    for path, n, is_shown, is_core, is_open in zip(paths, size.tolist(), shown, core, open_, strict=True):
        for c in path if is_shown else ():
            all_[c] = all_.get(c, 0) + n
            good[c] = good.get(c, 0) + n * bool(is_open)
            held[c] = held.get(c, 0) + n * bool(is_core)
    articles = {c for c in all_ if page.tags[c] in ("article", "main") and 2 * good[c] >= all_[c]}
    if articles:
        inside = np.array([not articles.isdisjoint(path) for path in paths])
        found = size[core & inside].sum()
        if found and (2 * found >= size[core].sum() or any(page.tags[c] == "main" and held[c] for c in articles)):
            return inside

    def stays(path: tuple[int, ...], is_open: bool) -> bool:
        if not path or page.tags[path[-1]] == "body":
            return is_open
        return 2 * good.get(path[-1], 0) >= all_.get(path[-1], 1)

    return core | np.array([stays(path, bool(o)) for path, o in zip(paths, open_, strict=True)])


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, in its place; an own column ``text`` is replaced."""
    names = [c for c in pages.columns if c not in (html, "text")]
    at = pages.columns.index(html)
    others = [pages.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = pa.array([main_text(h or "") for h in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in others), texts], names=[*names, "text"])

    return pages.mapInArrow(run, StructType([*(pages.schema[i] for i in others), StructField("text", StringType())]))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
