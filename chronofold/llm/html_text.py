"""Main text of web pages from the events of the standard library's streaming HTML parser.

The events cut a page into lines, one per block element. A line's text-to-tag ratio is its
characters outside links over its tags. Lines of menus, forms, notices and the like (by element,
role, class or id; a wrapper's class or id does not mark the article in it) have ratio 0 and are
never content. The ratios, in page order, are smoothed with a Gaussian; a threshold between the two
clusters of smoothed values (two means, in one dimension) marks dense lines. Regions are the runs of
lines under one sectioning element; a region is content where dense lines hold at least half of its
text, and then all its lines and those of the regions in it are kept. An outermost article or main
element is judged as a whole, with all in it that is not boilerplate, so tables, sections, short
paragraphs and headings stay; where one is chosen, regions before and after are left out. Where no
such element is dense, the one with most text is taken if dense regions outside have no more; where
nothing is dense, the region with most text.

Null and empty pages, and those without text, give an empty text; pages of any length are parsed
whole; repeated rows are parsed each; broken markup is read as far as the parser goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.arrow import chunks, map_batches

SIGMA = 1.5
RADIUS = 4
KERNEL = np.array([exp(-0.5 * (i / SIGMA) ** 2) for i in range(-RADIUS, RADIUS + 1)])
KERNEL /= KERNEL.sum()
#: Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
NO_TEXT = frozenset("script style noscript template iframe object embed svg math canvas audio video head title".split())
SIDE = frozenset("nav footer aside form button select textarea fieldset menu dialog header".split())
SECTION = frozenset("article main section div body td aside nav header footer".split())
MAIN = frozenset("article main body html".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert "
    "newsletter subscribe subscription signup login sidebar rail widget related recommended share sharing social breadcrumb breadcrumbs menu nav navbar "
    "navigation footer header masthead popup modal overlay comment comments discussion disqus respond replies pagination pager toolbar search skip".split()
)
#: What a name with such a word first says of its element is not what the element is (has-sidebar, no-comments).
PROPERTY = frozenset("has no with without".split())
WORD = re.compile("[A-Za-z]+")


TOP = ("", 0, False, (), False, False)


class Lines(HTMLParser):
    """Lines of a page: (region, text, characters in links, tags, is boilerplate, elements named like it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # element, region, boilerplate, elements named like boilerplate around it, without text, link
        self.stack: list[tuple[str, int, bool, tuple[int, ...], bool, bool]] = []
        self.lines: list[tuple[int, str, int, int, bool, tuple[int, ...]]] = []
        self.regions, self.tags, self.linked, self.parts, self.names, self.body = 1, 0, 0, [], 0, {0}
        self.parent, self.outer, self.named = {0: 0}, {0: 0}, {}  # by region: the one around it, its outermost main element; by that: the named elements around it

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, region, side, named, _, _ = self.stack[-1] if self.stack else TOP
                self.lines.append((region, text, self.linked, self.tags, side, named))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        _, region, side, named, silent, link = self.stack[-1] if self.stack else TOP
        if tag not in INLINE:
            self.flush()
            if tag in SECTION:
                self.parent[self.regions] = 0 if tag == "body" else region
                self.outer[self.regions] = self.outer[region]
                region, self.regions = self.regions, self.regions + 1
                if tag == "body":
                    self.body.add(region)
                elif tag in MAIN and not self.outer[region]:
                    self.outer[region], self.named[region] = region, named
            elif tag == "p" or tag[0] == "h" and tag[1:].isdigit():
                while self.stack and self.stack[-1][0] in INLINE | {"p"}:  # a block ends an open paragraph
                    self.stack.pop()
        if not side and tag not in MAIN:
            side = tag in SIDE or _is_side(attrs)
            if _is_named(attrs):
                self.names += 1
                named = (*named, self.names)
        self.stack.append((tag, region, side, named, silent or tag in NO_TEXT, link or tag == "a"))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.stack:
            *_, silent, link = self.stack[-1]
            if silent:
                return
            if link:
                self.linked += len(data)
        self.parts.append(data)


def _is_side(attrs: list) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if name == "role":
            if value.lower() in SIDE_ROLES:
                return True
        elif name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
    return False


def _is_named(attrs: list) -> bool:
    """Whether the class or id has a word of boilerplate."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.lower().split():
                words = WORD.findall(token)
                if words and words[0] not in PROPERTY and not SIDE_WORDS.isdisjoint(words):
                    return True
    return False


def threshold(values: np.ndarray) -> float:
    """The middle between the two means of the values (starting from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        under, over = values[values < cut], values[values >= cut]
        if not len(under) or not len(over):
            break
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    hard = np.array([x[4] for x in lines])
    if hard.all():
        return ""
    size = np.array([len(x[1]) for x in lines], float)
    plain = np.maximum(size - [x[2] for x in lines], 0)
    ratio = plain / np.maximum([x[3] for x in lines], 1)
    side = hard | _named(parser, plain, hard)
    dense = _dense(ratio, side)
    regions: dict[int, list[float]] = {}
    mains: dict[int, list[float]] = {}
    for (region, *_), n, d, s in zip(lines, plain, dense, side):
        if not s:
            for have in (regions.setdefault(region, [0.0, 0.0]), mains.setdefault(parser.outer[region], [0.0, 0.0])):
                have[0] += n
                have[1] += n * d
    mains.pop(0, None)
    thick = {r for r, (n, d) in regions.items() if n and 2 * d >= n and not parser.outer[r]}
    chosen = {m for m, (n, d) in mains.items() if n and 2 * d >= n}
    if mains and not chosen:
        most = max(mains, key=lambda m: mains[m][0])
        if mains[most][0] >= sum(regions[r][0] for r in thick):
            chosen = {most}
    kept = {r for r in regions if _under(parser, r, thick)}
    if chosen:
        kept = _within(parser, kept, chosen) | {r for r in regions if parser.outer[r] in chosen}
    if not kept:
        kept = {max(regions, key=lambda r: regions[r][0])}
    return "\n".join(x[1] for x, s in zip(lines, side) if x[0] in kept and not s)


def _dense(ratio: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which lines are dense, by clustering of the smoothed ratios; those of ``side`` have ratio 0 and are not."""
    ratio = np.where(side, 0.0, ratio)
    smooth = np.convolve(np.pad(ratio, RADIUS, mode="edge"), KERNEL, mode="valid")
    # a line counts by itself or by its neighbours, a dense paragraph is not thinned by short ones
    level = np.maximum(smooth, np.minimum(ratio, smooth.max()))
    return (level >= threshold(level[~side])) & ~side


def _named(parser: Lines, plain: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Which lines are boilerplate by a class or id around them.

    Where all main elements lie in elements so named, those around the one with most text are
    wrappers. Without main elements the outermost named ones are wrappers where the rest of the page
    has less text than they, in lines of less than half their length."""
    named = [x[5] for x in parser.lines]
    outer = [parser.outer[x[0]] for x in parser.lines]
    sizes: dict[int, float] = {}
    for m, n, h in zip(outer, plain, hard):
        if m and not h:
            sizes[m] = sizes.get(m, 0.0) + n
    if sizes:
        wrappers = set() if any(not parser.named[m] for m in sizes) else set(parser.named[max(sizes, key=lambda m: sizes[m])])
        return np.array([bool(set(n) - wrappers if m else n) for n, m in zip(named, outer)])
    depth = np.array([len(n) for n in named])
    free = ~hard & (depth == 0)
    wrapped = 2 * plain[free].sum() < plain[~hard].sum() and 2 * plain[free].max(initial=0.0) < plain[~hard].max()
    return depth > (depth[~hard & (depth > 0)].min() if wrapped else 0)


def _under(parser: Lines, region: int, chosen: set[int]) -> bool:
    """Whether a region is one of the chosen, or lies in one that is not the whole body."""
    if region in chosen:
        return True
    while region not in parser.body:
        region = parser.parent[region]
        if region in chosen and region not in parser.body:
            return True
    return False


def _within(parser: Lines, kept: set[int], chosen: set[int]) -> set[int]:
    """Where the page marks its main part, other regions that begin before or after it are left out."""
    order = [x[0] for x in parser.lines]
    at = [i for i, r in enumerate(order) if parser.outer[r] in chosen]
    inside = set(order[at[0] : at[-1] + 1])
    return {r for r in kept if r in inside and r >= min(chosen)}


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of each page."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema) + ", text string, n_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, html)):
            texts = [main_text(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return map_batches(pages.select(*keep, html), run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
