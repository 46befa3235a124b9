"""Main text of web pages by rules on blocks, in two passes.

First pass: each block is judged by its share of link text, its length and its share of stop words:
content, near content, boilerplate, or too short or too poor in stop words to tell. What the page's
markup says is one more feature: a container named as boilerplate turns a block into boilerplate,
and an article element turns blocks that are long enough into content. Second pass: the ambiguous blocks
inherit the label of the nearest decided neighbour, and near-content blocks stay unless boilerplate
stands on both sides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from playmetrics.llm.quality import STOP_WORDS

# Fixed names of HTML elements and usual class words.
SCRIPTS = frozenset(("script", "style"))
RAW = SCRIPTS | frozenset("noscript template textarea svg math iframe object select canvas".split())
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table figure dialog details "
    "fieldset menu button".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head nav header footer aside form menu dialog button fieldset".split())
CONTENT = frozenset(("article", "main"))
# These may hold the whole page, or a part of an article.
WRAPPERS = frozenset(("form", "fieldset"))
HEADINGS = frozenset(("header",))
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo cookie cookies consent notice gdpr popup modal "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar header footer comment comments reply replies respond "
    "disqus share sharing social related recommended newsletter subscribe signup login pagination pager toolbar widget "
    "skip copyright".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# Blocks that say nothing else.
NOTICES = frozenset(("advertisement", "share this", "share this article"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
# Where an element that never ends is taken to end.
NEXT_BLOCK = re.compile(r"<(?:p|div|h[1-6]|article|main|section|ul|ol|table|footer|header|nav|aside)\b", re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[^\W\d_]+")
STOPS = frozenset(STOP_WORDS)


class Limits(NamedTuple):
    """Bounds of the first pass. Without `names` the density rules decide alone. Where the known stop words
    are fewer than `known` of a page's words, those of up to `tiny` letters that occur in `spread` of its
    blocks stand in for them."""

    link_density: float = 0.4
    short: int = 70
    long: int = 200
    stops_low: float = 0.08
    stops_high: float = 0.15
    known: float = 0.04
    tiny: int = 4
    spread: int = 3
    wrapper: float = 0.5  # a form that holds more of the page's text than this is no form
    names: bool = True


class Block(NamedTuple):
    text: str
    links: int
    section: int
    dropped: bool
    wrapped: bool  # in a form
    vouched: bool


def dropped(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element's name, class, id or role says that it isn't part of the article. Inside an
    article a header holds its title."""
    if tag in DROPPED and tag not in WRAPPERS and not (inside and tag in HEADINGS):
        return True
    for m in NAMED.finditer(attrs) if "=" in attrs else ():
        words = set(re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()))
        if inside:
            words -= HEADINGS
        if not (DROPPED_ROLES if m[1].lower() == "role" else DROPPED_WORDS).isdisjoint(words):
            return tag != "body" and tag != "html"
    return False


class Place(NamedTuple):
    """What holds for the blocks of an open container."""

    tag: str
    dropped: bool
    wrapped: bool
    section: int


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order; white space is one space. Unclosed elements end with their
    container, and a page that stops inside a tag loses only that tag. Scripts and styles go up to their end
    tag or the page's end; other elements whose text isn't shown go up to their end tag or, without
    one, to the next block; self-closed ones are empty."""
    out: list[Block] = []
    open_: list[Place] = []
    often: Counter[str] = Counter()  # open containers by name
    parts: list[str] = []
    lower, endless = html.lower(), set()
    links, in_link, sections = 0, False, 0
    outside = Place("", False, False, 0)

    def close() -> None:
        nonlocal links, in_link
        text = " ".join(unescape("".join(parts)).split())
        if text:
            place = open_[-1] if open_ else outside
            out.append(Block(text, min(links, len(text)), place.section, place.dropped, place.wrapped, place.section > 0))
        parts.clear()
        links, in_link = 0, False

    def hidden(tag: str, at: int) -> int:
        """Where an element without shown text ends that began before `at`."""
        end = -1 if tag in endless else lower.find("</" + tag, at)
        if end >= 0:
            end = lower.find(">", end)
            return end + 1 if end >= 0 else len(html)
        endless.add(tag)  # not looked for again
        if tag in SCRIPTS:
            return len(html)
        following = NEXT_BLOCK.search(html, at)
        return following.start() if following else len(html)

    at = 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            parts.append(html[at : m.start()])
            links += (m.start() - at) * in_link
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m["end"] and (tag in SCRIPTS or not m["attrs"].endswith("/")):
                at = hidden(tag, at)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m["end"]
            continue
        if tag == "br":
            parts.append(" ")
            continue
        close()
        if tag not in CONTAINERS:
            continue
        if m["end"]:
            while often[tag]:
                last = open_.pop().tag
                often[last] -= 1
                if last == tag:
                    break
        elif not m["attrs"].endswith("/"):
            place = open_[-1] if open_ else outside
            section = place.section
            if tag in CONTENT:
                sections += 1
                section = sections
            gone = place.dropped or dropped(tag, m["attrs"], section > 0)
            open_.append(Place(tag, gone, place.wrapped or tag in WRAPPERS, section))
            often[tag] += 1
    if at < len(html):
        parts.append(html[at:])
        links += (len(html) - at) * in_link
    close()
    return out


def stop_words(found: list[Block], limits: Limits) -> frozenset[str]:
    """The stop words a page is judged by: the known ones, or its own if it holds few of those."""
    words = [WORD.findall(b.text.lower()) for b in found if b.links <= limits.link_density * len(b.text)]
    total = sum(map(len, words))
    if not total or sum(w in STOPS for part in words for w in part) >= limits.known * total:
        return STOPS
    spread = Counter(w for part in words for w in set(part) if len(w) <= limits.tiny)
    return frozenset(w for w, n in spread.items() if n >= limits.spread)


def density(block: Block, stops: frozenset[str], limits: Limits) -> str:
    """good, near, bad, or, for what densities can't tell, short and poor."""
    size = len(block.text)
    if block.links > limits.link_density * size or block.text.lower().rstrip(" .:!") in NOTICES:
        return "bad"
    if size < limits.long and not block.vouched and "\N{COPYRIGHT SIGN}" in block.text:
        return "bad"
    if size < limits.short:
        return "short"
    words = WORD.findall(block.text.lower())
    share = sum(w in stops for w in words) / len(words) if words else 0.0
    if share >= limits.stops_high:
        return "good" if size >= limits.long else "near"
    return "near" if share >= limits.stops_low else "poor"


def first_pass(found: list[Block], limits: Limits) -> list[str]:
    """Labels of all blocks: their densities, and what their containers' names add to them."""
    stops = stop_words(found, limits)
    labels = [density(b, stops, limits) for b in found]
    if not limits.names:
        return labels
    shown = [len(b.text) * (k != "bad" and not b.dropped) for b, k in zip(found, labels, strict=True)]
    in_forms = sum(n for n, b in zip(shown, found, strict=True) if b.wrapped)
    forms_go = in_forms <= limits.wrapper * sum(shown)
    for k, b in enumerate(found):
        if b.dropped or b.wrapped and forms_go:
            labels[k] = "bad"
        elif b.vouched and labels[k] in ("near", "poor"):
            labels[k] = "good"
    return labels


def main_text(html: str | None, limits: Limits = Limits()) -> str:  # noqa: B008
    """The article of one page, '' if there is none (or the page is NULL or empty)."""
    found = blocks(html or "")
    if not found:
        return ""
    if not limits.names:
        found = [b._replace(section=0, dropped=False, vouched=False) for b in found]
    first = first_pass(found, limits)
    # Dropped containers inside a section say nothing about its other short blocks.
    where = [-1 if b.dropped else b.section for b in found]
    labels = list(first)
    # Ambiguous and near blocks between two decided ones, by runs: each looks at the first pass only.
    before: dict[int, tuple[str, int]] = {}
    left: list[tuple[str, int] | None] = []
    for k, label in enumerate(first):
        left.append(before.get(where[k]))
        if label in ("good", "bad"):
            before[where[k]] = (label, k)
    after: dict[int, tuple[str, int]] = {}
    for k in range(len(first) - 1, -1, -1):
        label, a, b = first[k], left[k], after.get(where[k])
        if label in ("short", "poor"):
            if a and b:
                labels[k] = a[0] if a[0] == b[0] or k - a[1] < b[1] - k else b[0] if k - a[1] > b[1] - k else "good"
            elif a or b:
                labels[k] = (a or b)[0]
            else:
                labels[k] = "good" if found[k].vouched or "good" not in first else "bad"
        elif label == "near":
            labels[k] = "bad" if a and b and a[0] == b[0] == "bad" else "good"
        if label in ("good", "bad"):
            after[where[k]] = (label, k)
    return " ".join(b.text for b, label in zip(found, labels, strict=True) if label == "good")


def extract(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """page_id, url, text and n_chars of every row of `pages`.

    Row by row: repeated rows, NULL ids and urls stay as they are, a NULL or empty html gives an
    empty text, other columns play no part; the page is used whole, in time that grows with its length.
    Between two neighbours that are equally near, content wins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), limits) for h in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
