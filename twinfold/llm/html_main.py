"""Main text of web pages as the best-scoring contiguous region of tags and words.

A page is read as a sequence of tags and stretches of words. Words score by the element they stand in, tags by their name;
weights are log-odds of standing inside the main content, counted over labelled pages (those that mark their content with
``article`` or ``main``). Words of unknown places score ``WORD_PRIOR``, tags never score above ``-TAG_COST``. One linear scan
finds the contiguous region with the largest sum, and its blocks are the text.

Elements that are no content by their name or class (``DROPPED_TAGS``, ``DROPPED_NAMES``) score 0 and are left out, wherever they stand, so an
advert inside an article does not cut it. A ``header`` or ``footer`` counts as content only inside an article. Scripts, styles and HTML
comments end where the HTML standard ends them, and so does a head without an end tag; a tag that the page's end cuts off is dropped.

Forms, and elements dropped by a part of their class, id or role, are only hits: they stay if they hold the largest ``article`` or ``main``. Hits around more
than half of the words are scanned once more as content, their own tags at ``-MAX_WEIGHT``; that region is taken where the one without them
scores less than ``WIDE_SHARE`` of it.

Weights come from a bounded sample (``SAMPLE_PAGES`` pages, ``SAMPLE_CHARS`` characters, ``CLASSES`` kinds of token). Extraction is one pass without a shuffle.

Defined results: a null or empty page, or one without a positive region, has the empty text. White space is [\\x20\\x09-\\x0D]. Repeated rows each
give a row. Other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import map_batches
from twinfold.session import stage

SAMPLE_PAGES = 2_000
SAMPLE_CHARS = 32_000_000
CLASSES = 5_000
WORD_PRIOR = 0.5
TAG_PRIOR = -0.5
TAG_COST = 0.01
MAX_WEIGHT = 8.0
WIDE_SHARE = 0.1

#: Elements and names of classes or ids that decide what is no content (fixed values).
RAW_TAGS = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
DROPPED_TAGS = {
    "head", "nav", "aside", "button", "select", "option", "label", "input", "menu", "dialog", "svg", "canvas", "object",
    "audio", "video",
}
DROPPED_OUTSIDE_ARTICLE = {"header", "footer"}
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disqus", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "pagination", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
CONTENT_TAGS = {"article", "main"}
HIT_TAGS = {"form"}
NAMES_IGNORED = {"html", "body"} | CONTENT_TAGS
HEAD_TAGS = {"base", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title"}  # all others end an open head
BLOCK_TAGS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACE_TAGS = {"br", "td", "th", "wbr"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY_BLOCK = {"p"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"']+)))?")
_NAMING = {"class", "id", "role"}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


@dataclass
class Token:
    """A tag (``text`` is None) or a stretch of text, with the kind it is scored by, and what is around it."""

    kind: str
    text: str | None
    words: int
    dropped: bool
    inside: bool
    breaks: bool = False
    spaces: bool = False
    hit: int = -1  # the innermost hit around it, itself included
    content: int = -1  # the innermost article or main around it
    edge: bool = False  # a tag of the hit itself


@dataclass
class _Open:
    name: str
    kind: str
    dropped: bool
    inside: bool
    hit: int = -1
    content: int = -1
    edge: bool = False


@dataclass
class Outline:
    """The hit around each hit (-1 for none), the article or main around each, and the hit around each of those."""

    hits: list[int] = field(default_factory=list)
    contents: list[int] = field(default_factory=list)
    content_hits: list[int] = field(default_factory=list)


def _dropped_by_name(attributes: str) -> bool:
    for found in _ATTRIBUTE.finditer(attributes):
        if found[1].lower() in _NAMING:
            value = found[2] or found[3] or found[4] or ""
            if not DROPPED_NAMES.isdisjoint(re.split(r"[\s_-]+", value.lower())):
                return True
    return False


def _tokens(page: str, outline: Outline) -> Iterator[Token]:
    """Tags and texts in order, ``dropped`` without regard to hits; what holds what is noted in ``outline``."""
    stack: list[_Open] = [_Open("", "", False, False)]
    at, end = 0, len(page)

    def text(start: int, stop: int) -> Iterator[Token]:
        if stop > start:
            value = entities.unescape(page[start:stop])
            if stack[-1].name == "head" and value.strip(" \t\n\x0b\x0c\r"):
                stack.pop()
            words = len(_SPACE.sub(" ", value).split(" ")) - value.startswith(tuple(" \t\n\x0b\x0c\r")) - value.endswith(tuple(" \t\n\x0b\x0c\r"))
            top = stack[-1]
            block = next((o for o in reversed(stack) if o.name in BLOCK_TAGS or not o.name), top)
            yield Token("word@" + block.kind, value, max(words, 0) if value.strip(" \t\n\x0b\x0c\r") else 0, top.dropped, top.inside, hit=top.hit, content=top.content)

    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            yield from text(at, end)
            return
        yield from text(at, found.start())
        at = found.end()
        name = (found[2] or "").lower()
        if not name or (not found[4] and at >= end):
            continue
        top = stack[-1]
        if found[1]:
            if any(o.name == name for o in stack):
                while stack[-1].name != name:
                    stack.pop()
                top = stack.pop()
            own = top.edge and top.name == name
            yield Token("</" + name, None, 0, top.dropped, stack[-1].inside and top.inside, name in BLOCK_TAGS, name in SPACE_TAGS, top.hit, top.content, own)
            continue
        if stack[-1].name == "head" and name not in HEAD_TAGS:
            stack.pop()
            top = stack[-1]
        if name in BLOCK_TAGS:
            while stack[-1].name in CLOSED_BY_BLOCK:
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):  # an open p below inline elements ends too
                if stack[i].name in BLOCK_TAGS:
                    if stack[i].name in CLOSED_BY_BLOCK:
                        del stack[i:]
                    break
            top = stack[-1]
        drop = top.dropped or name in DROPPED_TAGS or (name in DROPPED_OUTSIDE_ARTICLE and not top.inside)
        inside = top.inside or name in CONTENT_TAGS
        hit, content = top.hit, top.content
        edge = not drop and (name in HIT_TAGS or (name not in NAMES_IGNORED and _dropped_by_name(found[3])))
        if edge:
            outline.hits.append(hit)
            hit = len(outline.hits) - 1
        if name in CONTENT_TAGS:
            outline.contents.append(content)
            outline.content_hits.append(hit)
            content = len(outline.contents) - 1
        yield Token("<" + name, None, 0, drop, top.inside, name in BLOCK_TAGS, name in SPACE_TAGS, hit, content, edge)
        if name in RAW_TAGS:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID_TAGS and not found[3].endswith("/"):
            outer = next((o.kind for o in reversed(stack) if o.name in BLOCK_TAGS and o.name not in CONTENT_TAGS), "")
            kind = outer.split("<")[0] if name in CONTENT_TAGS else f"{name}<{outer.split('<')[0]}"
            stack.append(_Open(name, kind, drop, inside, hit, content, edge))


def _held(parents: list[int], own: list[int]) -> list[int]:
    """Sums over each element and all that it holds; an element comes behind the one around it."""
    sums = list(own)
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            sums[parents[i]] += sums[i]
    return sums


def _drop_hits(tokens: list[Token], hits: list[int], stay: set[int]) -> None:
    """Drop what stands in a hit that does not stay."""
    gone: list[bool] = []
    for i, around in enumerate(hits):
        gone.append(i not in stay or (around >= 0 and gone[around]))
    for t in tokens:
        t.dropped = t.dropped or (t.hit >= 0 and gone[t.hit])


def tokenize(page: str, wide: bool = False) -> tuple[list[Token], bool]:
    """Tags and texts of a page in order, and whether it has hits around more than half of the words; with ``wide`` those stay."""
    outline = Outline()
    tokens = list(_tokens(page, outline))
    if not outline.hits:
        return tokens, False
    in_hits, in_contents, total = [0] * len(outline.hits), [0] * len(outline.contents), 0
    for t in tokens:
        if t.words and not t.dropped:
            total += t.words
            if t.hit >= 0:
                in_hits[t.hit] += t.words
            if t.content >= 0:
                in_contents[t.content] += t.words
    stay: set[int] = set()
    held = _held(outline.contents, in_contents)
    if any(held):
        hit = outline.content_hits[held.index(max(held))]
        while hit >= 0:
            stay.add(hit)
            hit = outline.hits[hit]
    most = {i for i, n in enumerate(_held(outline.hits, in_hits)) if 2 * n > total} - stay
    if wide:
        for t in tokens:
            t.edge = t.edge and t.hit in most
    _drop_hits(tokens, outline.hits, stay | most if wide else stay)
    return tokens, bool(most)


@dataclass
class Weights:
    """Log-odds by kind of token; kinds not counted fall back on their element alone, then on the priors."""

    kinds: dict[str, float] = field(default_factory=dict)

    def of(self, token: Token) -> float:
        if token.dropped:
            return 0.0
        weight = self.kinds.get(token.kind)
        if weight is None:
            weight = self.kinds.get(token.kind.split("<")[0]) if token.text is not None else None
        if token.text is not None:
            return token.words * (WORD_PRIOR if weight is None else weight)
        return min(-TAG_COST, TAG_PRIOR if weight is None else weight)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, the first and then the longest of equal ones; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and best > 0.0 and region[0] == start):
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region: blocks with single spaces, joined by two line ends."""
    tokens, wide = tokenize(page or "")
    scores = [weights.of(t) for t in tokens]
    start, end = best_region(scores)
    if wide:
        more, _ = tokenize(page or "", wide=True)
        others = [-MAX_WEIGHT if t.edge and not t.dropped else weights.of(t) for t in more]
        first, last = best_region(others)
        if sum(scores[start:end]) < WIDE_SHARE * sum(others[first:last]):
            tokens, start, end = more, first, last
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        block = _SPACE.sub(" ", "".join(part)).strip(" ")
        if block:
            blocks.append(block)
        part.clear()

    for token in tokens[start:end]:
        if token.breaks:
            flush()
        if token.dropped:
            continue
        if token.text is not None:
            part.append(token.text)
        elif token.spaces:
            part.append(" ")
    flush()
    return "\n\n".join(blocks)


def count_kinds(page: str | None) -> Counter[tuple[str, bool]]:
    """How many tokens of each kind stand inside and outside the marked content; none for a page that marks none."""
    tokens, _ = tokenize(page or "")
    counts: Counter[tuple[str, bool]] = Counter()
    if any(t.inside for t in tokens):
        for t in tokens:
            if not t.dropped:
                n = 1 if t.text is None else t.words
                counts[t.kind, t.inside] += n
                if t.text is not None and "<" in t.kind:
                    counts[t.kind.split("<")[0], t.inside] += n
    return counts


def learnt(counts: dict[tuple[str, bool], int]) -> Weights:
    """Weights from counts: log-odds of a kind inside against outside, words and tags each smoothed by one."""
    weights = Weights()
    for kind in {k for k, _ in counts}:
        inside, outside = counts.get((kind, True), 0), counts.get((kind, False), 0)
        odds = math.log((inside + 1.0) / (outside + 1.0))
        weights.kinds[kind] = max(-MAX_WEIGHT, min(MAX_WEIGHT, odds))
    return weights


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> Weights:
    """Count the kinds of tokens over a bounded sample of the pages."""
    from pyspark.sql import Window as W

    total = pages.count()
    part = pages.select("html") if total <= sample_pages else pages.select("html").sample(min(1.0, 1.2 * sample_pages / total), 3)
    sample = stage(part.limit(sample_pages), "pages")
    room = W.orderBy(F.length("html"), F.xxhash64("html")).rowsBetween(W.unboundedPreceding, W.currentRow)
    bounded = sample.withColumn("_upto", F.sum(F.length("html")).over(room)).where(F.col("_upto") <= sample_chars).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                counts += count_kinds(page)
        if counts:
            rows = [(k, inside, n) for (k, inside), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["kind", "inside", "n"])

    counted = bounded.mapInArrow(count, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "kind", "inside").limit(CLASSES).collect()
    return learnt({(r["kind"], r["inside"]): r["n"] for r in rows})


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    weights = train(pages) if weights is None else weights

    def build(batch: pa.RecordBatch) -> dict:
        texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select("page_id", "url", "html"), build, "text string, n_chars bigint", ["page_id", "url"])
