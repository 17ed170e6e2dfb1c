"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score one, tags a negative weight learned from
labelled pages: pages with an article or main element say which tags stand inside and outside the
content, and a tag's weight is the log ratio of these rates, in words. It goes by the element's
name, so that pages without a label, whose tags all stand outside of one, have the same. One linear scan finds the
contiguous region of the highest sum. Menus, adverts, forms, comments and the like inside the
region are left out by their elements' names and classes.
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

from hazardframe.llm.common import arrow_map, keep, only

#: Most labelled pages that weights are learned from, chosen by the hash of their key.
LABELLED = 5_000
#: Words that one nat of log ratio weighs; the least a tag costs; the most.
SCALE, LEAST, MOST = 10.0, 0.05, 200.0

# Element names.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "img", "br", "picture", "source",
}
APART = {
    "head", "nav", "aside", "footer", "form", "script", "style", "button", "select", "option", "noscript", "template",
    "svg", "iframe", "object", "canvas", "menu", "dialog", "title", "textarea", "xmp", "noframes", "audio", "video",
}
# Words in class names, ids and roles of what is no content.
HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "sponsor", "sponsored",
    "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "paywall", "signup", "login", "sidebar",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "masthead", "header", "footer",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "share", "sharing",
    "social", "related", "recommended", "recommendations", "widget", "toolbar", "search", "pagination", "pager",
    "contentinfo", "complementary", "skip",
}
KNOWN = {
    *VOID, *INLINE, *APART, "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li",
    "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure",
    "figcaption", "header", "html", "body", "details", "summary", "address", "center", "fieldset",
}

_NEXT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Token:
    """A tag (its weight's name) or a stretch of text; `apart` is text that is no content."""

    tag: str = ""
    block: bool = False
    text: str = ""
    apart: bool = False
    inside: bool = False


@dataclass
class Open:
    name: str
    apart: bool
    content: bool


def hinted(attributes: str) -> bool:
    """Whether a class, id or role names something that is no content."""
    for _, value in _NAMED.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if parts and parts[0] not in ("has", "with", "no", "is") and (parts[0] in HINTS or parts[-1] in HINTS):
                return True
    return False


def tokens(page: str) -> Iterator[Token]:
    """Tags and texts of a page in order; broken markup is read as far as it goes."""
    stack: list[Open] = []
    levels: dict[str, list[int]] = {}  # where elements of a name stand in the stack
    at, end = 0, len(page)

    def close_from(level: int) -> None:
        while len(stack) > level:
            levels[stack.pop().name].pop()

    while at < end:
        m = _NEXT.search(page, at)
        stop = m.start() if m else end
        top = stack[-1] if stack else Open("", False, False)
        if stop > at and (text := page[at:stop]).strip():
            yield Token(text=text, apart=top.apart, inside=top.content)
        if stop > at and page[at:stop].isspace():
            yield Token(text=" ", apart=top.apart, inside=top.content)
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        known = name if name in KNOWN else "other"
        if closing:
            places = levels.get(name)
            if name in ("br", "p") and not places:
                yield Token(tag=_weight_name(top, known), block=name not in INLINE, inside=top.content, apart=top.apart)
                continue
            if not places:
                continue
            own = stack[places[-1]]
            close_from(places[-1])
            yield Token(tag=_weight_name(own, known), block=name not in INLINE, inside=own.content, apart=own.apart)
            continue
        content = top.content or (name in ("article", "main") or 'role="main"' in attributes) and not top.apart
        plain = name in ("html", "body", "main", "article")
        apart = top.apart or name in APART or name == "header" and not content or not plain and (
            bool(attributes) and (hinted(attributes) or bool(_HIDDEN.search(attributes))))
        own = Open(name, apart, content)
        yield Token(tag=_weight_name(own, known), block=name not in INLINE, inside=content and not apart, apart=apart)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name == "p" and stack and stack[-1].name == "p":
                close_from(len(stack) - 1)
            levels.setdefault(name, []).append(len(stack))
            stack.append(own)


def _weight_name(own: Open, known: str) -> str:
    """Where a tag stands and its name; what is apart inside the content doesn't end it."""
    place = ("inner" if own.content else "apart") if own.apart else "content" if own.content else "page"
    return place + ">" + known


@dataclass
class Weights:
    """Cost of a tag by place and name, in words."""

    of: dict[str, float] = field(default_factory=dict)

    def cost(self, tag: str) -> float:
        if tag in self.of:
            return self.of[tag]
        return 20.0 if tag.startswith("apart") else 0.5 if tag.startswith("page") else LEAST


def region(found: list[Token], weights: Weights) -> tuple[int, int]:
    """The contiguous run of tokens of the highest score, the first of equals; (0, 0) if none."""
    best, at_best = 0.0, (0, 0)
    score, start = 0.0, 0
    for i, t in enumerate(found):
        if t.tag:
            score -= weights.cost(t.tag)
        elif not t.apart:
            score += len(t.text.split())
        if score <= 0:
            score, start = 0.0, i + 1
        elif score > best:
            best, at_best = score, (start, i + 1)
    return at_best


def main_text(page: str | None, weights: Weights) -> str:
    found = list(tokens(page or ""))
    begin, end = region(found, weights)
    blocks: list[list[str]] = [[]]
    for t in found[begin:end]:
        if t.tag:
            if t.block:
                blocks.append([])
            elif t.tag.endswith(">br"):
                blocks[-1].append(" ")
        elif not t.apart:
            blocks[-1].append(t.text)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, labelled: int = LABELLED, html: str = "html", key: str = "page_id") -> Weights:
    """Weights from at most `labelled` pages that mark their content with an article or main
    element; without any, tags have fixed costs. What reaches the driver is a row per tag kind."""
    marked = pages.select(F.col(key).alias("k"), F.col(html).alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    chosen = marked.filter("k is not null").select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(labelled)
    sample = marked.join(F.broadcast(keep(chosen, "labelled")), "k").select("html")  # at most `labelled` keys

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                for t in tokens(page.as_py()):
                    if t.tag and not t.tag.startswith("inner"):
                        (inside if t.inside else outside)[t.tag] += 1
        names = sorted(inside | outside)
        yield pa.RecordBatch.from_pydict(
            {"tag": pa.array(names, pa.string()), "i": pa.array([inside[n] for n in names], pa.int64()),
             "o": pa.array([outside[n] for n in names], pa.int64())})

    rows = arrow_map(sample, of, "tag string, i long, o long").groupBy("tag").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect()
    if not any(r.i for r in rows):
        return Weights()
    n_in, n_out = sum(r.i for r in rows) + len(rows), sum(r.o for r in rows) + len(rows)
    inside, outside = Counter(), Counter()
    for r in rows:
        for tag in _sharing(r.tag):
            inside[tag] += r.i
            outside[tag] += r.o
    ratio = {t: math.log((inside[t] + 1) / n_in) - math.log((outside[t] + 1) / n_out) for t in inside}
    return Weights({t: min(MOST, max(LEAST, -SCALE * x)) for t, x in ratio.items()})


def _sharing(tag: str) -> list[str]:
    """The tags that have one weight with `tag`: inside and outside of a label; what is apart has its own."""
    place, name = tag.split(">", 1)
    return [tag] if place == "apart" else ["content>" + name, "page>" + name]


def extract(pages: DataFrame, weights: Weights, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, url, text, n_chars) for every row. A null, empty or contentless page has the empty
    text; repeated rows stay repeated; further columns are ignored."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[key, "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return arrow_map(only(pages, key, "url", html), of, f"`{key}` {kind}, url string, text string, n_chars long")
