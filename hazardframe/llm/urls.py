"""URL filters over redirect equivalence.

Rules decide by host and path, the longest that fits. Redirects and canonical links make URLs
aliases of each other: connected components of these edges carry a block to the aliases that no
rule fits, unless some alias is explicitly allowed.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import components, keep

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_URL = r"^(.*?://)([^/?#]*)([^?#]*)(.*)$"
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TAG = r"(?is)<{0}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<{0}\b[^>]*>"
_VALUE = r"(?is)(?<![\w-]){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)^\s*(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?+|[;,]?\s*url\s*=\s*)[\"']?\s*([^\"']+)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
#: Named character references: those of HTML 4 and all that stand for an ASCII character.
_NAMES = {n: chr(c) for n, c in name2codepoint.items()} | {
    n[:-1]: c for n, c in html5.items() if n.endswith(";") and len(c) == 1 and c.isascii()}


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + _URL, group)


def host(url: Column) -> Column:
    return F.translate(_part(url, 2), *_ASCII)


def path(url: Column) -> Column:
    return _part(url, 3)


def node(url: Column) -> Column:
    """The URL without fragment, its host in lower case; null without ://."""
    rest = F.regexp_replace(_part(url, 4), "(?s)#.*$", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.translate(F.concat(_part(url, 1), _part(url, 2)), *_ASCII), _part(url, 3), rest))


def rule(host: Column, path: Column, rules: list[tuple[str, str, str]], give: str) -> Column:
    """The longest fitting rule's name or verdict, null if none fits; of equals the longer host."""
    fits = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits = F.when(here, F.lit(h + p if give == "rule" else verdict)).otherwise(fits)
    return fits


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(_TAG.format(name)), F.lit(0))


def _value(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if it is missing."""
    return F.concat(*[F.regexp_extract(tag, _VALUE.format(name), i) for i in (1, 2, 3)])


def _once(value: Column) -> Column:
    """`value` behind an explode, through which filters and projections do not copy it."""
    return F.explode(F.array(value))


def _decoded(text: Column) -> Column:
    """`text` with its character references replaced; unknown ones stay as they are."""
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,string>")

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#0*([0-9]{1,7});$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(char, F.try_element_at(names, F.regexp_extract(piece, r"^&(\w+);$", 1)), piece)

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#?\w+;|&|[^&]+"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _without_dots(to: Column) -> Column:
    """A path and what follows it, its . and .. segments taken away (RFC 3986, 5.2.4)."""
    whole = F.split(F.regexp_extract(to, "(?s)^([^?#]*)", 1), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.slice(whole, 2, F.size(whole)), F.array(F.lit("")), step)
    ends = F.when(F.element_at(whole, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    clean = F.array_join(F.concat(parts, ends), "/")
    return F.concat(F.when(clean == "", "/").otherwise(clean), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1))


def resolve(own: Column, to: Column) -> Column:
    """The URL that the reference `to` means on the page `own` (RFC 3986, 5.2); null if it names
    none: a scheme without ://, a fragment only, an empty text."""
    scheme, site, way = _part(own, 1), F.concat(_part(own, 1), _part(own, 2)), _part(own, 3)
    folder = F.when(way == "", "/").otherwise(F.regexp_replace(way, r"(?s)[^/]*$", ""))
    return (
        F.when((to == "") | to.startswith("#"), None)
        .when(to.rlike(_SCHEME), F.when(to.rlike(_SCHEME + "//"), to))
        .when(scheme == "", None)
        .when(to.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), to))
        .when(to.startswith("/"), F.concat(site, _without_dots(to)))
        .when(to.startswith("?"), F.concat(site, way, to))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, to))))
    )


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of pages and of all their canonical links and refresh targets, which are
    resolved against the page's base element, if any, or its URL."""
    marked = pages.select(F.col(url).alias("own"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    marked = marked.filter(F.col("html").rlike(r"(?i)canonical|refresh")).filter(F.col("html").rlike(r"(?i)<(link|meta)\b"))
    tagged = marked.select(
        "own", F.get(_tags(F.col("html"), "base"), 0).alias("base"),
        F.explode(F.concat(_tags(F.col("html"), "link"), _tags(F.col("html"), "meta"))).alias("tag"))
    rel = F.split(F.lower(F.trim(_value(F.col("tag"), "rel"))), r"\s+")
    link = F.when(F.array_contains(rel, "canonical"), _value(F.col("tag"), "href"))
    kind = F.lower(F.trim(_value(F.col("tag"), "http-equiv")))
    refresh = F.when(kind == "refresh", _value(F.col("tag"), "content"))
    is_link = F.col("tag").rlike(r"(?i)^<link\b")
    raw = tagged.select("own", "base", is_link.alias("link"), _once(F.when(is_link, link).otherwise(refresh)).alias("raw")).filter("raw <> ''")
    read = raw.select("own", "base", "link", _once(_decoded(F.col("raw"))).alias("value"))
    to = F.when(F.col("link"), F.col("value")).otherwise(F.regexp_extract("value", _REFRESH, 1))
    tidy = F.replace(F.trim(F.regexp_replace(to, r"[\t\r\n]", "")), F.lit(" "), F.lit("%20"))
    seen = F.trim(_value(F.col("base"), "href"))
    told = read.select("own", _once(seen).alias("seen"), "base", "value", "link").select("own", "seen", _once(tidy).alias("to"))
    based = told.select("own", "to", _once(F.coalesce(resolve(F.col("own"), F.col("seen")), F.col("own"))).alias("on"))
    whole = based.select("own", _once(resolve(F.col("on"), F.col("to"))).alias("whole"))
    return whole.select(node(F.col("own")).alias("a"), node(F.col("whole")).alias("b")).filter(
        "a is not null and b is not null and a <> b").distinct()


def judge(
    pages: DataFrame, links: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow",
    url: str = "url", key: str = "page_id",
) -> DataFrame:
    """(key, host, path, rule, verdict) for every row.

    `links` are (a, b) pairs of nodes, with or without a page. A null url or one without :// has
    an empty host and path, no rule and no alias. Repeated rows stay repeated; further columns
    are ignored; empty tables give empty results or leave each URL alone.
    """
    groups = keep(components(links, "aliases"), "aliases")
    ruled = groups.withColumn("verdict", rule(host(F.col("node")), path(F.col("node")), rules, "verdict"))
    fates = ruled.groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    fate = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    fates = keep(fates.select("component", fate.alias("fate")).filter("fate is not null"), "fates")
    told = keep(groups.join(fates, "component").select("node", "fate"), "told")
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("own")).select(
        key, host(F.col("own")).alias("host"), path(F.col("own")).alias("path"), node(F.col("own")).alias("node"))
    own = [rule(F.col("host"), F.col("path"), rules, x) for x in ("rule", "verdict")]
    return rows.join(told, "node", "left").select(
        key, "host", "path", own[0].alias("rule"), F.coalesce(own[1], "fate", F.lit(default)).alias("verdict"))


def oracle(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL of `judge` over pages and their own links."""

    def case(h: str, p: str, give: int) -> str:
        longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
        whens = " ".join(
            f"WHEN ({h} = '{r[1]}' OR ends_with({h}, '.{r[1]}')) AND starts_with({p}, '{r[2]}') THEN '{r[give] if give == 0 else r[1] + r[2]}'"
            for r in longest_first)
        return f"CASE {whens} END"

    def parts(u: str, g: int) -> str:
        return rf"regexp_extract(coalesce({u}, ''), '^(?s)(.*?://)([^/?#]*)([^?#]*)(.*)$', {g})"

    def lower(x: str) -> str:
        return f"translate({x}, '{_ASCII[0]}', '{_ASCII[1]}')"

    def nodes(u: str) -> str:
        return (f"CASE WHEN contains({u}, '://') THEN {lower(parts(u, 1) + ' || ' + parts(u, 2))} || {parts(u, 3)} || "
                f"regexp_replace({parts(u, 4)}, '(?s)#.*$', '') END")

    quote = "''"
    link = rf"""regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["{quote}]?canonical["{quote}]?[^>]*>'), '(?is)\bhref\s*=\s*["{quote}]?([^\s"{quote}>]+)', 1)"""
    refresh = rf"""regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["{quote}]?refresh["{quote}]?[^>]*>'), '(?is)\burl\s*=\s*["{quote}]?([^\s"{quote}>]+)', 1)"""
    return rf"""WITH RECURSIVE targets AS (SELECT url, replace(unnest([{link}, {refresh}]), '&amp;', '&') AS t FROM pages),
whole AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '/') THEN {parts("url", 1)} || {parts("url", 2)} || t END AS t FROM targets WHERE t <> ''),
one AS (SELECT {nodes("url")} AS a, {nodes("t")} AS b FROM whole),
both_ways AS (SELECT a, b FROM one WHERE a <> b UNION SELECT b, a FROM one WHERE a <> b),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
aliases AS (SELECT a, {case(lower(parts("b", 2)), parts("b", 3), 0)} AS v FROM reach),
fates AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS fate FROM aliases GROUP BY a),
judged AS (SELECT page_id, {lower(parts("url", 2))} AS host, {parts("url", 3)} AS path, {nodes("url")} AS node FROM pages)
SELECT page_id, host, path, {case("host", "path", 1)} AS rule, coalesce({case("host", "path", 0)}, fate, 'allow') AS verdict
FROM judged LEFT JOIN fates ON node = a"""
