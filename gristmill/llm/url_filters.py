"""URL filters with redirect equivalence, in DataFrame functions only.

A rule names a host and a path; it fits that host and its subdomains where the URL's path starts with the rule's, and the
longest rule wins (of equally long ones allow before block, then the least by name). Pages that canonical links, meta refreshes or given redirects
join are aliases of each other: they are components of the graph of those links. A page that no rule fits is blocked if
a rule blocks one of its aliases and none explicitly allows one of them.

Defined results: a null URL or one without '://' has empty host and path and no aliases, and is allowed; null html
has no links; links that can't be resolved are none; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialise, salted_join
from gristmill.llm.components import components

#: Rules that are tried in an expression beside the row; more rules are joined on hosts instead, and choose the same rule.
MAX_INLINE = 200
#: A tag ends at the first '>' outside a quoted value; group 1 of an attribute is its name, group 2 the value as it stands.
_TAG = r"""(?i)<(?:link|meta)\b(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_ATTRIBUTE = r"""([^\s"'<>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def without_dots(path: Column) -> Column:
    """path with its segments '.' and '..' resolved, as RFC 3986 does."""
    parts = F.split(path, "/")
    dots = (F.element_at(parts, -1) == ".") | (F.element_at(parts, -1) == "..")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)),
    )
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.when(dots, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))).otherwise(path)


def with_parts(rows: DataFrame, url: str) -> DataFrame:
    """rows and host, path and node of a URL column, and after, the path and query; null or without '://': empty.

    A node tells one page from another: host, path without dot segments and query do, scheme and fragment don't.
    """
    at = F.instr(url, "://")
    rows = rows.withColumn("__rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))))
    rows = rows.withColumn("host", F.coalesce(F.translate(F.regexp_extract("__rest", r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))).withColumn("after", F.coalesce(F.regexp_extract("__rest", r"^[^/?#]*([^#]*)", 1), F.lit("")))
    return rows.withColumn("path", F.regexp_extract("after", r"^[^?]*", 0)).withColumn("node", F.when(F.col("host") != "", F.concat("host", without_dots(F.col("path")), F.regexp_extract("after", r"(?s)\?.*", 0)))).drop("__rest")


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(_ordered(rules)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_rule(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows (with host and path) and a column fit, as fitting_rule() gives it."""
    if len(rules) <= MAX_INLINE:
        return rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "r_host string, r_path string, rule string, verdict string")
    urls = rows.filter("host <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    fits = urls.select("host", "path", F.explode(suffixes).alias("r_host")).join(table, "r_host").filter(F.startswith("path", "r_path"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "allow").alias("a"), "rule", "verdict")).alias("best"))
    fit = best.select(F.concat("host", F.lit("\n"), "path").alias("__url"), F.struct("best.rule", "best.verdict").alias("fit"))  # a host ends before any line end
    keyed = rows.withColumn("__url", F.when(F.col("host") != "", F.concat("host", F.lit("\n"), "path")))
    return salted_join(keyed, fit, "__url", "left", F.struct(*rows.columns)).drop("__url")


def unquoted(value: Column) -> Column:
    """An attribute's value without the quotes around it."""
    return F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")


def unescaped(value: Column) -> Column:
    """value with the characters that references name, by number or as one of XML's five; other references stay as they are."""

    def character(token: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(token, "^&#([0-9]{1,7});$", 1), F.lit("")), 10, 10), F.conv(F.nullif(F.regexp_extract(token, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1), F.lit("")), 16, 10)).cast("long")
        out = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(token)
        for name, sign in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            out = F.when(token == f"&{name};", sign).otherwise(out)
        return out

    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)&#?[0-9A-Za-z]+;|&|[^&]+"), F.lit(0)), character), "")).otherwise(value)


def refresh_target(content: Column) -> Column:
    """The URL of a refresh's content: what follows the time and 'url=', up to the end or, if a quote opens it, to that quote."""
    url = F.regexp_extract(content, r"(?is)^\s*(?:[\d.]+[;,\s]+|[^\"']*?(?=\burl\s*=))(?:url\s*=\s*)?(.*?)\s*$", 1)
    return F.regexp_replace(url, r"(?s)^([\"'])(.*?)(?:\1.*)?$", "$2")


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that canonical links and meta refreshes join, all of a page; b is null for a link that can't be resolved."""
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    found = pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", F.explode(tags).alias("tag"))
    found = found.select("url", F.lower(F.substring("tag", 2, 4)).alias("kind"), F.transform(F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"), F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(2)).alias("held"))

    def value(name: str) -> Column:
        return unescaped(unquoted(F.get("held", F.array_position("names", name).cast("int") - 1)))

    canonical = F.when((F.col("kind") == "link") & F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical"), value("href"))
    refresh = F.when((F.col("kind") == "meta") & (F.lower(F.btrim(value("http-equiv"))) == "refresh"), refresh_target(value("content")))
    link = F.regexp_replace(F.regexp_replace(F.coalesce(canonical, refresh), r"^\s+|\s+$", ""), r"[\t\n\r]", "")
    found = found.select("url", link.alias("link")).filter("link <> ''")
    found = materialise(found, "found")
    found = with_parts(found, "url").filter("node is not null").withColumn("scheme", F.regexp_extract("url", r"^[^:/?#]*", 0))
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^.*/", 0), F.lit("")), F.lit("/"))
    target = (
        F.when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("link"))
        .when(F.startswith("link", F.lit("//")), F.concat("scheme", F.lit(":"), "link"))
        .when(F.startswith("link", F.lit("/")), F.concat("scheme", F.lit("://"), "host", "link"))
        .when(F.startswith("link", F.lit("?")), F.concat(F.lit("://"), "host", "path", "link"))
        .when(~F.col("link").rlike(r"^#|^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.lit("://"), "host", folder, "link"))
    )
    ends = with_parts(found.select(F.col("node").alias("a"), target.alias("target")), "target")
    return ends.select("a", F.col("node").alias("b"))


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. redirects: (source, target) URLs, if a crawl kept them."""
    links = page_links(pages)
    if redirects is not None:
        given = with_parts(with_parts(redirects.select("source", "target"), "source").select(F.col("node").alias("a"), "target"), "target")
        links = links.unionByName(given.select("a", F.col("node").alias("b")))
    classes = components(materialise(links, "ends"))
    judged = with_rule(with_parts(classes.select("root", F.concat(F.lit("://"), "node").alias("url")), "url"), rules)
    blocked = judged.groupBy("root").agg(F.max(F.expr("fit.verdict = 'block'")).alias("block"), F.max(F.expr("fit.verdict = 'allow'")).alias("allow")).filter("block and not coalesce(allow, false)")
    aliases = salted_join(classes, blocked.select("root"), "root", "left_semi", F.col("node")).select("node", F.lit("block").alias("by_alias"))
    rows = with_rule(with_parts(pages.select("page_id", "url"), "url").select("page_id", "host", "path", "node"), rules)
    out = salted_join(rows, aliases, "node", "left", F.col("page_id"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "by_alias", F.lit("allow")).alias("verdict"))
