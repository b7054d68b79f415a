"""URL filters that follow redirects and canonical links, in DataFrame functions alone.

A page's own rule decides it. Pages without one are blocked if a resource of
their class is blocked by its rule: a class is a connected component over the
edges that redirects and canonical links make. An explicit allow has precedence:
a page that a rule allows stays allowed in a blocked class, and it takes no one
else out of it. All others are allowed.

Edges come from the pages (``<link rel="canonical">``, ``<meta
http-equiv="refresh">``, outside of comments, scripts and styles) and from a
table of observed redirects. A resource is a URL without its fragment, with
scheme and host in lower case (A-Z); it may be a node without being a page.

Defined results: a null URL and one without ``://`` have empty host and path, no
rule, no edges, and are allowed; null and empty pages have no links; links to
other schemes than http and https are no edges, relative ones are resolved
against the page; tags end at their first ``>``. Of rules that fit, the longest
host and path counts, at a tie between verdicts the allow; rules without host or
path count as empty there, those with another verdict are refused. Repeated
pages are judged each, null ids stay, empty tables give empty results, and
columns beside the named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import smallest_reachable
from .storage import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resource(url: Column) -> Column:
    """The URL without fragment and with scheme and host in lower case; null without ``://``."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(lowered(F.substring_index(url, "://", 1)), F.lit("://"), host(url), rest))


def _named(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that it uses often and that is computed once."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _without_dots(target: Column) -> Column:
    """``.`` and ``..`` taken out of the path of an absolute URL."""
    segments = F.split(F.regexp_extract(target, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/", -1)
    last = F.substring_index(F.regexp_extract(target, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/", -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    end = F.when(last.isin(".", ".."), F.lit("/")).otherwise("")
    clean = F.concat(
        F.regexp_extract(target, r"^[^:]*://[^/?#]*", 0), F.array_join(kept, "/"), end,
        F.regexp_extract(target, r"^[^:]*://[^/?#]*[^?#]*(.*)$", 1),
    )
    return F.when(target.rlike(r"/\.\.?(?:[/?#]|$)"), clean).otherwise(target)


def resolved(base: Column, href: Column) -> Column:
    """What a link means on a page, or null: nothing, a fragment, another scheme, a page without an address."""
    shown = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "&amp;|&#38;", "&")
    target = _named(_named(shown, lambda link: _absolute(base, link)), _without_dots)
    return F.when(F.locate("://", base) > 0, target)


def _absolute(base: Column, link: Column) -> Column:
    site = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    at = path(base)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.rlike(r"^(?:$|#)|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, at, link))
        .otherwise(F.concat(site, F.when(at == "", "/").otherwise(F.regexp_extract(at, r"(?s)^.*/", 0)), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (url, target) for each canonical link and each refresh of a page."""
    seen = F.regexp_replace(F.col("__html"), _HIDDEN, " ")
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("__html")).where(
        F.col("__html").rlike(r"(?i)canonical|http-equiv") & (F.locate("://", F.col("url")) > 0)
    )
    tags = rows.select("url", F.explode(F.regexp_extract_all(seen, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    relations = F.split(F.trim(lowered(_attribute(F.col("tag"), "rel"))), r"\s+")
    refresh = F.trim(lowered(_attribute(F.col("tag"), "http-equiv"))) == "refresh"
    wanted = F.regexp_extract(
        _attribute(F.col("tag"), "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?(.*?)["']?\s*$""", 1
    )
    is_link = lowered(F.substring("tag", 2, 4)) == "link"
    href = F.when(is_link & F.array_contains(relations, "canonical"), _attribute(F.col("tag"), "href")).when(
        ~is_link & refresh, wanted
    )
    return tags.select("url", resolved(F.col("url"), href).alias("target")).where("target IS NOT NULL")


def _rules(rules: DataFrame) -> DataFrame:
    """Rows (host, path, rule, allows), one for each host and path."""
    known = F.assert_true(F.col("verdict").isin("allow", "block"), "a rule allows or blocks")
    rows = rules.select(
        lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce(known.cast("boolean"), F.col("verdict") == "allow").alias("allows"),
    )
    return rows.groupBy("host", "path").agg(F.max("allows").alias("allows")).withColumn("rule", F.concat("host", "path"))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, rule, allows): the longest rule that fits each distinct ``url`` which has one.

    Each URL meets the rules of the hosts that it ends in, then, for each length of a path that such a host has rules of, the
    rule with just that path. All is equality, so a host with very many rules costs a URL no more than it has lengths, and
    Spark broadcasts the rules or not by their size.
    """
    known = written(_rules(rules), "rules")
    deepest = known.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    lengths = known.groupBy("host").agg(F.collect_set(F.length("path")).alias("__sizes"))
    labels = F.split(host(F.col("url")), r"\.")
    ends = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - deepest + 1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    met = urls.where(F.locate("://", F.col("url")) > 0).select("url", F.explode(ends).alias("host")).join(lengths, "host")
    cut = met.select("url", "host", path(F.col("url")).alias("__path"), F.explode("__sizes").alias("__size"))
    cut = cut.where(F.length("__path") >= F.col("__size"))
    asked = cut.select("url", "host", F.substring(F.col("__path"), F.lit(1), F.col("__size")).alias("path"))
    best = F.max_by(F.struct("rule", "allows"), F.struct(F.length("rule"), "allows", "rule"))
    found = asked.join(known, ["host", "path"]).groupBy("url").agg(best.alias("__best"))
    return found.select("url", "__best.rule", "__best.allows")


def judge(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url",
    html_col: str | None = "html"
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each page.

    ``rules`` has (verdict, host, path), ``redirects`` (url, target) with absolute targets. Nothing is gathered: classes are
    found by joins, and rows that meet one table by a resource that very many share are split by Spark's adaptive skew join,
    for which the smaller side is written first.
    """
    listed = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), resource(F.col(url_col)).alias("url"))
    edges = page_links(pages, url_col=url_col, html_col=html_col) if html_col else None
    if redirects is not None:
        told = redirects.select("url", "target")
        edges = told if edges is None else edges.unionByName(told)
    nodes = listed.select("url")
    inherited = None
    if edges is not None:
        ends = edges.select(resource(F.col("url")).alias("u"), resource(F.col("target")).alias("v")).where("u != v")
        ends = written(ends.distinct(), "alias-edges")
        nodes = nodes.unionByName(ends.select(F.explode(F.array("u", "v")).alias("url")))
    own = written(fitting_rules(nodes, rules), "own-rules")
    if edges is not None:
        members = written(smallest_reachable(ends, hubs=True).select(F.col("node").alias("url"), "component"), "alias-members")
        blocked = written(
            members.join(own.where("NOT allows").select("url"), "url").select("component").distinct(), "blocked-classes"
        )
        inherited = members.join(blocked, "component", "left_semi").select("url")
    # a resource is in here if it has a rule or lies in a blocked class
    decided = own.select("url", "rule", "allows")
    if inherited is not None:
        decided = decided.join(inherited.withColumn("__in", F.lit(True)), "url", "full")
    decided = written(decided.select("url", "rule", F.coalesce("allows", F.lit(False)).alias("allows")), "decided")
    return listed.join(decided, "url", "left").select(
        F.col("__id").alias(id_col), host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"), "rule",
        F.when(~F.col("allows"), "block").otherwise("allow").alias("verdict"),
    )
