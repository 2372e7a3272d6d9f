"""URL filters: rules on host and path, carried over to equivalent addresses.

A rule ``host/path`` fits its host and all subdomains where the path starts with
its own; the longest rule wins, an allow rule among equally long ones. Addresses
that redirect to each other or name one canonical address are equivalent:
connected components over those edges. A block decision reaches every member
that no rule speaks about; an address with an allow rule stays allowed.

Null addresses and addresses without ``://`` have no host, no rule, no
neighbours and are allowed. Repeated rows get the same verdict each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import with_once
from ..shared import written
from .common import ascii_lower, packed
from .graph import components

Rules = Sequence[tuple[str, str]]  # ("allow" or "block", "host/path")

# Fixed values.
RULES: Rules = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Rules = RULES) -> Column:
    """The winning rule as struct (verdict, rule), or null: one expression."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        rule_host, _, rest = rule.partition("/")
        fits = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = fits & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """The node of an address: without scheme and fragment, host in lower case."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, query))


def _tag(html: Column, element: str, attribute: str, value: str) -> Column:
    # a first look for the word keeps the pattern off pages that cannot match
    pattern = rf"(?is)<{element}\b[^>]*\b{attribute}\s*=\s*[\"']?{value}\b[^>]*>"
    return F.when(html.rlike(rf"(?i){value}"), F.regexp_extract(html, pattern, 0))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as found on the page at ``url``."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    return (
        F.when(link == "", None)
        .when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path_of(url), link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def declared_edges(pages: DataFrame) -> DataFrame:
    """``source`` and ``target`` of canonical links and refresh redirects in ``html``."""
    html = F.coalesce("html", F.lit(""))
    canonical = F.regexp_extract(
        _tag(html, "link", "rel", "canonical"), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1
    )
    refresh = F.regexp_extract(
        _tag(html, "meta", "http-equiv", "refresh"), r"(?is)\burl\s*=\s*[\"']?([^\"'>;]+)", 1
    )
    d = packed(pages, url=F.col("url"), links=F.array(canonical, refresh)).where("url is not null")
    d = d.select("url", F.explode("links").alias("link")).where("link <> ''")
    return d.select(F.col("url").alias("source"), _absolute(F.col("link"), F.col("url")).alias("target"))


def verdicts(pages: DataFrame, rules: Rules = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``row`` (the page's row), ``host``, ``path``, ``rule``, ``verdict``, ``by_alias``.

    ``redirects`` (source, target) adds observed redirects to the edges that the
    pages declare.
    """
    edges = declared_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = written(
        edges.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b"))
        .where("a <> b").distinct(),
        "url-edges",
    )
    labels = components(edges, "url-components")
    node = F.concat(F.lit("x://"), F.col("node"))
    blocked = labels.where(rule_of(host_of(node), path_of(node), rules)["verdict"] == "block")
    reached = labels.join(blocked.select("component").distinct(), "component", "left_semi")
    d = packed(pages, url=F.col("url"))
    d = d.select(
        "row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        address(F.col("url")).alias("node"),
    )
    d = with_once(d, "own", rule_of(F.col("host"), F.col("path"), rules))
    d = d.join(reached.select("node", F.lit(True).alias("reached")), "node", "left")
    by_alias = F.col("own").isNull() & F.coalesce("reached", F.lit(False))
    verdict = F.coalesce("own.verdict", F.when(by_alias, F.lit("block")).otherwise(F.lit("allow")))
    return d.select(
        "row", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"),
        by_alias.alias("by_alias"),
    )


def report(pages: DataFrame, rules: Rules = RULES) -> DataFrame:
    slim = pages.select("page_id", "url", "html")
    judged = verdicts(slim, rules)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "by_alias")
