"""URL filters with redirect equivalence.

Pages are nodes (host, path and query of their url); canonical links and refresh redirects in the
html are edges. Connected components of that graph are the aliases of one resource. A url's own rule
decides first; a url without a rule takes its component's decision: allow when an alias is explicitly
allowed, else block when an alias is blocked, else allow.

Scale: html is read once in the scan and never shuffled; rules are matched by equality on the host's
suffixes; the component rounds shuffle two keys an edge. Native DataFrame operations only.

Defined results: a url that is null or has no "://" has empty host and path, no node and no aliases;
a link that resolves to no absolute url is no edge; a page repeated in the table gets one row each;
scheme and fragment do not tell nodes apart; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.frames import components, pick, written

#: (host, path, verdict): a rule fits its host and all subdomains, below its path
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_TAG_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "r_host string, r_path string, r_verdict string")


def _rest(url) -> F.Column:
    """What follows the first "://", or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url) -> F.Column:
    """Host, path and query; null without a host."""
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def resolved(link, base) -> F.Column:
    """An absolute url from a link found on the page ``base``."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    return (F.when(link == "", F.lit(None)).when(link.contains("://"), link)
             .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
             .when(link.startswith("/"), F.concat(root, link)))


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of canonical links and refresh redirects."""
    p = pages.where("url is not null and html is not null")
    found = p.select("url", F.explode(F.array(
        F.regexp_extract(F.regexp_extract("html", _TAG_CANONICAL, 0), _HREF, 1),
        F.regexp_extract(F.regexp_extract("html", _TAG_REFRESH, 0), _REFRESH_URL, 1))).alias("link"))
    return found.where("link <> ''").select("url", resolved(F.col("link"), F.col("url")).alias("target")).where("target is not null")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) that a rule fits; the longest wins.
    Of equally long rules allow goes first, then the smaller rule."""
    u = urls.select("host", "path").distinct().where("host <> ''")
    labels = F.split("host", r"\.")
    u = u.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"))
    # the rules join by equality; the planner broadcasts them only below its size threshold
    hit = u.join(rules, "r_host").where(F.startswith("path", F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = F.min(F.struct((-F.length(rule)).alias("n"), F.col("r_verdict").alias("verdict"), rule.alias("rule")))
    return hit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (the smallest node of its
    aliases, or null when it has none)."""
    raw = pick(pages, "page_id", "url", "html")
    url = F.col("url")
    edges = written(links(raw).select("url", "target", node_of(url).alias("a"), node_of(F.col("target")).alias("b"))
                    .where("a is not null and b is not null and a <> b").distinct(), "links")
    parts = components(edges, "aliases")
    # explicit decisions inside components: of their pages' urls and of linked urls without a page
    ends = edges.select(F.col("a").alias("node"), url).union(edges.select(F.col("b"), F.col("target")))
    ends = ends.select("node", host_of(url).alias("host"), path_of(url).alias("path")).distinct()
    said = ends.join(match_rules(ends, rules), ["host", "path"]).join(parts, "node")
    decided = said.groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"))
    alias = parts.join(decided, "component").select("node", "component", "allowed")
    p = raw.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    p = p.join(match_rules(p, rules), ["host", "path"], "left").join(alias, "node", "left")
    method = F.when(F.col("allowed") == 0, "block").otherwise("allow")
    return p.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "component")


def digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    return judge(pages, rules_frame(pages.sparkSession)).drop("component")
