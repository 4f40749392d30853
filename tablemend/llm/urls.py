"""URL filters by host and path rules, carried over to aliases along redirects and canonical links.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import stored
from tablemend.llm.graph import connected_components
from tablemend.operators.joins import join_per_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The fitting rule as struct(name, verdict), or null: the longest; of two as long the allowing, then the first."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), rules[i].verdict != "allow", i))
    fits = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in [rules[i] for i in reversed(order)]:
        own = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        fits = F.when(own, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
    return fits


def with_node(df: DataFrame, url: str, node: str) -> DataFrame:
    """``df`` with what aliases are told apart by: host, path (at least ``/``) and query; null for what is no absolute url.

    In steps of their own, so that no expression is repeated within another.
    """
    df = df.withColumns({"_host": host_of(F.col(url)), "_rest": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)})
    slash = F.when(F.startswith("_rest", F.lit("/")), "").otherwise("/")
    return df.withColumn(node, F.when(F.col("_host") != "", F.concat(F.lit("x://"), "_host", slash, "_rest"))).drop("_host", "_rest")


def with_resolved(df: DataFrame, target: str, base: str) -> DataFrame:
    """``df`` with ``target`` made the node of that link seen from the node ``base``; null for what leads nowhere else."""
    df = df.withColumn("_t", F.trim(F.regexp_replace(target, "&amp;", "&")))
    link = F.col("_t")
    absolute = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.regexp_extract(base, r"^(x://[^/]*)", 1), link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, r"(?s)^(x://[^?]*)", 1), link))
        .when(link.rlike(r"^(#|$|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
        .otherwise(F.concat(F.regexp_extract(base, r"(?s)^(x://[^?]*/)", 1), link))
    )
    return with_node(df.withColumn("_absolute", absolute), "_absolute", target).drop("_t", "_absolute")


def page_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target) of canonical links and of redirects by a refresh, from the pages' markup: a node, and a link seen from it.

    A ``rel`` may hold more words. What stands in comments, scripts, styles and templates links nothing.
    """
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>", " ")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = with_node(pages.where(F.col(html).rlike("(?i)canonical|refresh")), url, "source")
    found = found.select("source", F.explode(tags).alias("tag"))
    canonical = F.col("tag").rlike(
        r"""(?is)^<link\b.*[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|'(?:[^']*\s)?canonical[\s']|canonical[\s/>])"""
    )
    refresh = F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""")
    target = F.when(canonical, F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)).when(
        refresh, F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    )
    return found.select("source", target.alias("target")).where("target IS NOT NULL")


def judge(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    The verdict is that of the fitting rule. Without one, it is ``block`` if a rule blocks any url that the page's
    url is equivalent to, else ``allow``: redirects (source, target urls) and canonical or refresh links of the pages join urls
    into classes, also through urls that are no page themselves. So a block reaches all aliases except those that
    a rule allows explicitly. A null url, or one without ``://``, has an empty host and path and no aliases. Null
    markup has no links. Repeated rows are all judged. Other columns are ignored, whatever their names.
    """
    seen = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"))
    seen = seen.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    seen = with_node(seen, "_url", "node")
    seen = seen.select(F.col("_id").alias(id), "node", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("fit"))
    links = None
    if html is not None:
        links = page_links(pages.select(F.col(url).alias("_url"), F.col(html).alias("_html")), "_url", "_html")
    if redirects is not None:
        moved = with_node(redirects.select(F.col("source").alias("_from"), "target"), "_from", "source").select("source", "target")
        links = moved if links is None else links.unionByName(moved)
    blocked = F.lit(None).cast("boolean")
    if links is not None:
        # Stored before and after links are resolved, or the planner would repeat their expressions within each other.
        links = stored(with_resolved(stored(links, "links-seen"), "target", "source"), "links-resolved")
        classes = connected_components(links.where("source IS NOT NULL AND target IS NOT NULL"), "source", "target")
        # Members are judged by rule wherever they are; a class is blocked if one of them is.
        members = classes.withColumns({"_host": host_of(F.col("node")), "_path": path_of(F.col("node"))})
        bad = members.where(rule_of(F.col("_host"), F.col("_path"), rules)["verdict"] == "block")
        bad = bad.select("component").distinct().withColumn("blocked", F.lit(True))
        seen = join_per_key(seen, join_per_key(classes, bad, ["component"], "inner").select("node", "blocked"), ["node"])
        blocked = F.col("blocked")
    return seen.select(
        id, "host", "path", F.col("fit.name").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"),
    )
