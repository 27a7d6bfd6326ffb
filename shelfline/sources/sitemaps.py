"""Sitemap documents and sitemap indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import strip

_LOCS = "array<struct<loc:string>>"


def _parsed(xml: Column) -> Column:
    """struct(root, url, sitemap); malformed XML has neither entries nor children."""
    root = F.regexp_extract(xml, "<(urlset|sitemapindex)[\\s>]", 1)
    body = F.from_xml(xml, f"url {_LOCS}, sitemap {_LOCS}", {"mode": "PERMISSIVE"})
    return F.struct(root.alias("root"), body["url"].alias("url"), body["sitemap"].alias("sitemap"))


def _locs(parsed: Column, root: str, kind: str) -> Column:
    entries = F.filter(parsed[kind], lambda e: e["loc"].isNotNull())
    return F.when(parsed["root"] == root, F.transform(entries, lambda e: strip(e["loc"])))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """(loc, url) for every entry of every ``urlset`` document; duplicates stay."""
    parsed = docs.select("loc", _parsed(F.col("xml")).alias("_p"))
    return parsed.select("loc", F.explode(_locs(F.col("_p"), "urlset", "url")).alias("url"))


def sitemap_children(docs: DataFrame) -> DataFrame:
    """(index_loc, loc) for every child named by a sitemap index."""
    parsed = docs.select("loc", _parsed(F.col("xml")).alias("_p"))
    return parsed.select(
        F.col("loc").alias("index_loc"),
        F.explode(_locs(F.col("_p"), "sitemapindex", "sitemap")).alias("loc"),
    )


def resolve_sitemap(entry: DataFrame, stored: DataFrame) -> DataFrame:
    """URLs reachable from entry documents, as (loc, url); ``loc`` is the document listing them.

    An index leads to its stored children, anything else is read as a plain sitemap. A child that
    is not stored, or that is malformed, is kept as one row with a NULL URL.
    """
    children = sitemap_children(entry)
    plain = sitemap_urls(entry.join(children.select(F.col("index_loc").alias("loc")), "loc", "left_anti"))
    listed = children.select("loc").join(
        stored.select("loc", "xml"), "loc", "left"
    )
    parsed = listed.select("loc", _parsed(F.col("xml")).alias("_p"))
    below = parsed.select("loc", F.explode_outer(_locs(F.col("_p"), "urlset", "url")).alias("url"))
    return plain.unionByName(below)
