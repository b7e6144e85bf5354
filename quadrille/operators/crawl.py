"""A crawl over stored pages: a frontier that grows by links, and can be taken up again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.text import canonical_url, links, url_year
from quadrille.plans.lineage import cut, discard


@dataclass(frozen=True)
class Bounds:
    """Where a crawl goes: on hosts of its seeds, below a path prefix, to a depth, and to pages whose path names no year before min_year."""

    depth: int = 2
    prefix: str = ""
    min_year: int | None = None
    same_host: bool = True


def _host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-z]+://([^/?#]*)", 1)


def frontier(pages: DataFrame, seeds: DataFrame, bounds: Bounds = Bounds(), state: DataFrame | None = None) -> DataFrame:
    """(url, depth, is_pdf): every URL that is reached from the seeds (url), at its least depth.

    pages (url, html) is what is stored; a URL without a page is reached but leads
    nowhere. state: the rows of an earlier crawl, from which this one goes on: its
    URLs keep their depth, and all of them are looked at again in case pages were
    added. Equal URLs are those of equal canonical form.
    """
    start = seeds.select(canonical_url(F.col("url")).alias("url")).where("url is not null").distinct()
    hosts = start.select(_host(F.col("url")).alias("host")).distinct()
    found = cut(links(pages.select(canonical_url(F.col("url")).alias("url"), "html")), "links")
    year = url_year(F.col("link"))
    good = F.regexp_replace("link", r"^[a-z]+://[^/]*", "").startswith(bounds.prefix) & (F.lit(True) if bounds.min_year is None else year.isNull() | (year >= bounds.min_year))
    edges = found.where(good).select(F.col("page_url").alias("url"), "link")
    if bounds.same_host:
        edges = edges.join(hosts, _host(F.col("link")) == F.col("host"), "left_semi")
    edges = cut(edges, "links")
    first = start.select("url", F.lit(0).alias("depth"))
    seen = cut((first if state is None else first.union(state.select("url", "depth"))).groupBy("url").agg(F.min("depth").alias("depth")), "crawl")
    for depth in range(bounds.depth):
        step = edges.join(seen.where(F.col("depth") == depth), "url").select(F.col("link").alias("url"), F.lit(depth + 1).alias("depth"))
        before, seen = seen, cut(seen.union(step).groupBy("url").agg(F.min("depth").alias("depth")), "crawl")
        discard(before)
    return seen.withColumn("is_pdf", F.regexp_replace("url", r"[?#].*$", "").rlike(r"(?i)\.pdf$"))
