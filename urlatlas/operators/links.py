"""Link extraction and link filters (allowed domains, deny pattern, validity)."""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import extract_hrefs
from ..functions.url import let, link_scheme, resolve_url, url_authority, url_parts
from ..functions.validate import denied, validate_url
from ..spec import DENY_PATTERN, LINK_SCHEMES
from .util import with_url_key


def page_links(html: Column, page_url: Column, unique: bool = True,
               base_parts: Column | None = None) -> Column:
    """Absolute links of a page as an array, in page order.

    ``<a>``/``<area>`` hrefs resolved against the page URL; only http, https,
    file and ftp links kept; ``unique`` keeps the first of equal links.
    """
    absolute = F.transform(extract_hrefs(html), lambda h: resolve_url(page_url, h, base_parts))
    kept = F.filter(absolute, lambda u: link_scheme(u).isin(*LINK_SCHEMES))
    return F.array_distinct(kept) if unique else kept


_LINKS_COLUMN: dict = {}


def _page_links_on_stage(unique: bool) -> Column:
    """``page_links`` over the fixed staging columns ``_html``, ``src_url``, ``_bp``.

    Building the expression takes thousands of JVM calls (lambda variables
    get fresh names, so it cannot be keyed by its text); the unresolved
    Column over fixed names is the same for every DataFrame, so it is built
    once per Spark context.
    """
    from pyspark import SparkContext
    key = (SparkContext._active_spark_context.applicationId, unique)
    if key not in _LINKS_COLUMN:
        _LINKS_COLUMN[key] = page_links(F.col("_html"), F.col("src_url"), unique, F.col("_bp"))
    return _LINKS_COLUMN[key]


def extract_links(pages: DataFrame, unique: bool = True, url_col: str = "url",
                  html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """One row per link: ``(page_id, src_url, pos, url)``.

    The distinct step runs per page, inside the row, before the explode, so
    the link rows that reach any later shuffle are already unique per page.
    """
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("src_url"),
                         F.col(html_col).alias("_html"), url_parts(F.col(url_col)).alias("_bp"))
            .select("page_id", "src_url", _page_links_on_stage(unique).alias("_links"))
            # the outer form plus a filter on its output: a plain explode makes
            # Catalyst infer size(links) > 0 below the projection, i.e. extract
            # every page's links twice
            .select("page_id", "src_url", F.posexplode_outer("_links").alias("pos", "url"))
            .where(F.col("pos").isNotNull())
            .withColumn("pos", F.col("pos").cast("int")))


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def allowed_only(df: DataFrame, domains: Optional[Union[Sequence[str], DataFrame]],
                 url_col: str = "url") -> DataFrame:
    """Keep links whose host (lower-cased authority) is an allowed domain or under one.

    ``None`` allows every domain. A list becomes literal predicates; a
    DataFrame ``(domain)`` becomes a semi join on the host's suffixes, which
    Spark broadcasts or shuffles by its size in bytes.
    """
    if domains is None:
        return df
    host = F.lower(url_authority(url_col))
    if not isinstance(domains, DataFrame):
        doms = [d.lower() for d in domains]
        if not doms:
            return df.where(F.lit(False))
        def pred(h):
            cond = h != ""
            anyd = None
            for d in doms:
                c = (h == F.lit(d)) | h.endswith("." + d)
                anyd = c if anyd is None else (anyd | c)
            return cond & anyd
        return df.where(let(host, pred))
    allow = domains.select(F.lower(F.col(domains.columns[0])).alias("_sfx")).distinct()
    # a non-null host key: no inferred isnotnull filter copies the host
    # expression below the projection; '' never matches an allowed suffix
    tagged = df.withColumn("_host", F.coalesce(host, F.lit("")))
    hosts = tagged.select("_host").distinct()
    ok_hosts = (hosts.withColumn("_sfx", F.explode(host_suffixes(F.col("_host"))))
                .join(allow, "_sfx", "left_semi").select("_host").distinct())
    # semi join on the host: each link row is kept at most once
    return tagged.join(ok_hosts, "_host", "left_semi").drop("_host")


def deny_links(df: DataFrame, pattern: str = DENY_PATTERN, url_col: str = "url") -> DataFrame:
    """Drop links matching the deny pattern (case-sensitive)."""
    if not pattern:
        return df
    return df.where(~denied(F.col(url_col), pattern))


def valid_links(df: DataFrame, url_col: str = "url", **kw) -> DataFrame:
    """Keep links that pass validation; adds ``normalized_url`` and ``url_hash``.

    A URL that passes validation always has a canonical form, so no filter
    on the canonical column is needed (such a filter would be pushed below
    the projection and copy the whole expression).
    """
    v = validate_url(F.col(url_col), **kw)
    return with_url_key(df.where(v["is_valid"]), url_col)
