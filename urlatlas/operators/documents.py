"""Page and failure records as URL documents; keyword tags; record checks."""

from __future__ import annotations

from typing import Optional, Sequence, Tuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import body_text, content_type, find_keywords, page_bytes, page_description, page_title
from ..functions.url import normalize_url, url_authority, url_hash
from ..schemas import METADATA, URL_DOCUMENT
from .util import with_distinct_url_key

def _no_headers() -> Column:
    return F.lit(None).cast(METADATA["headers"].dataType)


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(now, Column):
        return now.cast("timestamp_ntz")
    return F.lit(str(now)).cast("timestamp_ntz")


def _opt(df: DataFrame, name: Optional[str], default: Column) -> Column:
    return F.col(name) if name and name in df.columns else default


def ok_pages(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Keep pages with a 2xx status; a table without statuses passes whole."""
    if status_col not in df.columns:
        return df
    s = F.col(status_col)
    return df.where(s.isNull() | s.between(200, 299))


def page_documents(pages: DataFrame, keywords: Sequence[str] = (), now=None,
                   url_col: str = "url", html_col: str = "html", depth_col: str = "depth",
                   source_col: str = "source_url", status_col: str = "status",
                   headers_col: str = "headers", hash_algo: str = "sha256") -> DataFrame:
    """One URL document per fetched page (``URL_DOCUMENT`` schema).

    Title, description, keyword tags (body text, only when keywords are
    given), size in bytes, content type from the headers, canonical URL and
    its hash, raw authority as ``domain``; missing optional inputs default
    (depth 0, no referrer, no status, no headers).
    """
    ts = _now(now)
    html = F.col(html_col)
    kws = find_keywords(body_text(html), list(keywords)) if keywords else F.array().cast("array<string>")
    headers = _opt(pages, headers_col, _no_headers())
    staged = pages.withColumn("_n", normalize_url(F.col(url_col)))
    return staged.select(
        F.col(url_col).alias("url"),
        url_hash(F.col("_n"), hash_algo).alias("url_hash"),
        F.col("_n").alias("normalized_url"),
        url_authority(F.col(url_col)).alias("domain"),
        _opt(pages, source_col, F.lit(None).cast("string")).alias("source_url"),
        _opt(pages, depth_col, F.lit(0)).cast("int").alias("depth"),
        kws.alias("keywords"),
        page_title(html).alias("title"),
        page_description(html).alias("description"),
        _opt(pages, status_col, F.lit(None).cast("int")).cast("int").alias("status_code"),
        content_type(headers).alias("content_type"),
        ts.alias("timestamp"),
        ts.alias("last_checked"),
        F.lit(True).alias("is_active"),
        F.lit(0).alias("error_count"),
        F.struct(headers.alias("headers"), page_bytes(html).alias("size"),
                 F.lit(None).cast("string").alias("error"),
                 F.lit(None).cast("string").alias("error_type")).alias("metadata"))


def failed_fetches(fetch_log: DataFrame) -> DataFrame:
    """Fetches that failed: an error text, or a status outside 200-299."""
    s = F.col("status")
    return fetch_log.where(F.col("error").isNotNull() | (s.isNotNull() & ~s.between(200, 299)))


def error_documents(fetch_log: DataFrame, now=None, hash_algo: str = "sha256") -> DataFrame:
    """One URL document per failed fetch: inactive, ``error_count = 1``.

    ``status_code`` is the response status, null when no response came;
    metadata carries the error text and kind (``FetchError`` for a failure
    without a response, ``HttpError`` for an error status). A URL that
    cannot be canonicalised keeps a null hash (``conform_or_reject`` drops it).
    """
    ts = _now(now)
    f = with_distinct_url_key(failed_fetches(fetch_log), "url", "_n", "_h", hash_algo)
    err = F.coalesce(F.col("error"), F.concat(F.lit("HTTP status "), F.col("status").cast("string")))
    kind = F.when(F.col("error").isNotNull(), F.lit("FetchError")).otherwise(F.lit("HttpError"))
    return f.select(
        F.col("url"),
        F.col("_h").alias("url_hash"),
        F.col("_n").alias("normalized_url"),
        url_authority(F.col("url")).alias("domain"),
        _opt(f, "source_url", F.lit(None).cast("string")).alias("source_url"),
        _opt(f, "depth", F.lit(0)).cast("int").alias("depth"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("status").cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("content_type"),
        _opt(f, "ts", ts).cast("timestamp_ntz").alias("timestamp"),
        _opt(f, "ts", ts).cast("timestamp_ntz").alias("last_checked"),
        F.lit(False).alias("is_active"),
        F.lit(1).alias("error_count"),
        F.struct(_no_headers().alias("headers"), F.lit(None).cast("bigint").alias("size"),
                 err.alias("error"), kind.alias("error_type")).alias("metadata"))


def all_documents(page_docs: DataFrame, error_docs: DataFrame) -> DataFrame:
    """Success and failure documents in one output."""
    return page_docs.unionByName(error_docs)


def conform(df: DataFrame, now=None) -> DataFrame:
    """Rebuild records to ``URL_DOCUMENT``: defaults filled, types cast.

    Depth 0, no keywords, active, no errors and an empty metadata record
    where missing; ``timestamp`` is the store time (``now``).
    """
    ts = _now(now)

    def get(name, default):
        return F.coalesce(F.col(name), default) if name in df.columns else default
    cols = []
    for f in URL_DOCUMENT.fields:
        n = f.name
        if n == "timestamp":
            c = ts
        elif n == "last_checked":
            c = get(n, ts)
        elif n == "depth":
            c = get(n, F.lit(0))
        elif n == "keywords":
            c = get(n, F.array().cast("array<string>"))
        elif n == "is_active":
            c = get(n, F.lit(True))
        elif n == "error_count":
            c = get(n, F.lit(0))
        elif n == "metadata":
            c = get(n, F.struct(_no_headers().alias("headers"), F.lit(None).cast("bigint").alias("size"),
                                F.lit(None).cast("string").alias("error"),
                                F.lit(None).cast("string").alias("error_type")))
        else:
            c = F.col(n) if n in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(n))
    return df.select(*cols)


HTTP_URL_MAX = 2083
R_NO_URL = "missing url"
R_BAD_URL = "url is not an http(s) URL"
R_LONG_URL = "url longer than 2083 characters"
R_NO_KEY = "missing url_hash"
R_NO_NORMAL = "missing normalized_url"
R_NO_DOMAIN = "missing domain"


def record_problem(url: Column, url_hash_c: Column, normalized: Column, domain: Column) -> Column:
    """Why a record cannot be stored ('' when it can): required fields, http(s) URL."""
    return (F.when(url.isNull(), F.lit(R_NO_URL))
            .when(~url.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(R_BAD_URL))
            .when(F.length(url) > HTTP_URL_MAX, F.lit(R_LONG_URL))
            .when(url_hash_c.isNull(), F.lit(R_NO_KEY))
            .when(normalized.isNull(), F.lit(R_NO_NORMAL))
            .when(domain.isNull(), F.lit(R_NO_DOMAIN))
            .otherwise(F.lit("")))


def conform_or_reject(df: DataFrame, now=None) -> Tuple[DataFrame, DataFrame]:
    """Split records into ``(accepted, rejected)``; rejected rows carry ``reason``.

    The check runs once, in one projection; both outputs filter that column.
    """
    tagged = df.withColumn("_reason", record_problem(F.col("url"), F.col("url_hash"),
                                                     F.col("normalized_url"), F.col("domain")))
    accepted = conform(tagged.where(F.col("_reason") == "").drop("_reason"), now)
    rejected = tagged.where(F.col("_reason") != "").withColumnRenamed("_reason", "reason")
    return accepted, rejected


def with_keywords(docs: DataFrame, keywords: Optional[Sequence[str]] = None, mode: str = "any") -> DataFrame:
    """Keep documents tagged with any (or, ``mode='all'``, every) keyword."""
    k = F.col("keywords")
    if mode == "any" and not keywords:
        return docs.where(F.size(k) > 0)
    wanted = list(keywords or [])
    if mode == "any":
        return docs.where(F.arrays_overlap(k, F.array(*[F.lit(w) for w in wanted])))
    if mode == "all":
        cond = F.lit(True)
        for w in wanted:
            cond = cond & F.array_contains(k, w)
        return docs.where(cond)
    raise ValueError("mode is 'any' or 'all'")


def keyword_index(docs: DataFrame, key: str = "url_hash") -> DataFrame:
    """Inverted table ``(keyword, key)``: one row per keyword of a document."""
    return docs.select(F.explode_outer(F.col("keywords")).alias("keyword"), F.col(key)) \
        .where(F.col("keyword").isNotNull())  # outer form: no inferred filter copying the tags

