"""Derived inputs built from the given tables by plain arithmetic.

The page table's links never point at another page of the table, and its
URLs carry no upper case, ports or blocked hosts. These inputs add those
cases by rules that are restated, step for step, in the DuckDB oracle
(``urlatlas.plans.oracle``), so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import running_count
from ..spec import BLOCKED_DOMAINS

N_VARIANTS = 14
FIXED_NOW = "2024-01-31 00:00:00"


def _split_page_url(url):
    scheme = F.regexp_extract(url, r"^([a-z]+)://", 1)
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    tail = F.regexp_extract(url, r"(?s)^[a-z]+://[^/?#]*(.*)\z", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return scheme, host, tail, path


def url_variants(pages: DataFrame) -> DataFrame:
    """``(seq, url, base_id)``: fourteen spellings of every page URL.

    0 as is; 1 upper-case host; 2 ``:80``; 3 ``:443``; 4 ``www.`` added;
    5 path with ``//`` appended; 6 ``?b=2&a=1&a=0&c=``; 7 tracking names;
    8 ``#frag`` appended; 9 ``.PDF`` (odd ids) or ``.pdf`` appended; 10 scheme ``ftp``;
    11 path padded past 2000 characters; 12 host after an unclosed bracket;
    13 no scheme. ``seq = page_id * 14 + variant``.
    """
    url = F.col("url")
    scheme, host, tail, path = _split_page_url(url)
    sh = F.concat(scheme, F.lit("://"))
    v = F.col("v")
    built = (F.when(v == 0, url)
             .when(v == 1, F.concat(sh, F.upper(host), tail))
             .when(v == 2, F.concat(sh, host, F.lit(":80"), tail))
             .when(v == 3, F.concat(sh, host, F.lit(":443"), tail))
             .when(v == 4, F.concat(sh, F.lit("www."), host, tail))
             .when(v == 5, F.concat(sh, host, path, F.lit("//")))
             .when(v == 6, F.concat(sh, host, path, F.lit("?b=2&a=1&a=0&c=")))
             .when(v == 7, F.concat(sh, host, path, F.lit("?utm_source=x&utm_medium=y&gclid=z&id="),
                                    F.col("page_id").cast("string")))
             .when(v == 8, F.concat(url, F.lit("#frag")))
             .when(v == 9, F.concat(sh, host, path, F.when(F.pmod(F.col("page_id"), F.lit(2)) == 0, F.lit(".pdf")).otherwise(F.lit(".PDF"))))
             .when(v == 10, F.concat(F.lit("ftp://"), host, tail))
             .when(v == 11, F.concat(sh, host, path, F.lit("/"), F.repeat(F.lit("a"), 2000)))
             .when(v == 12, F.concat(sh, F.lit("["), host, path))
             .otherwise(F.concat(host, path)))
    return (pages.select("page_id", "url")
            .withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(N_VARIANTS - 1))))
            .select((F.col("page_id") * N_VARIANTS + v).alias("seq"), built.alias("url"),
                    F.col("page_id").alias("base_id")))


def blocked_urls(pages: DataFrame) -> DataFrame:
    """``(seq, url)``: page paths moved to the blocked hosts, even ids with ``www.``."""
    _, _, _, path = _split_page_url(F.col("url"))
    dom = F.element_at(F.array(*[F.lit(d) for d in BLOCKED_DOMAINS]),
                       (F.pmod(F.col("page_id"), F.lit(len(BLOCKED_DOMAINS))) + 1).cast("int"))
    sub = F.when(F.pmod(F.col("page_id"), F.lit(2)) == 0, F.lit("www.")).otherwise(F.lit(""))
    return pages.select(F.col("page_id").alias("seq"),
                        F.concat(F.lit("https://"), sub, dom, path).alias("url"))


# Hosts that meet the wildcard, exception, private and unlisted cases of the suffix rules.
SUFFIX_HOSTS = ("a.b.ck", "www.ck", "x.www.ck", "b.ck", "foo.com.ua", "com.ua", "a.city.kawasaki.jp", "x.y.kawasaki.jp",
                "foo.blogspot.com", "a.b.github.io", "deep.a.co.uk", "host.nosuchtld", "127.0.0.1",
                "a.b.рф", "a.b.xn--p1ai", "x.公司.cn", "x.y.XN--55QX5D.cn", "公司.cn")


def suffix_urls(pages: DataFrame) -> DataFrame:
    """``(seq, url)``: page paths moved to the hosts of ``SUFFIX_HOSTS``."""
    _, _, _, path = _split_page_url(F.col("url"))
    host = F.element_at(F.array(*[F.lit(h) for h in SUFFIX_HOSTS]),
                        (F.pmod(F.col("page_id"), F.lit(len(SUFFIX_HOSTS))) + 1).cast("int"))
    return pages.select(F.col("page_id").alias("seq"), F.concat(F.lit("https://"), host, path).alias("url"))


def page_edges(pages: DataFrame, n_pages: int | None = None) -> DataFrame:
    """``(src, dst, pos)``: three out-links per page, ``dst = (src*3 + pos*7 + 1) % n``."""
    n = n_pages if n_pages is not None else pages.count()
    return (pages.select(F.col("page_id").alias("src"))
            .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
            .select("src", F.pmod(F.col("src") * 3 + F.col("pos") * 7 + 1, F.lit(n)).alias("dst"),
                    F.col("pos").cast("int").alias("pos")))


def link_table(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as URLs: ``(src_url, dst_url, pos)``."""
    p = pages.select("page_id", "url")
    s = p.select(F.col("page_id").alias("src"), F.col("url").alias("src_url"))
    d = p.select(F.col("page_id").alias("dst"), F.col("url").alias("dst_url"))
    return edges.join(s, "src").join(d, "dst").select("src_url", "dst_url", "pos", "src", "dst")


STATUS_BY_DIGIT = (200, 200, 200, 200, 404, 403, 429, 500, 503, 408)
ERRORS = ("timeout", "connection refused", "no such host", "proxy 10.0.0.7:3128: connection reset after 3 attempts",
          "a.example: certificate has expired (not after 2023-12-31T23:59:59Z); the chain of 4 certificates could not be verified")


def rich_pages(pages: DataFrame) -> DataFrame:
    """Pages with what the given ones lack: meta descriptions, a first title without text, status and headers.

    By ``page_id``: modulo 3 picks the description (two attribute orders with
    character references, or none), modulo 4 = 0 puts an empty title first,
    modulo 10 picks the status of ``STATUS_BY_DIGIT``, even ids have a
    Content-Type header.
    """
    i = F.col("page_id")
    third = F.pmod(i, F.lit(3))
    meta = (F.when(third == 0, F.concat(F.lit('<meta name="description" content="Page '), i.cast("string"), F.lit(' &amp; more&hellip;">')))
            .when(third == 1, F.concat(F.lit("<meta content='d&#233;j&#xE0; "), i.cast("string"), F.lit("' name=description>")))
            .otherwise(F.lit("")))
    title = F.when(F.pmod(i, F.lit(4)) == 0, F.lit("<title></title>")).otherwise(F.lit(""))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_DIGIT]), (F.pmod(i, F.lit(10)) + 1).cast("int"))
    kind = F.create_map(F.lit("Content-Type"), F.array(F.lit("text/html; charset=utf-8"), F.lit("text/plain")))
    return pages.select("page_id", "url", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), meta, title)).alias("html"),
                        status.cast("int").alias("status"), F.when(F.pmod(i, F.lit(2)) == 0, kind).alias("headers"))


def fetch_log(events: DataFrame, pages: DataFrame, n_pages: int | None = None,
              with_attempt: bool = True) -> DataFrame:
    """One fetch per event: run, page URL, proxy, status, time, attempt, error.

    ``status`` is null and ``error`` one of ``ERRORS`` for error events;
    otherwise the last digit of ``event_id`` picks the status. ``attempt`` numbers the
    fetches of a URL by ``(ts, event_id)``; consumers that never read it can
    skip the numbering (``with_attempt=False``, attempt is null).
    """
    n = n_pages if n_pages is not None else pages.count()
    urls = pages.select(F.col("page_id").alias("_pid"), F.col("url"))
    is_err = F.col("event_type") == "error"
    status = F.element_at(F.array(*[F.lit(s) for s in STATUS_BY_DIGIT]),
                          (F.pmod(F.col("event_id"), F.lit(10)) + 1).cast("int"))
    ev = events.select(
        "event_id", "ts", "value",
        F.pmod(F.col("event_id"), F.lit(3)).cast("string").alias("run_id"),
        F.pmod(F.col("event_id"), F.lit(n)).alias("_pid"),
        F.concat(F.lit("http://proxy"), F.pmod(F.col("event_id"), F.lit(5)).cast("string")).alias("proxy_address"),
        F.when(is_err, F.lit(None).cast("int")).otherwise(status).cast("int").alias("status"),
        F.when(is_err, F.element_at(F.array(*[F.lit(e) for e in ERRORS]),
                                    (F.pmod(F.col("event_id"), F.lit(len(ERRORS))) + 1).cast("int"))).alias("error"))
    joined = ev.join(urls, "_pid").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    # attempt numbers per URL without gathering a URL's fetches in one task:
    # blocked running count, one block per day of fetch time
    if with_attempt:
        day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")
        numbered = running_count(joined, "url", "ts", "attempt", order=["ts", "event_id"], block=day)
    else:
        numbered = joined.withColumn("attempt", F.lit(None).cast("int"))
    return numbered.select(
        "event_id", "run_id", "url", "proxy_address", "status",
        F.col("value").alias("response_ms"), "ts", F.col("attempt").cast("int").alias("attempt"), "error")


def fixed_now():
    return F.lit(FIXED_NOW).cast("timestamp_ntz")
