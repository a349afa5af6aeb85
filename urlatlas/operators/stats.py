"""Run, proxy, error, sink, domain and keyword statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PROXY_BAN_CODES
from .documents import record_problem
from .util import with_distinct_url_key


def _ok(s):
    return s.between(200, 299)


def _failed():
    s = F.col("status")
    return F.col("error").isNotNull() | (s.isNotNull() & ~_ok(s))


#: Error texts listed with a run or proxy: the most frequent ones (``error_counts`` has them all).
TOP_ERRORS = 1000


def error_counts(fetch_log: DataFrame, by: str) -> DataFrame:
    """``(by, error, n_errors, first_seen, last_seen)``: every full error text of every run or proxy."""
    return fetch_log.where(F.col("error").isNotNull()).groupBy(by, "error").agg(
        F.count(F.lit(1)).alias("n_errors"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def _top_errors(fetch_log: DataFrame, by: str, top: int, out: str) -> DataFrame:
    """``(by, out)``: the ``top`` most frequent error texts (ties by text), in the order of the texts.

    Texts are counted first, so a group's rows never meet; the rank is cut
    before the shuffle, so neither do all texts of a group that has very many.
    """
    order = Window.partitionBy(by).orderBy(F.col("n_errors").desc(), "error")
    kept = error_counts(fetch_log, by).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return kept.groupBy(by).agg(F.array_sort(F.collect_list("error")).alias(out))


def _with_list(stats: DataFrame, lists: DataFrame, by: str, out: str) -> DataFrame:
    """Joins a list column, empty where a group (a null one too) has none."""
    other = lists.withColumnRenamed(by, "_by")
    joined = stats.join(other, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def crawl_stats(fetch_log: DataFrame, keywords_col: str | None = None, top_errors: int = TOP_ERRORS) -> DataFrame:
    """Per run: start/end, processed, failed, new and duplicate URLs, requests,
    mean response time, error texts, keywords.

    ``errors`` lists distinct full texts, the ``top_errors`` most frequent
    ones; ``keywords`` the distinct keywords of ``keywords_col`` (an array).
    """
    keyed = with_distinct_url_key(fetch_log, "url", "_n", "_h").withColumn("_h", F.coalesce("_h", F.lit("")))
    stats = keyed.groupBy("run_id").agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count_if(_ok(F.col("status"))).alias("urls_processed"),
        F.count_if(_failed()).alias("urls_failed"),
        F.count_distinct("_h").alias("new_urls_found"),
        (F.count(F.lit(1)) - F.count_distinct("_h")).alias("duplicate_urls"),
        F.count(F.lit(1)).alias("total_requests"),
        F.avg("response_ms").alias("average_response_time"))
    stats = _with_list(stats, _top_errors(fetch_log, "run_id", top_errors, "errors"), "run_id", "errors")
    if not keywords_col:
        return stats.withColumn("keywords", F.array().cast("array<string>"))
    kw = (fetch_log.select("run_id", F.explode_outer(keywords_col).alias("_k")).where(F.col("_k").isNotNull())
          .distinct().groupBy("run_id").agg(F.array_sort(F.collect_list("_k")).alias("keywords")))
    return _with_list(stats, kw, "run_id", "keywords")


def proxy_health(fetch_log: DataFrame, ban_codes=PROXY_BAN_CODES, top_errors: int = TOP_ERRORS) -> DataFrame:
    """Per proxy: successes, failures, mean response time, last use, active
    flag (no ban status ever seen), the most frequent error texts."""
    s = F.col("status")
    stats = fetch_log.groupBy("proxy_address").agg(
        F.count_if(_ok(s)).alias("success_count"),
        F.count_if(_failed()).alias("failure_count"),
        F.avg("response_ms").alias("average_response_time"),
        F.max("ts").alias("last_used"),
        (~F.coalesce(F.bool_or(s.isin(*ban_codes)), F.lit(False))).alias("is_active"))
    return _with_list(stats, _top_errors(fetch_log, "proxy_address", top_errors, "error_messages"), "proxy_address", "error_messages")


def sink_stats(docs: DataFrame, key: str = "url_hash") -> DataFrame:
    """Unique-insert counters: ``processed`` (stored), ``dropped`` (duplicate
    key), ``errors`` (record rejected). A duplicate counts once, as dropped."""
    problem = record_problem(F.col("url"), F.col("url_hash"), F.col("normalized_url"), F.col("domain"))
    tagged = docs.withColumn("_reason", problem)
    ok = F.col("_reason") == ""
    return tagged.agg(
        F.count_distinct(F.when(ok, F.col(key))).alias("processed"),
        (F.count_if(ok) - F.count_distinct(F.when(ok, F.col(key)))).alias("dropped"),
        F.count_if(~ok).alias("errors"))


def domain_summary(docs: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Documents per domain with first and last time seen."""
    return docs.groupBy(domain_col).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))


def keyword_summary(docs: DataFrame) -> DataFrame:
    """Documents per keyword."""
    # outer explode: a plain one infers size(keywords) > 0 below the projection
    return (docs.select(F.explode_outer("keywords").alias("keyword")).where(F.col("keyword").isNotNull())
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs")))
