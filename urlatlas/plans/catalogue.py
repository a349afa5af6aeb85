"""Registered queries: each a Spark plan over the given tables and its DuckDB twin.

Every query reads the page / event / document tables of a scale-factor
folder (or inputs Spark derives from them) and runs over all of their rows.
``SPARK[name](spark, sf_dir) -> DataFrame``; ``SQL[name] -> str`` (DuckDB,
tables pre-registered as views). Column names match one to one; arrays are
shown as text joined by ``|``; doubles are rounded to 6 places.
"""

from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import (canonical_domain, normalize_query, normalize_url, strip_url,
                             url_authority, url_hash, url_hostname)
from ..functions.validate import validate_url
from ..operators.dedup import dedup_verdicts, unique_urls
from ..operators.links import extract_links, valid_links
from ..operators.util import with_url_key
from ..sources import derived
from ..sources.tables import read_table
from ..spec import AUTHORITY_CONFUSABLES, DENY_PATTERN
from . import oracle as O

SPARK: Dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: Dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def pages(spark, sf):
    return read_table(spark, sf, "pages")


# ---------------------------------------------------------------- SQL inputs

def sql_url_variants() -> str:
    sh = "regexp_extract(url, '^([a-z]+)://', 1) || '://'"
    host = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
    tail = "regexp_extract(url, '(?s)^[a-z]+://[^/?#]*(.*)$', 1)"
    path = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    built = (f"CASE v WHEN 0 THEN url WHEN 1 THEN {sh} || upper({host}) || {tail} "
             f"WHEN 2 THEN {sh} || {host} || ':80' || {tail} WHEN 3 THEN {sh} || {host} || ':443' || {tail} "
             f"WHEN 4 THEN {sh} || 'www.' || {host} || {tail} WHEN 5 THEN {sh} || {host} || {path} || '//' "
             f"WHEN 6 THEN {sh} || {host} || {path} || '?b=2&a=1&a=0&c=' "
             f"WHEN 7 THEN {sh} || {host} || {path} || '?utm_source=x&utm_medium=y&gclid=z&id=' || CAST(page_id AS VARCHAR) "
             f"WHEN 8 THEN url || '#frag' WHEN 9 THEN {sh} || {host} || {path} || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.PDF' END "
             f"WHEN 10 THEN 'ftp://' || {host} || {tail} "
             f"WHEN 11 THEN {sh} || {host} || {path} || '/' || repeat('a', 2000) "
             f"WHEN 12 THEN {sh} || '[' || {host} || {path} ELSE {host} || {path} END")
    return (f"(SELECT page_id * {derived.N_VARIANTS} + v AS seq, {built} AS url, page_id AS base_id "
            f"FROM pages, (SELECT range AS v FROM range(0, {derived.N_VARIANTS})) vv)")


def sql_links() -> str:
    return O.links("pages", unique=True)


def sql_valid_links(src: str) -> str:
    s = O.validate(src, "url", "is_valid", "reason", "vl")
    s = f"(SELECT * FROM {s} WHERE is_valid)"
    s = O.normalize(s, "url", "normalized_url", "nl")
    return f"(SELECT *, sha256(normalized_url) AS url_hash FROM {s} WHERE normalized_url IS NOT NULL)"


# ---------------------------------------------------------------- F1 on pages

@register("normalize_pages", f"""
SELECT page_id, url, normalized_url, sha256(normalized_url) AS url_hash
FROM {O.normalize('pages', 'url', 'normalized_url', 'n')}
""")
def q_normalize_pages(spark, sf):
    return with_url_key(pages(spark, sf)).select("page_id", "url", "normalized_url", "url_hash")


# ------------------------------------------------------- F1, F3, F4 on variants

def _sql_normalize_variants():
    s = O.normalize(sql_url_variants(), "url", "normalized_url", "n")
    s = O.query_pass(s, "normalized_url", "dedup_url", "d")
    s = O.strip(s, "url", "stripped_url", "t")
    return f"SELECT seq, url, normalized_url, dedup_url, stripped_url FROM {s}"


@register("normalize_variants", _sql_normalize_variants())
def q_normalize_variants(spark, sf):
    v = derived.url_variants(pages(spark, sf)).withColumn("normalized_url", normalize_url("url"))
    return v.select("seq", "url", "normalized_url",
                    normalize_query("normalized_url").alias("dedup_url"), strip_url("url").alias("stripped_url"))


# ------------------------------------------------------------ F2, F5 domains

def _sql_domains():
    s = O.authority("pages", "url", "authority", "a")
    s = O.domain(s, "url", "domain", "d")
    s = O.hostname(s, "url", "hostname", "h")
    return f"SELECT page_id, authority, domain, hostname FROM {s}"


@register("domains", _sql_domains())
def q_domains(spark, sf):
    p = pages(spark, sf)
    return p.select("page_id", url_authority("url").alias("authority"),
                    canonical_domain("url").alias("domain"), url_hostname("url").alias("hostname"))


# --------------------------------------------------------------- P1 variants

def _sql_blocked_urls() -> str:
    doms = "[" + ", ".join(O.q(d) for d in derived.BLOCKED_DOMAINS) + "]"
    path = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    return (f"(SELECT page_id AS seq, 'https://' || CASE WHEN page_id % 2 = 0 THEN 'www.' ELSE '' END || "
            f"{doms}[CAST(page_id % {len(derived.BLOCKED_DOMAINS)} AS BIGINT) + 1] || {path} AS url FROM pages)")


def _sql_validation_rows() -> str:
    return (f"(SELECT 'variant' AS source, seq, url FROM {sql_url_variants()} "
            f"UNION ALL SELECT 'blocked' AS source, seq, url FROM {_sql_blocked_urls()})")


def validation_rows(spark, sf) -> DataFrame:
    p = pages(spark, sf)
    v = derived.url_variants(p).select(F.lit("variant").alias("source"), "seq", "url")
    b = derived.blocked_urls(p).select(F.lit("blocked").alias("source"), "seq", "url")
    return v.unionByName(b)


@register("validate_variants", f"""
SELECT source, seq, url, is_valid, reason
FROM {O.validate(_sql_validation_rows(), 'url', 'is_valid', 'reason', 'v')}
""")
def q_validate_variants(spark, sf):
    r = validation_rows(spark, sf)
    v = validate_url("url")
    return r.select("source", "seq", "url", v["is_valid"].alias("is_valid"), v["reason"].alias("reason"))


@register("validation_summary", f"""
SELECT reason, count(*) AS n_urls
FROM {O.validate(_sql_validation_rows(), 'url', 'is_valid', 'reason', 'v')}
GROUP BY reason
""")
def q_validation_summary(spark, sf):
    r = validation_rows(spark, sf)
    return (r.select(validate_url("url")["reason"].alias("reason"))
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_urls")))


# F1, P1f: a delimiter in compatibility form (or, for every 20th page, none) put into the host
_CONFUSABLES = [*AUTHORITY_CONFUSABLES, ""]


def _sql_authority_variants() -> str:
    chars = "[" + ", ".join(O.q(c) for c in _CONFUSABLES) + "]"
    url = (f"regexp_extract(url, '^([a-z]+://)', 1) || 'a' || {chars}[CAST(page_id % {len(_CONFUSABLES)} AS BIGINT) + 1] || "
           f"regexp_extract(url, '(?s)^[a-z]+://(.*)$', 1)")
    return f"(SELECT page_id, {url} AS url, page_id % {len(_CONFUSABLES)} < {len(_CONFUSABLES) - 1} AS odd FROM pages)"


def _sql_authority_checks() -> str:
    s = O.normalize(_sql_authority_variants(), "url", "normalized_url", "nv")
    return O.validate(s, "url", "is_valid", "reason", "vv")


@register("authority_variants", f"""
SELECT page_id, url, CASE WHEN odd THEN NULL ELSE normalized_url END AS normalized_url,
       CASE WHEN odd THEN FALSE ELSE is_valid END AS is_valid,
       CASE WHEN odd THEN 'Validation error: netloc ' || chr(39) || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || chr(39)
            || ' contains invalid characters under NFKC normalization' ELSE reason END AS reason
FROM {_sql_authority_checks()}
""")
def q_authority_variants(spark, sf):
    char = F.element_at(F.array(*[F.lit(c) for c in _CONFUSABLES]), (F.pmod(F.col("page_id"), F.lit(len(_CONFUSABLES))) + 1).cast("int"))
    url = F.concat(F.regexp_extract("url", "^([a-z]+://)", 1), F.lit("a"), char, F.regexp_extract("url", r"(?s)^[a-z]+://(.*)\z", 1))
    v = validate_url("url")
    return pages(spark, sf).select("page_id", url.alias("url")).select(
        "page_id", "url", normalize_url("url").alias("normalized_url"), v["is_valid"].alias("is_valid"), v["reason"].alias("reason"))


# ------------------------------------------------------------ F14, F15, O1

@register("links", f"SELECT page_id, src_url, pos, url FROM {sql_links()}")
def q_links(spark, sf):
    return extract_links(pages(spark, sf))


def _unique_links_spark(spark, sf) -> DataFrame:
    ln = valid_links(extract_links(pages(spark, sf)))
    return unique_urls(ln.select("url_hash", "normalized_url", "url", "page_id", "pos"), "url_hash", F.struct("page_id", "pos"))


def _sql_unique_links() -> str:
    vl = sql_valid_links(sql_links())
    o = "{'i': page_id, 'p': pos}"
    return (f"(SELECT url_hash, arg_min(normalized_url, {o}) AS normalized_url, arg_min(url, {o}) AS url, "
            f"min({o}).i AS page_id, min({o}).p AS pos FROM {vl} GROUP BY url_hash)")


@register("unique_links", f"SELECT url_hash, normalized_url, url, page_id, pos FROM {_sql_unique_links()}")
def q_unique_links(spark, sf):
    return _unique_links_spark(spark, sf)


@register("link_host_counts", f"""
SELECT domain, count(*) AS n_links, min(normalized_url) AS first_url
FROM {O.domain(_sql_unique_links(), 'normalized_url', 'domain', 'hd')}
GROUP BY domain
""")
def q_link_host_counts(spark, sf):
    u = _unique_links_spark(spark, sf)
    return (u.groupBy(canonical_domain("normalized_url").alias("domain"))
            .agg(F.count(F.lit(1)).alias("n_links"), F.min("normalized_url").alias("first_url")))


# ------------------------------------------------------------ W1, W2 verdicts

def _sql_verdicts() -> str:
    s = O.normalize(sql_url_variants(), "url", "n1", "n")
    s = O.query_pass(s, "n1", "n2", "d")
    s = (f"(SELECT seq, url, base_id, n2, CASE WHEN n2 IS NULL THEN '' ELSE sha256(n2) END AS hash_value FROM {s})")
    s = (f"(SELECT *, count(*) OVER (PARTITION BY hash_value ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc FROM {s})")
    return (f"(SELECT seq, url, base_id, hash_value, "
            f"CASE WHEN hash_value = '' THEN url ELSE n2 END AS normalized_url, "
            f"(hash_value = '' OR rc > 1) AS is_duplicate, "
            f"CASE WHEN hash_value = '' THEN 'Invalid URL format' WHEN rc > 1 THEN 'Exact duplicate' END AS reason, "
            f"CASE WHEN hash_value = '' THEN NULL ELSE rc END AS seen_count FROM {s})")


@register("dedup_verdicts", f"SELECT seq, url, base_id, hash_value, normalized_url, is_duplicate, reason, seen_count FROM {_sql_verdicts()}")
def q_dedup_verdicts(spark, sf):
    v = derived.url_variants(pages(spark, sf))
    return dedup_verdicts(v, "url", "seq").select(
        "seq", "url", "base_id", "hash_value", "normalized_url", "is_duplicate", "reason", "seen_count")


# ------------------------------------------------------------ A2, A3, L2, J1

from ..operators.dedup import dedup_stats, hot_urls, unseen, url_frequency  # noqa: E402


def _verdicts_spark(spark, sf):
    return dedup_verdicts(derived.url_variants(pages(spark, sf)), "url", "seq")


@register("dedup_stats", f"""
SELECT count(*) AS total_urls, count(*) FILTER (WHERE reason = 'Exact duplicate') AS duplicates,
       count(*) FILTER (WHERE NOT is_duplicate) AS unique_urls, CAST(0 AS BIGINT) AS cache_evictions,
       count(*) FILTER (WHERE NOT is_duplicate) AS cache_size,
       strftime(TIMESTAMP '{derived.FIXED_NOW}', '%Y-%m-%dT%H:%M:%S.%f') AS timestamp
FROM {_sql_verdicts()}
""")
def q_dedup_stats(spark, sf):
    return dedup_stats(_verdicts_spark(spark, sf), F.lit(str(derived.FIXED_NOW)).cast("timestamp_ntz"))


def _sql_frequency() -> str:
    return (f"(SELECT hash_value AS url_hash, count(*) AS frequency, min(seq) AS first_seq, "
            f"arg_min(normalized_url, seq) AS normalized_url FROM {_sql_verdicts()} WHERE hash_value <> '' GROUP BY hash_value)")


def _frequency_spark(spark, sf):
    from ..functions.url import url_parse_ok
    rows = derived.url_variants(pages(spark, sf)).where(url_parse_ok("url"))   # cheap: no parse without brackets
    v = with_url_key(rows, dedup_pass=True, empty_for_invalid=True).select("seq", "normalized_url", "url_hash")
    return url_frequency(v, "url_hash", "seq", "normalized_url")


@register("url_frequency", f"SELECT url_hash, frequency, first_seq, normalized_url FROM {_sql_frequency()}")
def q_url_frequency(spark, sf):
    return _frequency_spark(spark, sf)


HOT_CAP = 1000


@register("hot_urls", f"""
SELECT url_hash, frequency, first_seq, normalized_url FROM (
  SELECT *, row_number() OVER (ORDER BY frequency DESC, first_seq ASC) AS rn,
         count(*) OVER () AS n_keys FROM {_sql_frequency()})
WHERE n_keys < {HOT_CAP} OR rn <= {int(HOT_CAP * 0.75)}
""")
def q_hot_urls(spark, sf):
    return hot_urls(_frequency_spark(spark, sf), cap=HOT_CAP)


@register("unseen", f"""
SELECT v.seq, v.url, v.hash_value AS url_hash FROM {_sql_verdicts()} v
WHERE v.hash_value <> '' AND v.hash_value NOT IN (
  SELECT sha256(d2) FROM {O.query_pass(O.normalize('pages', 'url', 'd1', 'pn'), 'd1', 'd2', 'pq')} WHERE d2 IS NOT NULL)
""")
def q_unseen(spark, sf):
    v = _verdicts_spark(spark, sf).where(F.col("hash_value") != "") \
        .select("seq", "url", F.col("hash_value").alias("url_hash"))
    from ..operators.util import cut_lineage
    # the history of known keys, materialised as a stored key column would be
    hist = cut_lineage(with_url_key(pages(spark, sf), dedup_pass=True, empty_for_invalid=True).select("url_hash"))
    return unseen(v, hist, "url_hash")


# ------------------------------------------------------------ page functions

from ..functions.html import body_text, page_bytes, page_description, page_title  # noqa: E402
from ..operators.documents import (all_documents, conform_or_reject, error_documents,  # noqa: E402
                                   page_documents, with_keywords)
from ..operators.keywords import match_keywords  # noqa: E402
from ..operators.stats import (crawl_stats, domain_summary, error_counts, keyword_summary,  # noqa: E402
                               proxy_health, sink_stats)

# Keywords for the tag queries: words the generated prose holds, a phrase,
# a word found only in head scripts, and one absent word.
TAG_KEYWORDS = ("the", "der", "of the", "track", "Python")


def sql_rich_pages() -> str:
    meta = ("CASE page_id % 3 WHEN 0 THEN '<meta name=\"description\" content=\"Page ' || CAST(page_id AS VARCHAR) || ' &amp; more&hellip;\">' "
            "WHEN 1 THEN '<meta content=' || chr(39) || 'd&#233;j&#xE0; ' || CAST(page_id AS VARCHAR) || chr(39) || ' name=description>' ELSE '' END")
    st = "[" + ", ".join(str(s) for s in derived.STATUS_BY_DIGIT) + "]"
    return (f"(SELECT page_id, url, replace(html, '<head>', '<head>' || {meta} || CASE WHEN page_id % 4 = 0 THEN '<title></title>' ELSE '' END) AS html, "
            f"CAST({st}[page_id % 10 + 1] AS INTEGER) AS status, CASE WHEN page_id % 2 = 0 THEN 'text/html; charset=utf-8' END AS ctype FROM pages)")


def rich(spark, sf) -> DataFrame:
    return derived.rich_pages(pages(spark, sf))


@register("page_titles", f"SELECT page_id, {O.title('html')} AS title FROM {sql_rich_pages()}")
def q_page_titles(spark, sf):
    return rich(spark, sf).select("page_id", page_title("html").alias("title"))


@register("page_descriptions", f"SELECT page_id, {O.description('html')} AS description FROM {sql_rich_pages()}")
def q_page_descriptions(spark, sf):
    return rich(spark, sf).select("page_id", page_description("html").alias("description"))


@register("page_sizes", "SELECT page_id, CAST(strlen(html) AS BIGINT) AS size_bytes, "
                        "CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def q_page_sizes(spark, sf):
    return pages(spark, sf).select("page_id", page_bytes("html").alias("size_bytes"),
                                   F.length("html").cast("bigint").alias("n_chars"))


def _sql_tags() -> str:
    return (f"(SELECT page_id, url, {O.find_keywords('bt', TAG_KEYWORDS)} AS kw FROM "
            f"(SELECT page_id, url, {O.body_text('html')} AS bt FROM pages))")


@register("keyword_tags", f"SELECT page_id, array_to_string(kw, '|') AS keywords FROM {_sql_tags()}")
def q_keyword_tags(spark, sf):
    from ..functions.html import find_keywords
    p = pages(spark, sf)
    return p.select("page_id", F.array_join(find_keywords(body_text("html"), TAG_KEYWORDS), "|").alias("keywords"))


def _docs_spark(spark, sf, keywords=TAG_KEYWORDS):
    return page_documents(rich(spark, sf), keywords, derived.FIXED_NOW)


@register("keyword_summary", f"SELECT k AS keyword, count(*) AS n_docs FROM (SELECT unnest(kw) AS k FROM {_sql_tags()}) GROUP BY k")
def q_keyword_summary(spark, sf):
    return keyword_summary(_docs_spark(spark, sf))


@register("keyword_filter", f"""
SELECT url, array_to_string(kw, '|') AS keywords FROM {_sql_tags()}
WHERE list_contains(kw, 'the') AND list_contains(kw, 'der')
""")
def q_keyword_filter(spark, sf):
    d = with_keywords(_docs_spark(spark, sf), ["the", "der"], mode="all")
    return d.select("url", F.array_join("keywords", "|").alias("keywords"))


@register("keyword_index", f"SELECT unnest(kw) AS keyword, page_id FROM {_sql_tags()}")
def q_keyword_index(spark, sf):
    from ..functions.html import find_keywords
    p = pages(spark, sf).select("page_id", find_keywords(body_text("html"), TAG_KEYWORDS).alias("keywords"))
    return p.select(F.explode_outer("keywords").alias("keyword"), "page_id").where(F.col("keyword").isNotNull())


# A keyword table: the first words of the benchmark items, with the event types, which occur nowhere.
SQL_KEYWORDS = ("(SELECT list(DISTINCT k) AS kws FROM (SELECT regexp_extract(text, '^[^ ]+') AS k FROM benchmark "
                "UNION ALL SELECT event_type FROM events WHERE event_type IS NOT NULL))")


def _keyword_table(spark, sf) -> DataFrame:
    first = read_table(spark, sf, "benchmark").select(F.regexp_extract("text", "^[^ ]+", 0).alias("k"))
    return first.union(read_table(spark, sf, "events").select("event_type").distinct())


@register("keyword_join", """
SELECT page_id, array_to_string(list_sort(list_filter(kws, lambda k: instr(bt, lower(k)) > 0)), '|') AS keywords
FROM (SELECT page_id, """ + O.body_text('html') + """ AS bt FROM pages), """ + SQL_KEYWORDS)
def q_keyword_join(spark, sf):
    p = pages(spark, sf).select("page_id", body_text("html").alias("text"))
    return match_keywords(p, _keyword_table(spark, sf), "text").select("page_id", F.array_join("keywords", "|").alias("keywords"))


# ------------------------------------------------------------ P2, P3 link filters

from ..operators.links import allowed_only, deny_links  # noqa: E402

ALLOWED_TEST = ("example.com",)


@register("allowed_only", f"""
SELECT page_id, pos, url FROM {O.authority(sql_links(), 'url', 'au', 'al')}
WHERE lower(au) <> '' AND (lower(au) = 'example.com' OR ends_with(lower(au), '.example.com'))
""")
def q_allowed_only(spark, sf):
    return allowed_only(extract_links(pages(spark, sf)), ALLOWED_TEST).select("page_id", "pos", "url")


@register("allowed_only_table", f"""
SELECT page_id, pos, url FROM {O.authority(sql_links(), 'url', 'au', 'al')}
WHERE lower(au) IN (SELECT lower(a2) FROM {O.authority("(SELECT url FROM pages WHERE starts_with(url, 'https:'))", 'url', 'a2', 'ap')})
""")
def q_allowed_only_table(spark, sf):
    p = pages(spark, sf)
    allow = p.where(F.col("url").startswith("https:")).select(url_authority("url").alias("domain"))
    return allowed_only(extract_links(p), allow).select("page_id", "pos", "url")


@register("deny_links", f"""
SELECT seq, url FROM {sql_url_variants()}
WHERE NOT regexp_matches(url, {O.q(DENY_PATTERN)})
""")
def q_deny_links(spark, sf):
    return deny_links(derived.url_variants(pages(spark, sf)).select("seq", "url"))


# ------------------------------------------------------------ documents

def sql_fetch_log() -> str:
    st = "[" + ", ".join(str(s) for s in derived.STATUS_BY_DIGIT) + "]"
    return (f"(SELECT e.event_id, CAST(e.event_id % 3 AS VARCHAR) AS run_id, p.url, "
            f"'http://proxy' || CAST(e.event_id % 5 AS VARCHAR) AS proxy_address, "
            f"CAST(CASE WHEN e.event_type = 'error' THEN NULL ELSE {st}[e.event_id % 10 + 1] END AS INTEGER) AS status, "
            f"e.value AS response_ms, e.ts AS ts, "
            f"CAST(row_number() OVER (PARTITION BY p.url ORDER BY e.ts, e.event_id) AS INTEGER) AS attempt, "
            f"CASE WHEN e.event_type = 'error' THEN [{', '.join(O.q(x) for x in derived.ERRORS)}][e.event_id % {len(derived.ERRORS)} + 1] END AS error "
            f"FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))")


def fetch_log_spark(spark, sf, with_attempt: bool = False):
    p = pages(spark, sf)
    return derived.fetch_log(read_table(spark, sf, "events"), p, with_attempt=with_attempt)


NOW_SQL = f"TIMESTAMP '{derived.FIXED_NOW}'"


def _sql_page_docs(src: str | None = None, depth: str = "0", source: str = "CAST(NULL AS VARCHAR)") -> str:
    s = O.normalize(src or sql_rich_pages(), "url", "normalized_url", "dn")
    s = O.authority(s, "url", "domain", "da")
    return (f"(SELECT url, sha256(normalized_url) AS url_hash, normalized_url, domain, {source} AS source_url, "
            f"CAST({depth} AS INTEGER) AS depth, array_to_string({O.find_keywords(O.body_text('html'), TAG_KEYWORDS)}, '|') AS keywords, "
            f"{O.title('html')} AS title, {O.description('html')} AS description, status AS status_code, "
            f"ctype AS content_type, {NOW_SQL} AS timestamp, {NOW_SQL} AS last_checked, "
            f"TRUE AS is_active, 0 AS error_count, CAST(strlen(html) AS BIGINT) AS size, "
            f"CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS error_type FROM {s})")


def _flat(docs):
    return docs.select("url", "url_hash", "normalized_url", "domain", "source_url", "depth",
                       F.array_join("keywords", "|").alias("keywords"), "title", "description",
                       "status_code", "content_type", "timestamp", "last_checked", "is_active", "error_count",
                       F.col("metadata.size").alias("size"), F.col("metadata.error").alias("error"),
                       F.col("metadata.error_type").alias("error_type"))


DOC_COLS = ("url, url_hash, normalized_url, domain, source_url, depth, keywords, title, description, status_code, "
            "content_type, timestamp, last_checked, is_active, error_count, size, error, error_type")


@register("documents", f"SELECT {DOC_COLS} FROM {_sql_page_docs()}")
def q_documents(spark, sf):
    return _flat(_docs_spark(spark, sf))


def _sql_error_docs() -> str:
    f = (f"(SELECT * FROM {sql_fetch_log()} WHERE error IS NOT NULL OR "
         f"(status IS NOT NULL AND NOT (status BETWEEN 200 AND 299)))")
    s = O.normalize(f, "url", "normalized_url", "en")
    s = O.authority(s, "url", "domain", "ea")
    return (f"(SELECT url, sha256(normalized_url) AS url_hash, normalized_url, domain, CAST(NULL AS VARCHAR) AS source_url, "
            f"0 AS depth, '' AS keywords, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description, "
            f"status AS status_code, CAST(NULL AS VARCHAR) AS content_type, ts AS timestamp, ts AS last_checked, "
            f"FALSE AS is_active, 1 AS error_count, CAST(NULL AS BIGINT) AS size, "
            f"coalesce(error, 'HTTP status ' || CAST(status AS VARCHAR)) AS error, "
            f"CASE WHEN error IS NOT NULL THEN 'FetchError' ELSE 'HttpError' END AS error_type FROM {s})")


def _error_docs_spark(spark, sf):
    return error_documents(fetch_log_spark(spark, sf), derived.FIXED_NOW)


@register("error_documents", f"SELECT {DOC_COLS} FROM {_sql_error_docs()}")
def q_error_documents(spark, sf):
    return _flat(_error_docs_spark(spark, sf))


def _sql_all_docs() -> str:
    return f"(SELECT {DOC_COLS} FROM {_sql_page_docs()} UNION ALL SELECT {DOC_COLS} FROM {_sql_error_docs()})"


def _all_docs_spark(spark, sf):
    return all_documents(_docs_spark(spark, sf), _error_docs_spark(spark, sf))


@register("all_documents", f"SELECT url_hash, domain, status_code, is_active, error_count, error_type FROM {_sql_all_docs()}")
def q_all_documents(spark, sf):
    return _flat(_all_docs_spark(spark, sf)).select("url_hash", "domain", "status_code", "is_active",
                                                    "error_count", "error_type")


def _sql_variant_docs() -> str:
    s = O.normalize(sql_url_variants(), "url", "normalized_url", "vn")
    s = O.authority(s, "url", "domain", "va")
    return f"(SELECT seq, url, sha256(normalized_url) AS url_hash, normalized_url, domain FROM {s})"


def _variant_docs_spark(spark, sf):
    v = with_url_key(derived.url_variants(pages(spark, sf)))
    return v.select("seq", "url", "url_hash", "normalized_url", url_authority("url").alias("domain"))


@register("rejects", f"""
SELECT seq, url, CASE WHEN url IS NULL THEN 'missing url'
  WHEN NOT regexp_matches(url, '^(?i)https?://[^/?#\\s]+') THEN 'url is not an http(s) URL'
  WHEN length(url) > 2083 THEN 'url longer than 2083 characters'
  WHEN url_hash IS NULL THEN 'missing url_hash' WHEN normalized_url IS NULL THEN 'missing normalized_url'
  WHEN domain IS NULL THEN 'missing domain' ELSE '' END AS reason
FROM {_sql_variant_docs()} WHERE reason <> ''
""")
def q_rejects(spark, sf):
    _, rejected = conform_or_reject(_variant_docs_spark(spark, sf))
    return rejected.select("seq", "url", "reason")


# K4: every reason a record can be refused for, on records whose fields are taken away in turn
def _sql_broken_docs() -> str:
    gone = lambda c, k: f"CASE WHEN seq % 7 = {k} THEN NULL ELSE {c} END AS {c}"
    return (f"(SELECT seq, {gone('url', 1)}, {gone('url_hash', 2)}, {gone('normalized_url', 3)}, {gone('domain', 4)} "
            f"FROM (SELECT seq, CASE WHEN seq % 7 = 5 THEN url || repeat('x', 2100) ELSE url END AS url, url_hash, normalized_url, domain "
            f"FROM {_sql_variant_docs()}))")


def _broken_docs_spark(spark, sf) -> DataFrame:
    longer = F.when(F.col("seq") % 7 == 5, F.concat("url", F.repeat(F.lit("x"), 2100))).otherwise(F.col("url"))
    d = _variant_docs_spark(spark, sf).withColumn("url", longer)
    return d.select("seq", *[F.when(F.col("seq") % 7 != k, F.col(c)).alias(c)
                             for k, c in enumerate(("url", "url_hash", "normalized_url", "domain"), 1)])


@register("reject_reasons", f"""
SELECT reason, count(*) AS n_records FROM (
  SELECT CASE WHEN url IS NULL THEN 'missing url'
    WHEN NOT regexp_matches(url, '^(?i)https?://[^/?#\\s]+') THEN 'url is not an http(s) URL'
    WHEN length(url) > 2083 THEN 'url longer than 2083 characters'
    WHEN url_hash IS NULL THEN 'missing url_hash' WHEN normalized_url IS NULL THEN 'missing normalized_url'
    WHEN domain IS NULL THEN 'missing domain' ELSE '' END AS reason FROM {_sql_broken_docs()})
WHERE reason <> '' GROUP BY reason
""")
def q_reject_reasons(spark, sf):
    _, rejected = conform_or_reject(_broken_docs_spark(spark, sf))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"))


@register("sink_stats", f"""
SELECT count(DISTINCT url_hash) FILTER (WHERE ok) AS processed,
       count(*) FILTER (WHERE ok) - count(DISTINCT url_hash) FILTER (WHERE ok) AS dropped,
       count(*) FILTER (WHERE NOT ok) AS errors
FROM (SELECT url_hash, (url IS NOT NULL AND regexp_matches(url, '^(?i)https?://[^/?#\\s]+') AND length(url) <= 2083
       AND url_hash IS NOT NULL AND normalized_url IS NOT NULL AND domain IS NOT NULL) AS ok FROM {_sql_variant_docs()})
""")
def q_sink_stats(spark, sf):
    return sink_stats(_variant_docs_spark(spark, sf))


# ------------------------------------------------------------ A4, A5, A7 stats

def _sql_keyed_fetch_log() -> str:
    s = O.normalize(sql_fetch_log(), "url", "fn", "fk")
    return f"(SELECT *, sha256(fn) AS h FROM {s})"


@register("crawl_stats", f"""
SELECT run_id, min(ts) AS start_time, max(ts) AS end_time,
  count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS urls_processed,
  count(*) FILTER (WHERE error IS NOT NULL OR (status IS NOT NULL AND NOT (status BETWEEN 200 AND 299))) AS urls_failed,
  count(DISTINCT h) AS new_urls_found, count(*) - count(DISTINCT h) AS duplicate_urls, count(*) AS total_requests,
  round(avg(response_ms), 6) AS average_response_time,
  array_to_string(list_sort(list(DISTINCT error) FILTER (WHERE error IS NOT NULL)), '|') AS errors, '' AS keywords
FROM {_sql_keyed_fetch_log()} GROUP BY run_id
""")
def q_crawl_stats(spark, sf):
    s = crawl_stats(fetch_log_spark(spark, sf))
    return s.select("run_id", "start_time", "end_time", "urls_processed", "urls_failed", "new_urls_found",
                    "duplicate_urls", "total_requests", F.round("average_response_time", 6).alias("average_response_time"),
                    F.array_join("errors", "|").alias("errors"), F.array_join("keywords", "|").alias("keywords"))


# A4 with the keywords a run looked for; every fetch names one
_RUN_KEYWORDS = "[" + ", ".join(O.q(k) for k in TAG_KEYWORDS) + "]"


@register("crawl_stats_keywords", f"""
SELECT run_id, count(*) AS total_requests, array_to_string(list_sort(list(DISTINCT kw) FILTER (WHERE kw IS NOT NULL)), '|') AS keywords
FROM (SELECT run_id, CASE WHEN event_id % 7 < {len(TAG_KEYWORDS)} THEN {_RUN_KEYWORDS}[event_id % 7 + 1] END AS kw FROM {sql_fetch_log()}) GROUP BY run_id
""")
def q_crawl_stats_keywords(spark, sf):
    named = F.get(F.array(*[F.lit(k) for k in TAG_KEYWORDS]), (F.col("event_id") % 7).cast("int"))
    log = fetch_log_spark(spark, sf).withColumn("wanted", F.when(F.col("event_id") % 7 < len(TAG_KEYWORDS), F.array(named)))
    return crawl_stats(log, "wanted").select("run_id", "total_requests", F.array_join("keywords", "|").alias("keywords"))


# A4, A5: every error text of a run or proxy in full, however many there are
@register("error_counts", f"""
SELECT 'run ' || run_id AS of_what, error, count(*) AS n_errors, min(ts) AS first_seen, max(ts) AS last_seen
FROM {sql_fetch_log()} WHERE error IS NOT NULL GROUP BY run_id, error
UNION ALL SELECT proxy_address AS of_what, error, count(*) AS n_errors, min(ts) AS first_seen, max(ts) AS last_seen
FROM {sql_fetch_log()} WHERE error IS NOT NULL GROUP BY proxy_address, error
""")
def q_error_counts(spark, sf):
    log = fetch_log_spark(spark, sf)
    runs = error_counts(log, "run_id").withColumn("run_id", F.concat(F.lit("run "), "run_id")).withColumnRenamed("run_id", "of_what")
    return runs.unionByName(error_counts(log, "proxy_address").withColumnRenamed("proxy_address", "of_what"))


@register("proxy_health", f"""
SELECT proxy_address, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS success_count,
  count(*) FILTER (WHERE error IS NOT NULL OR (status IS NOT NULL AND NOT (status BETWEEN 200 AND 299))) AS failure_count,
  round(avg(response_ms), 6) AS average_response_time, max(ts) AS last_used,
  NOT coalesce(bool_or(status IN (403, 429)), FALSE) AS is_active,
  array_to_string(list_sort(list(DISTINCT error) FILTER (WHERE error IS NOT NULL)), '|') AS error_messages
FROM {sql_fetch_log()} GROUP BY proxy_address
""")
def q_proxy_health(spark, sf):
    s = proxy_health(fetch_log_spark(spark, sf))
    return s.select("proxy_address", "success_count", "failure_count",
                    F.round("average_response_time", 6).alias("average_response_time"), "last_used", "is_active",
                    F.array_join("error_messages", "|").alias("error_messages"))


@register("domain_summary", f"""
SELECT domain, count(*) AS n_docs, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM {_sql_all_docs()} GROUP BY domain
""")
def q_domain_summary(spark, sf):
    return domain_summary(_all_docs_spark(spark, sf))


# ------------------------------------------------------------ G4, G5 queues

from ..operators.frontier import recrawl_due, retry_queue  # noqa: E402


def _sql_last_fetch() -> str:
    order = "{'t': ts, 'a': attempt}"
    k = f"(SELECT *, {order} AS o FROM {_sql_keyed_fetch_log()} WHERE fn IS NOT NULL)"
    ok = f"(SELECT h AS okh, max(CASE WHEN status BETWEEN 200 AND 299 THEN o END) AS okv FROM {k} GROUP BY h)"
    return (f"(SELECT h AS url_hash, arg_min(url, o) AS url, count(*) AS attempts, "
            f"count(*) FILTER (WHERE okv IS NULL OR o > okv) AS trailing_failures, "
            f"arg_max_null(status, o) AS last_status, arg_max_null(error, o) AS last_error, max(ts) AS last_ts, "
            f"max(okv.t) AS last_ok_ts FROM {k} JOIN {ok} ON okh = h GROUP BY h)")


@register("retry_queue", f"""
SELECT url_hash, url, attempts, trailing_failures, last_status, last_error, last_ts, trailing_failures + 1 AS next_attempt
FROM {_sql_last_fetch()}
WHERE (last_status IN (500, 502, 503, 504, 408, 429) OR (last_status IS NULL AND last_error IS NOT NULL))
  AND trailing_failures <= 3
""")
def q_retry_queue(spark, sf):
    return retry_queue(fetch_log_spark(spark, sf, with_attempt=True))


@register("recrawl_due", f"""
SELECT url_hash, url, last_status, last_ts, last_ok_ts, reason FROM (
  SELECT *, CASE WHEN last_status IN (401, 403, 404, 429, 500, 502, 503, 504) THEN 'not cacheable'
    WHEN last_status IS NULL AND last_error IS NOT NULL THEN 'failed'
    WHEN last_ok_ts IS NULL OR last_ok_ts + INTERVAL 86400 SECOND <= {NOW_SQL} THEN 'expired' END AS reason
  FROM {_sql_last_fetch()}) WHERE reason IS NOT NULL
""")
def q_recrawl_due(spark, sf):
    return recrawl_due(fetch_log_spark(spark, sf, with_attempt=True), derived.FIXED_NOW)


# ------------------------------------------------------------ G1, G2 BFS

from ..operators.frontier import cap, expand, frontier_batch, intake  # noqa: E402
from ..spec import HarvestSpec  # noqa: E402


def _edges_spark(spark, sf):
    p = pages(spark, sf)
    return derived.link_table(p, derived.page_edges(p))


def _seeds_spark(spark, sf):
    """One entry page per site: the smallest page id of every canonical host."""
    p = pages(spark, sf).select("page_id", "url", canonical_domain("url").alias("host"))
    return (p.groupBy("host").agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("seq"))
            .select("seq", "url"))


def _bfs_spark(spark, sf, depth):
    spec = HarvestSpec(allowed_domains=None, max_depth=depth)
    return expand(_seeds_spark(spark, sf), _edges_spark(spark, sf), spec).nodes


def _sql_site_seed_urls() -> str:
    return (f"(SELECT arg_min(url, page_id) AS url FROM "
            f"{O.registrable('pages', 'url', 'reg', 'sr', DEFAULT_PUBLIC_SUFFIXES)} GROUP BY reg)")


def sql_bfs_ctes(depth: int, seed_urls: str | None = None, allow_from_seeds: bool = False, only: str = "TRUE") -> str:
    """CTEs ``e`` (filtered edges), ``seeds``, ``walk`` and ``nodes`` for a BFS to ``depth``."""
    n = (f"(SELECT (SELECT count(*) FROM pages) AS n)")
    lk = (f"(SELECT ps.url AS src_url, pd.url AS dst_url, CAST(k AS INTEGER) AS pos FROM pages ps, "
          f"(SELECT range AS k FROM range(0, 3)) kk, {n} nn, pages pd "
          f"WHERE pd.page_id = (ps.page_id * 3 + k * 7 + 1) % nn.n)")
    s = O.validate(lk, "dst_url", "ok", "why", "bv")
    s = f"(SELECT * FROM {s} WHERE ok AND ({only}) AND NOT regexp_matches(dst_url, {O.q(DENY_PATTERN)}))"
    if allow_from_seeds:
        sa = O.authority(seed_urls, "url", "sauth", "sa")
        s = O.authority(s, "dst_url", "dauth", "da")
        s = (f"(SELECT * FROM {s} WHERE lower(dauth) <> '' AND EXISTS (SELECT 1 FROM {sa} "
             f"WHERE sauth <> '' AND (lower(dauth) = lower(sauth) OR ends_with(lower(dauth), '.' || lower(sauth)))))")
    s = O.normalize(s, "dst_url", "dst_norm", "bd")
    s = O.normalize(s, "src_url", "src_norm", "bs")
    e = (f"SELECT sha256(src_norm) AS src_hash, sha256(dst_norm) AS dst_hash, dst_url, dst_norm, src_url, pos "
         f"FROM {s} WHERE dst_norm IS NOT NULL AND src_norm IS NOT NULL")
    if seed_urls is None:
        sd = O.domain("pages", "url", "host", "sh")
        sd = f"(SELECT arg_min(url, page_id) AS url FROM {sd} GROUP BY host)"
    else:
        sd = seed_urls
    sd = O.normalize(sd, "url", "nurl", "sn")
    seeds = (f"SELECT sha256(nurl) AS url_hash, min(url) AS url, arg_min(nurl, url) AS normalized_url "
             f"FROM {sd} WHERE nurl IS NOT NULL GROUP BY sha256(nurl)")
    return (f"WITH RECURSIVE e AS ({e}), seeds AS ({seeds}), "
            f"walk(node, depth) AS (SELECT url_hash, 0 FROM seeds UNION ALL "
            f"SELECT e.dst_hash, w.depth + 1 FROM walk w JOIN e ON e.src_hash = w.node WHERE w.depth < {depth}), "
            f"mind AS (SELECT node, min(depth) AS d FROM walk GROUP BY node), "
            f"ref AS (SELECT e.dst_hash, arg_min({{'u': e.dst_url, 'n': e.dst_norm, 's': e.src_url, 'h': e.src_hash}}, "
            f"{{'h': e.src_hash, 'p': e.pos}}) AS b FROM e JOIN mind pm ON pm.node = e.src_hash "
            f"JOIN mind cm ON cm.node = e.dst_hash WHERE pm.d = cm.d - 1 GROUP BY e.dst_hash), "
            f"nodes AS (SELECT url_hash, url, normalized_url, 0 AS depth, CAST(NULL AS VARCHAR) AS source_url, "
            f"CAST(NULL AS VARCHAR) AS source_hash FROM seeds UNION ALL "
            f"SELECT m.node, r.b.u, r.b.n, m.d, r.b.s, r.b.h FROM mind m JOIN ref r ON r.dst_hash = m.node WHERE m.d > 0) ")


@register("expand_bfs", sql_bfs_ctes(3) + "SELECT url_hash, url, normalized_url, depth, source_url, source_hash FROM nodes")
def q_expand_bfs(spark, sf):
    return _bfs_spark(spark, sf, 3)


@register("expand_once", sql_bfs_ctes(1) + "SELECT url_hash, url, normalized_url, depth, source_url, source_hash FROM nodes")
def q_expand_once(spark, sf):
    return _bfs_spark(spark, sf, 1)


# U2: links that a filter of the user's refuses are not followed
@register("expand_filtered", sql_bfs_ctes(3, only="length(dst_url) % 3 <> 0")
          + "SELECT url_hash, url, normalized_url, depth, source_url, source_hash FROM nodes")
def q_expand_filtered(spark, sf):
    spec = HarvestSpec(allowed_domains=None, max_depth=3, link_filter=lambda url: F.length(url) % 3 != 0)
    return expand(_seeds_spark(spark, sf), _edges_spark(spark, sf), spec).nodes


EXPAND_CAP = 60


@register("expand_capped", sql_bfs_ctes(3) + "SELECT url_hash, url, normalized_url, depth, source_url, source_hash FROM nodes "
          f"ORDER BY depth, url_hash LIMIT {EXPAND_CAP}")
def q_expand_capped(spark, sf):
    spec = HarvestSpec(allowed_domains=None, max_depth=3, max_urls=EXPAND_CAP)
    return expand(_seeds_spark(spark, sf), _edges_spark(spark, sf), spec).nodes


# ------------------------------------------------------------ W3, G6, L1

def _sql_batch(per_host: int, total: int | None) -> str:
    s = O.hostname("pages", "url", "host", "fh")
    ranked = (f"(SELECT page_id AS seq, url, host, CAST(row_number() OVER (PARTITION BY host ORDER BY page_id) AS INTEGER) "
              f"AS host_rank FROM {s})")
    body = (f"SELECT seq, url, host, host_rank, {NOW_SQL} + to_microseconds(CAST((host_rank - 1) * 500000 AS BIGINT)) "
            f"AS not_before FROM {ranked} WHERE host_rank <= {per_host}")
    if total is not None:
        body += f" ORDER BY seq, host LIMIT {total}"
    return body


def _batch_spark(spark, sf, per_host, total):
    p = pages(spark, sf).select(F.col("page_id").alias("seq"), "url", F.lit(0).alias("depth"))
    b = frontier_batch(p, per_host=per_host, total=total, now=derived.FIXED_NOW)
    return b.select("seq", "url", "host", F.col("host_rank").cast("int").alias("host_rank"), "not_before")


@register("frontier_batch", _sql_batch(16, 32))
def q_frontier_batch(spark, sf):
    return _batch_spark(spark, sf, 16, 32)


@register("frontier_hosts", _sql_batch(2, None))
def q_frontier_hosts(spark, sf):
    return _batch_spark(spark, sf, 2, None)


# W3, G6 with both quotas: hosts share addresses by the length of their names
def _sql_addressed(per_host: int, per_address: int) -> str:
    s = O.hostname(sql_url_variants(), "url", "host", "fh")
    r = (f"(SELECT seq, url, host, '10.0.0.' || CAST(length(host) % 9 AS VARCHAR) AS address, "
         f"CAST(row_number() OVER (PARTITION BY host ORDER BY seq, url) AS INTEGER) AS host_rank FROM {s} "
         f"WHERE regexp_matches(ltrim(url), '^(?i)https?://') AND coalesce(host, '') <> '')")
    return (f"SELECT seq, url, host, address, host_rank, address_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY address "
            f"ORDER BY seq, url, host) AS INTEGER) AS address_rank FROM {r} WHERE host_rank <= {per_host}) WHERE address_rank <= {per_address}")


@register("frontier_batch_addresses", _sql_addressed(16, 64))
def q_frontier_batch_addresses(spark, sf):
    rows = derived.url_variants(pages(spark, sf)).select("seq", "url")
    hosts = rows.select(url_hostname("url").alias("host")).distinct()
    known = hosts.select("host", F.concat(F.lit("10.0.0."), (F.length("host") % 9).cast("string")).alias("address"))
    b = frontier_batch(rows, per_host=16, total=None, now=derived.FIXED_NOW, addresses=known, per_address=64)
    return b.select("seq", "url", "host", "address", F.col("host_rank").cast("int").alias("host_rank"),
                    F.col("address_rank").cast("int").alias("address_rank"))


# S5: the queue dealt over tasks by host, hot hosts over several
@register("intake", f"SELECT seq, url, coalesce(host, '') AS host FROM {O.hostname(sql_url_variants(), 'url', 'host', 'ih')}")
def q_intake(spark, sf):
    return intake(derived.url_variants(pages(spark, sf)).select("seq", "url"), 16)


@register("cap", f"SELECT url_hash, normalized_url, url, page_id, pos FROM {_sql_unique_links()} ORDER BY page_id, pos, url_hash LIMIT 100")
def q_cap(spark, sf):
    return cap(_unique_links_spark(spark, sf), 100, ["page_id", "pos", "url_hash"])


# ------------------------------------------------------------ Q1-Q4 look-ups, K1, K8

from ..operators.store import (UrlStore, append_unique, by_domain, by_hash, by_time,  # noqa: E402
                               found_urls)


def _lookup_cols(d):
    return _flat(d).select("url_hash", "url", "domain", "timestamp", "status_code", "keywords")


LOOKUP_SQL_COLS = "url_hash, url, domain, timestamp, status_code, keywords"


def _doc_store(spark, sf) -> UrlStore:
    """All documents written to a clustered store of this query; the look-up reads the store."""
    store = UrlStore(spark, _scratch(spark, "docstore"))
    store.write_clustered(_all_docs_spark(spark, sf))
    return store


@register("by_hash", f"""
SELECT {LOOKUP_SQL_COLS} FROM {_sql_all_docs()} WHERE url_hash IN (
  SELECT url_hash FROM {_sql_last_fetch()}
  WHERE (last_status IN (500, 502, 503, 504, 408, 429) OR (last_status IS NULL AND last_error IS NOT NULL))
    AND trailing_failures <= 3)
""")
def q_by_hash(spark, sf):
    keys = retry_queue(fetch_log_spark(spark, sf, with_attempt=True)).select("url_hash")
    return _lookup_cols(by_hash(_doc_store(spark, sf).read(), keys))


@register("by_domain", f"""
SELECT {LOOKUP_SQL_COLS} FROM {_sql_all_docs()} WHERE domain = (
  SELECT domain FROM {_sql_all_docs()} GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1)
""")
def q_by_domain(spark, sf):
    docs = _doc_store(spark, sf).read()
    top = docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("domain")).first()
    return _lookup_cols(by_domain(docs, top["domain"]))


@register("by_time", f"""
SELECT {LOOKUP_SQL_COLS} FROM {_sql_all_docs()}
WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-10 00:00:00'
""")
def q_by_time(spark, sf):
    return _lookup_cols(by_time(_doc_store(spark, sf).read(), "2024-01-05 00:00:00", "2024-01-10 00:00:00"))


@register("by_keyword", f"SELECT {LOOKUP_SQL_COLS} FROM {_sql_all_docs()} WHERE list_contains(string_split(keywords, '|'), 'der')")
def q_by_keyword(spark, sf):
    return _lookup_cols(_doc_store(spark, sf).by_keyword("der"))


@register("found_urls", f"SELECT url, domain, depth, timestamp AS found_date FROM {_sql_page_docs()}")
def q_found_urls(spark, sf):
    return found_urls(_docs_spark(spark, sf))


@register("append_unique", f"""
SELECT url_hash, url FROM {_sql_page_docs()}
UNION ALL
SELECT url_hash, arg_min(url, seq) AS url FROM {_sql_variant_docs()}
WHERE url_hash IS NOT NULL AND url_hash NOT IN (SELECT url_hash FROM {_sql_page_docs()} WHERE url_hash IS NOT NULL)
GROUP BY url_hash
""")
def q_append_unique(spark, sf):
    store = _docs_spark(spark, sf).select("url_hash", "url")
    new = _variant_docs_spark(spark, sf).select("url_hash", "url", "seq")
    return append_unique(store, new, "url_hash", order="seq").select("url_hash", "url")


@register("store_roundtrip", f"SELECT {DOC_COLS} FROM {_sql_page_docs()}")
def q_store_roundtrip(spark, sf):
    import uuid

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    store = UrlStore(spark, path)
    store.write_clustered(_docs_spark(spark, sf))
    return _flat(store.read().drop("day"))


# ------------------------------------------------------------ F7, J6 registrable domain

from ..operators.domains import registrable_domain  # noqa: E402
from ..spec import DEFAULT_PUBLIC_SUFFIXES  # noqa: E402


def _sql_suffix_rows() -> str:
    hosts = "[" + ", ".join(O.q(h) for h in derived.SUFFIX_HOSTS) + "]"
    path = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    return (f"(SELECT * FROM {_sql_validation_rows()} UNION ALL SELECT 'suffix' AS source, page_id AS seq, "
            f"'https://' || {hosts}[CAST(page_id % {len(derived.SUFFIX_HOSTS)} AS BIGINT) + 1] || {path} AS url FROM pages)")


@register("registrable_domains", f"""
SELECT source, seq, registrable_domain
FROM {O.registrable(_sql_suffix_rows(), 'url', 'registrable_domain', 'rg', DEFAULT_PUBLIC_SUFFIXES)}
""")
def q_registrable_domains(spark, sf):
    s = derived.suffix_urls(pages(spark, sf)).select(F.lit("suffix").alias("source"), "seq", "url")
    return registrable_domain(validation_rows(spark, sf).unionByName(s)).select("source", "seq", "registrable_domain")


# ------------------------------------------------------------ T1-T6 streams

from ..streaming import streams as S  # noqa: E402


def _scratch(spark, tag: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


STREAM_ROWS_PER_FILE = 100_000


def _stream_of(spark, df, order_col: str, tag: str):
    path = _scratch(spark, tag)
    S.ordered_stream_files(df, path, order_col, STREAM_ROWS_PER_FILE)
    return S.spread(spark.readStream.schema(spark.read.parquet(path).schema)
                    .option("maxFilesPerTrigger", 1).parquet(path))


def _variant_stream(spark, sf):
    return _stream_of(spark, derived.url_variants(pages(spark, sf)), "seq", "variants")


@register("stream_documents", f"SELECT {DOC_COLS} FROM {_sql_page_docs()}")
def q_stream_documents(spark, sf):
    src = _stream_of(spark, rich(spark, sf), "page_id", "pages")
    docs = page_documents(src, TAG_KEYWORDS, derived.FIXED_NOW)
    return _flat(S.run_to_table(docs, _scratch(spark, "stream-documents")))


@register("stream_unique", f"SELECT DISTINCT hash_value FROM {_sql_verdicts()}")
def q_stream_unique(spark, sf):
    keyed = S.keyed_urls(_variant_stream(spark, sf))
    return S.run_to_table(S.stream_unique(keyed, "hash_value"), _scratch(spark, "stream-unique")).select("hash_value")


TTL_S = 18 * 3600


def _sql_ttl_verdicts() -> str:
    k = O.query_pass(O.normalize(f"(SELECT event_id AS seq, url, ts FROM {sql_fetch_log()})", "url", "n1", "n"), "n1", "n2", "d")
    k = f"(SELECT seq, url, ts, n2, sha256(n2) AS hash_value FROM {k})"
    k = (f"(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY hash_value ORDER BY ts, seq) <= INTERVAL {TTL_S} SECOND THEN 0 ELSE 1 END AS fresh FROM {k})")
    k = f"(SELECT *, sum(fresh) OVER (PARTITION BY hash_value ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM {k})"
    return (f"(SELECT seq, url, hash_value, n2 AS normalized_url, row_number() OVER "
            f"(PARTITION BY hash_value, session ORDER BY ts, seq) AS seen_count FROM {k})")


def _ttl_verdicts(spark, sf):
    log = fetch_log_spark(spark, sf).select(F.col("event_id").alias("seq"), "url", "ts")
    folder = _scratch(spark, "stream-ttl")
    S.run_verdicts(_stream_of(spark, log, "ts", "fetches"), folder, ts_col="ts", ttl_s=TTL_S).awaitTermination()
    return S.read_verdicts(spark, folder)


@register("stream_unique_ttl", f"SELECT seq, url, hash_value FROM {_sql_ttl_verdicts()} WHERE seen_count = 1")
def q_stream_unique_ttl(spark, sf):
    return _ttl_verdicts(spark, sf).where(~F.col("is_duplicate")).select("seq", "url", "hash_value")


@register("stream_verdicts_ttl", f"""
SELECT seq, url, hash_value, normalized_url, seen_count > 1 AS is_duplicate,
       CASE WHEN seen_count > 1 THEN 'Exact duplicate' END AS reason, seen_count FROM {_sql_ttl_verdicts()}
""")
def q_stream_verdicts_ttl(spark, sf):
    return _ttl_verdicts(spark, sf)


def _run_variant_verdicts(spark, sf) -> str:
    folder = _scratch(spark, "stream-verdicts")
    S.run_verdicts(_variant_stream(spark, sf).select("seq", "url"), folder).awaitTermination()
    return folder


@register("stream_verdicts", f"SELECT seq, url, hash_value, normalized_url, is_duplicate, reason, seen_count FROM {_sql_verdicts()}")
def q_stream_verdicts(spark, sf):
    return S.read_verdicts(spark, _run_variant_verdicts(spark, sf))


@register("stream_store", f"SELECT DISTINCT url_hash FROM {_sql_variant_docs()} WHERE url_hash IS NOT NULL")
def q_stream_store(spark, sf):
    src = _variant_stream(spark, sf)
    docs = with_url_key(src).select("seq", "url", "url_hash", "normalized_url", url_authority("url").alias("domain"),
                                    F.lit(derived.FIXED_NOW).cast("timestamp_ntz").alias("timestamp"))
    # a micro-batch's keys fall into all buckets, so their number follows its size, not that of the whole input
    store = UrlStore(spark, _scratch(spark, "store"), key_buckets=S.KEY_BUCKETS)
    q = S.stream_store(docs, store, _scratch(spark, "ckpt"), order="seq")
    q.awaitTermination()
    return store.read().select("url_hash")


@register("stream_stats", f"""
SELECT count(*) AS total_urls, count(*) FILTER (WHERE reason = 'Exact duplicate') AS duplicates,
       count(*) FILTER (WHERE NOT is_duplicate) AS unique_urls FROM {_sql_verdicts()}
""")
def q_stream_stats(spark, sf):
    return S.stream_stats(spark, _run_variant_verdicts(spark, sf))


# ------------------------------------------------------------ G3 harvest

from .harvest import harvest  # noqa: E402


def _sql_harvest() -> str:
    kp = O.normalize(sql_rich_pages(), "url", "pn", "hk")
    first = (f"(SELECT sha256(pn) AS ph, arg_min(url, page_id) AS url, arg_min(html, page_id) AS html, arg_min(status, page_id) AS status, "
             f"arg_min_null(ctype, page_id) AS ctype FROM {kp} WHERE pn IS NOT NULL AND status BETWEEN 200 AND 299 GROUP BY sha256(pn))")
    reached = f"(SELECT f.url, f.html, f.status, f.ctype, n.depth AS n_depth, n.source_url AS n_source FROM {first} f JOIN nodes n ON n.url_hash = f.ph)"
    return sql_bfs_ctes(3) + f"SELECT {DOC_COLS} FROM {_sql_page_docs(reached, 'n_depth', 'n_source')}"


@register("harvest", _sql_harvest())
def q_harvest(spark, sf):
    spec = HarvestSpec(allowed_domains=None, keywords=TAG_KEYWORDS, max_depth=3)
    res = harvest(rich(spark, sf), _edges_spark(spark, sf), _seeds_spark(spark, sf), spec, now=derived.FIXED_NOW)
    return _flat(res.documents)


# U1: the documents pass through a hook of the user's before they are checked; those whose URL it takes are rejected
@register("harvest_hook", _sql_harvest().replace(f"SELECT {DOC_COLS} FROM", "SELECT url_hash, 'hook: ' || title AS title, depth FROM", 1)
          + " WHERE depth <> 1")
def q_harvest_hook(spark, sf):
    spec = HarvestSpec(allowed_domains=None, keywords=TAG_KEYWORDS, max_depth=3)
    hook = lambda d: d.withColumns({"title": F.concat(F.lit("hook: "), "title"), "url": F.when(F.col("depth") != 1, F.col("url"))})
    res = harvest(rich(spark, sf), _edges_spark(spark, sf), _seeds_spark(spark, sf), spec, now=derived.FIXED_NOW, on_documents=hook)
    return _flat(res.documents).select("url_hash", "title", "depth")


# ------------------------------------------------------------ S4, P2 in G1: allowed domains from the seeds

def _site_seeds_spark(spark, sf):
    """One entry page per registrable domain (smallest page id)."""
    p = registrable_domain(pages(spark, sf).select("page_id", "url"))
    return (p.groupBy("registrable_domain").agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("seq"))
            .select("seq", "url"))


@register("expand_site", sql_bfs_ctes(3, _sql_site_seed_urls(), allow_from_seeds=True)
          + "SELECT url_hash, url, normalized_url, depth, source_url, source_hash FROM nodes")
def q_expand_site(spark, sf):
    spec = HarvestSpec(allowed_domains=(), max_depth=3)   # () = the seeds' authorities
    return expand(_site_seeds_spark(spark, sf), _edges_spark(spark, sf), spec).nodes


# ------------------------------------------------------------ F13, J5 on the long-text corpus

def _sql_doc_tags() -> str:
    return f"(SELECT doc_id, {O.find_keywords('lower(text)', TAG_KEYWORDS)} AS kw FROM documents)"


@register("keyword_tags_documents", f"SELECT doc_id, array_to_string(kw, '|') AS keywords FROM {_sql_doc_tags()}")
def q_keyword_tags_documents(spark, sf):
    from ..functions.html import find_keywords
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(find_keywords(F.lower("text"), TAG_KEYWORDS), "|").alias("keywords"))


@register("keyword_join_documents", """
SELECT doc_id, array_to_string(list_sort(list_filter(kws, lambda k: instr(lower(text), lower(k)) > 0)), '|') AS keywords
FROM documents, """ + SQL_KEYWORDS)
def q_keyword_join_documents(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return match_keywords(d, _keyword_table(spark, sf), "text").select("doc_id", F.array_join("keywords", "|").alias("keywords"))


# the same tags with the table cut into blocks, as tables are that one automaton does not hold
@register("keyword_join_grams", SQL["keyword_join"])
def q_keyword_join_grams(spark, sf):
    p = pages(spark, sf).select("page_id", body_text("html").alias("text"))
    return match_keywords(p, _keyword_table(spark, sf), "text", block_bytes=1000).select(
        "page_id", F.array_join("keywords", "|").alias("keywords"))


# P4 by itself: pages with a status outside 2xx go
@register("ok_pages", f"SELECT page_id, status FROM {sql_rich_pages()} WHERE status BETWEEN 200 AND 299")
def q_ok_pages(spark, sf):
    from ..operators.documents import ok_pages
    return ok_pages(rich(spark, sf)).select("page_id", "status")


# S1: seeds from a table
@register("seeds", "SELECT page_id AS seq, url, 0 AS depth FROM pages WHERE starts_with(url, 'https:')")
def q_seeds(spark, sf):
    from ..sources.tables import seeds_from
    return seeds_from(pages(spark, sf).where(F.col("url").startswith("https:")), "url", "page_id")


# the 128-bit key
@register("md5_keys", f"SELECT page_id, md5(n) AS url_key FROM {O.normalize('pages', 'url', 'n', 'm')}")
def q_md5_keys(spark, sf):
    return pages(spark, sf).select("page_id", url_hash(normalize_url("url"), "md5").alias("url_key"))


# K2, K5, L4: a store keyed by the raw URL, few rows per file, read in order of time, domain and key
@register("store_by_url", f"SELECT url, min(domain) AS domain FROM {_sql_page_docs()} GROUP BY url")
def q_store_by_url(spark, sf):
    store = UrlStore(spark, _scratch(spark, "urlstore"), key="url", max_records_per_file=50)
    d = _docs_spark(spark, sf)
    store.append_unique(d.unionByName(d), order="url_hash")
    return store.read().orderBy("timestamp", "domain", "url_hash").select("url", "domain")


# K5: how many rows the files of a store hold
@register("store_file_sizes", "SELECT count(*) AS n_rows, TRUE AS within_bound, count(*) >= 50 AS several_files FROM pages")
def q_store_file_sizes(spark, sf):
    store = UrlStore(spark, _scratch(spark, "filesizes"), max_records_per_file=40)
    store.write_clustered(_docs_spark(spark, sf))
    files = store.file_sizes()
    return files.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 40).alias("within_bound"), (F.count(F.lit(1)) > 1).alias("several_files"))
