"""Breadth-first harvest replay over a link table, work batches and queues."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import List, Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import normalize_url, url_hash, url_hostname, url_parse_ok
from ..functions.validate import validate_url
from ..spec import (CACHE_IGNORE_HTTP_CODES, CACHE_TTL_S, CONCURRENT_REQUESTS, DOWNLOAD_DELAY_S,
                    PER_ADDRESS_REQUESTS, PER_HOST_REQUESTS, RETRY_HTTP_CODES, RETRY_TIMES, HarvestSpec)
from ..sources.tables import default_allowed
from .links import allowed_only, deny_links
from ..session import ensure_checkpoint_dir
from .util import cut_lineage, top_n, with_distinct_url_key, with_url_key


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return now.cast("timestamp_ntz") if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


# --------------------------------------------------------------------- edges

def prepare_edges(links: DataFrame, spec: HarvestSpec, seeds: Optional[DataFrame] = None,
                  partitions: Optional[int] = None) -> DataFrame:
    """Filter and key a link table once: ``(src_hash, dst_hash, dst_url, dst_norm, src_url, pos)``.

    Deny pattern, allowed domains (``spec.allowed_domains``; empty means the
    seeds' authorities, ``None`` every domain), validation and the user's
    ``link_filter`` run here, before any shuffle, as does dropping links of
    pages whose own URL does not canonicalise. The result is written once as
    a bucketed table, so no BFS level shuffles the edges again.
    """
    ln = links.select("src_url", F.col("dst_url").alias("url"), "pos")
    ln = deny_links(ln, spec.deny_pattern, "url")
    allowed = spec.allowed_domains
    if allowed is not None and not isinstance(allowed, DataFrame) and len(allowed) == 0:
        if seeds is None:
            raise ValueError("allowed_domains=() needs the seeds")
        # the seeds' authorities stay a DataFrame: a semi join, never a driver list
        allowed = default_allowed(seeds)
    ln = allowed_only(ln, allowed, "url")
    if spec.link_filter is not None:
        ln = ln.where(spec.link_filter(F.col("url")))
    v = validate_url(F.col("url"), blocked_domains=spec.blocked_domains, max_length=spec.max_url_length)
    ln = ln.where(v["is_valid"])
    # valid links always canonicalise; the raw-text test drops pages whose URL
    # does not, which would all share one null source
    keyed = (ln.where(F.col("src_url").isNotNull() & url_parse_ok("src_url"))
             .withColumn("dst_norm", normalize_url(F.col("url")))
             .withColumn("src_norm", normalize_url(F.col("src_url")))
             .select(url_hash(F.col("src_norm"), spec.hash_algo).alias("src_hash"),
                     url_hash(F.col("dst_norm"), spec.hash_algo).alias("dst_hash"),
                     F.col("url").alias("dst_url"), "dst_norm", "src_url", "pos"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("dst_hash"), F.lit(SOURCE_SALTS)).cast("int"))
    n = partitions or int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _bucketed(salted, n)


#: A page's links lie in this many buckets, so that one page with very many links is no single task.
SOURCE_SALTS = 8


def _bucketed(edges: DataFrame, buckets: int) -> DataFrame:
    """Edges as a table bucketed by ``(src_hash, salt)`` in the shared folder.

    Joins on these columns read the buckets where they lie: only the other
    side is shuffled. The table's name leaves the catalog again; the files
    stay in the folder.
    """
    spark, tag = edges.sparkSession, uuid.uuid4().hex
    name = f"urlatlas_edges_{tag}"
    (edges.repartition(buckets, "src_hash", "salt").write.bucketBy(buckets, "src_hash", "salt").sortBy("src_hash", "salt")
     .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/edges-{tag}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def seed_nodes(seeds: DataFrame, spec: HarvestSpec) -> DataFrame:
    """Seeds as visited nodes at depth 0 (no referrer); they are never re-added."""
    s = with_url_key(seeds.select("url"), "url", algo=spec.hash_algo)
    first = F.min_by(F.struct("url", "normalized_url"), F.col("url")).alias("_f")
    # seeds that do not canonicalise form the null group; an aggregate flag
    # drops it (a filter on the key would be pushed down and copy the key)
    return (s.groupBy("url_hash").agg(first, F.max(F.col("url_hash").isNotNull()).alias("_has_key"))
            .where(F.col("_has_key"))
            .select("url_hash", "_f.url", "_f.normalized_url", F.lit(0).alias("depth"),
                    F.lit(None).cast("string").alias("source_url"),
                    F.lit(None).cast("string").alias("source_hash")))


def expand_once(frontier: DataFrame, edges: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """One BFS step: unseen link targets of the frontier, at ``depth``.

    Each new node keeps one referrer: the parent with the smallest hash
    (ties by link position). ``min_by`` aggregates partially before the
    shuffle on the target, so a much-linked target costs one row per task.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(SOURCE_SALTS - 1))).alias("salt")
    cand = (frontier.select(F.col("url_hash").alias("src_hash"), every)
            .join(edges, ["src_hash", "salt"])
            .groupBy("dst_hash")
            .agg(F.min_by(F.struct("dst_url", "dst_norm", "src_url", "src_hash"),
                          F.struct("src_hash", "pos")).alias("_b")))
    new = cand.join(visited.select(F.col("url_hash").alias("dst_hash")), "dst_hash", "left_anti")
    return new.select(F.col("dst_hash").alias("url_hash"), F.col("_b.dst_url").alias("url"),
                      F.col("_b.dst_norm").alias("normalized_url"), F.lit(depth).alias("depth"),
                      F.col("_b.src_url").alias("source_url"), F.col("_b.src_hash").alias("source_hash"))


@dataclass
class BfsResult:
    nodes: DataFrame
    level_sizes: List[int]


def expand(seeds: DataFrame, links: DataFrame, spec: HarvestSpec = HarvestSpec(allowed_domains=None),
           edges: Optional[DataFrame] = None) -> BfsResult:
    """Replay a harvest: from ``seeds`` over ``links`` to ``spec.max_depth``.

    Every URL once (by canonical hash), depth and referrer kept. The loop
    runs on the driver, one distributed join per level; each level's node
    set is checkpointed to the session's checkpoint folder (survives lost
    executors, cuts lineage). The stop test is one row count per level.
    With ``spec.max_urls`` the output is capped in (depth, url_hash) order;
    by default nothing is cut.
    """
    edges = edges if edges is not None else prepare_edges(links, spec, seeds)
    visited = cut_lineage(seed_nodes(seeds, spec))
    frontier = visited
    sizes = [visited.count()]
    for d in range(1, spec.max_depth + 1):
        new = cut_lineage(expand_once(frontier, edges, visited, d))
        k = new.count()
        if k == 0:
            break
        sizes.append(k)
        # the visited set is the union of checkpointed levels: its lineage is
        # one level deep whatever the depth, without rewriting it each level
        visited = visited.unionByName(new)
        frontier = new
    return BfsResult(cap_levels(visited, sizes, spec.max_urls), sizes)


def cap_levels(nodes: DataFrame, level_sizes: List[int], max_urls: Optional[int]) -> DataFrame:
    """Keep the first ``max_urls`` nodes in (depth, url_hash) order (None: all).

    Whole levels below the cut are kept by a filter; only the level that
    crosses the cap is ordered and limited.
    """
    total = sum(level_sizes)
    if max_urls is None or total <= max_urls:
        return nodes
    cum = 0
    for depth, size in enumerate(level_sizes):
        if cum + size > max_urls:
            head = nodes.where(F.col("depth") < depth)
            rest = top_n(nodes.where(F.col("depth") == depth), max_urls - cum, [F.col("url_hash")])
            return head.unionByName(rest)
        cum += size
    return nodes


def cap(df: DataFrame, n: int, order: Optional[list] = None) -> DataFrame:
    """Hard cap: the first ``n`` rows by ``(depth, seq, url_hash)`` (a top-n report)."""
    order = order or [c for c in ("depth", "seq", "url_hash") if c in df.columns]
    return top_n(df, n, [F.col(c) if isinstance(c, str) else c for c in order])


# ----------------------------------------------------------------- batches

def intake(df: DataFrame, partitions: int, salt_buckets: int = 16, url_col: str = "url") -> DataFrame:
    """Spread a URL queue over ``partitions`` tasks, grouped by host.

    A host is split over ``salt_buckets`` tasks by a hash of the URL, so one
    host holding a large share of the queue does not become one task; with 1
    all rows of a host land together. Adds ``host``.
    """
    host = url_hostname(F.col(url_col))
    out = df.withColumn("host", F.coalesce(host, F.lit("")))
    if salt_buckets > 1:
        salt = F.pmod(F.xxhash64(F.col(url_col)), F.lit(salt_buckets))
        return out.repartition(partitions, "host", salt)
    return out.repartition(partitions, "host")


def frontier_batch(df: DataFrame, per_host: int = PER_HOST_REQUESTS, total: Optional[int] = CONCURRENT_REQUESTS,
                   delay_s: float = DOWNLOAD_DELAY_S, now=None, url_col: str = "url",
                   order: tuple = ("depth", "seq"), addresses: Optional[DataFrame] = None,
                   per_address: int = PER_ADDRESS_REQUESTS) -> DataFrame:
    """Next work batch: at most ``per_host`` per host, ``per_address`` per address, ``total`` overall.

    Adds ``host``, ``host_rank`` and ``not_before`` (``now`` plus one delay
    per earlier request to the same host). With a table ``addresses (host,
    address)`` also ``address`` and ``address_rank``; a host without an
    address is one of its own, of several the smallest counts. URLs are taken
    in ``order`` (ties go by URL) unless their host or address is full; a URL
    that its host refuses does not fill its address. As every host has one
    address, ranking what is left after the hosts' cut gives just that.

    Both ranks are ``row_number <= k`` filters, which Spark plans as partial
    limits before the shuffle, so a host or address with most of the rows
    sends at most its quota per task. URLs that are not http(s) or have no
    host cannot be fetched and are left out.
    """
    order_cols = [*[F.col(c) for c in order if c in df.columns], F.col(url_col)]
    w = Window.partitionBy("host").orderBy(*order_cols)
    fetchable = df.where(F.ltrim(F.col(url_col)).rlike(r"(?i)^https?://"))
    ranked = (fetchable.withColumn("host", F.coalesce(url_hostname(F.col(url_col)), F.lit("")))
              .where(F.col("host") != "")
              .withColumn("host_rank", F.row_number().over(w))
              .where(F.col("host_rank") <= per_host))
    if addresses is not None:
        known = addresses.where(F.col("host").isNotNull() & F.col("address").isNotNull()).groupBy(
            F.lower("host").alias("host")).agg(F.min("address").alias("address"))
        ranked = ranked.join(known, "host", "left").withColumn("address", F.coalesce("address", "host"))
        # after the cut a host has at most per_host rows, so only an address of very many hosts is large
        ranked = (ranked.withColumn("address_rank", F.row_number().over(Window.partitionBy("address").orderBy(*order_cols, "host")))
                  .where(F.col("address_rank") <= per_address))
    ranked = ranked.withColumn(
        "not_before", _now(now) + F.make_dt_interval(secs=((F.col("host_rank") - 1) * F.lit(delay_s)).cast("decimal(18,6)")))
    if total is not None:
        ranked = ranked.orderBy(*order_cols, F.col("host")).limit(total)
    return ranked


# ------------------------------------------------------------------ queues

def _last_fetch(fetch_log: DataFrame, hash_algo: str = "sha256") -> DataFrame:
    """Per canonical URL: last fetch, last good fetch, and failures since it.

    Two passes of partial aggregates, no window: the last good fetch of a URL
    is a map-side combined maximum; joined back, it turns the count of later
    failures into a plain conditional count. The join is salted (a URL's last
    good fetch is repeated per salt), and the counts are summed per (URL, salt)
    where the join left them, so a much-fetched URL is no single task.
    """
    keyed = with_distinct_url_key(fetch_log.select("url", "status", "error", "ts", "attempt"), "url", "_n", "url_hash", hash_algo)
    # read by both passes: keyed once, the URLs' long expressions are not evaluated again
    keyed = cut_lineage(keyed.where(F.col("url_hash").isNotNull()).select(
        "url_hash", "url", "status", "error", F.struct("ts", "attempt").alias("_o"),
        F.coalesce(F.col("status").between(200, 299), F.lit(False)).alias("_ok"),
        F.pmod(F.xxhash64("ts", "attempt"), F.lit(FETCH_SALTS)).cast("int").alias("_salt")))
    good = keyed.where("_ok").groupBy("url_hash").agg(F.max("_o").alias("_last"))
    good = good.select("url_hash", "_last", F.explode(F.sequence(F.lit(0), F.lit(FETCH_SALTS - 1))).alias("_salt"))
    after = F.col("_last").isNull() | (F.col("_o") > F.col("_last"))
    parts = keyed.join(good, ["url_hash", "_salt"], "left").groupBy("url_hash", "_salt").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(after).alias("after"), F.max("_last").alias("ok"), F.min("_o").alias("o0"), F.max("_o").alias("o1"),
        F.min_by("url", "_o").alias("url"), F.max_by("status", "_o").alias("status"), F.max_by("error", "_o").alias("error"))
    return parts.groupBy("url_hash").agg(
        F.min_by("url", "o0").alias("url"), F.sum("n").alias("attempts"), F.sum("after").alias("trailing_failures"),
        F.max_by("status", "o1").alias("last_status"), F.max_by("error", "o1").alias("last_error"),
        F.max("o1.ts").alias("last_ts"), F.max("ok.ts").alias("last_ok_ts"))


#: Parts that the fetches of one URL are joined in.
FETCH_SALTS = 8


def retry_queue(fetch_log: DataFrame, times: int = RETRY_TIMES, codes=RETRY_HTTP_CODES) -> DataFrame:
    """URLs to fetch again: the last fetch failed with a retryable status (or
    got no response) and at most ``times`` fetches failed since the last
    good one, i.e. fewer than ``times`` retries are used up."""
    last = _last_fetch(fetch_log)
    retryable = F.col("last_status").isin(*codes) | (F.col("last_status").isNull() & F.col("last_error").isNotNull())
    return (last.where(retryable & (F.col("trailing_failures") <= times))
            .select("url_hash", "url", "attempts", "trailing_failures", "last_status", "last_error", "last_ts",
                    (F.col("trailing_failures") + 1).alias("next_attempt")))


def recrawl_due(fetch_log: DataFrame, now=None, ttl_s: int = CACHE_TTL_S,
                ignore_codes=CACHE_IGNORE_HTTP_CODES) -> DataFrame:
    """URLs whose cached copy is not usable at ``now``.

    ``not cacheable``: last status in the ignore list; ``failed``: last fetch
    had no response; ``expired``: last good fetch older than ``ttl_s``
    (or none at all).
    """
    last = _last_fetch(fetch_log)
    t = _now(now)
    expired = F.col("last_ok_ts").isNull() | (F.col("last_ok_ts") + F.make_dt_interval(secs=F.lit(ttl_s)) <= t)
    reason = (F.when(F.col("last_status").isin(*ignore_codes), F.lit("not cacheable"))
              .when(F.col("last_status").isNull() & F.col("last_error").isNotNull(), F.lit("failed"))
              .when(expired, F.lit("expired")))
    return (last.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .select("url_hash", "url", "last_status", "last_ts", "last_ok_ts", "reason"))
