"""Duplicate verdicts, first occurrences, frequencies, counters, hot URLs.

Arrival order is always an explicit ``seq`` column (unique per row). The
verdict of a row depends only on the rows with the same key and a smaller
``seq``, so a batch gives exactly what a one-at-a-time loop would give with
an unbounded seen set.

Skew: one URL may own a large share of all rows. Nothing here gathers a
key's rows into one task: first occurrences and counts use partial
(map-side) aggregation, and the running count splits every key into blocks
of ``seq`` (``block_size``) before any per-key ordering.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DEDUP_CACHE_SIZE, EVICTION_KEEP
from .util import cut_lineage, top_n, with_url_key

R_INVALID = "Invalid URL format"
R_DUPLICATE = "Exact duplicate"
DEFAULT_BLOCK = 1 << 20


def running_count(df: DataFrame, key: str, seq: str, out: str = "seen_count",
                  block_size: int = DEFAULT_BLOCK, order: Optional[Sequence[str]] = None,
                  block: Optional[Column] = None) -> DataFrame:
    """Number of rows with the same ``key`` up to and including this row,
    in ``order`` (default: ``seq``).

    Two levels: rows are cut into ``(key, block)`` pieces, the block being
    ``seq // block_size`` or a given monotone ``block`` column (e.g. the day
    of a timestamp). Piece sizes (a map-side combined count) become per-key
    offsets, one row per piece; the rows are shuffled by piece for the join
    with them and ranked where they then lie. No task ever holds more than
    one piece of a key.
    """
    blk = block if block is not None else F.floor(F.col(seq) / F.lit(block_size)).cast("bigint")
    order_cols = [F.col(c) for c in (order or [seq])]
    rows = df.withColumn("_blk", blk)
    sizes = rows.groupBy(key, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_blk", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    joined = rows.join(offsets, [key, "_blk"])
    w_in = Window.partitionBy(key, "_blk").orderBy(*order_cols)
    return (joined.withColumn(out, (F.col("_off") + F.row_number().over(w_in)).cast("bigint"))
            .drop("_blk", "_off"))


def session_count(df: DataFrame, key: str, at: str, seq: str, gap: Optional[int] = None,
                  block_size: int = DEFAULT_BLOCK, carried: Optional[DataFrame] = None) -> tuple[DataFrame, DataFrame]:
    """Running count per key that starts anew after a silence of more than ``gap``.

    ``at`` is a long that orders a key's rows (``seq`` breaks ties); without
    ``gap`` the count never starts anew. ``carried (key, last, count)`` is
    where earlier rows left off. Returns the rows with ``seen_count``, and
    the new ``(key, last, count)`` of every key met.

    A key's rows are cut into blocks of ``block_size`` of ``at``; each block
    is ranked on its own, and the counts that flow from block to block are
    settled on one row per block, so no task holds more than one block of a key.
    """
    one = Window.partitionBy(key, "_blk").orderBy(at, seq)
    upto = one.rowsBetween(Window.unboundedPreceding, 0)
    silent = F.lit(False) if gap is None else F.coalesce(F.col(at) - F.lag(at).over(one) > gap, F.lit(False))
    rows = (df.withColumn("_blk", F.floor(F.col(at) / F.lit(block_size)).cast("bigint"))
            .withColumn("_rn", F.row_number().over(one)).withColumn("_new", silent)
            .withColumn("_off", F.max(F.when(F.col("_new"), F.col("_rn") - 1).otherwise(0)).over(upto))
            .withColumn("_cut", F.max(F.col("_new")).over(upto)))
    rows = cut_lineage(rows.drop("_new"))
    blocks = rows.groupBy(key, "_blk").agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"),
        (F.count(F.lit(1)) - F.max("_off")).alias("_tail"), F.max("_cut").alias("_broken"))
    if carried is not None:
        old = carried.select(
            key, F.lit(None).cast("bigint").alias("_blk"), F.col("last").alias("_first"), F.col("last").alias("_last"),
            F.col("count").alias("_n"), F.col("count").alias("_tail"), F.lit(True).alias("_broken"))
        blocks = blocks.unionByName(old)
    per_key = Window.partitionBy(key).orderBy(F.col("_blk").asc_nulls_first())  # one row per block
    linked = F.lag("_last").over(per_key).isNotNull()
    if gap is not None:
        linked = linked & (F.col("_first") - F.lag("_last").over(per_key) <= gap)
    base = F.when(linked & F.lag("_broken").over(per_key), F.lag("_tail").over(per_key)).otherwise(F.lit(0))
    blocks = (blocks.withColumn("_base", base)
              .withColumn("_reset", (~linked | F.lag("_broken").over(per_key)).cast("int"))
              .withColumn("_grp", F.sum("_reset").over(per_key)))
    group = Window.partitionBy(key, "_grp").orderBy(F.col("_blk").asc_nulls_first())
    before = F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_in", F.first("_base").over(group.rowsBetween(Window.unboundedPreceding, 0)) + before)
    blocks = cut_lineage(blocks.withColumn("_out", F.when(F.col("_broken"), F.col("_tail")).otherwise(F.col("_in") + F.col("_n"))))
    flow = blocks.where(F.col("_blk").isNotNull()).select(key, "_blk", "_in")
    counted = rows.join(flow, [key, "_blk"]).withColumn(
        "seen_count", (F.col("_rn") - F.col("_off") + F.when(F.col("_cut"), F.lit(0)).otherwise(F.col("_in"))).cast("bigint"))
    # a key without a block of its own was carried, not met
    now = (blocks.groupBy(key).agg(F.max_by(F.struct("_last", "_out"), F.coalesce("_blk", F.lit(-(1 << 62)))).alias("_s"),
                                   F.count("_blk").alias("_met")).where("_met > 0"))
    return (counted.drop("_blk", "_rn", "_off", "_cut", "_in"),
            now.select(key, F.col("_s._last").alias("last"), F.col("_s._out").alias("count")))


def dedup_verdicts(df: DataFrame, url_col: str = "url", seq_col: str = "seq",
                   block_size: int = DEFAULT_BLOCK, materialize: bool = True) -> DataFrame:
    """Verdict for every row, in arrival order.

    Adds ``is_duplicate``, ``hash_value``, ``normalized_url``, ``reason`` and
    ``seen_count`` (running frequency of the key at this arrival). A URL
    that cannot be canonicalised is a duplicate with reason
    ``Invalid URL format``, empty hash and its own text as normalized URL.

    The running count reads the keyed rows twice (block sizes, ranking);
    column pruning makes the two reads differ, so Spark would canonicalise
    every URL twice. ``materialize`` checkpoints the keyed rows once instead
    (writing a few columns costs far less than the regex work).
    """
    keyed = with_url_key(df, url_col, "normalized_url", "hash_value", dedup_pass=True, empty_for_invalid=True)
    if materialize:
        keyed = cut_lineage(keyed)
    counted = running_count(keyed, "hash_value", seq_col, "seen_count", block_size)
    invalid = F.col("hash_value") == ""
    return (counted
            .withColumn("is_duplicate", invalid | (F.col("seen_count") > 1))
            .withColumn("reason", F.when(invalid, F.lit(R_INVALID))
                        .when(F.col("seen_count") > 1, F.lit(R_DUPLICATE)))
            .withColumn("normalized_url", F.when(invalid, F.col(url_col)).otherwise(F.col("normalized_url")))
            .withColumn("seen_count", F.when(invalid, F.lit(None).cast("bigint")).otherwise(F.col("seen_count"))))


def unique_urls(df: DataFrame, key: str = "url_hash", seq_col: str | Column = "seq") -> DataFrame:
    """First occurrence per key (by ``seq``, a name or a struct of columns), all columns kept.

    ``min_by`` is computed partially on the map side, so a hot key sends one
    row per partition to the shuffle, not all of its rows.
    """
    cols = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(seq_col) if isinstance(seq_col, str) else seq_col).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*df.columns)


def url_frequency(df: DataFrame, key: str = "url_hash", seq_col: str = "seq",
                  url_col: str = "normalized_url") -> DataFrame:
    """``(key, frequency, first_seq, url)`` per key."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(seq_col).alias("first_seq"),
        F.min_by(F.col(url_col), F.col(seq_col)).alias(url_col))


def hot_urls(freq: DataFrame, cap: int = DEDUP_CACHE_SIZE, keep: float = EVICTION_KEEP) -> DataFrame:
    """What survives an eviction: the most frequent ``int(cap * keep)`` keys.

    Ties go to the key seen first. Below the cap nothing is evicted and all
    keys stay. The kept set is a top-k report: its size is the limit.
    """
    n_keep = int(cap * keep)
    total = freq.count()
    if total < cap:
        return freq
    # first_seq is unique per key, so the order has no ties
    return top_n(freq, n_keep, [F.col("frequency").desc(), F.col("first_seq").asc()])


def dedup_stats(verdicts: DataFrame, now=None) -> DataFrame:
    """Counters of a verdict table: total, duplicates, unique, cache size, evictions, timestamp."""
    ts = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    return verdicts.agg(
        F.count(F.lit(1)).alias("total_urls"),
        F.count_if(F.col("reason") == R_DUPLICATE).alias("duplicates"),
        F.count_if(~F.col("is_duplicate")).alias("unique_urls"),
        F.lit(0).cast("bigint").alias("cache_evictions"),
        F.count_if(~F.col("is_duplicate")).alias("cache_size"),
    ).withColumn("timestamp", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def unseen(df: DataFrame, history: DataFrame, key: str = "url_hash") -> DataFrame:
    """Rows whose key is not in ``history`` (anti join; AQE splits hot partitions).

    ``history`` is normally a stored key column (the URL store). A history
    computed on the fly should be checkpointed first: Spark carries filters
    on ``df``'s key across the join equality into ``history`` and would
    recompute its key expression inside that filter.
    """
    return df.join(history.select(key), key, "left_anti")
