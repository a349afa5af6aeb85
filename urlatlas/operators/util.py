"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder.

    Survives executor loss (data is written to the shared folder), unlike
    a local checkpoint. The folder comes from ``spark.checkpoint.dir``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_url_key(df: DataFrame, url_col: str = "url", norm_out: str = "normalized_url",
                 hash_out: str = "url_hash", algo: str = "sha256", dedup_pass: bool = False,
                 empty_for_invalid: bool = False) -> DataFrame:
    """Add the canonical URL and its hash, the canonical URL in its own projection.

    The canonical URL is a long interpreted expression; Spark does not share
    such expressions between columns of one projection, so the hash is taken
    from the staged column (Catalyst keeps the two projections apart because
    the expensive one is referenced twice). With ``empty_for_invalid`` the
    hash is never null (``''`` instead): joins and groupings on it then get
    no inferred ``isnotnull`` filter, which Catalyst would otherwise push
    below the projection as a second copy of the whole expression.
    """
    from ..functions.url import normalize_query, normalize_url, url_hash
    n = normalize_url(F.col(url_col))
    if dedup_pass:
        n = normalize_query(n)
    h = url_hash(F.col(norm_out), algo)
    if empty_for_invalid:
        h = F.coalesce(h, F.lit(""))
    return df.withColumn(norm_out, n).withColumn(hash_out, h)


def with_distinct_url_key(df: DataFrame, url_col: str = "url", norm_out: str = "normalized_url",
                          hash_out: str = "url_hash", algo: str = "sha256") -> DataFrame:
    """``with_url_key`` for tables that repeat their URLs: every distinct URL is canonicalised once.

    The distinct URLs (map-side combined) are keyed and joined back; adaptive
    execution broadcasts them if they are few and splits a hot URL's rows if
    not. Null URLs keep null keys.
    """
    urls = df.select(F.col(url_col).alias("_url")).distinct()
    keyed = with_url_key(urls, "_url", norm_out, hash_out, algo)
    return df.join(keyed, F.col(url_col) == F.col("_url"), "left").drop("_url")


def top_n(df: DataFrame, n: int, order: list, small: int = 100_000) -> DataFrame:
    """The first ``n`` rows of ``df`` in ``order`` (ties must be broken by ``order``).

    Small ``n``: ``orderBy().limit()`` (every task keeps its best ``n``, one
    task merges them). Large ``n``: that merge would receive ``partitions x
    n`` rows, so instead the rows are range-sorted and checkpointed, rows
    per sorted partition are counted (one small row each), whole partitions
    before the cut are kept by a filter and only the partition that crosses
    ``n`` is ranked. The result stays spread over the sorted partitions.
    """
    if n <= small:
        return df.orderBy(*order).limit(n)
    ranked = cut_lineage(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = sorted((r["_pid"], r["n"]) for r in ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    keep, total, cut = [], 0, None
    for pid, cnt in sizes:
        if total + cnt <= n:
            keep.append(pid)
            total += cnt
        else:
            cut = (pid, n - total)
            break
    from pyspark.sql import Window
    head = ranked.where(F.col("_pid").isin(keep)) if keep else ranked.where(F.lit(False))
    if cut is None or cut[1] == 0:
        return head.drop("_pid")
    w = Window.partitionBy("_pid").orderBy(*order)
    tail = (ranked.where(F.col("_pid") == cut[0]).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= cut[1]).drop("_rn"))
    return head.unionByName(tail).drop("_pid")
