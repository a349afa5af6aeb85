"""Readers for page tables, seeds and fetch logs (batch and stream)."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import url_authority
from ..schemas import PAGE_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, path: str, stream: bool = False,
               max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """Fetched pages ``(page_id, url, html)``; ``stream=True`` gives a ``readStream``."""
    if not stream:
        return spark.read.parquet(path)
    r = spark.readStream.schema(PAGE_SCHEMA).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def seeds(spark: SparkSession, urls: Iterable[str]) -> DataFrame:
    """Seed list as ``(seq, url, depth=0)`` in the given order."""
    rows = [(i, u) for i, u in enumerate(urls)]
    return (spark.createDataFrame(rows, "seq bigint, url string")
            .withColumn("depth", F.lit(0)))


def seeds_from(df: DataFrame, url_col: str = "url", seq_col: Optional[str] = None) -> DataFrame:
    """Seed rows from any table: ``(seq, url, depth=0)``."""
    seq = F.col(seq_col) if seq_col else F.monotonically_increasing_id()
    return df.select(seq.cast("bigint").alias("seq"), F.col(url_col).alias("url"), F.lit(0).alias("depth"))


def default_allowed(seed_df: DataFrame, url_col: str = "url") -> DataFrame:
    """Allowed domains when none are given: the raw authorities of the seeds."""
    return (seed_df.select(url_authority(url_col).alias("domain"))
            .where(F.col("domain").isNotNull() & (F.col("domain") != "")).distinct())
