"""URL store: one row per key in a clustered Parquet table with a key index and postings, plus look-ups."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Optional, Sequence, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import conform_or_reject
from .util import cut_lineage


def first_per_key(df: DataFrame, key: str = "url_hash", order: Optional[str] = None,
                  drop_null_key: bool = True) -> DataFrame:
    """One row per key: the first by ``order`` (partial ``min_by``), else any.

    Rows with a null key form one group, dropped by an aggregate flag: a
    filter on the key itself would be pushed below the aggregation into the
    projection that computes the key, evaluating it twice.
    """
    cols = [c for c in df.columns if c != key]
    pick = (F.min_by(F.struct(*cols), F.col(order)) if order is not None
            else F.first(F.struct(*cols), ignorenulls=False)).alias("_f")
    aggs = [pick]
    if drop_null_key:
        aggs.append(F.max(F.col(key).isNotNull()).alias("_has_key"))
    out = df.groupBy(key).agg(*aggs)
    if drop_null_key:
        out = out.where(F.col("_has_key"))
    return out.select(key, "_f.*").select(*df.columns)


class UrlStore:
    """A Parquet URL table at ``path``, written batch by batch, with a key index and keyword postings.

    Every write is a batch with a folder of its own (``batch=B/day=D``) that
    counts once its marker stands in ``_manifest``; a batch that is written
    again after a failure replaces its folder, and one whose marker stands is
    not written twice. Beside the rows a batch writes

    * its keys into ``_keys-N``, a table bucketed by key into ``N`` buckets:
      an insert moves the new keys to the buckets, the stored ones stay.
      Small appends wait until ``INDEX_EVERY`` of them go there together
      (``_indexed`` names those that are there), one file a bucket; the keys
      of those that wait are read from their rows;
    * its postings ``(keyword, url_hash, file)`` into ``_postings``, in
      buckets of the keyword: a keyword look-up reads one bucket, and then
      only the files named there.

    Inside a batch rows are range partitioned and sorted by ``(day, domain,
    url_hash)``: days are folders, Parquet's minima and maxima skip row
    groups for a domain, and Bloom filters skip them for a hash or URL. The
    hash in the range key splits a domain that holds a large share of the
    rows over many files instead of one.
    """

    POSTING_BUCKETS = 256
    INDEX_EVERY = 16

    def __init__(self, spark: SparkSession, path: str, key: str = "url_hash",
                 max_records_per_file: Optional[int] = None, key_buckets: Optional[int] = None):
        if key not in ("url_hash", "url"):
            raise ValueError("key is 'url_hash' or 'url'")
        self.spark, self.path, self.key = spark, path, key
        self.max_records_per_file = max_records_per_file
        self._buckets = key_buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def within(self, spark: SparkSession) -> "UrlStore":
        """The same store, worked on in another session."""
        return UrlStore(spark, self.path, self.key, self.max_records_per_file, self._buckets)

    # ------------------------------------------------------------ batches

    def _names(self, folder: str, prefix: str = "") -> list:
        at = self._path(folder)
        found = [st.getPath().getName() for st in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n[len(prefix):] for n in found if n.startswith(prefix) and not n.startswith("."))

    def batches(self) -> list:
        """Names of the batches that count."""
        return self._names(f"{self.path}/_manifest")

    def exists(self) -> bool:
        return bool(self.batches())

    def _load(self, paths: list) -> DataFrame:
        # the columns are those of the first batch; a batch without rows has no file to tell them
        schema = self.spark.read.parquet(f"{self.path}/_schema").schema
        if "day" not in schema.names:
            schema = schema.add("day", "date")
        return self.spark.read.schema(schema.add("batch", "string")).option("basePath", self.path).parquet(*paths).drop("batch")

    def read(self) -> DataFrame:
        return self._load([f"{self.path}/batch={b}" for b in self.batches()])

    def _written(self, batch: str) -> DataFrame:
        return self._load([f"{self.path}/batch={batch}"])

    def _write(self, df: DataFrame, batch: str, partitions: Optional[int]) -> None:
        """Rows, keys and postings of a batch, then its marker."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch) or batch.startswith("_"):
            raise ValueError("a batch is named by letters, digits, '-' and '_'")
        if not self._names(f"{self.path}/_schema"):
            self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{self.path}/_schema")
        # without a number adaptive execution sizes the files from the rows there are
        keys = ["day", "domain", "url_hash"]
        laid = df.withColumn("day", F.to_date("timestamp"))
        laid = laid.repartitionByRange(partitions, *keys) if partitions else laid.repartitionByRange(*keys)
        w = laid.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("day")
        for c in ("url_hash", "url"):
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        if self.max_records_per_file:
            w = w.option("maxRecordsPerFile", self.max_records_per_file)
        w.parquet(f"{self.path}/batch={batch}")
        self._fs.mkdirs(self._path(f"{self.path}/_keys-{self._key_buckets()}"))
        if "keywords" in df.columns:
            self._add_postings(self.spark.read.schema(df.schema).parquet(f"{self.path}/batch={batch}"), batch)
        self._fs.create(self._path(f"{self.path}/_manifest/{batch}")).close()

    def write_clustered(self, df: DataFrame, mode: str = "overwrite", partitions: Optional[int] = None) -> None:
        """Stores all rows of ``df`` as one batch, whatever their keys; ``overwrite`` drops the earlier batches."""
        earlier = self.batches()
        self._write(df, f"all-{uuid.uuid4().hex}", partitions)
        self._index(1)
        for b in earlier if mode == "overwrite" else []:
            for place in (f"_manifest/{b}", f"_indexed/{b}", f"batch={b}", f"_postings/batch={b}"):
                self._fs.delete(self._path(f"{self.path}/{place}"), True)

    def append_unique(self, df: DataFrame, order: Optional[str] = None, partitions: Optional[int] = None,
                      batch_id: Optional[str] = None) -> DataFrame:
        """Store rows whose key is not yet stored; returns what was appended.

        Duplicates inside the batch collapse to one row (the first by
        ``order``), then those whose key is stored are removed: the stored
        keys stay where they lie and stream past a hash table of the batch's,
        unsorted. Re-running the same batch appends nothing (idempotent); with a
        ``batch_id`` that is stored already nothing is computed, and what it
        appended is returned.
        """
        name = batch_id or uuid.uuid4().hex
        if name in self.batches():
            return self._written(name).drop("day")
        batch = cut_lineage(first_per_key(df, self.key, order))
        if self.exists():
            self._index(self.INDEX_EVERY)
            asked = batch.select(self.key).hint("shuffle_hash")
            known = [stored.join(asked, self.key, "left_semi") for stored in self._stored_keys()]
            batch = cut_lineage(batch.join(reduce(DataFrame.union, known).hint("shuffle_hash"), self.key, "left_anti"))
        self._write(batch, name, partitions)
        return self._written(name).select(*df.columns)

    def compact(self, path: str) -> "UrlStore":
        """The same rows written anew, clustered, as a store at ``path`` (many small appends make many small files)."""
        new = UrlStore(self.spark, path, self.key, self.max_records_per_file, self._buckets)
        new.write_clustered(self.read().drop("day"))
        return new

    def file_sizes(self) -> DataFrame:
        """``(file, n_rows)`` of every data file."""
        rows = self.spark.read.schema("url_hash string").parquet(*[f"{self.path}/batch={b}" for b in self.batches()])
        return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))

    # ---------------------------------------------------------- key index

    def _key_buckets(self) -> int:
        have = self._names(self.path, "_keys-")
        return int(have[0]) if have else self._buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _key_table(self) -> str:
        """The key table under a name of its own in the session's catalog; the caller drops the name again."""
        n = self._key_buckets()
        name = f"urlatlas_keys_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (`{self.key}` STRING, batch STRING) USING parquet "
                       f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {n} BUCKETS LOCATION '{self.path}/_keys-{n}'")
        return name

    def _waiting(self) -> list:
        """Batches that count and whose keys are not in the key table yet."""
        done = set(self._names(f"{self.path}/_indexed"))
        return [b for b in self.batches() if b not in done]

    def _keys_of(self, batches: list) -> DataFrame:
        rows = (self.spark.read.schema(f"`{self.key}` string, batch string").option("basePath", self.path)
                .parquet(*[f"{self.path}/batch={b}" for b in batches]))
        return rows.where(F.col(self.key).isNotNull()).select(self.key, "batch")

    def _index(self, least: int) -> None:
        """Moves the keys of the waiting batches into the key table, if there are ``least`` of them.

        After a failure before the markers they go there again: keys that stand twice are known all the same.
        """
        waiting = self._waiting()
        if len(waiting) < least:
            return
        name = self._key_table()
        try:
            keys = self._keys_of(waiting)
            keys.repartition(self._key_buckets(), self.key).write.insertInto(name)  # one file a bucket
        finally:
            self.spark.sql(f"DROP TABLE {name}")
        for b in waiting:
            self._fs.create(self._path(f"{self.path}/_indexed/{b}")).close()

    def _stored_keys(self) -> list:
        """Stored keys: the key table, and the keys of the batches that wait, each if there are any."""
        waiting = self._waiting()
        found = [self._indexed_keys()] if len(waiting) < len(self.batches()) else []
        return found + ([self._keys_of(waiting).select(self.key)] if waiting else [])

    def keys(self) -> DataFrame:
        """Stored keys; once all are indexed, as a bucketed table: joins on the key leave it where it lies."""
        return reduce(DataFrame.union, self._stored_keys() or [self._indexed_keys()])

    def _indexed_keys(self) -> DataFrame:
        name = self._key_table()
        try:
            table = self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the plan keeps the buckets, the files stay
        # keys of batches that failed before their marker, or were overwritten, do not count
        return table.where(F.col("batch").isin(self.batches())).select(self.key)

    # ----------------------------------------------------------- postings

    def _add_postings(self, rows: DataFrame, batch: str) -> None:
        """``(bucket, keyword, url_hash, file)`` of a batch; a keyword of very many rows lies in many files of its bucket."""
        place = F.regexp_extract(F.col("_metadata.file_path"), r"(batch=[^/]+/.+)$", 1)
        tags = rows.select(F.explode("keywords").alias("keyword"), "url_hash", place.alias("file")).where(F.col("keyword").isNotNull())
        keyed = tags.withColumn("bucket", self._posting_bucket(F.col("keyword")))
        (keyed.repartitionByRange("bucket", "keyword", "url_hash").sortWithinPartitions("bucket", "keyword", "url_hash")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_postings/batch={batch}"))

    def _posting_bucket(self, keyword):
        return F.pmod(F.xxhash64(keyword), F.lit(self.POSTING_BUCKETS)).cast("int")

    def postings(self, keyword: Optional[str] = None) -> DataFrame:
        """``(keyword, url_hash, file)`` of all stored rows, or of one keyword (one bucket is read)."""
        have = set(self._names(f"{self.path}/_postings", "batch="))
        paths = [f"{self.path}/_postings/batch={b}" for b in self.batches() if b in have]
        schema = "keyword string, url_hash string, file string, bucket int, batch string"
        if not paths:
            return self.spark.createDataFrame([], schema).drop("bucket", "batch")
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/_postings").parquet(*paths)
        if keyword is not None:
            found = found.where((F.col("bucket") == self._posting_bucket(F.lit(keyword))) & (F.col("keyword") == keyword))
        return found.drop("bucket", "batch")

    def by_keyword(self, keyword: str) -> DataFrame:
        """Stored rows with a keyword: only files that the postings name are read."""
        # as many rows as files hold the keyword; a read of the whole store lists them all
        files = [r["file"] for r in self.postings(keyword).select("file").distinct().collect()]
        if not files:
            return self.read().where(F.lit(False))
        return by_keyword(self._load([f"{self.path}/{f}" for f in sorted(files)]), keyword)


def drop_known(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``store`` (null keys are never known).

    Where ``store`` is a key table bucketed by ``key`` (``UrlStore.keys``) its
    buckets are joined where they lie; only the batch moves.
    """
    return batch.join(store.select(key), key, "left_anti")


def append_unique(store: DataFrame, new: DataFrame, key: str = "url_hash",
                  order: Optional[str] = None) -> DataFrame:
    """Store contents after a unique insert of ``new`` (plan only, nothing written)."""
    # non-null join keys: no inferred isnotnull filter is pushed into the
    # projections that compute them (null keys never match anyway)
    one = first_per_key(new, key, order).withColumn("_k", F.coalesce(F.col(key), F.lit("")))
    fresh = drop_known(one, store.select(F.coalesce(F.col(key), F.lit("")).alias("_k")), "_k").drop("_k")
    return store.unionByName(fresh.select(*store.columns))


def store_documents(docs: DataFrame, store: UrlStore, now=None, order: str = "last_checked", batch_id: Optional[str] = None):
    """Check, rebuild and uniquely store documents; returns ``(appended, rejected)``.

    Of several documents of one key the first by ``order`` stays (of ties by the whole record).
    """
    accepted, rejected = conform_or_reject(docs, now)
    first = F.struct(F.col(order), F.to_json(F.struct(*[c for c in accepted.columns if c not in (order, "timestamp")])))
    one = accepted.withColumn("_order", first)
    kept = first_per_key(one, store.key, "_order").drop("_order")
    return store.append_unique(kept, batch_id=batch_id), rejected


def found_urls(docs: DataFrame) -> DataFrame:
    """The four-column URL row: url, domain, depth, found_date."""
    return docs.select("url", "domain", "depth", F.col("timestamp").alias("found_date"))


# ---------------------------------------------------------------- look-ups

def by_hash(docs: DataFrame, hashes: Union[Sequence[str], DataFrame]) -> DataFrame:
    """Documents with the given hashes (literal list or a key table, semi join)."""
    if isinstance(hashes, DataFrame):
        keys = hashes.select(F.col(hashes.columns[0]).alias("url_hash")).distinct()
        return docs.join(keys, "url_hash", "left_semi")
    return docs.where(F.col("url_hash").isin(list(hashes)))


def by_domain(docs: DataFrame, domain: str) -> DataFrame:
    return docs.where(F.col("domain") == F.lit(domain))


def by_time(docs: DataFrame, start, end) -> DataFrame:
    """Documents with ``start <= timestamp < end``.

    On a store read (``day`` partition column) the day range is added as a
    partition predicate, so only the days in range are listed and read.
    """
    ts = F.col("timestamp")
    lo, hi = F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(end)).cast("timestamp_ntz")
    cond = (ts >= lo) & (ts < hi)
    if "day" in docs.columns:
        cond = cond & F.col("day").between(F.to_date(lo), F.to_date(hi))
    return docs.where(cond)


def by_keyword(docs: DataFrame, keyword: str) -> DataFrame:
    return docs.where(F.array_contains("keywords", keyword))

