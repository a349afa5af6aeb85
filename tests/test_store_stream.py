import re
import uuid

from pyspark.sql import functions as F

from urlatlas.operators.dedup import dedup_verdicts
from urlatlas.operators.store import UrlStore, by_domain, by_hash, drop_known, store_documents
from urlatlas.session import ensure_checkpoint_dir
from urlatlas.streaming import streams as S
from urlatlas.streaming.state import KeyedState


def _scratch(spark, tag):
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _docs(spark, n, offset=0):
    rows = [(f"http://h{i % 7}.com/p{i % 11}", f"h{i % 11}", f"h{i % 7}.com", i + offset) for i in range(n)]
    return (spark.createDataFrame(rows, "url string, url_hash string, domain string, seq long")
            .withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))


def test_append_unique_is_idempotent(spark):
    store = UrlStore(spark, _scratch(spark, "store"))
    store.append_unique(_docs(spark, 30), order="seq")
    assert store.read().count() == 11
    store.append_unique(_docs(spark, 30), order="seq")
    store.append_unique(_docs(spark, 50, 100), order="seq")
    got = store.read()
    assert got.count() == 11 and got.select("url_hash").distinct().count() == 11
    small = store.compact(_scratch(spark, "compact"))
    assert sorted(map(tuple, small.read().collect())) == sorted(map(tuple, got.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows_scanned(df):
    """Rows that the scans of a look-up hand on: what row group statistics and Bloom filters leave."""
    df.collect()
    jvm, todo, found = df.sparkSession.sparkContext._jvm, [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_repeated_and_failed_batches(spark):
    store = UrlStore(spark, _scratch(spark, "batches"), key_buckets=3)
    first = store.append_unique(_docs(spark, 30), order="seq", batch_id="b1")
    again = store.append_unique(_docs(spark, 99, 7), order="seq", batch_id="b1")  # known: nothing is computed
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and store.batches() == ["b1"]
    # a batch that failed before its marker does not count, neither its rows nor its keys; run again it replaces them
    more = _docs(spark, 5).withColumns({"url_hash": F.concat(F.lit("x"), "url_hash")})
    store._write(more, "b2", None)
    store._fs.delete(store._path(f"{store.path}/_manifest/b2"), False)
    assert store.read().count() == 11 and store.keys().count() == 11
    assert store.append_unique(more, order="seq", batch_id="b2").count() == 5
    assert store.read().count() == 16 and store.read().select("url_hash").distinct().count() == 16
    assert store.append_unique(more, order="seq", batch_id="b3").count() == 0
    # another session's object of the same folder: bucketed keys are found by their folder
    other = UrlStore(spark, store.path, key_buckets=99)
    assert other.keys().distinct().count() == 16 and other._key_buckets() == 3
    store.write_clustered(_docs(spark, 4))
    assert store.read().count() == 4 and store.keys().distinct().count() == 4
    try:
        store.append_unique(_docs(spark, 4), batch_id="../x")
        raise AssertionError("a folder name")
    except ValueError:
        pass


def test_no_exchange_on_the_side_of_the_stored_keys(spark):
    store = UrlStore(spark, _scratch(spark, "plan"))
    store.write_clustered(_docs(spark, 30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(drop_known(_docs(spark, 50).repartition(3), store.keys(), "url_hash"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda k: len(lines[k]) - len(lines[k].lstrip(" :+-*()0123456789"))
    above, k = [], at
    for j in range(at, -1, -1):  # the operators over the scan, up to the join
        if depth(j) < depth(k):
            above.append(lines[j])
            k = j
            if "Join" in lines[j]:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)
    assert "Bucketed: true" in lines[at]


def test_lookups_read_few_row_groups(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".com/"), "id").alias("url"), F.sha2(F.col("id").cast("string"), 256).alias("url_hash"),
        F.concat(F.lit("h"), F.lpad((F.col("id") % 50).cast("string"), 2, "0"), F.lit(".com")).alias("domain"),
        F.when(F.col("id") == 77, F.array(F.lit("rare"), F.lit("often"))).when(F.col("id") % 2 == 0, F.array(F.lit("often"))).alias("keywords"),
        F.timestamp_seconds(F.lit(1_700_000_000)).cast("timestamp_ntz").alias("timestamp"))
    store = UrlStore(spark, _scratch(spark, "prune"), max_records_per_file=200)  # 20 files of one row group
    store.write_clustered(rows, partitions=4)
    key = rows.where("url like '%/1234'").first()
    by_key = by_hash(store.read(), [key["url_hash"]])
    assert by_key.count() == 1 and _rows_scanned(by_key) <= 400                       # Bloom filters: 20 files, one or two read
    by_url = store.read().where(F.col("url") == key["url"])
    assert by_url.count() == 1 and _rows_scanned(by_url) <= 400
    by_dom = by_domain(store.read(), "h07.com")
    assert by_dom.count() == 80 and _rows_scanned(by_dom) <= 400                      # minima and maxima
    rare = store.by_keyword("rare")
    assert [r["url"] for r in rare.collect()] == ["http://h27.com/77"] and len(rare.inputFiles()) == 1
    assert store.by_keyword("often").count() == 2001 and store.by_keyword("none").count() == 0
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", _plan(store.postings("rare")))
    assert store.postings().groupBy("keyword").count().collect() and {r["keyword"]: r["n"] for r in store.postings().groupBy("keyword").agg(
        F.count("*").alias("n")).collect()} == {"rare": 1, "often": 2001}


def test_documents_keep_the_first_of_a_key(spark):
    def doc(url, title, checked):
        return spark.createDataFrame([(url, "h1", url, "a.com", title, checked)],
                                     "url string, url_hash string, normalized_url string, domain string, title string, last_checked string").withColumn(
            "last_checked", F.col("last_checked").cast("timestamp_ntz"))
    late, early = doc("http://a.com/x", "late", "2024-01-02 00:00:00"), doc("http://a.com/x", "early", "2024-01-01 00:00:00")
    for docs in (late.union(early), early.union(late)):
        store = UrlStore(spark, _scratch(spark, "first"))
        appended, rejected = store_documents(docs, store, now="2024-02-01 00:00:00")
        assert [r["title"] for r in appended.collect()] == ["early"] and rejected.count() == 0


def test_stream_verdicts_equal_batch(spark):
    urls = [(i, f"http://ex.com/{i % 13}?utm_source=x" if i % 4 else f"HTTP://EX.COM:80/{i % 13}") for i in range(120)]
    df = spark.createDataFrame(urls, "seq long, url string")
    path = _scratch(spark, "src")
    S.ordered_stream_files(df, path, "seq", 25)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    folder = _scratch(spark, "sv")
    S.run_verdicts(src, folder).awaitTermination()
    got = sorted((r.seq, r.is_duplicate, r.seen_count) for r in S.read_verdicts(spark, folder).collect())
    exp = sorted((r.seq, r.is_duplicate, r.seen_count) for r in dedup_verdicts(df).collect())
    assert got == exp
    st = S.stream_stats(spark, folder).first()
    assert (st.total_urls, st.duplicates, st.unique_urls) == (120, sum(d for _, d, _ in exp), sum(not d for _, d, _ in exp))


def test_duplicate_pair_across_micro_batches(spark):
    df = spark.createDataFrame([(0, "https://example.com/page"), (1, "https://www.example.com/page/"), (2, "http://[x")],
                               "seq long, url string")
    path, folder = _scratch(spark, "src"), _scratch(spark, "pair")
    assert S.ordered_stream_files(df, path, "seq", 1) == 3
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    S.run_verdicts(src, folder).awaitTermination()
    got = [(r.is_duplicate, r.seen_count) for r in S.read_verdicts(spark, folder).orderBy("seq").collect()]
    assert got == [(False, 1), (True, 2), (True, None)]


def test_ttl_verdicts_do_not_depend_on_micro_batches(spark):
    import random
    rnd = random.Random(4)
    t, rows = 0, []
    for i in range(300):
        t += rnd.choice([0, 1, 30, 4000])
        rows.append((i, f"http://ex.com/{rnd.choice([1, 1, 1, 2, 3])}", t))
    ttl, last, count, want = 3600, {}, {}, {}
    for i, u, at in rows:
        count[u] = count[u] + 1 if u in last and at - last[u] <= ttl else 1
        last[u], want[i] = at, count[u]
    df = spark.createDataFrame(rows, "seq long, url string, s long").select("seq", "url", F.timestamp_seconds("s").alias("ts"))
    for per_file in (7, 1000):
        path, folder = _scratch(spark, "src"), _scratch(spark, "ttl")
        S.ordered_stream_files(df.repartition(1), path, "ts", per_file)
        src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 9).parquet(path)
        S.run_verdicts(src, folder, ts_col="ts", ttl_s=ttl, buckets=3, merge_every=2).awaitTermination()
        assert {r.seq: r.seen_count for r in S.read_verdicts(spark, folder).collect()} == want


def test_verdict_state_stays_flat_and_exact_over_fifty_batches(spark):
    """Keys come and go; what a batch reads and what is stored does not grow, and a repeated batch sees the same state."""
    folder = _scratch(spark, "state")
    gap, want, rows_stored, bytes_stored = 5, {}, [], []

    def state():
        return KeyedState(spark, folder, gap, buckets=2, merge_every=5)

    for n in range(50):
        met = [f"k{n % 4}", f"new{n}", f"new{max(0, n - 3)}"]
        keys = spark.createDataFrame([(k,) for k in sorted(set(met))], "hash_value string")
        seen = {r.hash_value: (r.last, r.count_) for r in state().before(n, keys).withColumnRenamed("count", "count_").collect()}
        # keys silent for longer than the gap may be gone or not: their count starts anew either way
        alive = lambda d: {k: v for k, v in d.items() if n - v[0] <= gap}
        assert alive(seen) == alive({k: want[k] for k in met if k in want})
        if n in (5, 12):  # the batch failed after its merge and runs again
            again = {r.hash_value: (r.last, r.count_) for r in state().before(n, keys).withColumnRenamed("count", "count_").collect()}
            assert again == seen
        now = {k: (n, seen.get(k, (0, 0))[1] + 1 if k in alive(seen) else 1) for k in met}
        want.update(now)
        state().change(n, spark.createDataFrame([(k, *v) for k, v in now.items()], "hash_value string, last long, count long"))
        if n % 5 == 4:
            rows, size = state().size()
            rows_stored.append(rows)
            bytes_stored.append(size)
    assert len(set(rows_stored[2:])) == 1 and rows_stored[-1] < 30 < len(want)
    assert max(bytes_stored[6:]) < 1.25 * max(bytes_stored[2:6])  # file headers weigh a little differently


def test_state_without_a_gap_keeps_every_key_and_reads_only_its_buckets(spark):
    state = KeyedState(spark, _scratch(spark, "state"), None, buckets=8, merge_every=2)
    for n in range(3):
        state.before(n, spark.createDataFrame([], "hash_value string"))
        state.change(n, spark.createDataFrame([(f"k{i}", n, n) for i in range(40) if i % 3 >= n], "hash_value string, last long, count long"))
    one = spark.createDataFrame([("k5",), ("unknown",)], "hash_value string")
    found = state.before(3, one)
    assert [tuple(r) for r in found.collect()] == [("k5", 2, 2)]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", found._jdf.queryExecution().executedPlan().toString())
    every = state.before(3, spark.createDataFrame([(f"k{i}",) for i in range(40)], "hash_value string"))
    assert {r["hash_value"]: r["last"] for r in every.collect()} == {f"k{i}": i % 3 for i in range(40)}


def test_rows_per_file_and_clustered_layout(spark):
    store = UrlStore(spark, _scratch(spark, "k5"), max_records_per_file=5)
    store.write_clustered(_docs(spark, 40), partitions=2)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{store.path}/batch={store.batches()[0]}/day=2024-01-01")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [st for st in fs.listStatus(root) if st.getPath().getName().endswith(".parquet")]
    assert len(files) >= 8                     # 40 rows, at most 5 per file
    got = store.read()
    assert got.count() == 40 and "day" in got.columns


def test_dedup_stats_timestamp_text(spark):
    from urlatlas.operators.dedup import dedup_stats
    df = spark.createDataFrame([(0, "http://a.com/"), (1, "http://A.com"), (2, "http://[x")], "seq long, url string")
    st = dedup_stats(dedup_verdicts(df), now=F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).first()
    assert (st.total_urls, st.duplicates, st.unique_urls, st.cache_size) == (3, 1, 1, 1)
    assert st.timestamp == "2024-01-31T12:00:00.000000"


def _files(spark, folder):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    it = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while it.hasNext():
        found.append(it.next().getPath().toString())
    return [f for f in found if f.endswith(".parquet")]


def test_small_appends_go_to_the_key_table_together(spark):
    store = UrlStore(spark, _scratch(spark, "small"), key_buckets=2)
    store.INDEX_EVERY = 3
    for n in range(7):
        rows = _docs(spark, 3 + n).withColumn("url_hash", F.concat(F.lit("k"), F.col("seq").cast("string")))
        assert store.append_unique(rows, order="seq", batch_id=f"b{n}").count() == (3 if n == 0 else 1)
    assert len(_files(spark, f"{store.path}/_keys-2")) <= 2 * 2  # a file a bucket for every three appends
    assert store.read().count() == 9 and sorted(r[0] for r in store.keys().collect()) == [f"k{i}" for i in range(9)]
    assert [len(store._waiting()), len(UrlStore(spark, store.path)._waiting())] == [1, 1]
    store._index(1)
    assert store._waiting() == [] and store.keys().distinct().count() == 9


def test_state_passes_neither_the_driver_nor_many_files(spark):
    state = KeyedState(spark, _scratch(spark, "state"), None, buckets=8, merge_every=4)
    state.change(0, spark.createDataFrame([(f"k{i}", 1, 1) for i in range(40)], "hash_value string, last long, count long").coalesce(2))
    found = state.before(1, spark.createDataFrame([("k5",), ("new",)], "hash_value string"))
    assert [tuple(r) for r in found.collect()] == [("k5", 1, 1)]
    assert "ShuffledHashJoin" in _plan(found) and "Broadcast" not in _plan(found)
    assert len(_files(spark, f"{state.path}/delta/batch=0")) <= 2


def test_micro_batches_take_settings_of_their_own_size(spark):
    df = spark.createDataFrame([(i, f"http://ex.com/{i % 5}") for i in range(20)], "seq long, url string")
    path, folder = _scratch(spark, "src"), _scratch(spark, "unique")
    S.ordered_stream_files(df, path, "seq", 10)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    seen = []
    try:
        got = S.run_to_table(S.stream_unique(S.keyed_urls(src)), folder)

        def look(batch, number):
            own = S.batch_session(batch)
            own = S.batch_session(batch, 10 ** 9)  # never more than the caller's
            seen.append([own.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "autoBroadcastJoinThreshold")])
            S.batch_session(batch, 20)
            seen.append(own.conf.get("spark.sql.shuffle.partitions"))
        src.writeStream.foreachBatch(look).option("checkpointLocation", _scratch(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cores = spark.sparkContext.defaultParallelism
    assert seen[:2] == [["40", "-1"], str(cores)]
    assert got.count() == 5
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/state/0")
    parts = [st for st in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root) if st.getPath().getName().isdigit()]
    assert len(parts) == min(40, 2 * cores)
