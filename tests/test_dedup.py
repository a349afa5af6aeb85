"""Verdicts against a one-at-a-time loop with an unbounded seen set."""
import hashlib
import random

from pyspark.sql import functions as F

from url_cases import DEDUP_KEYS
from urlatlas.operators.dedup import dedup_stats, dedup_verdicts, hot_urls, unique_urls, url_frequency


def loop_verdicts(urls):
    seen, freq, out = set(), {}, []
    for u in urls:
        n = DEDUP_KEYS[u]
        if n is None:
            out.append((True, "", u, "Invalid URL format", None))
            continue
        h = hashlib.sha256(n.encode()).hexdigest()
        freq[h] = freq.get(h, 0) + 1
        if h in seen:
            out.append((True, h, n, "Exact duplicate", freq[h]))
        else:
            seen.add(h)
            out.append((False, h, n, None, freq[h]))
    return out


def _urls(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice(list(DEDUP_KEYS)) for _ in range(n)]


def test_reference_duplicate_example(spark):
    df = spark.createDataFrame([(0, "https://example.com/page"), (1, "https://www.example.com/page/")],
                               "seq long, url string")
    got = dedup_verdicts(df).orderBy("seq").collect()
    assert [r.is_duplicate for r in got] == [False, True]


def test_verdicts_equal_loop_any_block_size(spark):
    for seed in (1, 2):
        urls = _urls(300, seed)
        order = list(range(300))
        random.Random(seed).shuffle(order)   # rows arrive in a shuffled physical order
        df = spark.createDataFrame([(i, urls[i]) for i in order], "seq long, url string").repartition(5)
        expect = loop_verdicts(urls)
        for block in (7, 1 << 20):
            got = dedup_verdicts(df, block_size=block).orderBy("seq").collect()
            assert [(r.is_duplicate, r.hash_value, r.normalized_url, r.reason, r.seen_count) for r in got] == expect


def test_stats_frequency_first(spark):
    urls = _urls(200, 3)
    df = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    v = dedup_verdicts(df)
    st = dedup_stats(v).first()
    exp = loop_verdicts(urls)
    assert st.total_urls == 200
    assert st.duplicates == sum(1 for e in exp if e[3] == "Exact duplicate")
    assert st.unique_urls == sum(1 for e in exp if not e[0])
    assert st.total_urls == st.unique_urls + st.duplicates + sum(1 for e in exp if e[3] == "Invalid URL format")
    valid = v.where(F.col("hash_value") != "").withColumnRenamed("hash_value", "url_hash")
    freq = {r.url_hash: (r.frequency, r.first_seq) for r in url_frequency(valid).collect()}
    first = {r.url_hash: r.seq for r in unique_urls(valid.select("url_hash", "seq", "url")).collect()}
    assert {h: f[1] for h, f in freq.items()} == first
    hot = hot_urls(url_frequency(valid), cap=3, keep=0.75).collect()
    ranked = sorted(freq.items(), key=lambda kv: (-kv[1][0], kv[1][1]))[:2]
    assert [r.url_hash for r in hot] == [h for h, _ in ranked]


def test_top_n_distributed_equals_limit(spark):
    from urlatlas.operators.util import top_n
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("g")).repartition(6)
    order = [F.col("g").desc(), F.col("k").asc()]
    exp = [tuple(r) for r in df.orderBy(*order).limit(1234).collect()]
    got = [tuple(r) for r in top_n(df, 1234, order, small=0).orderBy(*order).collect()]
    assert got == exp
    assert top_n(df, 10_000, order, small=0).count() == 5000
    assert top_n(df, 0, order, small=-1).count() == 0
