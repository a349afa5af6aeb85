import datetime as dt

from pyspark.sql import functions as F

from urlatlas.operators.frontier import expand, frontier_batch, recrawl_due, retry_queue
from urlatlas.spec import HarvestSpec


def py_bfs(edges, seeds, max_depth):
    depth = {s: 0 for s in seeds}
    frontier = list(seeds)
    for d in range(1, max_depth + 1):
        nxt = []
        for s in frontier:
            for t in edges.get(s, []):
                if t not in depth:
                    depth[t] = d
                    nxt.append(t)
        frontier = sorted(set(nxt))
    return depth


def test_bfs_matches_loop(spark):
    n = 40
    edges = {i: [f"http://n{(i * 3 + k * 7 + 1) % n}.org/p" for k in range(3)] for i in range(n)}
    rows = [(f"http://n{i}.org/p", t, k) for i in range(n) for k, t in enumerate(edges[i])]
    rows.append(("http://n0.org/p", "http://n0.org/file.pdf", 9))        # denied
    rows.append(("http://n0.org/p", "https://www.facebook.com/z", 10))   # blocked
    links = spark.createDataFrame(rows, "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([(0, "http://n0.org/p"), (1, "http://n5.org/p")], "seq long, url string")
    graph = {f"http://n{i}.org/p": edges[i] for i in range(n)}
    for depth in (1, 2, 3):
        res = expand(seeds, links, HarvestSpec(allowed_domains=None, max_depth=depth))
        got = {r.normalized_url: r.depth for r in res.nodes.collect()}
        assert got == py_bfs(graph, ["http://n0.org/p", "http://n5.org/p"], depth)
    # allowed domains from the seeds: nothing outside n0.org / n5.org
    res = expand(seeds, links, HarvestSpec(max_depth=3))
    assert {r.normalized_url for r in res.nodes.collect()} <= {"http://n0.org/p", "http://n5.org/p"}
    capped = expand(seeds, links, HarvestSpec(allowed_domains=None, max_depth=3, max_urls=7)).nodes
    assert capped.count() == 7 and capped.where("depth = 0").count() == 2


def test_frontier_batch_limits(spark):
    rows = [(i, f"http://{'hot' if i % 3 else 'h' + str(i)}.com/{i}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, url string, depth int")
    b = frontier_batch(df, per_host=4, total=None, now="2024-01-01 00:00:00").collect()
    per = {}
    for r in b:
        per.setdefault(r.host, []).append(r)
    assert len(per["hot.com"]) == 4 and all(len(v) == 1 for k, v in per.items() if k != "hot.com")
    assert max(r.not_before for r in per["hot.com"]) == dt.datetime(2024, 1, 1, 0, 0, 1, 500000)
    assert len(frontier_batch(df, per_host=4, total=5).collect()) == 5


def test_frontier_batch_with_addresses_is_greedy(spark):
    import random
    rnd = random.Random(5)
    hosts = [f"h{i}.com" for i in range(12)]
    table = [(h, f"10.0.0.{i % 3}") for i, h in enumerate(hosts[:10])] + [("H0.com", "10.0.0.9"), (None, "x"), ("h11.com", None)]
    rows = [(i, f"http://{rnd.choice(hosts + hosts[:1] * 30)}/{i % 50}", i // 60) for i in range(400)] + [(999, "ftp://h1.com/", 0)]
    df = spark.createDataFrame(rows, "seq long, url string, depth int")
    b = frontier_batch(df, per_host=6, total=None, now="2024-01-01 00:00:00", per_address=9,
                       addresses=spark.createDataFrame(table, "host string, address string")).collect()
    at, per_host, per_address, want = {h.lower(): a for h, a in reversed(table) if h and a}, {}, {}, []
    for seq, url, depth in sorted(rows, key=lambda r: (r[2], r[0])):
        if not url.startswith("http://"):
            continue
        host = url.split("/")[2]
        address = at.get(host, host)
        if per_host.get(host, 0) < 6:
            per_host[host] = per_host.get(host, 0) + 1
            if per_address.get(address, 0) < 9:
                per_address[address] = per_address.get(address, 0) + 1
                want.append((seq, host, address))
    assert sorted((r.seq, r.host, r.address) for r in b) == sorted(want)
    assert max(per_address.values()) == 9 and max(per_host.values()) == 6


def test_last_fetch_has_no_window_and_splits_a_hot_url(spark):
    from urlatlas.operators.frontier import FETCH_SALTS, _last_fetch
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    log = [("http://hot.com/", 200 if s in (3, 40) else (500 if s % 2 else None), None if s % 2 else "timeout", t(s), s) for s in range(90)]
    log += [("http://never.com/", 404, None, t(s), s) for s in range(7)] + [("http://[x", 404, None, t(1), 1)]
    df = spark.createDataFrame(log, "url string, status int, error string, ts timestamp_ntz, attempt int")
    last = _last_fetch(df)
    assert "Window" not in last._jdf.queryExecution().executedPlan().toString()
    got = {r.url: (r.attempts, r.trailing_failures, r.last_status, r.last_error, r.last_ts, r.last_ok_ts) for r in last.collect()}
    assert got == {"http://hot.com/": (90, 49, 500, None, t(89), t(40)), "http://never.com/": (7, 7, 404, None, t(6), None)}
    assert FETCH_SALTS > 1


def test_error_lists_hold_full_texts(spark):
    from urlatlas.operators.stats import crawl_stats, error_counts, proxy_health
    long = "host 10.0.0.1: " + "x" * 200
    log = [("r", "http://a.com/", "p", None, 1.0, dt.datetime(2024, 1, 1), e) for e in (long, long, long + "y", "b 1", "b 2", None)]
    log += [(None, "http://a.com/", None, None, 1.0, dt.datetime(2024, 1, 1), "only")]
    df = spark.createDataFrame(log, "run_id string, url string, proxy_address string, status int, response_ms double, ts timestamp_ntz, error string")
    assert {r.run_id: r.errors for r in crawl_stats(df).collect()} == {"r": ["b 1", "b 2", long, long + "y"], None: ["only"]}
    assert {r.proxy_address: r.error_messages for r in proxy_health(df, top_errors=2).collect()} == {"p": ["b 1", long], None: ["only"]}
    assert {(r.run_id, r.error): r.n_errors for r in error_counts(df, "run_id").collect()}[("r", long)] == 2


def test_retry_and_recrawl(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    log = [("a", "http://x.com/a", "p", 200, 1.0, t(1), 1, None),
           ("a", "http://x.com/a", "p", 503, 1.0, t(2), 2, None),
           ("a", "http://x.com/b", "p", None, 1.0, t(1), 1, "timeout"),
           ("a", "http://x.com/c", "p", 404, 1.0, t(1), 1, None),
           ("a", "http://x.com/d", "p", 200, 1.0, t(5), 1, None)] + \
          [("a", "http://x.com/e", "p", 500, 1.0, t(i), i, None) for i in range(1, 6)]
    df = spark.createDataFrame(log, "run_id string, url string, proxy_address string, status int, "
                                    "response_ms double, ts timestamp_ntz, attempt int, error string")
    rq = {r.url: r.next_attempt for r in retry_queue(df).collect()}
    assert rq == {"http://x.com/a": 2, "http://x.com/b": 2}   # e used up its retries
    due = {r.url: r.reason for r in recrawl_due(df, "2024-01-02 02:00:00").collect()}
    assert due == {"http://x.com/a": "not cacheable", "http://x.com/b": "failed", "http://x.com/c": "not cacheable",
                   "http://x.com/e": "not cacheable"}
    assert "http://x.com/d" in {r.url for r in recrawl_due(df, "2024-01-02 06:00:00").collect()}


def test_intake_splits_hot_host(spark):
    from urlatlas.operators.frontier import intake
    rows = [(i, f"http://hot.com/{i}") for i in range(400)] + [(1000 + i, f"http://c{i}.org/") for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, url string")
    one = intake(df, 8, salt_buckets=1).where("host = 'hot.com'").select(F.spark_partition_id().alias("p")).distinct().count()
    many = intake(df, 8).where("host = 'hot.com'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert one == 1 and many > 1
    assert intake(df, 8, salt_buckets=8).count() == 420
