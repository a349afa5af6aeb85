from pyspark.sql import functions as F

from urlatlas.operators.documents import conform, conform_or_reject
from urlatlas.operators.stats import sink_stats
from urlatlas.plans.harvest import harvest
from urlatlas.spec import HarvestSpec


def _site(spark):
    pages = [(i, f"http://s.org/p{i}", f"<html><head><title>T{i}</title></head><body>page {i} python "
              + "".join(f"<a href='/p{j}'>x</a>" for j in ((i + 1) % 6, (i + 2) % 6)) + "</body></html>")
             for i in range(6)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = spark.createDataFrame([(f"http://s.org/p{i}", f"http://s.org/p{j}", k)
                                   for i in range(6) for k, j in enumerate(((i + 1) % 6, (i + 2) % 6))] +
                                  [("http://s.org/p0", "http://other.net/x", 9)],
                                  "src_url string, dst_url string, pos int")
    seeds = spark.createDataFrame([(0, "http://s.org/p0")], "seq long, url string")
    return p, links, seeds


def test_harvest_with_hooks(spark):
    p, links, seeds = _site(spark)
    spec = HarvestSpec(keywords=("Python", "java"), max_depth=2,
                       link_filter=lambda u: ~u.endswith("/p2"))          # U2: user link rule
    res = harvest(p, links, seeds, spec, now="2024-01-01 00:00:00",
                  on_documents=lambda d: d.withColumn("title", F.upper("title")))  # U1: per-document hook
    docs = {r.url: r for r in res.documents.collect()}
    # allowed domains default to the seeds' authority: other.net is never reached; p2 is filtered
    assert set(docs) == {"http://s.org/p0", "http://s.org/p1", "http://s.org/p3"}
    assert docs["http://s.org/p1"].depth == 1 and docs["http://s.org/p1"].source_url == "http://s.org/p0"
    assert docs["http://s.org/p3"].depth == 2 and docs["http://s.org/p0"].source_url is None
    assert docs["http://s.org/p0"].keywords == ["Python"] and docs["http://s.org/p0"].title == "T0"
    assert res.level_sizes == [1, 1, 1]
    assert res.stats.first().processed == 3


def test_conform_defaults_and_rejects(spark):
    df = spark.createDataFrame([("http://a.com/x", "h1", "http://a.com/x", "a.com"),
                                ("ftp://a.com/x", "h2", "ftp://a.com/x", "a.com"),
                                ("http://a.com/y", None, None, "a.com"),
                                ("http://a.com/x", "h1", "http://a.com/x", "a.com")],
                               "url string, url_hash string, normalized_url string, domain string")
    acc, rej = conform_or_reject(df, now="2024-01-01 00:00:00")
    a = acc.collect()
    assert len(a) == 2 and a[0].depth == 0 and a[0].keywords == [] and a[0].is_active and a[0].error_count == 0
    assert sorted(r.reason for r in rej.collect()) == ["missing url_hash", "url is not an http(s) URL"]
    st = sink_stats(df).first()
    assert (st.processed, st.dropped, st.errors) == (1, 1, 2)
    assert len(conform(df).columns) == 16
