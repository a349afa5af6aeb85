"""Randomised checks: properties of generated URLs; results independent of partitioning."""
from urllib.parse import parse_qsl, urlencode, urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from urlatlas.functions import url as U
from urlatlas.spec import TRACKING_PARAMS

SCHEMES = st.sampled_from(["http", "https", "HTTP", "ftp", "mailto", "", "h2-x.y"])
HOST_PART = st.sampled_from(["www.", "m.", ".m.", "-mobile.", "ex", "EX", "a", "com", ".", ":80", ":443", ":8080",
                             "u@", "[", "]", "[::1]", "é", "%41", "_"])
PATH_PART = st.sampled_from(["/", "//", "a", "B", ";p=1", ";", ".", "..", "%2F", "é", " ", "~", "*", "+"])
QUERY_PART = st.sampled_from(["a=1", "b=", "=v", "utm_source=x", "ref", "A=2", "a=%zz", "k=a+b", "é=ü", "x==y",
                              "source=1", "%75tm_medium=1", "q=~*", "", "c=%20"])
TAIL = st.sampled_from(["", "#", "#f", "?", "?#x"])


@st.composite
def urls(draw):
    scheme = draw(SCHEMES)
    host = "".join(draw(st.lists(HOST_PART, max_size=5)))
    path = "".join(draw(st.lists(PATH_PART, max_size=6)))
    query = "&".join(draw(st.lists(QUERY_PART, max_size=5)))
    lead = draw(st.sampled_from(["", " ", "\t", "\x01"]))
    sep = draw(st.sampled_from(["://", ":", "//", ":///"]))
    u = f"{lead}{scheme}{sep if scheme else draw(st.sampled_from(['', '//']))}{host}{path}"
    if query or draw(st.booleans()):
        u += "?" + query
    return u + draw(TAIL)


def decoded(url):
    """Query names and values in order, without empty values."""
    return parse_qsl(url.partition("?")[2].partition("#")[0])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(urls(), min_size=50, max_size=120))
def test_properties_of_canonical_urls(spark, batch):
    df = spark.createDataFrame([(u,) for u in batch], "u string").withColumn("n", U.normalize_url("u"))
    out = df.select("u", "n", U.normalize_url("n").alias("again"), U.normalize_query("n").alias("q")).collect()
    for r in out:
        if r.n is None:
            assert "[" in r.u or "]" in r.u, repr(r.u)  # only bracketed hosts can fail to parse
            continue
        assert "#" not in r.n
        kept = decoded(r.n)
        # names sorted, none of them a tracking name, and a round trip through the standard library changes nothing
        assert [k for k, _ in kept] == sorted(k for k, _ in kept), repr(r.u)
        assert not {k for k, _ in kept} & set(TRACKING_PARAMS)
        assert urlencode(kept) == r.n.partition("?")[2], repr(r.u)
        if r.n.startswith("http") and "://" in r.n and not r.n.startswith(("http:///", "https:///")):
            body = r.n.partition("?")[0]
            assert body == body.lower() and (body.count("/") == 3 or not body.endswith("/")), repr(r.u)
            if r.again is not None and "." not in r.n.partition("?")[0].partition("//")[2].partition("/")[0]:
                assert r.again.partition("?")[2] == r.n.partition("?")[2], repr(r.u)
        assert not {k for k, _ in decoded(r.q)} & {"utm_source", "fbclid", "ref"}


HREF = st.lists(st.sampled_from(["a", "..", ".", "", "b", "%2e", "c;x"]), max_size=5).map("/".join)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["http://h.com/x/y/z", "https://h.com/", "http://h.com/a/b/?q=1#f"]),
                          st.tuples(st.sampled_from(["", "/", "?k=v", "#z"]), HREF).map(lambda t: t[0] + t[1])),
                min_size=30, max_size=60))
def test_generated_links_match_urljoin(spark, pairs):
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", U.resolve_url("b", "h").alias("r")).collect():
        assert r.r == urljoin(r.b, r.h), (r.b, r.h)


def test_results_independent_of_partition_count(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    got = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got.append(sorted(tuple(r) for r in E.queries()["dedup_verdicts"](spark, sf).collect()))
        got.append(sorted(tuple(r) for r in E.queries()["link_host_counts"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[2] and got[1] == got[3]
