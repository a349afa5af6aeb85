"""Registrable domains against literal values of the public-suffix rules."""
from urlatlas.operators.domains import registrable_domain

CASES = {"http://a.b.ck/": "a.b.ck", "http://x.a.b.ck/": "a.b.ck", "http://b.ck/": ".b.ck", "http://www.ck/": "www.ck",
         "http://x.www.ck/p": "www.ck", "http://foo.com.ua/": "foo.com.ua", "http://com.ua/": ".com.ua", "http://foo.ua": "foo.ua",
         "http://a.city.kawasaki.jp": "city.kawasaki.jp", "http://x.y.kawasaki.jp": "x.y.kawasaki.jp",
         "http://foo.blogspot.com/": "blogspot.com", "http://a.b.github.io": "github.io", "http://Deep.A.co.uk:80/": "A.co.uk",
         "http://host.nosuchtld/": "nosuchtld.", "http://10.0.0.1/": "10.0.0.1."}


def test_rules(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string")
    assert {r.url: r.registrable_domain for r in registrable_domain(df).collect()} == CASES


INTERNATIONAL = {"http://a.b.xn--p1ai/": "b.xn--p1ai", "http://a.b.рф/": "b.рф", "http://a.B.XN--P1AI/": "B.XN--P1AI",
                 "http://x.公司.cn/": "x.公司.cn", "http://y.x.xn--55qx5d.cn": "x.xn--55qx5d.cn", "http://公司.cn/": ".公司.cn",
                 "http://q.xn--zzz!/": "xn--zzz!.", "http://a.xn--e1afmkfd.xn--p1ai/": "xn--e1afmkfd.xn--p1ai"}


def test_unicode_and_ascii_labels_meet_the_same_rules(spark):
    df = spark.createDataFrame([(u,) for u in INTERNATIONAL], "url string")
    assert {r.url: r.registrable_domain for r in registrable_domain(df).collect()} == INTERNATIONAL
    # rules written in ASCII meet Unicode hosts, also as wildcards and exceptions
    table = spark.createDataFrame([("xn--p1ai",), ("*.xn--55qx5d",), ("!www.xn--55qx5d",), ("xn--\u00fc",)], "rule string")
    hosts = {"http://a.b.рф/": "b.рф", "http://a.b.c.公司/": "b.c.公司", "http://a.www.公司": "www.公司"}
    df = spark.createDataFrame([(u,) for u in hosts], "url string")
    assert {r.url: r.registrable_domain for r in registrable_domain(df, suffixes=table).collect()} == hosts


def test_private_suffixes_on_request(spark):
    df = spark.createDataFrame([("http://a.foo.blogspot.com/",), ("http://x.y.zz/",)], "url string")
    got = [r.registrable_domain for r in registrable_domain(df, include_private=True).orderBy("url").collect()]
    assert got == ["foo.blogspot.com", "zz."]
    table = spark.createDataFrame([("zz", False), ("y.zz", True), ("com", None)], "rule string, private boolean")
    for private, want in ((False, ["blogspot.com", "y.zz"]), (True, ["blogspot.com", "x.y.zz"])):
        got = registrable_domain(df, suffixes=table, include_private=private).orderBy("url").collect()
        assert [r.registrable_domain for r in got] == want
