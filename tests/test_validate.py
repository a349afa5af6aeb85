from urlatlas.functions.validate import validate_url
from urlatlas.operators.domains import registrable_domain

CASES = [
    ("https://example.com/a", ""),
    ("example.com/a", "Invalid URL format"),
    ("ftp://example.com/a", "Invalid scheme"),
    ("https://www.facebook.com/x", "Blocked domain"),
    ("https://facebook.com", "Blocked domain"),
    ("https://notfacebook.com", ""),
    ("https://FACEBOOK.COM/x", ""),          # the domain set compares the spelling as written
    ("https://x.com/file.PDF", "Blocked file extension"),
    ("https://x.com/file.pdf?a=1", ""),      # the extension must end the URL
    ("https://x.com/" + "a" * 2000, "URL too long"),
    ("http://[::1", "Validation error: Invalid IPv6 URL"),
    ("http://[1.2.3.4]/", "Validation error: An IPv4 address cannot be in brackets"),
    ("http://a\u2100b.com/", "Validation error: netloc 'a\u2100b.com' contains invalid characters under NFKC normalization"),
    ("http://a\uff0fb.com/x", "Validation error: netloc 'a\uff0fb.com' contains invalid characters under NFKC normalization"),
    ("ftp://u\uff20h:80/", "Validation error: netloc 'u\uff20h:80' contains invalid characters under NFKC normalization"),
    ("http://a.com/\uff0f\u2100?\uff1f", ""),   # only the authority counts
    ("http://b\u00fccher.example/\u00e9", ""),
    (None, "Invalid URL format"),
]


def test_validation_reasons(spark):
    df = spark.createDataFrame([(u,) for u, _ in CASES], "u string")
    got = [(r.v.is_valid, r.v.reason) for r in df.select(validate_url("u").alias("v")).collect()]
    assert got == [(why == "", why) for _, why in CASES]


def test_delimiters_in_compatibility_form(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from urlatlas.functions.url import normalize_url, url_authority, url_parse_ok
    from urlatlas.spec import AUTHORITY_CONFUSABLES
    found = [chr(c) for c in range(0x80, 0x110000) if set("/?#@:") & set(unicodedata.normalize("NFKC", chr(c)))]
    assert "".join(found) == AUTHORITY_CONFUSABLES
    df = spark.createDataFrame([(f"http://a{c}b.com/{c}",) for c in found], "u string")
    got = df.select(normalize_url("u"), url_authority("u"), url_parse_ok("u")).collect()
    assert {tuple(r) for r in got} == {(None, None, False)}
    assert df.select(url_parse_ok(F.replace("u", F.lit("http://a"), F.lit("http://a/")))).distinct().collect() == [(True,)]


def test_registrable_domain(spark):
    urls = ["http://a.b.example.co.uk/x", "https://www.Example.com", "http://localhost:8080/",
            "http://1.2.3.4/", "http://co.uk/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = dict((r.i, r.registrable_domain) for r in registrable_domain(df).collect())
    assert got == {0: "example.co.uk", 1: "Example.com", 2: "localhost.", 3: "1.2.3.4.", 4: ".co.uk"}
