from pyspark.sql import functions as F

from urlatlas.functions import html as H
from urlatlas.operators.keywords import match_keywords
from urlatlas.operators.links import extract_links

PAGES = [
    (0, "http://h.com/d/p", "<html><head><title>A &amp; B</title><title>2nd</title>"
        "<meta content=\"desc here\" name=\"description\"></head><body><p>Web <b>Crawling</b> here</p>"
        "<!-- <a href='/hidden'>x</a> --><script>var s='<p>';</script>"
        "<a href='/one'>1</a><A HREF=/two>2</A><a href=\"../up\">3</a><area href='?q=1'>"
        "<a href='mailto:x@y.z'>m</a><a href='#top'>t</a><a href='/one'>dup</a></body></html>"),
    (1, "https://h.com/", "<html><head><title></title></head><p>no body tag</p></html>"),
    (2, "https://h.com/x", "<html><head><script>track(1)</script></head><body>only <i>body</i> text"),
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_title_and_description(spark):
    got = _pages(spark).select(H.page_title("html"), H.page_description("html")).collect()
    assert [tuple(r) for r in got] == [("A & B", "desc here"), (None, None), (None, None)]


def test_character_references(spark):
    cases = [("It&#8217;s &eacute;", "It’s é"), ("&amp;lt; &lt;", "&lt; <"), ("&#x1F600;&#0;&#xD800;", "😀\ufffd\ufffd"),
             ("&nosuch; & &; &amp", "&nosuch; & &; &amp"), ("&notin;&NotEqualTilde;&Aacute;&#65", "∉≂̸ÁA"), ("", ""), (None, None),
             ("&amp;" * 5000, "&" * 5000), ("a &mdash; b&hellip;", "a — b…"), ("&#1114112;&#9999999;", "\ufffd\ufffd")]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    got = {r.i: r.d for r in df.select("i", H.decode_entities("s").alias("d")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_first_title_that_has_a_text(spark):
    pages = ["<title></title><title>second &amp; last</title>", "<TITLE lang=en>One</TITLE><title>Two</title>", "<title></title>", "x"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    assert [r.t for r in df.orderBy("i").select(H.page_title("h").alias("t")).collect()] == ["second & last", "One", None, None]


def test_many_adjacent_tags(spark):
    page = "<body>a" + "<br>" * 100_000 + "b</body>"
    assert spark.createDataFrame([(page,)], "h string").select(H.body_text("h")).first()[0] == "a b"


def test_body_text_and_keywords(spark):
    df = _pages(spark).select("page_id", H.body_text("html").alias("t"))
    kws = ["crawling", "Web Crawling", "track", "BODY", "nothing"]
    got = {r.page_id: r.k for r in df.select("page_id", H.find_keywords(F.col("t"), kws).alias("k")).collect()}
    assert got[0] == ["crawling"]  # the phrase is cut by a tag: "web  crawling"
    assert got[1] == []            # no <body>: no text
    assert got[2] == ["BODY"]      # head script text is not body text
    t0 = df.where("page_id = 0").first().t
    assert t0.startswith("web ") and "hidden" not in t0


def test_links(spark):
    ln = extract_links(_pages(spark)).where("page_id = 0").orderBy("pos").collect()
    assert [r.url for r in ln] == ["http://h.com/one", "http://h.com/two", "http://h.com/up",
                                   "http://h.com/d/p?q=1", "http://h.com/d/p#top"]


def test_keyword_tables_lists_and_blocks_agree(spark):
    texts = spark.createDataFrame(
        [(0, "the web crawling of data mining"), (1, "python and pythons"), (2, "a b"), (3, ""), (4, None), (5, "i\u0307 \u6f22\u5b57")],
        "id long, text string")
    words = ["Python", "web crawling", "a", "ab", "mining", "zzz", None, "", "PYTHON", "thons", "\u0130", "\u6f22"]
    kw = spark.createDataFrame([(k,) for k in words + ["a"]], "k string")

    def tags(keywords, **more):
        return {r.id: r.keywords for r in match_keywords(texts, keywords, "text", **more).collect()}

    one = tags(kw)
    assert one == tags(kw, block_bytes=40)
    assert one[0] == ["", "a", "mining", "web crawling"] and one[1] == ["", "PYTHON", "Python", "a", "thons"]
    assert one[2] == ["", "a"] and one[3] == [""] and one[4] == [] and one[5] == ["", "\u0130", "\u6f22"]
    assert tags(words + ["a"])[1] == ["Python", "a", "", "PYTHON", "thons", "a"]
    listed = {r.id: r.k for r in texts.select("id", H.find_keywords(F.col("text"), [w for w in words if w is not None]).alias("k")).collect()}
    assert listed == tags(words)
    none = spark.createDataFrame([], "k string")
    assert set(map(tuple, tags(none).values())) == set(map(tuple, tags([]).values())) == {()}


def test_many_keywords_in_one_and_in_many_automata(spark):
    texts = spark.createDataFrame([(i, f"w{i} w{i * 7}x and w{99_999 - i}.") for i in range(40)], "id long, text string")
    table = spark.range(100_000).select(F.concat(F.lit("W"), F.col("id").cast("string")).alias("k"))
    want = {i: sorted({f"W{n}"[:k] for n in (i, i * 7, 99_999 - i) for k in range(2, 7) if f"W{n}"[:k] == f"W{int(f'W{n}'[1:k])}"})
            for i in range(40)}
    for size in (2 << 20, 400_000):
        assert {r.id: r.keywords for r in match_keywords(texts, table, "text", block_bytes=size).collect()} == want
