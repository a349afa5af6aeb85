"""op2, op3, op4, op8 against plain restatements and planted cases."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

import brute
from urlatlas.llm import secret_links, tag_paths, toxicity, wu_manber


def plain_hits(text, items, window=13):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    hit, found = set(), set()
    for item, body in items:
        ws = plain_words(body)
        n = min(window, len(ws))
        wins = {tuple(ws[a:a + n]) for a in range(len(ws) - n + 1)} if n else set()
        for a in range(len(words) - n + 1 if n else 0):
            if tuple(words[a:a + n]) in wins:
                hit.update(range(a, a + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def bench_case():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "x1", "née", "delta", "eps", "zz"])
    run = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(run(rnd.choice([1, 4, 12, 13, 14, 40])) + [f"k{i}"])) for i in range(12)]
    items += [(3, " ".join(run(20))), (None, "only-one Item"), (50, None), (51, "..."), (3, items[0][1])]
    docs = []
    for i in range(60):
        parts = run(rnd.randint(0, 80))
        for _, body in rnd.sample(items, 2):
            ws = plain_words(body)
            a = rnd.randint(0, max(0, len(ws) - 5))
            parts[len(parts) // 2:len(parts) // 2] = ws[a:] if rnd.random() < 0.5 else ws
        docs.append((i, " ".join(w.upper() if rnd.random() < 0.3 else w for w in parts)))
    docs += [(60, None), (61, ""), (61, ""), (None, items[2][1]), (62, ", ".join(plain_words(items[5][1]) * 2000)),
             (63, "- -" * 2000)]
    return docs, items


def test_contamination_matches_plain_search(frame, spark):
    docs, items = bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, list) else x for x in r)
    want = sorted(((i, *plain_hits(t, items)) for i, t in docs), key=key)
    for block in (10 ** 6, 300):  # one pass, and several
        got = wu_manber.contamination(frame(docs), bench, block_bytes=block).withColumn("n_hit", wu_manber.hit_words(F.col("hits")))
        assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()), key=key) == want
        kept = wu_manber.drop_contaminated(frame(docs), bench, block_bytes=block)
        clean = [(i, t) for (i, t) in docs if not (lambda n, h, _: h and 20 * h >= n)(*plain_hits(t, items))]
        assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((i or -1, t or "") for i, t in clean)
    assert wu_manber.contamination(frame([]), bench).collect() == []
    assert all(r.hits == [] for r in wu_manber.contamination(frame(docs), bench.limit(0)).collect())


SECRETS = [
    "", None, "password=abcde", "PASSWORD : 'abcdef' token=token:abcdefgh", "api_key = \"a.b-c/d+e=\" AKIA" + "A" * 16,
    "AKIA" + "B" * 15 + " " + "ab12" * 6 + "Z" + "f" * 23, "paſſword=abcdef toKen=abcdefg",
    "user=alice and then nothing", "user=alice\nsecret=hunter22", "user=alice\n\nsecret=hunter22",
    "user=alice" + " x" * 120 + "secret=hunter22", "https://db.example.com/x token=abcdefgh",
    "https://db.example.com/x", "Zx9Kq0Lm4Np7Rt2Vw5Yb8Dc login: bob", "Zx9Kq0Lm4Np7Rt2Vw5Yb8Dc", "é password=ééabcdefg \U0001F600 token=abcdef1",
    "token=abcdef " * 3000, "https://example.com/AbCdEf1234567890GhIjKlMnOp/page", "user=" + "uvw" * 40 + " secret=hunter22"]


def test_secrets_base_spans_and_links(frame):
    rows = list(enumerate(SECRETS)) + [(None, "token=abcdef"), (2, "password=abcde")]
    got = secret_links.secrets(frame(rows)).withColumn("s", secret_links.spans_text(F.col("spans"))).collect()
    assert len(got) == len(rows)
    base = {"assign": r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                      r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24)}
    for r in got:
        text = "token=abcdef" if r.doc_id is None else SECRETS[r.doc_id] or ""
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(base.items()) for m in re.finditer(p, text)
                      if len(m[least[kind][0]]) >= least[kind][1])
        assert [(s.start, s["rank"], s.kind, s.end) for s in r.base] == want
        assert set(r.base) <= set(r.spans)
    extra = {r.doc_id: [s.kind for s in r.spans if s.kind in secret_links.WEAK] for r in got}
    assert {i: k for i, k in extra.items() if k} == {8: ["id"], 11: ["endpoint"], 13: ["secret", "id"], 18: ["id"]}
    # a link is no secret that its own path confirms; a long name is one part
    assert [(s.start, s.end) for r in got if r.doc_id == 18 for s in r.spans if s.kind == "id"] == [(5, 125)]
    assert secret_links.secrets(frame([])).collect() == []


def test_links_need_an_overlapping_scope(spark):
    rnd = random.Random(2)
    parts = []
    for row in range(30):
        for _ in range(rnd.randint(0, 30)):
            a = rnd.randint(0, 4000)
            parts.append((row, rnd.choice(secret_links.KINDS), a, a + rnd.randint(3, 900), rnd.randint(0, 1)))
    got = {tuple(r) for r in secret_links.linked(spark.createDataFrame(
        parts, "row long, kind string, start int, end int, paragraph int")).collect()}
    want = {(row, kind, a, b) for row, kind, a, b, p in parts if kind in secret_links.WEAK and any(
        r2 == row and p2 == p and secret_links.ROLE[k2] in secret_links.NEEDS[kind] and a2 < b + secret_links.REACH
        and b2 > max(0, a - secret_links.REACH) and (b2 <= a or a2 >= b) for r2, k2, a2, b2, p2 in parts)}
    assert got == want and len(want) < sum(p[1] in secret_links.WEAK for p in parts)


PAGES = [
    (None, ""), ("", ""), ("<p></p><br>", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav><a>Home</a></nav><article><h1>T</h1><p>One&nbsp;two\n three.<p>Four <b>five</b><br>six</article><footer>x</footer>",
     "T\nOne\xa0two three.\nFour five six"),
    ("<body><div class='menu'>Menu, items. here</div><div id=main><p>Long text of the page, with marks. And more of it.</p>"
     "<p>Second long paragraph, as it happens, of the same page.</p><p>x</p></div><aside>Ad, text. Here.</aside></body>",
     "Long text of the page, with marks. And more of it.\nSecond long paragraph, as it happens, of the same page.\nx"),
    ("<article><p>Body, of text.</p><form>Name <input></form><div class='comments'><p>I like it, really.</p></div>"
     "<div class='cookie-notice'>We use cookies.</div><script>if (a<b) '</p>'</script><style>p{}</style></article>"
     "<article class=comment><p>Much longer comment text, that goes on and on, and on. And on.</p></article>", "Body, of text."),
    ("<div class='page has-sidebar'><main><p>Kept text, inside. Of main.</p></main></div>", "Kept text, inside. Of main."),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>cut off &am", "a\nb\nc\nd\ncut off &am"),
    ("<article><p>a < b && c > d <!-- no --> <p title='x>y'>e</p></article>", "a < b && c > d\ne"),
    ("<article><p>text</p><p hidden>no</p><div style='display: none'>no</div></article", "text"),
]


def test_page_text_cases(frame, spark):
    for page, want in PAGES:
        assert tag_paths.main_text(page) == want
    big = "<article>" + "<p>Some words, here.</p>" * 20000 + "<br>" * 100000 + "</article>"
    assert tag_paths.main_text(big).count("\n") == 19999
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAGES)], "page_id long, html string")
    got = {r.page_id: r.text for r in df.select("page_id", tag_paths.page_text()(F.col("html")).alias("text")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(PAGES)}
    assert df.limit(0).select(tag_paths.page_text()(F.col("html"))).collect() == []


LONG = "Long text of the page, with marks. And more of it, as it goes."
KEPT = [
    (f"<nav>x</nav><article><p>{LONG}</p></article><article><p>{LONG} Two.</p></article><footer>f</footer>", f"{LONG}\n{LONG} Two."),
    (f"<main><div><p>{LONG}</p><p>{LONG} b</p></div><article><p>Short teaser.</p></article></main>", f"{LONG}\n{LONG} b"),
    (f"<article><p>{LONG}</p><h2 id='discussion'>Discussion</h2><p>{LONG}</p></article>", f"{LONG}\nDiscussion\n{LONG}"),
    (f"<article><p>{LONG}</p><section class='related-work'><h2>Others</h2><p>{LONG}</p></section></article>", f"{LONG}\nOthers\n{LONG}"),
    (f"<article><p>{LONG}</p><svg width='3'/><p>{LONG} x</p></article>", f"{LONG}\n{LONG} x"),
    (f"<article><p>{LONG}</p><object data=x><p>{LONG} x</p></article>", f"{LONG}\n{LONG} x"),
    (f"<article><p>{LONG} <math><mi>x</mi></math></p></article>", f"{LONG} x"),
    ("<nav><ul><li>Home<li>More</ul></nav><footer>Copyright of it, long enough. Yes.</footer>", ""),
    (f"<article><p>{LONG}</p></article><div id=comments><ol class=comment-list><li><article><p>{LONG} {LONG}</p></article></ol></div>", LONG),
    ("<article><table><tr><td>a<tr><td>b<td>c</table></article>", "a\nb\nc"),
]


def test_page_text_keeps_articles_whole():
    for page, want in KEPT:
        assert tag_paths.main_text(page) == want
    page = KEPT[0][0]
    assert tag_paths.main_text(page, 50.0) == "" and tag_paths.main_text(page, 0.0).startswith("x\n")


def test_page_text_matches_brute_force():
    rnd = random.Random(9)
    names = ["article", "main", "div", "div class=ad", "p", "ul", "li", "nav", "h2", "section", "aside", "div class='side bar'", "table", "td"]
    kept = 0
    for n in range(150):
        page = ""
        for _ in range(rnd.randint(1, 40)):
            tag = rnd.choice(names)
            page += rnd.choice([f"<{tag}>", f"<{tag}>", f"</{tag.split()[0]}>", "</div>"])
            page += " ".join(rnd.choice(["word", "and,", "end.", "x"]) for _ in range(rnd.choice([0, 1, 5, 40])))
        want = brute.tag_path_text(*tag_paths.parse(page))
        assert tag_paths.main_text(page) == want, page
        kept += bool(want)
    assert kept > 100


def test_page_text_is_linear_in_depth():
    for page in ("<div>" * 50_000 + "x" + "</a></p>" * 50_000, "<ul>" + "<div>" * 50_000 + "<li>x</section>" * 50_000):
        start = time.perf_counter()
        tag_paths.main_text(page)
        assert time.perf_counter() - start < 4


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 3, 7):
        e, trans = rng.normal(size=n), rng.normal(size=(2, 2))
        p, pair = toxicity.marginals(e, trans)
        scores = {}
        for code in range(2 ** n):
            y = tuple(code >> t & 1 for t in range(n))
            scores[y] = np.exp(sum(e[t] for t in range(n) if y[t]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z = sum(scores.values())
        want = np.zeros((2, 2))
        for y, s in scores.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += s / z
        assert np.allclose(pair, want)
        assert np.allclose(p, [sum(s for y, s in scores.items() if y[t]) / z for t in range(n)])


def test_chains_are_not_cut():
    """A transition reaches over any distance: what the first word says decides the last one's label."""
    trans = np.array([[0.0, -40.0], [-40.0, 0.0]])
    for first in (-6.0, 6.0):
        p, _ = toxicity.marginals(np.array([first, *[0.0] * 5000]), trans)
        assert np.allclose(p, 1 / (1 + np.exp(-first)))


def test_words_of_many_texts_are_those_of_each(monkeypatch):
    """Words, numbers, places and slots found together are those of the plain pattern, whatever the letters."""
    rnd = random.Random(5)
    odd = ["İstanbul", "ΟΔΟΣ", "ΣΑΣ", "οδος", "Straße", "ẞ", "ÜBER", "über", "漢字仮名", "Ⅷ", "x_y", "a1b", "١٢", "é", "e\u0301", "𝒜𝓑", "🙂",
           "Kelvin\u212a", "z" * 70, "ж" * 40, "Ж" * 40, "ǅ", "ŉ", "\x00", "\n", "it's", "A", "ab", "abc", "abcd", "abcdefg", "\u2028"]
    plain = [" ".join(rnd.choice(["Ta", "LO", "mi.", "7", "re-su"]) for _ in range(20)), "", "12 !!", "x"]
    mixed = [rnd.choice([" ", "", ","]).join(rnd.choices(odd, k=rnd.randint(0, 30))) for _ in range(60)]
    for texts in ([], [""], ["12 !!", ""], plain, plain + odd, plain + mixed):
        words = toxicity.cut(texts)
        names, found = words.names(), [list(toxicity.WORD.finditer(t)) for t in texts]
        assert len(set(names)) == len(names)
        assert [names[i] for i in words.number] == [m[0].lower() for f in found for m in f]
        assert list(zip(words.start.tolist(), words.end.tolist())) == [m.span() for f in found for m in f]
        assert np.diff(words.ends).tolist() == [len(f) for f in found]
        own, near = toxicity.many_slots(words.distinct)
        assert [[k for k in row if k < toxicity.SLOTS] for row in own.tolist()] == [toxicity.slots(w) for w in names]
        assert near.tolist() == [toxicity.neighbour(w) for w in names]
        monkeypatch.setattr(toxicity, "RUN", 40)
        assert [t for run in toxicity.runs(texts) for t in run] == texts
        monkeypatch.undo()


def test_many_chains_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [1], [5, 0, 1], rng.integers(0, 12, 50), [400, *rng.integers(0, 40, 70), 90]):
        ends = np.cumsum([0, *sizes])
        e, trans = rng.normal(size=ends[-1]), rng.normal(size=(2, 2))
        alone = [toxicity.marginals(e[a:b], trans) for a, b in zip(ends, ends[1:])]
        for breadth in (1, 3, 32, 1000):
            monkeypatch.setattr(toxicity, "BREADTH", breadth)
            p, pair = toxicity.marginals(e, trans, ends)
            assert np.array_equal(p, np.concatenate([np.zeros(0), *(q for q, _ in alone)]))
            assert np.allclose(pair, sum((m for _, m in alone), np.zeros((2, 2))))
        monkeypatch.undo()


def test_scoring_takes_no_python_step_a_word():
    """Jumps of the interpreter while many texts are scored: fewer by far than words."""
    import sys
    import pyarrow as pa
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abdegiklmnorstu"), 6)) for _ in range(2000)]
    texts = pa.array([" ".join(rng.choice(vocabulary, 250)) for _ in range(300)])
    model = toxicity.Model(rng.normal(-2, 0.3, toxicity.SLOTS), rng.normal(0, 0.1, (2, toxicity.SLOTS)), np.eye(2), np.ones(5))
    look = toxicity.Lookup(model)
    toxicity._score(texts[:2], look)
    watch, jumps = sys.monitoring, [0]

    def jump(*_):
        jumps[0] += 1
    tool = next(i for i in range(6) if watch.get_tool(i) is None)
    watch.use_tool_id(tool, "jumps")
    try:
        watch.register_callback(tool, watch.events.JUMP, jump)
        watch.set_events(tool, watch.events.JUMP)
        scores = toxicity._score(texts, look)
    finally:
        watch.set_events(tool, 0)
        watch.free_tool_id(tool)
    assert len(scores) == 300 and jumps[0] < 300 * 250 / 10


def toxic_docs(n=240):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["ta", "lo", "mi", "re", "su", "ka"]) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(30, 300))]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words.insert(rnd.randint(0, len(words)), rnd.choice(["grubble", "Snorvex", "blurptang" + word()]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_finds_marked_words_in_unseen_documents(frame, spark):
    docs, labels = toxic_docs()
    docs += [(1000, None), (1001, ""), (1002, "12 !!"), (None, "grubble"), (1003, "ta lo " * 40000 + "grubble"), (1003, "ta")]
    known = spark.createDataFrame(labels + [(1, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    df = frame(docs)
    model = toxicity.fit(df, known, F.col("doc_id") < 160)
    got = df.select("doc_id", toxicity.toxicity(model, spark)(F.col("text")).alias("t"), "text").select("doc_id", "t.*", "text").collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1
        marks = [m.span() for m in re.finditer(r"(?i)grubble|snorvex|blurptang\w*", r.text or "")]
        assert [(s.start, s.end) for s in r.spans] == marks
        if r.doc_id is not None and r.doc_id < 240:
            assert (r.score >= toxicity.THRESHOLD) == bool(marks)
    left = {r.doc_id for r in toxicity.drop_toxic(df, model).collect()}
    assert {1000, 1001, 1002, 1, 2} <= left and not {0, 5, 235} & left
    assert toxicity.drop_toxic(frame([]), model).collect() == []


def test_toxicity_without_toxic_examples(frame, spark):
    docs, labels = toxic_docs(20)
    for some in ([], [(i, 0) for i, _ in labels]):
        model = toxicity.fit(frame(docs), spark.createDataFrame(some, "doc_id long, toxic int"), F.lit(True))
        assert all(r.score < 0.7 for r in frame(docs).select(toxicity.toxicity(model, spark)(F.col("text")).alias("t")).select("t.*").collect())


def test_registered_toxicity_on_held_out_rows(spark):
    """Held-out rows of sf0.01 (18 toxic, 15 of them English); recall by language on sf0.1 is in the README."""
    from urlatlas.llm import queries
    sf = "/root/testdata/sf0.01"
    got = queries.op8_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    got = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in got.where("held_out").collect()]
    caught = [r for r in held if r.predicted]
    assert sum(r.toxic for r in caught) >= 0.9 * len(caught) and len(caught) >= 0.7 * sum(r.toxic for r in held)
    english = [r for r in held if r.lang == "en" and r.toxic]
    assert sum(r.predicted for r in english) >= 0.85 * len(english)
    pos, neg = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.85


def test_digest_of_the_registered_secret_scan(spark, tmp_path):
    from urlatlas.llm import queries
    spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_secret_links(spark, str(tmp_path)).collect()}
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    assert got[8].spans == "id:5:10,assign:11:26" and got[8].n_assign == 1
    assert got[8].base_sha256 == hashlib.sha256(b"assign:11:26").hexdigest()


def test_toxicity_learns_words_that_clean_texts_also_have(frame, spark):
    """Toxic texts hold a word many times that one clean text in five holds once."""
    docs, labels = toxic_docs(0)
    rnd = random.Random(4)
    for i in range(600):
        words = ["".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(150)]
        toxic = i % 5 == 0
        for _ in range(rnd.randint(4, 9) if toxic else rnd.random() < 0.2):
            words.insert(rnd.randint(0, len(words)), "achlich" + rnd.choice(["", "er", "em", "keit", "ung"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = frame(docs)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") < 400)
    scores = {r.doc_id: r.s for r in df.where("doc_id >= 400").select("doc_id", toxicity.toxicity(model, spark)(F.col("text"))["score"].alias("s")).collect()}
    caught = sum(s >= toxicity.THRESHOLD for i, s in scores.items() if i % 5 == 0)
    flagged = sum(s >= toxicity.THRESHOLD for i, s in scores.items() if i % 5)
    assert caught >= 36 and flagged <= 4  # of 40 and 160


def test_a_worker_keeps_one_thing_and_hands_contexts_on_early(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from urlatlas.llm import common, toxicity as T
    from urlatlas.llm.token_ids import encoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = encoder(path)
    assert encoder(path) is first
    common.kept("another", dict)
    assert list(common._KEPT) == ["another"] and encoder(path) is not first

    texts = [f"alpha{'abcdefghij'[i % 10]} beta gamma{'xyz'[i % 3]} delta" for i in range(60)]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 3 for i in range(60)], pa.int32())], names=["text", "fold"])
    found = lambda: [b.to_pylist() for b in T._contexts(iter([rows]))]
    whole = found()
    monkeypatch.setattr(T, "HELD", 20)
    parts = found()
    assert len(whole) == 1 and len(parts) > 1 and all(len(p) < 20 + 4 * 5 for p in parts)
    distinct = lambda ps: {tuple(r.values()) for p in ps for r in p}
    assert distinct(parts) == distinct(whole)
