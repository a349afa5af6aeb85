"""op1, op7, op9 and the component search against plain restatements."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from urlatlas.llm import chunk_recipes, line_chunks, simhash
from urlatlas.llm.common import work_dir
from urlatlas.llm.components import connected_components

LONG = "Sentence one is here. But another follows! " * 3000


def exact(rows):
    strip = {ord(c): None for c in " \t\n\x0b\x0c\r"}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(strip), []).append((-len(t or ""), i is None, i))
    return {k: (min(g)[2], len(g)) for k, g in groups.items()}


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (None, "ab"), (8, LONG), (9, LONG + " "),
        (10, LONG.replace("one", "two", 1)), (11, "a b"), (3, "a  b"), (12, "x" * 20000), (13, "x" * 20001)]


def check_exact(frame, **kw):
    got = chunk_recipes.exact_duplicates(frame(ROWS), **kw).collect()
    want = exact(ROWS)
    assert len(got) == len(ROWS)
    strip = {ord(c): None for c in " \t\n\x0b\x0c\r"}
    import hashlib
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)  # rows repeated in full count one keeper
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert strip


def test_exact_duplicates(frame):
    check_exact(frame)


def test_exact_duplicates_survive_hash_clashes(frame):
    check_exact(frame, chunk_hash=lambda c: F.length(c).cast("long"))


def test_exact_duplicates_empty(frame):
    assert chunk_recipes.exact_duplicates(frame([])).collect() == []


def passages():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [[line(60)], [line(20), line(20), "", line(20)], [line(30), line(21)], [line(1) for _ in range(60)]]
    short = line(12)
    docs = []
    for i in range(40):
        parts = [line(rnd.choice([3, 15, 70])) for _ in range(rnd.randint(0, 5))]
        for p in rnd.sample(shared, rnd.randint(0, 3)):
            parts += [*p, line(8), short]
        docs.append((i, "\n".join(parts)))
    docs += [(40, docs[7][1]), (41, ""), (42, "\n\n"), (43, "\n".join([shared[0][0]] * 3))]
    return docs, shared, short


def test_line_chunks_match_brute_force(frame):
    docs, shared, short = passages()
    got = {r.doc_id: r.text for r in line_chunks.drop_repeated_chunks(frame(docs)).collect()}
    assert got == brute.drop_repeated_lines(docs)
    texts = list(got.values())
    for p in shared:  # each passage stays once, in full
        assert sum("\n".join(p) in t for t in texts) == 1
    assert sum(short in t for t in texts) > 5  # short repeated lines stay


def test_line_chunks_survive_hash_clashes(frame):
    docs, _, _ = passages()
    plain = [(i, 0, t) for i, t in docs]
    df = frame(plain, "id long, tag long, text string") if False else frame([]).sparkSession.createDataFrame(
        plain, "id long, tag long, text string")
    got = line_chunks.repeated_lines(df, line_hash=lambda c: F.length(c).cast("long"))
    want = line_chunks.repeated_lines(df)
    as_set = lambda d: {(r.id, tuple(sorted(r.lines))) for r in d.collect()}
    assert as_set(got) == as_set(want) and as_set(want)


def test_line_chunks_nulls_and_repeats(frame):
    long = " ".join(f"w{i}" for i in range(55))
    rows = [(1, None), (1, None), (None, long), (2, "x\n" + long), (2, "x\n" + long), (3, long + "\ny")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", r.text is None)
                 for r in line_chunks.drop_repeated_chunks(frame(rows)).collect())
    assert got == sorted([((False, 1), "", True), ((False, 1), "", True), ((True, 0), "", False),
                          ((False, 2), "x\n" + long, False), ((False, 2), "x\n" + long, False), ((False, 3), "y", False)])
    assert line_chunks.drop_repeated_chunks(frame([])).collect() == []


@pytest.mark.parametrize("line_hash", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_line_chunks_of_repeated_rows_are_those_of_one(spark, line_hash):
    line = lambda k, n=20: " ".join(f"w{k}x{i}" for i in range(n))
    shared = "\n".join(line(k) for k in (1, 2, 3))  # under 51 words a line, 60 in all
    nameless = "\n".join(line(k, 25) for k in (4, 5, 6))
    rows = [(1, "a " + line(7) + "\n" + shared)] * 2 + [(2, shared + "\nend of two")]
    rows += [(3, "three begins\n" + nameless)] + [(None, nameless + "\nb " + line(8))] * 3 + [(None, "c\n" + nameless)]
    df = spark.createDataFrame([(i, zlib.crc32(t.encode()), t) for i, t in rows], "id long, tag long, text string")
    got = sorted((r.id is None, r.id or 0, sorted(r.lines)) for r in line_chunks.repeated_lines(df, line_hash=line_hash).collect())
    assert got == [(False, 2, [0, 1, 2]), (True, 0, [0, 1, 2]), (True, 0, [1, 2, 3])]


def test_repeated_rows_lose_passages_together(frame):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    shared = "\n".join(line(k) for k in (1, 2, 3))
    rows = [(1, "one\n" + shared)] + [(2, shared + "\ntwo")] * 2 + [(None, "none\n" + shared)] * 3
    got = [(r.doc_id, r.text, r.removed_lines) for r in line_chunks.drop_repeated_chunks(frame(rows)).collect()]
    want = [(1, "one\n" + shared, 0)] + [(2, "two", 3)] * 2 + [(None, "none", 3)] * 3
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_on_paths_and_stars(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(300, 300), (1, None)]
    edges += [(rnd.randint(400, 480), rnd.randint(400, 480)) for _ in range(60)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(df, work_dir(spark)).collect()}
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in edges:
        if b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}
    assert connected_components(df.limit(0), work_dir(spark)).collect() == []


def test_covering_masks_cover_every_pair_of_bits():
    for radius in (2, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_near_links_find_every_pair(spark):
    rnd = random.Random(9)
    fps = {0}
    base = [rnd.getrandbits(64) for _ in range(4)]
    for b in base:
        for _ in range(60):
            x = b
            for k in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << k
            fps.add(x)
    chain = rnd.getrandbits(64)
    for k in range(0, 64, 2):
        chain ^= 3 << k
        fps.add(chain)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps.values()], "fp long")
    links = simhash.near_links(df, 2, work_dir(spark))
    parts = {r.node: r.root for r in connected_components(links, work_dir(spark)).collect()}
    want = brute.components(fps)
    group = {}
    for i, c in want.items():
        group.setdefault(c, set()).add(simhash.signed(fps[i]))
    got = {}
    for f in map(simhash.signed, fps.values()):
        got.setdefault(parts.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, group.values()))


def test_near_duplicates_edge_cases(frame):
    text = " ".join(f"word{i % 97} x{i}" for i in range(400))
    rows = [(5, text), (3, text.upper()), (9, text + " end"), (None, text), (1, None), (2, ""), (2, ""), (7, "One Two"),
            (8, "one\ttwo"), (4, "one"), (6, "É é"), (10, text * 40)]
    got = simhash.near_duplicates(frame(rows)).collect()
    fps = {(r.doc_id): r.fingerprint for r in got}
    assert len(got) == len(rows)
    assert all(fps[i] == f"{brute.simhash(t):016x}" for i, t in rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[5] == comp[3] == comp[None] == 3 and comp[1] == comp[2] == 1 and comp[7] == comp[8] == 7
    kept = [r.doc_id for r in simhash.keep_one_of_each(frame(rows)).collect()]
    assert sorted(kept) == sorted({c for c in comp.values()})
    assert simhash.near_duplicates(frame([])).collect() == []


def test_one_row_of_every_component_stays(frame):
    word = lambda k: " ".join(f"k{k}x{i}" for i in range(300))
    rows = [(None, word(1)), (None, word(2)), (None, word(2).upper()), (None, word(3)), (None, word(3))]  # three, no ids
    rows += [(4, word(4)), (4, word(5)), (4, word(5))]  # one id, two components
    rows += [(3, word(6)), (5, word(6).upper()), (5, word(7)), (8, word(7))]  # 5 is in one and names another
    rows += [(9, word(8)), (None, word(8))]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(frame(rows)).collect()]
    assert sorted(t.lower() for _, t in kept) == sorted(word(k) for k in range(1, 9))
    assert {t: i for i, t in kept if i is not None} == {word(4): 4, word(5): 4, word(6): 3, word(7): 5, word(8): 9}
    assert all(c in frame(rows).columns for c in simhash.keep_one_of_each(frame(rows)).columns)
    assert simhash.keep_one_of_each(frame([])).collect() == []
