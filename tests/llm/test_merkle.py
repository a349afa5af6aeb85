"""op11: the manifest against a plain tree in memory, with null, repeated and hot keys."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from urlatlas.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(digests):
    """Levels of a tree, the digests first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def others(levels, rank):
    out = []
    for level in levels[:-1]:
        run = rank // 3 * 3
        out.append([d for k, d in enumerate(level[run:run + 3], run) if k != rank])
        rank //= 3
    return out


def fold(digest, rank, path):
    for run in path:
        k = rank % 3
        digest = h("".join([*run[:k], digest, *run[k:]]))
        rank //= 3
    return digest


def expected(rows):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    groups = [(k, sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r) for r in g), key=lambda t: t[:3]))
              for k, g in groupby(sorted(rows, key=key), key)]
    trees = [tree([t[2] for t in g]) for _, g in groups]
    top = tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for s, (_, g) in enumerate(groups):
        for rank, (_, _, leaf, r) in enumerate(g):
            path, above = others(trees[s], rank), others(top, s)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            changed = leaf_of(r, r[4].replace("\n", "") if r[4] is not None else None) if even else leaf
            folded = fold(fold(changed, rank, path), s, above)
            out.append((r[0], leaf, trees[s][-1][0], root, h("".join(d for run in path + above for d in run)), folded, folded == root))
    return out


def result(spark, rows, levels=merkle.LEVELS):
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("id", "leaf", "tree", "rank", "n", "row", "tampered", "digest", "blk", "root")})
    return [tuple(r) for r in merkle.proofs(df, levels=levels).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def make(n, sources, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]),
             rng.choice([None, "", "a\nb", "one line", "é\n\n漢字", f"text {i}\n"])) for i in range(n)]


@pytest.mark.parametrize("n, sources, levels", [
    (1, ["a"], 5), (28, [None], 1), (40, ["a", None, "", "é", "z", "Z"], 5), (400, ["hot"] * 9 + ["b", None], 2)])
def test_equals_a_plain_tree(spark, n, sources, levels):
    # few levels a pack: many rounds and a descent through many packs on few rows
    rows = make(n, sources, n)
    rows += rows[:5] + [(None, rows[0][1], None, None, None)] * 3 if n > 2 else []
    assert order(result(spark, rows, levels)) == order(expected(rows))


def test_many_sources_and_an_empty_table(spark):
    rows = [(i, f"s{i % 300}", "en", i, "t\n" * (i % 3)) for i in range(320)]
    assert order(result(spark, rows)) == order(expected(rows))
    assert result(spark, []) == []


def test_siblings_and_damage(spark):
    rows = make(30, ["a", "b"], 7)
    df = spark.createDataFrame(rows, SCHEMA)
    m = merkle.build(df, [F.col(c) for c in df.columns])
    found = merkle.prove(m).collect()
    assert len(found) == 30
    for r in found:
        assert bytes(r["folded_root"]) == m.root  # nothing was tampered with
        assert bytes(r["proof"]) == merkle.hex_digest([bytes(d) for run in r["siblings"] for d in run])
        assert all(len(run) <= 2 for run in r["siblings"])
    records = dict(merkle.build_pack([bytes([k]) * 32 for k in range(8)], 2)[1])
    root, _ = merkle.build_pack([bytes([k]) * 32 for k in range(8)], 2)
    assert merkle.descend(records, root, 7, 2) == (b"\x07" * 32, [[merkle.hex_digest([bytes([k]) * 32 for k in g]) for g in ((0, 1, 2), (3, 4, 5))],
                                                                 [b"\x06" * 32]])
    with pytest.raises(ValueError):
        merkle.build_pack([b"a" * 32] * 10, 2)
