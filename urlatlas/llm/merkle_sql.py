"""The manifest's DuckDB twin: one SQL text with a subquery per level (comparison only)."""

from __future__ import annotations

from urlatlas.llm.merkle import FANOUT

#: Levels spelt out in the SQL: enough for ``3 ** 13`` rows a source and ``3 ** 6`` sources.
SOURCE_LEVELS, TOP_LEVELS = 13, 6
LESS = "replace(text, chr(10), '')"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32(s: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({s}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {bits}), 4294967295)"


def _levels(name: str, first: str, count: int) -> list[str]:
    """CTEs ``name0 ...``: nodes ``(tree, r, g, m)`` of every level, with what stands before and after them in their run."""
    out = [f"{name}0 AS ({first})"]
    for k in range(count):
        run = f"PARTITION BY tree, r // {FANOUT}"
        out.append(f"{name}{k}w AS (SELECT tree, r, m, "
                   f"coalesce(string_agg(g, '') OVER ({run} ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, "
                   f"coalesce(string_agg(g, '') OVER ({run} ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT tree, r // {FANOUT} AS r, CASE WHEN m > 1 THEN sha256(string_agg(g, '' ORDER BY r)) "
                   f"ELSE min(g) END AS g, (m + {FANOUT - 1}) // {FANOUT} AS m FROM {name}{k} GROUP BY tree, r // {FANOUT}, m)")
    return out


def proofs_sql() -> str:
    d = (f"d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree, {_leaf('text')} AS leaf, "
         f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf(LESS)} ELSE {_leaf('text')} END AS bad FROM documents)")
    rank = ("l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, "
            "count(*) OVER (PARTITION BY tree) AS n FROM d)")
    ctes = [d, rank, *_levels("s", "SELECT tree, rank AS r, leaf AS g, n AS m FROM l", SOURCE_LEVELS)]
    ctes.append(f"u AS (SELECT tree, g AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS m FROM s{SOURCE_LEVELS})")
    ctes += _levels("t", "SELECT '' AS tree, place AS r, subroot AS g, m FROM u", TOP_LEVELS)
    ctes.append("f0 AS (SELECT l.doc_id, l.tree, l.leaf, u.subroot, l.rank AS r, u.place, l.bad AS x, '' AS proof FROM l JOIN u USING (tree))")
    at, steps = 0, [("s", k, "f.tree = w.tree AND f.r = w.r", "r") for k in range(SOURCE_LEVELS)] + [
        ("t", k, "f.place = w.r", "place") for k in range(TOP_LEVELS)]
    for name, k, on, digit in steps:
        keep = {"r": "f.r", "place": "f.place"} | {digit: f"f.{digit} // {FANOUT}"}
        ctes.append(f"f{at + 1} AS (SELECT f.doc_id, f.tree, f.leaf, f.subroot, {keep['r']} AS r, {keep['place']} AS place, "
                    f"CASE WHEN w.m > 1 THEN sha256(w.pre || f.x || w.post) ELSE f.x END AS x, f.proof || w.pre || w.post AS proof "
                    f"FROM f{at} f JOIN {name}{k}w w ON {on})")
        at += 1
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, g AS root, sha256(proof) AS proof_sha256, x AS folded_root, "
            f"x = g AS verified FROM f{at}, t{TOP_LEVELS}")
