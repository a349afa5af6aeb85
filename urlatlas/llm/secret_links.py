"""Secret scan with multipart credential linking.

Tasks cut parts out of whole texts: strong ones by the base patterns, weak
ones (user and client names, random-looking strings, service addresses) by
looser ones. A weak part says little by itself; it is reported when a
complementary part lies in its scope: within ``REACH`` characters in the same
paragraph (paragraphs end at blank lines). Names and addresses need a secret,
secrets need a name or an address.

The parts meet in an interval join: every part enters the cells of text it
touches, a weak part those its scope touches, and a semi-join on (row,
paragraph, cell, role) with an overlap test confirms it. A cell holds a
bounded number of parts (they do not overlap within a kind), so a text full
of parts cannot blow up the join, and no pairs are produced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import stage, text_of, work_dir

#: Code points between a weak part and its complement at most, and the size of a join cell.
REACH, CELL = 200, 512

#: Base kinds (fixed values): pattern, group that is measured, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # same matches as [0-9a-f]+ of 24 and more
}
#: Weak kinds: pattern and the group that is the part.
WEAK = {
    "id": (re.compile(r"""(?:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE), 1),
    "secret": (re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])"
                          r"[A-Za-z0-9+/_-]{20,}={0,2}"), 0),
    "endpoint": (re.compile(r"""(?:https?|ftps?|sftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)"""
                            r"""://[^\s"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]{4,}(?::[0-9]+)?)""",
                            re.ASCII | re.IGNORECASE), 0),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "name", "id": "name", "endpoint": "address"}
NEEDS = {"id": ["secret"], "endpoint": ["secret"], "secret": ["name", "address"]}
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base kinds in order of start, then kind."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def weak_spans(text: str, strong: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak candidates that touch no base span."""
    out = []
    for kind, (pattern, group) in WEAK.items():
        out += [(m.start(group), kind, m.end(group)) for m in pattern.finditer(text)]
    taken = _merged([(a, b) for a, _, b in strong])
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)  # the last base range that starts before the candidate's end
        return k == 0 or taken[k - 1][1] <= a

    return sorted(s for s in out if free(s[0], s[2]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


PARTS = "array<struct<kind: string, start: int, end: int, paragraph: int>>"
ARROW_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("paragraph", pa.int32())]))


def _find_parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for text in b.column(2):
            text = text.as_py()
            strong = base_spans(text)
            found = strong + weak_spans(text, strong)
            ends = [m.start() for m in BLANK_LINE.finditer(text)] if len(found) > 1 else []
            rows.append([{"kind": k, "start": a, "end": e, "paragraph": bisect_left(ends, a)} for a, k, e in found])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, ARROW_PARTS)],
                                         names=["doc_id", "row", "parts"])


def _by_kind(values: dict, kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x))
                                       for pair in values.items() for x in pair]), kind)


def linked(parts: DataFrame, reach: int = REACH, cell: int = CELL) -> DataFrame:
    """The weak parts of ``(row, kind, start, end, paragraph)`` that have a complement in their scope, beside them."""
    cells = lambda a, b: F.explode(F.sequence((a / cell).cast("int"), (b / cell).cast("int"))).alias("cell")
    weak = parts.where(F.col("kind").isin(*WEAK))
    low, high = F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach
    seeking = (weak.select("*", F.explode(_by_kind(NEEDS, F.col("kind"))).alias("role"), low.alias("low"), high.alias("high"))
               .select("*", cells(F.col("low"), F.col("high"))))
    # complements as (place, role) with their extent: the cell of a part holds its start, longer parts enter several
    there = parts.select(F.col("row").alias("row_"), F.col("paragraph").alias("paragraph_"),
                         _by_kind(ROLE, F.col("kind")).alias("role_"), F.col("start").alias("a"), F.col("end").alias("b"),
                         cells(F.col("start"), F.col("end"))).withColumnRenamed("cell", "cell_")
    meets = ((F.col("row") == F.col("row_")) & (F.col("paragraph") == F.col("paragraph_"))
             & (F.col("cell") == F.col("cell_")) & (F.col("role") == F.col("role_"))
             & (F.col("a") < F.col("high")) & (F.col("b") > F.col("low"))
             # parts that overlap are readings of one place, not two complementary ones
             & ((F.col("b") <= F.col("start")) | (F.col("a") >= F.col("end"))))
    return seeking.join(there, meets, "left_semi").select("row", "kind", "start", "end").distinct()


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``(doc_id, base, spans)`` per row of ``docs``: arrays of ``(start, rank, kind, end)`` in order.

    ``base`` has the base kinds, ``spans`` these and the linked weak parts;
    offsets are code points, ends exclusive, ``rank`` is the kind's place in
    ``KINDS``. Null and empty texts have none; repeated rows, null ids and
    extra columns change nothing; an empty table gives no rows.
    """
    folder, id_type = work_dir(docs.sparkSession), docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col))
    found = stage(texts.mapInArrow(_find_parts, f"doc_id {id_type}, row long, parts {PARTS}"), folder, "parts")
    parts = found.where(F.size("parts") > 1).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    ranks = {k: i for i, k in enumerate(KINDS)}
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c)
    span = lambda p: F.struct(p["start"].alias("start"), rank(p["kind"]).alias("rank"), p["kind"].alias("kind"),
                              p["end"].alias("end"))
    extra = linked(parts, reach).groupBy("row").agg(F.collect_list(F.struct(
        "start", rank(F.col("kind")).alias("rank"), "kind", "end")).alias("extra"))
    strong = F.transform(F.filter("parts", lambda p: p["kind"].isin(*BASE)), span)
    return (found.join(extra, "row", "left").withColumn("base", F.array_sort(strong))
            .select("doc_id", "base", F.when(F.col("extra").isNull(), F.col("base"))
                    .otherwise(F.array_sort(F.concat("base", "extra"))).alias("spans")))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
