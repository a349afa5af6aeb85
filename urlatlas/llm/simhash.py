"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are computed per text in Arrow batches (numpy). Near-duplicate
linking works on distinct fingerprints, so a group of copies is one row.

Covering masks: every bit position gets a non-zero vector of ``radius + 1``
bits, every table a non-zero vector too; a table's mask keeps the positions
whose vector has an odd product with the table's. Up to ``radius`` positions
in which two fingerprints differ give ``radius`` linear conditions on a
table vector of ``radius + 1`` bits, which have a non-zero solution: in that
table the two agree on every kept bit. So each pair within the radius meets
in at least one of ``2^(radius+1) - 1`` tables, with no probability involved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import fresh, stage, text_of, word_blocks, work_dir
from urlatlas.llm.components import connected_components

BITS = 64
#: Maps the white space of the contract to spaces.
BLANKS = bytes(0x20 if 9 <= c <= 13 else c for c in range(256))


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``; zero if it has no words.

    A-Z are lower-cased, words are runs without ASCII white space; fewer than
    ``width`` words are one shingle. Repeated shingles count as often as they occur.
    """
    import xxhash
    raw = (text or "").encode("utf-8").lower().translate(BLANKS)  # bytes.lower: A-Z only
    ones, n, few = np.zeros(BITS, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for _, words in word_blocks(raw, width - 1):
        m = len(words) - width + 1
        if m < 1:
            few = words
            continue
        shingles = zip(*(words[k:] for k in range(width)))
        h = np.fromiter((digest(b" ".join(s), seed) for s in shingles), dtype="<u8", count=m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += m
    if not n:
        return digest(b" ".join(few), seed) if few else 0
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                 tagged: bool = False) -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint as a signed long. Null texts count as empty.

    ``tagged`` adds ``tag``, a hash of the text that tells texts of one id apart.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([simhash(t.as_py(), width) for t in b.column(1)], dtype="<u8").view("<i8")
            kept = [b.column(0), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.int64())], names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "tag", "fp"] if tagged else ["id", "fp"]
    tag = [F.xxhash64(text_of(text_col)).alias("tag")] if tagged else []
    return docs.select(F.col(id_col).alias("id"), text_of(text_col), *tag).mapInArrow(
        batches, f"id {id_type}, {'tag long, ' if tagged else ''}fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int) -> list[int]:
    """The kept-bit masks of the covering family, one for each table."""
    tables = range(1, 1 << (radius + 1))
    vector = [i % len(tables) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & t).bit_count() % 2) for t in tables]


def _bits(mask: Column) -> Column:
    """Array of the single-bit longs set in ``mask``."""
    one = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.filter(one, lambda b: b.bitwiseAND(mask) != 0)


def _ball_edges(fps: DataFrame, free: Column, radius: int) -> DataFrame:
    """Edges ``(u, v)`` that connect fingerprints within ``radius`` over a shared free-bit change.

    For an even radius two fingerprints differ in at most ``radius`` bits
    exactly when changing at most ``radius / 2`` bits of each can give one
    common value. All that give a value link to the smallest of them. A value
    has at most 1 + 64 (for radius 2) such fingerprints, so no group is large
    however many near copies there are, and no pairs are listed.
    """
    around = F.array(F.col("fp"))
    near = around
    for _ in range(radius // 2):
        near = F.flatten(F.transform(near, lambda x: F.concat(
            F.array(x), F.transform(_bits(free), lambda b: x.bitwiseXOR(b)))))
    values = fps.select("fp", F.explode(F.array_distinct(near)).alias("value"))
    met = values.groupBy("value").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u <> v").distinct()


def near_links(distinct: DataFrame, radius: int, folder: str) -> DataFrame:
    """Edges that connect exactly the distinct fingerprints ``(fp)`` within ``radius`` bits (even).

    Each fingerprint enters one bucket per covering mask. Buckets with one
    member drop out; a fingerprint's free bits are those its shared buckets
    leave out. Every pair within the radius shares a bucket, so all its
    differing bits are free in both.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius must be 2 or 4")
    masks = [signed(m) for m in covering_masks(radius)]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("b"))
    keyed = keyed.select("fp", "b.t", "b.key")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    left_out = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("t") + 1)
    free = (keyed.join(shared, ["t", "key"], "left_semi").groupBy("fp").agg(F.bit_or(left_out).alias("free")))
    free = stage(free, folder, "free")
    return _ball_edges(free, F.col("free"), radius)


def component_roots(distinct: DataFrame, radius: int, folder: str) -> DataFrame:
    """``distinct`` (one row per fingerprint ``fp``) with ``root``, the smallest fingerprint reachable over links."""
    parts = stage(connected_components(near_links(distinct, radius, folder), folder), folder, "components")
    return distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        *distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable over links. Null and empty
    texts have fingerprint zero and link like any other. Null ids get the
    component of their fingerprint but never name one (a component of null
    ids only has a null id). Repeated rows stay; extra columns are ignored;
    an empty table gives no rows. Copies are never expanded into pairs.
    """
    folder = work_dir(docs.sparkSession)
    rows = stage(fingerprints(docs, id_col, text_col, width), folder, "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), folder, "distinct")
    roots = component_roots(distinct, radius, folder)
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    same = rows.join(by_fp, F.col("fp") == F.col("_fp"))
    return same.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                     radius: int = 2) -> DataFrame:
    """One row of ``docs`` of every near-duplicate component, columns as they came.

    The row with the smallest id stays, null last; of several texts of that
    id the one with the smallest hash; of rows equal in both any one. An id
    is no name for a component here: it may be null, or have texts in several.
    """
    folder = work_dir(docs.sparkSession)
    rid, own, tag = fresh(docs, "_id", "_own", "_tag")
    rows = stage(fingerprints(docs, id_col, text_col, width, tagged=True), folder, "fingerprints")
    place = F.struct(F.col("id").isNull().alias("no"), "id", "tag")
    distinct = stage(rows.groupBy("fp").agg(F.min(place).alias("first")), folder, "distinct")
    first = component_roots(distinct, radius, folder).groupBy("root").agg(F.min("first").alias("first"))
    first = stage(first.select(F.col("first.id").alias(rid), F.col("first.tag").alias(tag)), folder, "first")
    mine = F.col(id_col).eqNullSafe(F.col(rid)) & (F.col(own) == F.col(tag))
    chosen = docs.withColumn(own, F.xxhash64(text_of(text_col))).join(first, mine, "left_semi")
    # whole rows are compared only where rows repeat at all
    repeated = rows.groupBy("id", "tag").count().where("count > 1")
    return (chosen if repeated.isEmpty() else chosen.dropDuplicates([id_col, own])).drop(own)
