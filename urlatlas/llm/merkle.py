"""Merkle dataset manifest: a content-addressed DAG over the rows of a table, and inclusion proofs from it.

Every row is a leaf. Per source the leaves, in id order, are hashed three at
a time until one digest is left, the subroot; the subroots, in source order,
are hashed likewise into the root. The manifest stores, for every inner node,
its digest and the digests of its children, in packs: a pack holds the nodes
of ``LEVELS`` levels under one digest and is found by that digest. Proofs are
made by descent: requests start at the root, the digits of their ranks (base
three, highest first) choose a child at every node, the children not chosen
are collected, and the path is reversed at the end. Requests of leaves that
share a pack descend to it together, so neither the root nor a large source
meets more than one row per pack, and what moves per leaf is a few digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from urlatlas.llm.common import stage, work_dir

FANOUT = 3
#: Levels of nodes in a pack; at most ``FANOUT ** LEVELS`` children leave it.
LEVELS = 5
#: Rows that a task gives to Spark at a time.
BATCH = 256

Records = dict[bytes, list[bytes]]


class Manifest(NamedTuple):
    """The stored DAG; digests are binary here and hex text where they are hashed or shown.

    ``leaves (tree, rank, n, id, leaf, tampered)`` are the ranked rows and
    ``sources (all, tree, rank, n, subroot, leaves)`` the ranked subroots.
    ``packs[k] (digest, records)`` hold the nodes of the source trees whose
    level above the leaves is from ``k * levels`` to ``(k + 1) * levels``, and
    ``top_packs`` those above the subroots. ``root`` is None for an empty table.
    """
    leaves: DataFrame
    sources: DataFrame
    packs: list[DataFrame]
    top_packs: list[DataFrame]
    root: bytes | None
    levels: int
    folder: str


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: of every value's UTF-8 byte count, ``:`` and itself, ``-`` where null."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_digest(digests: list[bytes]) -> bytes:
    """SHA-256 of the digests' hex texts, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode("ascii")).digest()


def ranked(rows: DataFrame, tree: str, order: list[str], folder: str, name: str) -> DataFrame:
    """Adds ``rank``, the place of a row among those of its ``tree`` in ``order`` (from 0), and ``n``, their number.

    Rows are range-partitioned and sorted; a row's place in its partition,
    less that of its tree's first row there, plus the tree's rows in earlier
    partitions, is its rank. No task holds more of a tree than a range
    partition, and the table of counts has one row per tree and partition.
    ``order`` must leave no ties among rows that differ.
    """
    keys = [tree, *order]
    # each id is the partition and, in the lower 33 bits, the place there
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = stage(laid, folder, f"{name}-sorted").withColumn("_part", F.shiftright("_at", 33))
    counts = laid.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part")
    counts = counts.select(
        tree, "_part", "_first", F.sum("_n").over(Window.partitionBy(tree)).alias("n"),
        (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    placed = laid.join(stage(counts, folder, f"{name}-counts"), [tree, "_part"])
    return placed.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def heights(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def build_pack(digests: list[bytes], levels: int) -> tuple[bytes, Records]:
    """The node ``levels`` above consecutive ``digests``, and the record of every node in between."""
    records: Records = {}
    for _ in range(levels):
        above = []
        for k in range(0, len(digests), FANOUT):
            children = digests[k:k + FANOUT]
            above.append(hex_digest(children))
            records[above[-1]] = children
        digests = above
    if len(digests) != 1:
        raise ValueError("more digests than the levels hold")
    return digests[0], records


_PACK = "array<struct<digest binary, children array<binary>>>"
_PACK_TYPE = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
_PATH = "array<array<binary>>"
_PATH_TYPE = pa.list_(pa.list_(pa.binary()))


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a row that holds a pack is large, a batch of them is not taken apart at once."""
    for b in it:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)


def _packs(it: Iterator[pa.RecordBatch], depth: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Packs of ``(tree, blk, n, digests)``, which hold the digests of a pack in the order of their ranks."""
    def made() -> Iterator[tuple]:
        for r in _rows(it):
            digest, records = build_pack([d["digest"] for d in r["digests"]], min(levels, heights(r["n"]) - depth * levels))
            yield r["tree"], r["blk"], r["n"], digest, [{"digest": k, "children": v} for k, v in records.items()]

    return _batches(made(), pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                                       ("records", _PACK_TYPE)]))


def _block(levels: int) -> Column:
    return F.expr(f"rank div {FANOUT ** levels}").alias("blk")


def grow(leaves: DataFrame, levels: int, folder: str, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Hashes the trees of ``leaves (tree, rank, n, digest)`` up to their roots.

    Returns ``(tree, digest)`` of the roots, and the packs ``(digest,
    records)`` of every round. A round takes ``levels`` levels: it groups
    consecutive digests, and what it gives is the next one's leaves.
    A tree that has its root already goes through later rounds as it is.
    """
    rows, packs = leaves.select("tree", "rank", "n", "digest"), []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        depth = len(packs)
        grouped = rows.groupBy("tree", _block(levels), "n").agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("digests"))
        made = grouped.mapInArrow(
            lambda it, depth=depth: _packs(it, depth, levels), f"tree string, rank long, n long, digest binary, records {_PACK}")
        made = stage(made, folder, f"{name}-packs-{depth}")
        packs.append(made.select("digest", "records"))
        rows = made.select("tree", "rank", "n", "digest")
        if heights(most) <= (depth + 1) * levels:
            return rows.select("tree", "digest"), packs


def build(rows: DataFrame, values: list[Column], id_col: str = "doc_id", source_col: str = "source",
          tampered: Column | None = None, levels: int = LEVELS) -> Manifest:
    """Hashes ``rows`` into a manifest, which is written to a new work folder.

    A leaf is the digest of ``values``; ``tampered`` is another digest per
    row that is kept beside it for checks (null: none). Order within a
    source: null ids first, then rising; rows of one id by their leaves.
    Rows that are equal throughout are leaves of their own.
    """
    folder = work_dir(rows.sparkSession)
    other = tampered if tampered is not None else F.lit(None)
    source = F.col(source_col).cast("string")
    leaves = stage(rows.select(
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("tree"),  # null sources before the others
        F.col(id_col).alias("id"), leaf_digest(values).alias("leaf"), other.cast("binary").alias("tampered"),
        F.monotonically_increasing_id().alias("row")), folder, "leaves")
    leaves = stage(ranked(leaves, "tree", ["id", "leaf", "row"], folder, "leaves").drop("row"), folder, "ranked-leaves")
    subroots, packs = grow(leaves.withColumnRenamed("leaf", "digest"), levels, folder, "sources")
    sizes = leaves.groupBy("tree").agg(F.max("n").alias("leaves"))
    sources = subroots.join(sizes, "tree").select(F.lit("").alias("all"), "tree", F.col("digest").alias("subroot"), "leaves")
    sources = stage(ranked(sources, "all", ["tree"], folder, "all"), folder, "ranked-sources")
    roots, top_packs = grow(sources.select(F.col("all").alias("tree"), "rank", "n", F.col("subroot").alias("digest")), levels, folder, "all")
    root = roots.first()  # one row, none for an empty table
    return Manifest(leaves, sources, packs, top_packs, bytes(root["digest"]) if root else None, levels, folder)


def descend(records: Records, digest: bytes, rank: int, levels: int) -> tuple[bytes, list[list[bytes]]]:
    """From ``digest`` down by the digits of ``rank``: the digest reached, and the children not chosen at each level."""
    segments = []
    for level in range(levels - 1, -1, -1):
        children = records[digest]
        digit = rank // FANOUT ** level % FANOUT
        segments.append(children[:digit] + children[digit + 1:])
        digest = children[digit]
    return digest, segments


def fold(leaf: bytes, rank: int, path: list[list[bytes]]) -> bytes:
    """Root of ``leaf`` at ``rank`` from the siblings of every level, lowest first."""
    for others in path:
        digit = rank % FANOUT
        leaf = hex_digest([*others[:digit], leaf, *others[digit:]])
        rank //= FANOUT
    return leaf


def _height(n: Column) -> Column:
    """``heights`` as a column: thresholds are exact, unlike a logarithm."""
    out, power = F.lit(0), 1
    while power < 1 << 62:
        out, power = out + (n > power).cast("int"), power * FANOUT
    return out


def _step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests one pack further down: one row for every digest that leaves their pack."""
    def moved() -> Iterator[tuple]:
        for r in _rows(it):
            records = {e["digest"]: e["children"] for e in r["records"]}
            exits = [(r["digest"], r["path"])]
            for _ in range(r["levels"]):
                exits = [(c, [*path, records[d][:k] + records[d][k + 1:]])
                         for d, path in exits for k, c in enumerate(records[d])]
            # only the last node of a level has fewer children than FANOUT, so exits are consecutive ranks
            for k, (digest, path) in enumerate(exits):
                yield r["tree"], r["rank"] * FANOUT ** r["levels"] + k, r["n"], digest, path

    return _batches(moved(), pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                                        ("path", _PATH_TYPE)]))


def _stored(packs: DataFrame) -> DataFrame:
    """Packs by their content: equal digests stand for equal nodes, of which one copy is enough."""
    return packs.groupBy("digest").agg(F.first("records").alias("records"))


def _down(start: DataFrame, packs: list[DataFrame], levels: int, last: int, folder: str, name: str) -> DataFrame:
    """Requests ``(tree, rank, n, digest, path)`` from the roots of their trees down to the nodes of level ``last * levels``.

    Trees that are less high wait at their root until the others have come down to them.
    """
    now, height = start, _height(F.col("n"))
    for depth in range(len(packs) - 1, last - 1, -1):
        moving = now.where(height > depth * levels).withColumn("levels", F.least(F.lit(levels), height - depth * levels))
        stepped = moving.join(_stored(packs[depth]), "digest").mapInArrow(
            _step, f"tree string, rank long, n long, digest binary, path {_PATH}")
        waiting = now.where(height <= depth * levels).select("tree", "rank", "n", "digest", "path")
        now = stage(stepped.unionByName(waiting), folder, f"{name}-{depth}")
    return now


def prove(manifest: Manifest, with_siblings: bool = True) -> DataFrame:
    """``id, leaf, subroot, proof, folded_root`` of every leaf, and ``siblings``.

    ``siblings`` lists the others of each run of nodes, lowest level first,
    through the subroot to the root (null if not wanted); ``proof`` is their
    digest, and ``folded_root`` what they give with the tampered digest, or
    with the leaf where there is none.
    """
    folder, sources, levels = manifest.folder, manifest.sources, manifest.levels
    # all requests start at the root; those of one source go down to its subroot together
    start = sources.where("rank = 0").select(F.lit("").alias("tree"), "rank", "n", F.lit(manifest.root).cast("binary").alias("digest"),
                                             F.array().cast(_PATH).alias("path"))
    top = _down(start, manifest.top_packs, levels, 0, folder, "descent-all").select("rank", "path")
    begun = stage(top.join(sources.drop("n"), "rank").select("tree", F.col("rank").alias("source_rank"), "subroot", "leaves", "path"),
                  folder, "descent-sources")
    begin = begun.select("tree", F.lit(0).cast("long").alias("rank"), F.col("leaves").alias("n"), F.col("subroot").alias("digest"), "path")
    # then to the lowest pack of every leaf, one row per pack
    low = _down(begin, manifest.packs, levels, 1, folder, "descent-leaves").join(begun.select("tree", "source_rank", "subroot"), "tree")
    low = low.select("tree", F.col("rank").alias("blk"), "digest", "path", "source_rank", "subroot", _height(F.col("n")).alias("height"))
    asked = manifest.leaves.groupBy("tree", _block(levels)).agg(F.collect_list(F.struct("rank", "id", "leaf", "tampered")).alias("requests"))
    last = asked.join(low, ["tree", "blk"]).join(_stored(manifest.packs[0]), "digest")
    kind = manifest.leaves.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *((c, pa.binary()) for c in ("leaf", "subroot", "proof", "folded_root")),
                        ("siblings", _PATH_TYPE)])

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proved() -> Iterator[tuple]:
            for r in _rows(it):
                records, height = {e["digest"]: e["children"] for e in r["records"]}, r["height"]
                for q in r["requests"]:
                    leaf, segments = descend(records, r["digest"], q["rank"], min(levels, height))
                    if leaf != q["leaf"]:
                        raise ValueError("the descent reached a leaf that is not the one asked for")
                    path = (r["path"] + segments)[::-1]
                    # the lowest levels are the source's, by the leaf's rank; those above it go by the source's
                    changed = leaf if q["tampered"] is None else q["tampered"]
                    folded = fold(fold(changed, q["rank"], path[:height]), r["source_rank"], path[height:])
                    yield (q["id"], leaf, r["subroot"], hex_digest([d for others in path for d in others]), folded,
                           path if with_siblings else None)

        return _batches(proved(), schema)

    return last.mapInArrow(finish, f"id {kind.simpleString()}, leaf binary, subroot binary, proof binary, folded_root binary, siblings {_PATH}")


def proofs(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
           source_col: str = "source", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Rows whose id has an even crc32 are tampered with after hashing: their
    text loses its line feeds (a null text, or one without line feeds, stays
    as it is; a null id is never chosen). ``verified`` tells whether the row
    as it is then folds to the root with the original siblings. Nulls in any
    column, empty texts, repeated ids and repeated rows are leaves like any
    others; a null source is a source of its own, before the others; an
    empty table gives no rows.
    """
    changed = F.when(F.crc32(F.col(id_col).cast("string")) % 2 == 0,
                     leaf_digest([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in columns]))
    rows = docs.select(*dict.fromkeys([*columns, id_col, source_col]))
    manifest = build(rows, [F.col(c) for c in columns], id_col, source_col, changed, levels)
    found = prove(manifest, with_siblings=False)
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root).cast("binary")
    return found.select(F.col("id").alias(id_col), text("leaf").alias("leaf"), text("subroot").alias("subroot"),
                        text(root).alias("root"), text("proof").alias("proof_sha256"), text("folded_root").alias("folded_root"),
                        (F.col("folded_root") == root).alias("verified"))
