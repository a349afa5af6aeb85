"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text without its white space is cut into content-defined chunks; each
chunk gets a verified identifier (its 64-bit hash, plus a number for the
rare hash that stands for several byte-wise different chunks). A document's
recipe is the ordered list of these identifiers: two texts are equal exactly
when their recipes are. Chunk bytes move once, to verify identifiers;
afterwards only recipes (some 8 bytes for each several hundred characters)
are grouped, compared and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import WHITE, hash_collisions, stage, text_of, work_dir

#: A chunk ends after a sentence mark that some capital letters follow, 64 to 8192 characters from
#: its start; the trigger looks at content alone, so chunks fall back into step after an insertion.
CHUNK = r"(?s).{64,8191}?[.!?](?=[B-EL-PT-W])|.{1,8192}"


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     chunk_pattern: str = CHUNK, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting white space (null counts as
    empty). Of equal texts the row with the most code points stays, then the
    smallest id (null last); of rows that tie in both, one stays. Empty
    tables give no rows; other columns are ignored. No group is collected:
    the kept row is a ``min`` with map-side combine, so a group holding a
    third of all rows costs no more than others; the join back to the rows
    can be split by adaptive skew handling.
    """
    folder = work_dir(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    base = base.withColumn("norm", F.regexp_replace("text", WHITE, ""))
    chunks = F.regexp_extract_all("norm", F.lit(chunk_pattern), F.lit(0))
    rows = base.select(
        "doc_id", F.length("text").alias("n"), F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks, lambda c: chunk_hash(c)).alias("recipe"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), folder, "recipes")

    pieces = base.select(F.explode(chunks).alias("piece")).select(chunk_hash(F.col("piece")).alias("h"), "piece")
    clash = hash_collisions(pieces, folder)
    if clash is not None:
        rows = _verified(rows, base.select(F.sha2("norm", 256).alias("text_sha256"), chunks.alias("chunks")), clash,
                         chunk_hash, folder)

    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    groups = rows.groupBy("recipe").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    groups = stage(groups, folder, "groups")  # so that the join below is free to split a hot recipe
    same = rows.join(groups, "recipe")
    return same.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def _verified(rows: DataFrame, texts: DataFrame, clash: DataFrame, chunk_hash: Callable[[Column], Column],
              folder: str) -> DataFrame:
    """Recipes in which a hash that stands for several chunks carries the chunk's number.

    Every recipe becomes hash, number, hash, number, ...; only documents with
    such a hash are looked at again, chunk by chunk.
    """
    hashes = clash.select("h").distinct()
    again = texts.select("text_sha256", F.posexplode("chunks").alias("pos", "piece"))
    numbers = (again.withColumn("h", chunk_hash(F.col("piece"))).join(clash, ["h", "piece"])
               .select("text_sha256", "pos", "k").distinct()
               .groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("ks")))
    hit = rows.select("row", F.explode("recipe").alias("h")).join(hashes, "h", "left_semi").select("row").distinct()
    fixed = (rows.join(hit, "row", "left_semi").join(numbers, "text_sha256")
             .withColumn("recipe", F.flatten(F.transform("recipe", lambda h, i: F.array(
                 h, F.coalesce(F.element_at("ks", i), F.lit(0)).cast("long"))))).drop("ks"))
    rest = rows.join(hit, "row", "left_anti").withColumn(
        "recipe", F.flatten(F.transform("recipe", lambda h: F.array(h, F.lit(0).cast("long")))))
    return stage(rest.unionByName(fixed.select(rest.columns)), folder, "verified")
