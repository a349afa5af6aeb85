"""Keyword tables against texts: one pass of every text over a multi-pattern automaton.

The keywords become a trie with failure links (Aho-Corasick), so a text is
read once whatever the number of keywords. An automaton is built in the
Python workers from a broadcast of bounded bytes, once per worker; a larger
table is cut into such blocks by a hash of the keyword, and the blocks follow
each other: each one's hits are written before the next one's is sent, so
neither the driver nor a worker holds more than one block.
"""

from __future__ import annotations

import uuid
from typing import Sequence, Union

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .util import cut_lineage

#: Bytes of keyword text in one automaton (some hundred thousand keywords).
BLOCK_BYTES = 2 << 20


def _finder(spark: SparkSession, rows: Sequence):
    """A broadcast of keywords (``kw``, ``lowered``), and a text function giving those found, in their order.

    The function holds all it needs, so workers do not import this package.
    The automaton is kept beside the broadcast value: one per worker, however
    many tasks and batches it runs.
    """
    words: dict[str, list[int]] = {}  # several spellings may have one lower case
    for k, r in enumerate(rows):
        words.setdefault(r["lowered"], []).append(k)
    sent = spark.sparkContext.broadcast({"words": words, "spelt": [r["kw"] for r in rows]})

    def find(texts: pa.Array) -> pa.Array:
        held = sent.value
        if "found" not in held:
            import ahocorasick
            tree = ahocorasick.Automaton()
            for k, (word, numbers) in enumerate(held["words"].items()):
                if word:
                    tree.add_word(word, k)
            tree.make_automaton()
            held["always"] = held["words"].get("", [])  # the empty keyword occurs in every text
            held["numbers"] = list(held["words"].values())
            held["tree"] = tree if len(tree) else None
            held["found"] = True
        tree, numbers, always, spelt = held["tree"], held["numbers"], held["always"], held["spelt"]
        out = []
        for t in texts:
            t = t.as_py()
            if t is None:
                out.append([])
                continue
            hits = {k for _, k in tree.iter(t)} if tree is not None else ()
            out.append([spelt[n] for n in sorted([n for k in hits for n in numbers[k]] + always)])
        return pa.array(out, pa.list_(pa.string()))

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return sent, F.arrow_udf(find, "array<string>")


def match_keywords(df: DataFrame, keywords: Union[Sequence[str], DataFrame], text_col: str = "text",
                   out: str = "keywords", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tag every row with the keywords its (lower-case) text contains.

    ``keywords`` is a list (result in list order, repeats kept) or a table
    whose first column holds them (distinct, ascending); nulls are no
    keywords. Keywords are compared in lower case and returned as spelt.
    The empty keyword occurs in every text, and a null text holds none.
    """
    spark = df.sparkSession
    if isinstance(keywords, DataFrame):
        kw = keywords.select(F.col(keywords.columns[0]).cast("string").alias("kw")).where(F.col("kw").isNotNull()).distinct()
    else:
        listed = spark.createDataFrame([(k, w) for k, w in enumerate(keywords) if w is not None], "k int, kw string")
        _, find = _finder(spark, listed.withColumn("lowered", F.lower("kw")).orderBy("k").collect())
        return df.withColumn(out, find(F.col(text_col)))
    kw = kw.withColumn("lowered", F.lower("kw"))
    size = kw.agg(F.sum(F.octet_length("lowered")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = max(1, -(-((size["b"] or 0) + 8 * size["n"]) // block_bytes))
    if blocks == 1:
        _, find = _finder(spark, kw.orderBy("kw").collect())  # bounded by block_bytes
        return df.withColumn(out, find(F.col(text_col)))
    return _in_blocks(df, kw, blocks, text_col, out)


def _in_blocks(df: DataFrame, kw: DataFrame, blocks: int, text_col: str, out: str) -> DataFrame:
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keyword-hits-{uuid.uuid4().hex}"
    # rows and blocks are fixed first: every pass must see the same row numbers and the same keywords
    rows = cut_lineage(df.withColumn("_rid", F.monotonically_increasing_id()))
    kw.withColumn("block", F.pmod(F.xxhash64("kw"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/table")
    table = spark.read.schema("kw string, lowered string, block int").parquet(f"{folder}/table")
    for b in range(blocks):
        sent, find = _finder(spark, table.where(F.col("block") == b).collect())  # about block_bytes
        hits = rows.select("_rid", find(F.col(text_col)).alias("_k")).where(F.size("_k") > 0)
        hits.write.parquet(f"{folder}/hits/block={b}")
        sent.destroy()
    hits = spark.read.schema("_rid long, _k array<string>, block int").parquet(f"{folder}/hits")
    hits = hits.groupBy("_rid").agg(F.array_sort(F.flatten(F.collect_list("_k"))).alias("_hits"))
    found = F.coalesce(F.col("_hits"), F.array().cast("array<string>"))
    return rows.join(hits, "_rid", "left").withColumn(out, found).drop("_rid", "_hits")
