"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of consecutive benchmark words. For the windows
of one length, a shift table over blocks of two words says how far the search
may jump (a block that occurs in no window lets it skip almost a whole
window), buckets keyed by a window's last block select the test strings that
may end here, and a byte comparison with the text confirms. Document texts
are searched where they lie: no shuffle, no join, no pairs.

The benchmark travels to the tasks in blocks of bounded size; documents are
passed once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import fresh, stage, text_of, word_blocks, work_dir

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text searched for in one pass over the documents.
BLOCK_BYTES = 2_000_000
#: Windows of one row of the benchmark table that travels.
SEGMENT = 2000

#: Bytes that belong to words map to themselves (A-Z to a-z), all others to a space.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
                   for c in range(256))


def normalised(text: str | None) -> bytes:
    """Lower-cased words of ``text`` separated by spaces (runs of spaces possible)."""
    return (text or "").encode("utf-8").translate(WORD_BYTES)


class WindowSearch:
    """Search tables for windows of one length: ``windows`` maps a window's words to its item numbers."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[int]]):
        self.length = length
        self.block = block = min(2, length)
        self.default = length - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[int]]] = {}
        for window, items in windows.items():
            for end in range(block, length + 1):
                key = window[end - block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(window[-block:], {})[window] = items

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """``(number of the window's first word, items)`` for every occurrence, in order."""
        length, block, default, shift, bucket = self.length, self.block, self.default, self.shift, self.bucket
        end = length
        while end <= len(words):
            key = tuple(words[end - block:end])
            jump = shift.get(key, default)
            if jump:
                end += jump
                continue
            items = bucket[key].get(tuple(words[end - length:end]))
            if items:
                yield end - length, items
            end += 1


def searches(segments: list[tuple[int, list[bytes]]], window: int) -> list[WindowSearch]:
    """Search tables for ``(item number, words)`` segments, one for each window length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, words in segments:
        n = min(window, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(tuple(words[a:a + n]), set()).add(item)
    return [WindowSearch(n, w) for n, w in sorted(by_length.items())]


def find(text: str | None, tables: list[WindowSearch], window: int) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Word count, merged ranges ``[start, end)`` of hit words, and the items with occurring windows."""
    n, spans, items = 0, [], set()
    for first, words in word_blocks(normalised(text), window - 1):
        n = first + len(words)
        for t in tables:
            for at, found in t.occurrences(words):
                spans.append((first + at, first + at + t.length))
                items |= found
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return n, merged, items


FOUND = "struct<n_words: long, hits: array<struct<start: long, end: long>>, items: array<string>>"
ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         ("items", pa.list_(pa.string()))])

#: Search tables of the last block a Python worker met, so that its next task finds them built.
_BUILT: dict[str, tuple[list[str], list[WindowSearch]]] = {}


def _tables(key: str, segments: list[tuple[str, bytes]], window: int) -> tuple[list[str], list[WindowSearch]]:
    """Item ids by number, and the search tables of a block of the benchmark."""
    if key not in _BUILT:
        _BUILT.clear()
        names = sorted({item for item, _ in segments})
        number = {item: i for i, item in enumerate(names)}
        _BUILT[key] = names, searches([(number[item], words.split()) for item, words in segments], window)
    return _BUILT[key]


def _segments(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, words)``: benchmark words in rows of at most ``SEGMENT`` windows."""
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            items, out = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = normalised(text).split()
                for a in range(0, max(1, len(words) - window + 1) if words else 0, SEGMENT):
                    items.append(item)
                    out.append(b" ".join(words[a:a + SEGMENT + window - 1]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.string())], names=["item", "words"])

    named = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_of(text_col))
    return named.mapInArrow(cut, "item string, words string").distinct()


def _search_columns(benchmark: DataFrame, id_col: str, text_col: str, window: int,
                    block_bytes: int) -> list[Callable[[Column], Column]]:
    """Functions of a text column, one for each block of the benchmark, giving ``(n_words, hits, items)``."""
    spark, folder = benchmark.sparkSession, work_dir(benchmark.sparkSession)
    segments = stage(_segments(benchmark, id_col, text_col, window), folder, "segments")
    total = segments.agg(F.sum(F.length("words")).alias("n")).first().n or 0
    blocks = -(-total // block_bytes) or 1

    def column(k: int) -> Callable[[Column], Column]:
        # a block holds block_bytes on average by hash, whatever the benchmark's size
        mine = segments.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast([(r["item"], r["words"].encode("utf-8")) for r in mine])
        key = f"{folder}/{k}"

        def search(texts: pa.Array) -> pa.Array:
            names, tables = _tables(key, sent.value, window)
            rows = []
            for t in texts:
                n, hits, items = find(t.as_py(), tables, window)
                rows.append({"n_words": n, "hits": [{"start": x, "end": y} for x, y in hits],
                             "items": [names[i] for i in sorted(items)]})
            return pa.array(rows, ARROW_FOUND)

        search.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # arrow_udf reads types, not their names
        return F.arrow_udf(search, FOUND)

    return [column(k) for k in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, hits, items)`` per row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters
    from U+0080. A window is ``window`` consecutive words of an item; an item
    of fewer words, but not none, is one window. ``hits`` lists the merged
    ranges of document words inside occurrences, ``items`` the ids (as
    strings) of items with occurring windows. Null texts have no words; rows
    of one item id are one item, a null item id is the empty string; repeated
    document rows stay; an empty benchmark hits nothing.
    """
    columns = _search_columns(benchmark, item_id, item_text, window, block_bytes)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    if len(columns) == 1:
        return texts.select("doc_id", columns[0](F.col("text")).alias("f")).select("doc_id", "f.*")
    return _merged(texts, columns).select("doc_id", "n_words", "hits", "items",
                                          F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def _merged(texts: DataFrame, columns: list[Callable[[Column], Column]]) -> DataFrame:
    """One row per different ``(doc_id, tag)`` with what all blocks found; later passes move hits only."""
    tagged = texts.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    parts = [tagged.select("doc_id", "tag", f(F.col("text")).alias("f")).select("doc_id", "tag", "f.*")
             .withColumn("copies", F.lit(int(k == 0))) for k, f in enumerate(columns)]
    parts = [parts[0], *(p.where(F.size("items") > 0) for p in parts[1:])]
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "tag").agg(
        F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), both("hits"), both("items"))


def hit_words(hits: Column) -> Column:
    """Number of words in ``hits`` (sorted by start; ranges from different blocks may overlap)."""
    zero = F.lit(0).cast("long")
    return F.aggregate(hits, F.struct(zero.alias("n"), zero.alias("upto")), lambda a, r: F.struct(
        (a["n"] + F.greatest(zero, r["end"] - F.greatest(r["start"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], r["end"]).alias("upto")))["n"]


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: at least one word in twenty lies in an occurrence."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows, columns as they came; :func:`contamination` tells how they are judged."""
    columns = _search_columns(benchmark, "item_id", "text", window, block_bytes)
    found, rid, tag = fresh(docs, "_found", "_id", "_tag")
    if len(columns) == 1:
        judged = docs.withColumn(found, columns[0](text_of(text_col)))
        hit = hit_words(F.col(found)["hits"])
        return judged.where(~contaminated(hit, F.col(found)["n_words"])).drop(found)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    bad = (_merged(texts, columns).where(contaminated(hit_words(F.col("hits")), F.col("n_words")))
           .select(F.col("doc_id").alias(rid), F.col("tag").alias(tag)))
    same = F.col(id_col).eqNullSafe(F.col(rid)) & (F.xxhash64(text_of(text_col)) == F.col(tag))
    return docs.join(bad, same, "left_anti")
