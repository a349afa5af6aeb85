"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces go longest first; each goes to the bin that
fits it best under every constraint, by the norm of what would be left over
or by the weighted dot product of the piece with what is left.

Pieces of one length are alike, and so are bins that hold the same lengths.
The plan is therefore made on the histogram of piece lengths, which has at
most ``tokens`` rows however large the corpus: a step takes a run of pieces
of one length and a run of like bins and fills all of them at once. Tasks
then look up the place of each piece from its length and its rank among the
pieces of that length. Nothing but the histogram reaches the driver, and the
packing is that of one best-fit pass over the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlatlas.llm.common import stage, text_of, work_dir
from urlatlas.llm.token_ids import encoder


class Capacity(NamedTuple):
    """What a bin holds at most, and how much each kind weighs in the choice of a bin."""
    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)
    score: str = "residual_norm"  # or "dot_product"


def plan_bins(histogram: dict[int, int], cap: Capacity) -> np.ndarray:
    """Places for pieces ``{length: count}``: rows ``(length, rank, count, bin, per_bin, offset)``.

    Pieces ``rank`` to ``rank + count - 1`` of a length go to the bins from
    ``bin`` on, ``per_bin`` to each, from token ``offset`` on.
    """
    size = np.array(cap[:3], dtype=np.float64)
    weight = np.array(cap.weights) / size
    # runs of like bins: first bin, bins, used tokens, used documents, used attention
    runs = np.zeros((0, 5), dtype=np.int64)
    places, bins = [], 0
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if length < 1 or (item > size).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        rank, left = 0, histogram[length]
        most = int(min(size // item))  # of this length in an empty bin
        while left:
            residual = size - runs[:, 2:]
            fits = (residual >= item).all(axis=1)
            if fits.any():
                if cap.score == "dot_product":
                    value = -((residual * weight) @ (item * weight))
                else:
                    value = np.linalg.norm((residual - item) * weight, axis=1)
                k = int(np.argmin(np.where(fits, value, np.inf)))
                first, n, *used = runs[k].tolist()
                each = int((residual[k] // item).min())
            else:
                k, first, used, each = None, bins, [0, 0, 0], most
                n = -(-left // most)
                bins += n
            full, rest = min(n, left // each), 0
            if full < n and left % each and full == left // each:
                rest = left % each
            new = []
            for count, per in ((full, each), (1, rest)):
                if not per or not count:
                    continue
                places.append((length, rank, count * per, first, per, used[0]))
                new.append((first, count, *(u + per * int(i) for u, i in zip(used, item))))
                rank, left, first, n = rank + count * per, left - count * per, first + count, n - count
            if n:
                new.append((first, n, *used))
            kept = runs if k is None else np.delete(runs, k, axis=0)
            runs = np.concatenate([kept, np.array(new, dtype=np.int64).reshape(-1, 5)])
            runs = runs[cap.tokens - runs[:, 2] >= 1]
    return np.array(places, dtype=np.int64).reshape(-1, 6)


PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _cut(texts: DataFrame, id_type: str, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """Pieces of at most ``tokens`` ids, numbered by length within each task (``part``)."""
    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, end_id.to_bytes(4, "little")
        part, met = TaskContext.get().partitionId(), np.zeros(tokens + 1, dtype=np.int64)
        for b in it:
            at, rows = [], []
            for k, text in enumerate(b.column(1)):
                ids = encode(text.as_py()) + end
                for piece, a in enumerate(range(0, len(ids), 4 * tokens)):
                    data = ids[a:a + 4 * tokens]
                    n = len(data) // 4
                    at.append(k)
                    rows.append((piece, a // 4, n, zlib.crc32(data), part, met[n]))
                    met[n] += 1
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return texts.mapInArrow(cut, PIECES.format(id_type))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         cap: Capacity = Capacity()) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its ids and ``end_id``; only documents of more than
    ``cap.tokens`` ids are cut, into pieces of that many, the last may be
    shorter. Null and empty texts are one piece of one id; repeated rows and
    null ids are packed like any other; an empty table gives no rows. In a
    sequence, ``offset`` is gapless from 0.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col))
    pieces = stage(_cut(texts, id_type, tokenizer, end_id, cap.tokens), folder, "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), folder, "counts")
    # a window holds one row per task that met the length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stage(counts.select(F.col("length").alias("_length"), F.col("part").alias("_part"),
                                 F.coalesce(before, F.lit(0)).alias("before")), folder, "starts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_bins(histogram, cap))  # some rows for each length at most

    def look_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value[np.lexsort((plan.value[:, 1], plan.value[:, 0]))]
        step = max(histogram.values(), default=0) + 1
        keys = rows[:, 0] * step + rows[:, 1]
        for b in it:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            p = rows[np.searchsorted(keys, length * step + rank, side="right") - 1]
            k = rank - p[:, 1]
            seq, offset = p[:, 3] + k // np.maximum(p[:, 4], 1), p[:, 5] + k % np.maximum(p[:, 4], 1) * length
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], names=[
                "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    same = (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))
    ranked = pieces.join(starts, same).select("doc_id", "piece", "start", "length", "ids_crc32",
                                              (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(look_up, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, "
                                      "sequence_id long, offset long")
