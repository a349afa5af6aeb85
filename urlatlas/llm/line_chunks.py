"""Line deduplication by content-defined line chunks (DataFrame functions only).

Every line has a 64-bit hash. From every line that holds words a chunk rolls
forward over the following line hashes, and another rolls backward, until it
holds ``min_words`` words: where a chunk ends depends on the lines inside it
alone, so an insertion elsewhere in the document shifts no chunk, and a
repeated passage is covered from its first line (forward chunks) to its last
(backward chunks) whatever surrounds it. A chunk is known by the ordered list
of its verified line hashes; chunks met more than once are repeated, and every
occurrence but the first (smallest document id, then place) loses its lines.

The text moves twice: once to compare the bytes of lines that share a hash
(distinct lines, after a map-side combine), once to rebuild the documents
that lose lines. Everything between works on hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlatlas.llm.common import fresh, hash_collisions, stage, text_of, work_dir

#: "Over 50 words".
MIN_WORDS = 51


def line_table(docs: DataFrame, line_hash: Callable[[Column], Column]) -> DataFrame:
    """``(id, tag, pos, line)`` for lines that hold words; ``tag`` tells documents of one id apart."""
    lines = docs.select("id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("id", "tag", "pos", "line", line_hash(F.col("line")).alias("h"),
                        _words(F.col("line")).alias("w")).where("w > 0")


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def line_ids(docs: DataFrame, line_hash: Callable[[Column], Column]) -> DataFrame:
    """``(id, tag, pos, line, w)`` of each document once, however many rows repeat it; ``line`` is the hash.

    Repeats go before their lines are told apart by place, since the lines of
    two copies would interleave. Only hashes move, combined map-side.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda line, pos: F.struct(
        pos.alias("pos"), line_hash(line).alias("line"), _words(line).alias("w")))
    held = docs.select("id", "tag", F.filter(lines, lambda x: x["w"] > 0).alias("lines"))
    return held.groupBy("id", "tag").agg(F.any_value("lines").alias("lines")).select("id", "tag", F.inline("lines"))


def line_chunks(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Content-defined chunks of ``(id, tag, pos, line, w)``: ``(id, tag, start, end, chunk)``.

    ``line`` identifies a line's text, ``chunk`` is the ordered list of the
    identifiers in it (one for most chunks, ``min_words`` at most).

    A forward chunk holds line ``j`` if the lines from its start up to before
    ``j`` hold fewer than ``min_words`` words; a backward chunk mirrors this.
    Lines without words count for nothing, so a frame holds at most
    ``min_words`` lines. Chunks that a document's edge cuts short are left out.
    """
    doc = Window.partitionBy("id", "tag").orderBy("pos")
    sums = lines.withColumn("upto", F.sum("w").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("before", F.col("upto") - F.col("w"))
    reach = min_words - 1
    ahead = Window.partitionBy("id", "tag").orderBy("before").rangeBetween(0, reach)
    back = Window.partitionBy("id", "tag").orderBy("upto").rangeBetween(-reach, 0)
    rolled = sums.select(
        "id", "tag", "pos",
        F.collect_list("line").over(ahead).alias("fwd"), F.max("pos").over(ahead).alias("last"),
        F.sum("w").over(ahead).alias("fwd_w"),
        F.collect_list("line").over(back).alias("bwd"), F.min("pos").over(back).alias("first"),
        F.sum("w").over(back).alias("bwd_w"))
    two = F.array(
        F.when(F.col("fwd_w") >= min_words, F.struct(F.col("pos").alias("start"), F.col("last").alias("end"),
                                                     F.col("fwd").alias("chunk"))),
        F.when((F.col("bwd_w") >= min_words) & (F.col("first") < F.col("pos")),
               F.struct(F.col("first").alias("start"), F.col("pos").alias("end"), F.col("bwd").alias("chunk"))))
    return rolled.select("id", "tag", F.explode(F.array_compact(two)).alias("c")).select("id", "tag", "c.*")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS,
                   line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(id, tag, lines)``: the line numbers each document loses; documents that lose none are absent.

    ``docs`` has ``id, tag, text``; rows equal in ``id`` and ``tag`` are one document.
    """
    folder = work_dir(docs.sparkSession)
    lines = line_table(docs, line_hash)
    clash = hash_collisions(lines.select("h", F.col("line").alias("piece")), folder)
    if clash is None:
        ids = line_ids(docs, line_hash)
    else:  # a hash that stands for several texts is told apart by its number
        ids = (lines.join(clash.withColumnRenamed("piece", "line"), ["h", "line"], "left")
               .select("id", "tag", "pos", F.struct("h", "k").alias("line"), "w").distinct())
    chunks = stage(line_chunks(ids, min_words), folder, "chunks")
    place = F.struct(F.col("id").isNull().alias("no"), "id", "tag", "start")
    several = (chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min(place).alias("first"))
               .where("n > 1").select("chunk", "first"))
    several = stage(several, folder, "repeated")  # so that the join below is free to split a hot chunk
    later = chunks.join(several, "chunk").where(place != F.col("first"))
    gone = later.select("id", "tag", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    return gone.groupBy("id", "tag").agg(F.collect_list("line").alias("lines"))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_words: int = MIN_WORDS, count_col: str | None = None) -> DataFrame:
    """``docs`` without the repeated multi-line passages, columns as they came plus ``removed_lines``.

    A line that holds ``min_words`` words by itself is a chunk too. The first
    occurrence stays (smallest id, null last; then place). Rows equal in id
    and text are one document and get the same result. Null and empty texts
    stay as they are; lines are cut at ``\\n`` and joined by it again. Blank
    lines between removed lines go with them. ``count_col`` (if given) is set
    to the new text's code points where lines went. Of every line text at
    least one occurrence stays, so nothing is lost from the corpus.
    """
    rid, tag, own, gone, lines, n_gone = fresh(docs, "_id", "_tag", "_own", "_gone", "_lines", "removed_lines")
    text = text_of(text_col)
    lost = (repeated_lines(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text")),
                           min_words)
            .select(F.col("id").alias(rid), F.col("tag").alias(tag), F.col("lines").alias(gone)))
    joined = (docs.withColumn(own, F.xxhash64(text))
              .join(lost, F.col(id_col).eqNullSafe(F.col(rid)) & (F.col(own) == F.col(tag)), "left")
              .withColumn(lines, F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    out = {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left)}
    if count_col:
        size = F.length(left).cast(docs.schema[count_col].dataType)
        out[count_col] = F.when(F.col(gone).isNull(), F.col(count_col)).otherwise(size)
    counted = F.coalesce(F.size(gone), F.lit(0)).alias(n_gone)
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns], counted)
