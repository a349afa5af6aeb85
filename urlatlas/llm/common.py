"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import weakref
import zipfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlatlas.llm.files import create

#: Fixed value: the white space the contracts name, as a character class.
WHITE = r"[\x20\x09-\x0D]"


def work_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the folder of ``spark.checkpoint.dir``.

    A local-mode session without that setting uses a folder beside its
    warehouse; any other session without it is an error, since executors
    would not see each other's files.
    """
    ship_code(spark)
    return f"{_shared(spark)}/llm-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_work"
    # with its file system spelt out, so that Spark and Arrow mean the same folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(path).toString().rstrip("/")


_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship_code(spark: SparkSession) -> None:
    """Once per Spark context: makes this package importable in Python workers, wherever they start."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path, out = create(f"{_shared(spark)}/llm-code", package.name, ".zip")
    with out, zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context)


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the one thing that was asked for last.

    Workers serve one operator after the other; what each of them looks up
    must not add up.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``folder`` and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_blocks(raw: bytes, overlap: int, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Words of space-separated ``raw`` in bounded blocks: ``(number of the first word, words)``.

    A block repeats the last ``overlap`` words of the one before it, so a
    window of ``overlap + 1`` words lies in exactly one block. Bounds a
    task's memory for very long texts. No words give no block.
    """
    at, first, tail = 0, 0, []
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        words = tail + raw[at:end].split()
        if len(words) > len(tail):
            yield first, words
        keep = min(overlap, len(words))
        first += len(words) - keep
        tail = words[len(words) - keep:]
        at = end


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names derived from ``names`` that no column of ``df`` has in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_collisions(pieces: DataFrame, folder: str) -> DataFrame | None:
    """Byte comparison of pieces that share a hash.

    ``pieces`` has ``h`` (a 64-bit hash) and ``piece`` (its text). Returns
    ``(h, piece, k)`` for the hashes that stand for more than one text, with
    ``k`` (from 0) telling those texts apart, or None if there is no such
    hash (the normal case: two equal 64-bit hashes among a billion texts have
    a chance of about 3 %). Each distinct text moves once, after a map-side
    combine; the texts of shared hashes move again only where there are any.
    """
    distinct = pieces.select("h", "piece").distinct()
    several = stage(distinct.groupBy("h").count().where("count > 1").select("h"), folder, "shared-hashes")
    if several.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("h").orderBy("piece")) - 1
    return stage(distinct.join(several, "h", "left_semi").withColumn("k", number.cast("int")), folder, "clashes")
