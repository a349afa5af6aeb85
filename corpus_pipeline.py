"""Corpus pipeline: documents through the filtering stages of the training-data operators.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame that is written as Parquet and read back
as the next one's ``docs``. ``run`` applies them to ``documents``. All stages
but the last return the columns of ``docs``; null and empty texts, null and
repeated ids and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from urlatlas.llm.common import stage, table, work_dir
from urlatlas.llm.line_chunks import drop_repeated_chunks
from urlatlas.llm.packing import pack
from urlatlas.llm.queries import held_out
from urlatlas.llm.simhash import keep_one_of_each
from urlatlas.llm.toxicity import drop_toxic, fit
from urlatlas.llm.wu_manber import drop_contaminated


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on the labelled ones among ``docs``."""
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages an earlier one has; ``n_chars`` follows where lines went."""
    return drop_repeated_chunks(docs, count_col="n_chars").select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in a benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 4096 tokens, with its sequence and offset."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity scores, fingerprint components and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), folder, name)
    return docs
