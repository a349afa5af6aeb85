"""Registrable domain by longest public-suffix match (a join, not a UDF)."""

from __future__ import annotations

from typing import Optional, Sequence, Union

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validate import raw_host
from ..spec import DEFAULT_PUBLIC_SUFFIXES, PRIVATE_SUFFIXES

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}\z"


def label_forms(rules: Column) -> Column:
    """Spellings of a rule: every label in Unicode and in its ASCII (``xn--``) form, in all combinations.

    A host may spell each of its labels either way and meets the rule in
    both; labels that do not decode stay as they are.
    """
    def forms(texts: pa.Array) -> pa.Array:
        def both(label):
            if label.startswith("xn--") and label.isascii():
                try:
                    return [label, label[4:].encode("ascii").decode("punycode")]
                except UnicodeError:
                    return [label]
            return [label] if label.isascii() else [label, "xn--" + label.encode("punycode").decode("ascii")]

        out = []
        for t in texts.to_pylist():
            spelt = [""]
            for k, label in enumerate((t or "").split(".")):
                # an exception's mark is no part of its label
                mark, bare = ("!", label[1:]) if label.startswith("!") else ("", label)
                spelt = [f"{head}{'.' if k else ''}{mark}{b}" for head in spelt for b in both(bare)]
            out.append(spelt if t is not None else [])
        return pa.array(out, pa.list_(pa.string()))

    forms.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(forms, "array<string>")(rules)


def suffix_table(spark, suffixes: Optional[Union[Sequence[str], DataFrame]] = None,
                 include_private: bool = False) -> DataFrame:
    """``(suffix)``: rules of the public-suffix syntax, lower-cased, in Unicode and ASCII spelling.

    A DataFrame has the rules in its first column and may flag private ones
    in a boolean column ``private``; those count only with ``include_private``.
    """
    if isinstance(suffixes, DataFrame):
        if "private" in suffixes.columns and not include_private:
            suffixes = suffixes.where(~F.coalesce(F.col("private"), F.lit(False)))
        rules = suffixes.select(F.lower(F.col(suffixes.columns[0])).alias("suffix"))
    else:
        listed = suffixes or (*DEFAULT_PUBLIC_SUFFIXES, *(PRIVATE_SUFFIXES if include_private else ()))
        rules = spark.createDataFrame([(s.lower(),) for s in listed], "suffix string")
    return rules.select(F.explode(label_forms(F.col("suffix"))).alias("suffix")).distinct()


def registrable_domain(df: DataFrame, url_col: str = "url", out: str = "registrable_domain",
                       suffixes: Optional[Union[Sequence[str], DataFrame]] = None,
                       include_private: bool = False) -> DataFrame:
    """Add ``out`` = ``{label}.{public suffix}`` of the URL's host.

    Work runs on distinct hosts only: the rules that could match a host (its
    suffixes, each with the first label as a wildcard, each as an exception)
    are exploded and equi-joined with the suffix table; an exception wins,
    else the smallest start label (longest suffix); the host map is joined
    back. Private suffixes count only with ``include_private``.
    Labels keep their case and spelling; matching is case-blind, and blind to
    the difference between a Unicode label and its ``xn--`` form. No suffix match gives
    ``{last label}.``; an IPv4 host gives ``{ip}.``; a host that is itself
    a suffix gives ``.{suffix}``.
    """
    spark = df.sparkSession
    psl = suffix_table(spark, suffixes, include_private)  # joined as it comes: Spark broadcasts it by its size in bytes
    # a non-null host key: joins on it get no inferred isnotnull filter (which
    # would be pushed below and copy the host expression); '' maps to null
    tagged = df.withColumn("_host", F.coalesce(raw_host(F.col(url_col)), F.lit("")))
    hosts = tagged.select("_host").distinct()
    labels = F.split(F.col("_host"), r"\.")
    ends = hosts.select("_host", F.posexplode_outer(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(F.split(F.lower(F.col("_host")), r"\."), i, F.size(labels) - i + 1), ".")))
        .alias("_p", "_end"))
    rule = lambda text, start, exception: F.struct(text.alias("suffix"), start.alias("_i"), F.lit(exception).alias("_x"))
    cands = ends.where(F.col("_end").isNotNull()).select("_host", F.explode(F.array(
        rule(F.col("_end"), F.col("_p"), False),
        rule(F.regexp_replace("_end", r"^[^.]*\.", "*."), F.col("_p"), False),
        rule(F.concat(F.lit("!"), "_end"), F.col("_p") + 1, True))).alias("_r")).select("_host", "_r.*")
    best = cands.join(psl, "suffix").groupBy("_host").agg(
        F.coalesce(F.min(F.when(F.col("_x"), F.col("_i"))), F.min("_i")).alias("_i"))
    lab = F.split(F.col("_host"), r"\.")
    n = F.size(lab)
    sfx = F.array_join(F.slice(lab, F.col("_i") + 1, n - F.col("_i")), ".")
    reg = (F.when(F.col("_host") == "", F.lit(None).cast("string"))
           .when(F.col("_host").rlike(IPV4), F.concat(F.col("_host"), F.lit(".")))
           .when(F.col("_i").isNull(), F.concat(F.element_at(lab, -1), F.lit(".")))
           .when(F.col("_i") == 0, F.concat(F.lit("."), sfx))
           .otherwise(F.concat(F.element_at(lab, F.col("_i").cast("int")), F.lit("."), sfx)))
    host_map = hosts.join(best, "_host", "left").select("_host", reg.alias(out))
    return tagged.join(host_map, "_host", "left").drop("_host")
