"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become counts of hashed character 1- to 3-grams of their lower-cased
words. Document frequencies and language shares are counted over every
learnable row; the weights are learnt from a bounded sample, drawn language
by language, with follow-the-regularised-leader and elastic-net penalties.
Two halves of the sample are each scored by a model of the other half, and
these scores settle one temperature. Prediction is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import fresh, stage, text_of, work_dir

#: Documents the weights are learnt from, shared evenly among the languages (the documented bound of the sample; see ``_sample``).
SAMPLE_DOCS = 2000
#: Documents that a language is given at least, however many languages there are.
LEAST_DOCS = 20
#: Longest n-gram, and hash buckets of all n-grams.
ORDER, BUCKETS = 3, 1 << 16
#: Follow-the-regularised-leader: rate, its offset, absolute and squared penalty, passes over the sample.
RATE, OFFSET, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
#: Code points of a text that are turned into n-grams at a time.
CHUNK = 1 << 18
#: Value for texts without a letter.
UNKNOWN = "und"

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))
_BLANK = ord(" ")


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: what it counts as (its lower case; a blank if it is no letter or mark), and whether it is a letter."""
    kind = [category(chr(c))[0] for c in range(0x110000)]
    letter = np.array([k == "L" for k in kind])
    as_code = np.full(0x110000, _BLANK, dtype=np.uint32)
    for c in np.flatnonzero(letter | np.array([k == "M" for k in kind])):
        as_code[c] = ord(chr(c).lower()[0])
    return as_code, letter


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``text``, rising, and their counts; lower-cased words stand between single blanks.

    Both are empty for a text without a letter. The text is read in chunks,
    each of which repeats the last ``ORDER - 1`` code points kept from the one
    before it, so every n-gram counts once wherever a chunk ends.
    """
    as_code, letter = _alphabet()
    counts, some, tail = None, False, np.full(1, _BLANK, dtype=np.uint32)
    for at in range(0, len(text), CHUNK):
        raw = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        some = some or bool(letter[raw].any())
        code = as_code[raw]
        if at + CHUNK >= len(text):
            code = np.append(code, np.uint32(_BLANK))
        blank = code == _BLANK
        code = code[~(blank & np.append(tail[-1] == _BLANK, blank[:-1]))]
        grams = _grams(np.concatenate([tail, code]), len(tail) if at else 0)
        if at == 0 and len(text) <= CHUNK:  # the usual text: its sorted buckets are the result
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, dtype=np.int64)
            return (grams[first].astype(np.int64), np.diff(np.append(first, len(grams)))) if some else (first[:0], first[:0])
        found = np.bincount(grams, minlength=BUCKETS)
        counts = found if counts is None else counts + found
        tail = np.concatenate([tail, code])[-(ORDER - 1):]
    at = np.flatnonzero(counts) if some else np.zeros(0, dtype=np.int64)
    return at, counts[at] if some else at


def _grams(code: np.ndarray, counted: int) -> np.ndarray:
    """Sorted buckets of the n-grams of ``code`` that end beyond its first ``counted`` code points."""
    h, parts = np.zeros(len(code), dtype=np.uint32), []
    for n in range(1, ORDER + 1):
        # h[i] covers the n code points from i on
        h = h[:max(0, len(code) - n + 1)] * _MIX[0] + code[n - 1:] + np.uint32(n)
        new = h[max(0, counted - n + 1):]
        parts.append((((new ^ (new >> np.uint32(15))) * _MIX[1]) >> np.uint32(16)).astype(np.uint16))
    return np.sort(np.concatenate(parts), kind="stable")


class Model(NamedTuple):
    """``weights`` is ``BUCKETS x languages``; ``prior`` shifts the scores from the sample's shares to those of all rows."""
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray
    temperature: float


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the buckets ``at``, scaled to length one."""
    x = counts * idf[at]
    return x / np.linalg.norm(x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader with an elastic net (none on the bias).

    Rows are visited in the order given, ``EPOCHS`` times. The absolute
    penalty keeps weights at zero until their gradients agree on a sign.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    w = np.zeros((BUCKETS + 1, classes))
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels):
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            p = softmax(x @ w[at])
            p[y] -= 1
            g = x[:, None] * p
            old, zi = n[at], z[at]
            new = old + g * g
            zi += g - (np.sqrt(new) - np.sqrt(old)) / RATE * w[at]
            z[at], n[at] = zi, new
            l1 = np.full((len(at), 1), L1)
            l2 = np.full((len(at), 1), L2)
            l1[-1] = l2[-1] = 0
            w[at] = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((OFFSET + np.sqrt(new)) / RATE + l2))
    return w[:-1], w[-1]


def calibrate(scores: np.ndarray, labels: np.ndarray, prior: np.ndarray) -> float:
    """The temperature with the least log loss on held-apart ``scores``, rows weighted to the languages' shares of all rows."""
    if not len(scores):
        return 1.0
    weight = np.exp(prior)[labels]

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t) + prior)
        return float(-(weight * np.log(np.maximum(p[range(len(labels)), labels], 1e-300))).sum())

    low, high, golden = np.log(0.02), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, h, at, n`` of ``(lang, h, text)``: the buckets that occur and their counts, as packed integers."""
    for b in it:
        for k in range(b.num_rows):
            at, counts = gram_counts(b.column("text")[k].as_py())
            yield pa.RecordBatch.from_arrays(
                [b.column("lang").slice(k, 1), b.column("h").slice(k, 1), pa.array([at.astype("<u2").tobytes()], pa.binary()),
                 pa.array([counts.astype("<u4").tobytes()], pa.binary())], names=["lang", "h", "at", "n"])


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of this task's texts that hold each bucket; bucket ``BUCKETS`` counts the texts with a letter."""
    found = np.zeros(BUCKETS + 1, dtype=np.int64)
    for b in it:
        for text in b.column(0):
            at, _ = gram_counts(text.as_py())
            found[at] += 1
            found[-1] += len(at) > 0
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["bucket", "n"])


def _sample(rows: DataFrame, sample_docs: int) -> DataFrame:
    """``lang, h, text``: of every language the texts whose hash is in its lowest share, each distinct text once.

    The share is set by the number of the language's distinct texts, so that
    ``sample_docs`` are expected, evenly from all languages that have enough;
    no language's rows have to meet for that.
    """
    keyed = rows.select("lang", F.xxhash64("text").alias("h"), "text").where(F.col("text").rlike(r"\p{L}"))
    # one number a language, as a model has
    texts = {r["lang"]: r["count"] for r in keyed.select("lang", "h").distinct().groupBy("lang").count().collect()}
    share = max(LEAST_DOCS, -(-sample_docs // max(1, len(texts))))
    limits = F.create_map(*[F.lit(v) for lang, n in texts.items() for v in (lang, min(1.0, share / n))])
    low = F.shiftrightunsigned("h", 1).cast("double") / float(1 << 63) <= limits[F.col("lang")]
    return keyed.where(low).groupBy("lang", "h").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from the rows that ``train`` allows; null languages and texts without a letter teach nothing.

    One language gives a model that always answers it; None if there is none.
    """
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession)
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    # a model has a column per language, so the driver may hold one number per language
    shares = {r["lang"]: r["count"] for r in rows.where(F.col("text").rlike(r"\p{L}")).groupBy("lang").count().collect()}
    if not shares:
        return None
    languages = sorted(shares)
    found = rows.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(BUCKETS + 1)
    for r in found:  # one row per bucket
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    features = stage(_sample(rows, sample_docs).mapInArrow(
        _features, "lang string, h long, at binary, n binary"), folder, "features")
    sent = spark.sparkContext.broadcast((languages, idf))
    # three trainings, one task each: on either half (by the text's hash), and on all of the sample
    sets = features.withColumn("half", F.pmod("h", F.lit(2)).cast("int")).withColumn("trained", F.explode(F.array(*map(F.lit, range(3)))))

    def train_set(part: pa.Table) -> pa.Table:
        names, weight = sent.value
        part = part.sort_by([("h", "ascending"), ("lang", "ascending")])
        rows = []
        for at, n in zip(part.column("at"), part.column("n")):
            at = np.frombuffer(at.as_py(), "<u2").astype(np.int64)
            rows.append((at, weighted(at, np.frombuffer(n.as_py(), "<u4"), weight)))
        labels = [names.index(v) for v in part.column("lang").to_pylist()]
        which = part.column("trained")[0].as_py()
        own = [which == 2 or h == which for h in part.column("half").to_pylist()]
        w, bias = train_ftrl([r for r, o in zip(rows, own) if o], [y for y, o in zip(labels, own) if o], len(names))
        others = [k for k, o in enumerate(own) if not o]
        scores = np.array([rows[k][1] @ w[rows[k][0]] + bias for k in others]).reshape(-1, len(names))
        at = np.flatnonzero(w)
        return pa.table({
            "trained": pa.array([which], pa.int32()), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()),
            "w": pa.array([w.flat[at].astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias.tolist()], pa.list_(pa.float64())),
            "scores": pa.array([scores.ravel().tolist()], pa.list_(pa.float64())),
            "labels": pa.array([[labels[k] for k in others]], pa.list_(pa.int32()))})

    made = {r["trained"]: r for r in sets.groupBy("trained").applyInArrow(
        train_set, "trained int, at binary, w binary, bias array<double>, scores array<double>, labels array<int>").collect()}
    drawn = {r["lang"]: r["count"] for r in features.groupBy("lang").count().collect()}
    total, taken = sum(shares.values()), sum(drawn.values())
    prior = np.log([shares[v] / total * taken / max(1, drawn.get(v, 0)) for v in languages])
    scores = np.array([s for k in (0, 1) for s in made[k]["scores"]]).reshape(-1, len(languages))
    temperature = calibrate(scores, np.array([y for k in (0, 1) for y in made[k]["labels"]], dtype=int), prior)
    weights = np.zeros((BUCKETS, len(languages)), dtype=np.float32)
    weights.flat[np.frombuffer(made[2]["at"], "<u4")] = np.frombuffer(made[2]["w"], "<f4")
    return Model(languages, idf, weights, np.array(made[2]["bias"]), prior, temperature)


PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def _predict(text: str | None, model: Model | None) -> dict:
    at, counts = gram_counts(text or "")
    if model is None or not len(at):
        return {"lang": UNKNOWN, "score": 0.0}
    p = softmax((weighted(at, counts, model.idf) @ model.weights[at] + model.bias) / model.temperature + model.prior)
    best = int(p.argmax())
    return {"lang": model.languages[best], "score": float(p[best])}


def language(model: Model | None, docs: DataFrame) -> Callable[[Column], Column]:
    """A function of a text column giving ``(lang, score)``: the likeliest language and its calibrated probability.

    A null text, one without letters, and every text of a model that learnt
    nothing are ``und`` with score 0. Texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else tuple(model))

    def predict(texts: pa.Array) -> pa.Array:
        known = None if sent.value is None else Model(*sent.value)
        return pa.array([_predict(t.as_py(), known) for t in texts], PREDICTED)

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, "struct<lang: string, score: double>")


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; the model learns from the rows that are not held out.

    Ids may be null or repeat; an empty table gives no rows.
    """
    model = fit(docs, ~held_out, lang_col, text_col)
    found, = fresh(docs, "_found")
    out = docs.select(id_col, held_out.alias("held_out"), language(model, docs)(F.col(text_col).cast("string")).alias(found))
    return out.select(id_col, "held_out", F.col(found)["lang"].alias("lang_pred"), F.col(found)["score"].alias("score"))
