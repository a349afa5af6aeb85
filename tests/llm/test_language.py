"""op13: n-gram counts against a plain restatement, held-out accuracy, and rows that teach or tell nothing."""

import unicodedata
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from urlatlas.llm import language_id as lid
from urlatlas.llm.queries import op13_language

SF_ORACLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
TEXTS = ["", "  ", "12 ²3", "a", "Ab, cD!", "Straße ÉTÉ naïve", "漢字かな交じり", "été", "x" * 50, "one two\n\tthree  four-five", "\ud800 half"]


def plain_counts(text):
    keep = lambda c: unicodedata.category(c)[0] in "LM"
    words = "".join(c.lower()[0] if keep(c) else " " for c in text).split(" ")
    words = " " + " ".join(w for w in words if w) + " "
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return {}
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            h = 0
            for k, c in enumerate(words[i:i + n], 1):
                h = (h * 0x9E3779B1 + ord(c) + k) & 0xFFFFFFFF
            out[(((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 16] += 1
    return dict(out)


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_counts_do_not_depend_on_chunks(monkeypatch, chunk):
    monkeypatch.setattr(lid, "CHUNK", chunk)
    for text in TEXTS:
        at, n = lid.gram_counts(text)
        assert dict(zip(at.tolist(), n.tolist())) == plain_counts(text), text


def test_the_absolute_penalty_leaves_weights_at_zero_and_classes_apart():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(300):
        y = k % 3
        at = np.unique(np.append(rng.integers(1000, 60000, 5), [y, 3]))
        rows.append((at, np.where(at < 4, 0.7, 0.02)))  # the others are met once each, with a small weight
        labels.append(y)
    w, b = lid.train_ftrl(rows, labels, 3)
    assert all(int((x @ w[at] + b).argmax()) == y for (at, x), y in zip(rows, labels))
    assert (w[1000:] != 0).mean() < 0.001 and (w[:3] != 0).all()


def test_temperature_has_the_least_loss_on_the_grid():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 400)
    scores = 4 * rng.standard_normal((400, 3)) + 3 * np.eye(3)[labels]
    prior = np.log([1.5, 1.0, 0.5])

    def loss(t):
        p = lid.softmax(scores / t + prior)
        return -(np.exp(prior)[labels] * np.log(p[range(400), labels])).sum()

    t = lid.calibrate(scores, labels, prior)
    assert loss(t) <= min(loss(u) for u in np.linspace(0.1, 15, 400)) + 1e-6
    assert lid.calibrate(np.zeros((0, 3)), labels[:0], prior) == 1.0


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang", "text")
    rows = op13_language(spark, SF_ORACLE).join(docs, "doc_id").collect()
    apart = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(apart) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in apart) / len(apart) > 0.98
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in apart if r["lang"] == lang]
        assert sum(r["lang_pred"] == lang for r in own) / len(own) > 0.95
    # calibrated: the mean score is near the share of right answers
    assert abs(np.mean([r["score"] for r in apart]) - np.mean([r["lang_pred"] == r["lang"] for r in apart])) < 0.03


def words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("de") for c in ("h", "found", "_found", "score", "half", "held_out_", "source")})
    return {tuple(r)[0]: tuple(r)[1:] for r in lid.identify(df, F.coalesce(F.col("doc_id") >= 1000, F.lit(False))).collect()}


def test_labels_of_held_out_rows_ids_and_nulls_do_not_count(spark):
    rng = np.random.default_rng(3)
    known = [(i, words(rng, "abcd" if i % 3 else "wxyz", 30), "x1" if i % 3 else "x2") for i in range(60)]
    hot = [(100 + i, "abcd abcd dcba", "x1") for i in range(200)]  # copies have one voice in the sample
    odd = [(500, None, "x1"), (501, "", "x2"), (502, "4711", "x2"), (503, "wxyz", None), (None, "zzzz wwww", "x2"), (504, "²", "x1")]
    apart = [(1000, "dcba abcd", "x2"), (1001, "zyxw", "x1"), (1002, None, "x1"), (1003, "wxyz " * 90000, None), (1004, "12", "x1")]
    got = result(spark, known + hot + odd + apart)
    assert [got[i][:2] for i in (1000, 1001, 1002, 1003, 1004)] == [(True, "x1"), (True, "x2"), (True, "und"), (True, "x2"), (True, "und")]
    assert [got[i][1] for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "x2", "und"] and got[None] == (False, "x2", got[None][2])
    assert all(0 <= s <= 1 for _, _, s in got.values()) and got[1002][2] == 0 and got[1000][2] > 0.5
    swapped = [(i, t, "x1" if lang == "x2" else "x2") for i, t, lang in apart]
    assert result(spark, known + hot + odd + swapped) == got


def test_nothing_and_one_language(spark):
    assert result(spark, []) == {}
    assert result(spark, [(1, "some text", None), (2, "", "en")]) == {1: (False, "und", 0.0), 2: (False, "und", 0.0)}
    assert result(spark, [(1, "some text", "en"), (1000, "漢字", "ja")]) == {1: (False, "en", 1.0), 1000: (True, "en", 1.0)}
