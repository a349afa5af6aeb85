"""op12: components against a dense eigensolver, exact deviations, and vectors that cannot be fitted."""

import math

import numpy as np
import pytest

from urlatlas.llm.jacobi_davidson import leading_eigenpairs, minres
from urlatlas.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(spark, vectors, schema=SCHEMA):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(vectors, schema)
    return df.withColumns({c: F.lit("x") for c in ("id", "ID_", "x", "c", "component", "n", "deviation", "v")})


def check(got, vectors, components=32):
    """``got`` equals what a dense eigensolver gives for the plain list ``vectors``."""
    x = np.array([[math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    exact = [int(t) for t in ((n * x.astype(object) - s) ** 2).sum(axis=1)]
    centred = (n * x - s) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for j in range(1, k + 1):
        found = by[j]
        assert len(found) == n and {r["n"] for r in found} == {n}
        want = sorted(zip((i for i, _ in vectors), exact, centred @ basis[:, j - 1] / math.sqrt(values[j - 1])), key=lambda t: (t[0], t[1]))
        have = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in found), key=lambda t: (t[0], t[1]))
        assert [t[:2] for t in have] == [t[:2] for t in want]
        a, b = np.array([t[2] for t in have]), np.array([t[2] for t in want])
        gap = min(abs(values[j - 1] - v) for i, v in enumerate(values) if i != j - 1) / values[0] if len(values) > 1 else 1
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-11 / max(gap, 1e-9)
        assert {r["explained"] for r in found} == {found[0]["explained"]}
        assert found[0]["explained"] == pytest.approx(values[j - 1] / values.sum(), rel=1e-9)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_components_equal_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    spread = np.concatenate([[9, 5, 5], rng.uniform(0.5, 2, 45)])
    vectors = [(i, [float(c) for c in rng.standard_normal(48) * spread + 3]) for i in range(700)]
    check(whiten(rows_of(spark, vectors)).collect(), vectors)


def test_rows_that_cannot_be_fitted_go_and_the_others_do_not_notice(spark):
    rng = np.random.default_rng(4)
    good = [(i % 50, [float(c) for c in rng.standard_normal(5)]) for i in range(120)]
    good += good[:7]  # repeated rows count twice
    bad = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 5), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (1004, [1.0, 2.0]), (1005, []), (1006, [3e38] * 5)]
    got = whiten(rows_of(spark, good + bad)).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in good}
    check(got, good)


def test_no_variance_gives_no_component(spark):
    assert whiten(rows_of(spark, [])).collect() == []
    assert whiten(rows_of(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(rows_of(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    assert whiten(rows_of(spark, [(1, []), (2, [])])).collect() == []
    flat = [(i, [float(i), 7.0, float(2 * i)]) for i in range(20)]  # one direction only
    got = whiten(rows_of(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    check(got, flat)


def test_deviations_stay_exact_where_64_bits_do_not_hold_their_parts(spark):
    big = [(0, [2.0 ** 40, 1.0]), (1, [-(2.0 ** 40), 0.5]), (2, [0.0, 0.25])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(rows_of(spark, big), components=1).collect()}
    assert got == {0: None, 1: None, 2: (3 * 16 - (64 + 32 + 16)) ** 2}
    middling = [(0, [2.0 ** 20, 1.0]), (1, [0.0, 0.5])]
    got = {r["vec_id"]: r["deviation"] for r in whiten(rows_of(spark, middling), components=1).collect()}
    assert got == {0: (2 ** 26) ** 2 + 32 ** 2, 1: (2 ** 26) ** 2 + 32 ** 2}


@pytest.mark.parametrize("case", ["spread", "equal", "few", "flat"])
def test_eigenpairs_of_a_hidden_matrix(case):
    rng, d = np.random.default_rng(5), 150
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(rng.exponential(1, d) ** 2)[::-1]
    if case == "equal":
        values[3:9] = values[3]
    elif case == "few":
        values[20:] = 0
    elif case == "flat":
        values = 1 + 0.01 * values / values[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found = leading_eigenpairs(lambda m: a @ m, d, 32, values.sum())
    assert abs(found.values - values[:32]).max() < 1e-13 * values[0] * d
    assert found.residuals.max() < 1e-13 * values[0]
    assert abs(found.vectors.T @ found.vectors - np.eye(32)).max() < 1e-13


def test_minres_solves_indefinite_systems_side_by_side():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    right = rng.standard_normal((30, 4))
    right[:, 2] = 0
    x = minres(lambda m: a @ m, right, 200, 1e-12)
    assert abs(a @ x - right).max() < 1e-8 and not x[:, 2].any()
