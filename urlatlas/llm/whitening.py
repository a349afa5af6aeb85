"""Embedding whitening: principal components by Jacobi-Davidson on distributed centred products.

The covariance is never formed. Vectors are turned into integers, their exact
sums give exact centred rows, which are written once; every product of the
covariance with a block of vectors is then one pass over those rows
(``jacobi_davidson``), whose partial sums Spark adds up.
The driver holds blocks of ``dimension x search space`` numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import fresh, stage, work_dir
from urlatlas.llm.jacobi_davidson import leading_eigenpairs

COMPONENTS = 32
#: Entries count in units of one 64th; the contract's offset of 1 000 000 leaves all centred numbers as they are.
SCALE = 64
#: Components whose eigenvalue is this much smaller than the first are rounding, not variance.
LEAST_SHARE = 1e-10
#: Centred numbers that a task turns into results at a time.
CHUNK = 1 << 20
_LONG = 1 << 63


class Whitening(NamedTuple):
    """What was learnt: ``vectors`` is ``dimension x components``, ``values`` their eigenvalues, falling."""
    rows: int
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    identity_error: float


def integer_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Adds ``x``: every entry as ``floor(64 * entry)``, for the rows that can be whitened.

    Rows go whose vector is null, holds a null, infinite or undefined entry,
    or one whose integer does not fit 64 bits.
    """
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(_LONG >> 1))
    v = F.col(vector_col).cast("array<double>")
    good = rows.withColumn("x", v).where(F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(fits(c), F.lit(False))))
    return good.withColumn("x", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls, all of length ``d``, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _safe(x: np.ndarray, factor: int) -> np.ndarray:
    """``x`` as 64-bit integers if ``factor`` times any entry fits those, else as Python integers."""
    most = int(np.abs(x.astype(float)).max(initial=0)) + 1
    return x if most * factor < _LONG >> 1 else x.astype(object)


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension."""
    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in it:
            x = _matrix(b.column(0), d)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, _safe(x, max(1, len(x))).sum(axis=0))] if len(x) else total
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    got = vectors.select("x").mapInArrow(partial, "i int, n long, s decimal(38,0)")
    found = {r["i"]: r for r in got.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}  # one row a dimension
    return (found[0]["n"] if found else 0), [int(found[i]["s"]) for i in range(d)] if found else []


def _centred(vectors: DataFrame, d: int, n: int, sums: list[int]) -> DataFrame:
    """``id, deviation, c``: exact sum of squares of ``n * x - sums``, and ``x - sums / n`` in doubles.

    A deviation beyond 64 bits is null.
    """
    most = max(map(abs, sums), default=0)

    def centre(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            x = _safe(_matrix(b.column("x"), d), 4 * n)
            small = x.dtype != object and most < _LONG >> 2
            s = np.array(sums, dtype=np.int64 if small else object)
            c = (x if small else x.astype(object)) * n - s
            squares = _safe(c, 2 * d * (int(np.abs(c.astype(float)).max(initial=0)) + 1))
            deviation = [int(t) if int(t) < _LONG else None for t in (squares * squares).sum(axis=1)]
            flat = pa.array((c.astype(float) / n).ravel())
            offsets = pa.array(np.arange(0, (b.num_rows + 1) * d, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                                             names=["id", "deviation", "c"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(centre, f"id {kind}, deviation long, c array<double>")


def _moment(centred: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``f(rows)`` over all centred rows: one pass, partial sums added in the order of tasks."""
    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in it:
            if b.num_rows:
                total += f(_matrix(b.column(0), d))
        at = pa.array(np.arange(total.size, dtype=np.int32))
        task = pa.array(np.full(total.size, TaskContext.get().partitionId(), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, task, pa.array(total.ravel())], names=["at", "task", "v"])

    parts = centred.select("c").mapInArrow(partial, "at int, task int, v double")
    # one number per task and place; always added in the order of the tasks, so that a repeated pass gives the same doubles
    in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("task", "v"))), F.lit(0.0), lambda a, t: a + t["v"])
    total = np.zeros(shape)
    for r in parts.groupBy("at").agg(in_order.alias("v")).collect():  # as many rows as the block has numbers
        total.flat[r["at"]] = r["v"]
    return total


def fit(centred: DataFrame, d: int, n: int, components: int = COMPONENTS) -> Whitening:
    """Components of the covariance (divisor ``n``) of centred rows ``c``.

    The sign of a component makes its largest entry positive. Components
    without variance (under ``LEAST_SHARE`` of the first eigenvalue: fewer
    rows than dimensions, constant dimensions, one row) are left out.
    """
    trace = float(_moment(centred, d, lambda c: np.array([[np.square(c).sum()]]), (1, 1))[0, 0]) / n

    def product(block: np.ndarray) -> np.ndarray:
        return _moment(centred, d, lambda c: c.T @ (c @ block), block.shape) / n

    found = leading_eigenpairs(product, d, components, trace)
    keep = found.values > LEAST_SHARE * (found.values[0] if len(found.values) else 0)
    values, vectors = found.values[keep], found.vectors[:, keep]
    k = len(values)
    if k:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    turn = vectors / np.sqrt(values)

    def second(c: np.ndarray) -> np.ndarray:
        y = np.hstack([c @ turn, np.ones((len(c), 1))])
        return y.T @ y

    m = _moment(centred, d, second, (k + 1, k + 1)) / n
    off = m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)
    return Whitening(n, trace, values, vectors, found.residuals[keep], float(np.abs(off).max(initial=0)))


def _project(centred: DataFrame, d: int, w: Whitening) -> DataFrame:
    k, turn = len(w.values), w.vectors / np.sqrt(w.values)
    explained = w.values / w.trace if w.trace else w.values
    numbers = np.arange(1, k + 1, dtype=np.int32)
    step = max(1, CHUNK // max(1, d + k))

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows if k else 0, step):
                b = whole.slice(at, step)
                y = _matrix(b.column("c"), d) @ turn
                each = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(each), pa.array(np.tile(numbers, len(y))), b.column("deviation").take(each),
                     pa.array(y.ravel()), pa.array(np.tile(explained, len(y)))],
                    names=["id", "component", "deviation", "whitened", "explained"])

    kind = centred.schema["id"].dataType.simpleString()
    return centred.mapInArrow(project, f"id {kind}, component int, deviation long, whitened double, explained double")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``, one row per vector and component.

    All vectors that ``integer_vectors`` keeps are fitted and whitened; of
    vectors of different lengths those of the most frequent length (the longer
    one of a tie), since the others have no covariance with them. ``n`` is
    their number. Ids may be null or repeat; every row counts. An empty table,
    a single vector or vectors that are all equal have no component and give no row.
    """
    folder = work_dir(rows.sparkSession)
    id_name = fresh(rows, "id")[0]
    vectors = integer_vectors(rows.select(F.col(id_col).alias(id_name), F.col(vector_col).alias("v")), "v")
    vectors = stage(vectors.select(F.col(id_name).alias("id"), "x"), folder, "integers")
    # one row per length that occurs; the longest two are enough to choose from
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    d = top["d"] if top else 0
    vectors = vectors.where((F.size("x") == d) & (F.size("x") > 0))
    n, sums = _sums(vectors, d) if d else (0, [])
    centred = stage(_centred(vectors, d, max(n, 1), sums), folder, "centred")
    if n:
        w = fit(centred, d, n, components)
    else:
        w = Whitening(0, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    out = _project(centred, d, w)
    return out.select(F.col("id").alias(id_col), "component", F.lit(w.rows).cast("long").alias("n"), "deviation", "whitened",
                      "explained", F.lit(w.identity_error).alias("identity_error"))
