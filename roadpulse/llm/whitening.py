"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, x = floor(256 * c). The fit list holds each distinct x once; centred, it is the matrix X,
which stays distributed. A step takes a right vector v, forms u = Xv, makes it orthogonal to all earlier u, and then
forms X'u, which is made orthogonal to all earlier v. Both products are one pass over the rows. The scalars make a
small bidiagonal B with X = U B V', whose singular values and right vectors give the components and deviations.

The left vectors are as long as the table, so that they are never stored: each is X times a short vector, and a pass works
it out again from its rows. What reaches the driver is a few numbers per dimension and step, at any number of rows.
All steps are taken, one per dimension, since an early stop would miss repeated singular values; a step whose
product vanishes goes on with a random direction orthogonal to all before. A lost executor costs its tasks of one pass.

Defined results: rows whose vector is NULL or holds a NULL or non-finite entry are dropped, as are empty vectors and
those that are not as long as most are (of equally frequent lengths, the longest). Entries are held to +-2**53 / 256.
Rows that repeat an id or a vector are all returned. Components without variance (an eigenvalue below 1e-12 of the
largest) can't be whitened and are not returned, so that fewer than two distinct vectors, or an empty table, give no
rows. A deviation beyond 64 bits is NULL. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import stored

SCALE = 256
#: Whole numbers up to this are exact as doubles.
LARGEST = 1 << 53
COMPONENTS = 4
SEED = 11
#: A product shorter than this share of X's norm has vanished; an eigenvalue below its share of the largest is none.
VANISHED, NO_VARIANCE = 1e-13, 1e-12
#: Vectors handled at once within a task.
CHUNK = 4096

_WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Fit:
    """``sums`` are exact. ``components`` has a column per component; ``identity_error`` is measured by ``whiten``."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_vectors(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Stored (vec_id, x) of the rows that remain."""
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    rows = vectors.filter(F.coalesce(F.forall(column, fine), F.lit(False)) & (F.size(column) > 0))
    rows = stored(rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(column, entry).alias("x")), "whole")
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max_by("length", F.struct("n", "length"))).first()[0]
    return rows.filter(F.size("x") == F.lit(usual or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, CHUNK):
            part = batch.slice(begin, CHUNK)
            yield part, _matrix(part.column(at))


def _row_of(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: [value] for name, value in values.items()})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension over a task's rows, as text, since they may be beyond 64 bits."""
    n, total = 0, None
    for _, x in _chunks(batches):
        exact = x.sum(0) if abs(x).max() < LARGEST // CHUNK else x.astype(object).sum(0)
        part = np.array([int(v) for v in exact], object)
        n, total = n + len(x), part if total is None else total + part
    if n:
        yield _row_of(n=n, sums=[str(v) for v in total])


def exact_sums(fit_list: DataFrame) -> tuple[int, tuple[int, ...]]:
    """n and the sum of each dimension; a row per dimension reaches the driver."""
    parts = fit_list.select("x").mapInArrow(_sums, "n long, sums array<string>")
    rows = parts.select("n", F.posexplode("sums").alias("dimension", "part")).groupBy("dimension").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    ).collect()
    rows.sort(key=lambda r: r["dimension"])
    return (rows[0]["n"] if rows else 0), tuple(int(r["total"]) for r in rows)


def deviations_of(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit numbers where these hold it, else as Python's."""
    bound = n * int(abs(x).max(initial=0)) + max(map(abs, sums))
    whole = x if bound < 1 << 62 else x.astype(object)
    return whole * n - np.array(sums, whole.dtype)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n, from exact whole numbers."""
    return deviations_of(x, n, sums).astype(float) / n


def _total(fit_list: DataFrame, n: int, sums: tuple[int, ...], product, width: int) -> np.ndarray:
    """The sum over all rows of ``product(centred rows)``, an array of ``width`` numbers; a row per task is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(width), False
        for _, x in _chunks(batches):
            total, any_rows = total + product(centred(x, n, sums)), True
        if any_rows:
            yield _row_of(part=total)

    parts = fit_list.select("x").mapInArrow(add, "part array<double>")
    # Sums of one position: as many rows as positions after the map side; their number is the dimension's, not the table's.
    rows = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for row in rows:
        out[row["at"]] = row["value"]
    return out


def bidiagonalise(product_sum, dimensions: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B, B upper bidiagonal and both U and V orthonormal.

    ``product_sum(f, width)`` is the sum of ``f(rows)`` over all blocks of rows of X. Column j of U is X P[:, j].
    """
    rng = np.random.default_rng(seed)
    right, short = np.zeros((dimensions, dimensions)), np.zeros((dimensions, dimensions))
    back, band = np.zeros((dimensions, dimensions)), np.zeros((dimensions, dimensions))
    scale = np.sqrt(product_sum(lambda rows: np.array([(rows * rows).sum()]), 1)[0])

    def fresh(j: int) -> np.ndarray:
        v = rng.standard_normal(dimensions)
        for _ in range(2):
            v -= right[:, :j] @ (right[:, :j].T @ v)
        return v / np.linalg.norm(v)

    v = fresh(0)
    for j in range(dimensions):
        right[:, j] = v
        earlier = short[:, :j].copy()
        # Xv against all earlier left vectors; what remains is X times a short vector.
        on = product_sum(lambda rows: (rows @ earlier).T @ (rows @ v), j) if j else np.zeros(0)
        direction = v - earlier @ on

        def second(rows: np.ndarray) -> np.ndarray:
            u = rows @ direction
            return np.concatenate(([u @ u], (rows @ earlier).T @ u, rows.T @ u))

        sums = product_sum(second, 1 + j + dimensions)
        again, across = sums[1 : 1 + j], sums[1 + j :]
        alpha = np.sqrt(max(0.0, sums[0] - again @ again))
        if alpha > VANISHED * scale:
            short[:, j] = (direction - earlier @ again) / alpha
            back[:, j] = (across - back[:, :j] @ again) / alpha
            band[j, j] = alpha
        if j:
            band[j - 1, j] = on[j - 1] + again[j - 1]
        if j + 1 == dimensions:
            break
        rest = back[:, j] - alpha * v
        for _ in range(2):
            rest = rest - right[:, : j + 1] @ (right[:, : j + 1].T @ rest)
        beta = np.linalg.norm(rest)
        v = rest / beta if beta > VANISHED * scale else fresh(j + 1)
    return right, band


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit | None, DataFrame]:
    """The fit of stored ``rows`` (with ``x``), None without variance, and its stored fit list."""
    fit_list = stored(rows.select("x").distinct(), "fit-list")
    n, sums = exact_sums(fit_list)
    if n < 2:
        return None, fit_list
    total = lambda product, width: _total(fit_list, n, sums, product, width)
    right, band = bidiagonalise(total, len(sums))
    _, deviations, turn = np.linalg.svd(band)
    values = deviations**2 / n
    count = int((values[:components] > NO_VARIANCE * values[0]).sum()) if values[0] > 0 else 0
    model = Fit(n, sums, right @ turn[:count].T, values[:count], float(values.sum()))
    return (model if count else None), fit_list


def whitening_error(model: Fit, fit_list: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, centred first."""
    turn, k = model.components / np.sqrt(model.eigenvalues), len(model.eigenvalues)
    mean = _total(fit_list, model.n, model.sums, lambda rows: (rows @ turn).sum(0), k) / model.n

    def squares(rows: np.ndarray) -> np.ndarray:
        white = rows @ turn - mean
        return (white.T @ white).ravel()

    found = _total(fit_list, model.n, model.sums, squares, k * k).reshape(k, k) / model.n
    return float(abs(found - np.eye(k)).max())


def _whitener(model: Fit, error: float):
    turn, k = model.components / np.sqrt(model.eigenvalues), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace

    def whiten_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches, 1):
            away, rows = deviations_of(x, model.n, model.sums), len(x)
            white = (away.astype(float) / model.n) @ turn
            if len(model.sums) * int(abs(away).max(initial=0)) ** 2 >= 1 << 63:
                away = away.astype(object)
            deviation = [v if v < 1 << 63 else None for v in map(int, (away * away).sum(1))]
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": part.column(0).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, model.n)),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(white.ravel()),
                    "explained": pa.array(np.tile(explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, error)),
                }
            )

    return whiten_rows


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component."""
    rows = whole_vectors(vectors, column, key)
    model, fit_list = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _WHITENED)
    return rows.mapInArrow(_whitener(model, whitening_error(model, fit_list)), _WHITENED)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
