"""Embedding whitening with a covariance recovered by polarisation.

A component c becomes the integer floor(64 * c) + 1,000,000. The variance of a sum is
``var(i + j) = var(i) + var(j) + 2 cov(i, j)``, so the squares of centred values of every dimension and of
every sum of two dimensions are all that is aggregated; differences of the variances are the
covariances. Values are centred by the whole part of their mean before they are squared, and the
remainder is taken off in whole numbers, so every variance is exact whatever the order of the rows.

Tasks send one partial sum for each dimension and pair, Spark adds them up as decimals, and the driver
gets one number for each: bounded by the square of the dimension (2,080 of them for 64 dimensions), not by
the rows. The matrix is assembled there and handed to ``eigh``; what goes back to the tasks is the mean and
at most ``components`` vectors.

Rows whose vector is null, or holds null or non-finite entries, take no part. If vectors differ in length,
the most frequent length stays (of equally frequent ones the greater). Components beyond 2^40 in size are an
error. A component without variance is returned with whitened null, and left out of the identity error. Rows
repeated count as often as they occur, null ids come back as null, an empty table gives an empty result;
columns other than id and vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsignal.llm.common import worker_state

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 40)


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``S``; ``vectors`` has a column for each eigenvalue, falling."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: list[list[float]]
    trace: float


def finite(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column):
    """Whole-number values of an Arrow column of vectors of one length."""
    import numpy as np

    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError("a component of a vector is beyond 2^40")
    return np.floor(flat * SCALE).astype(np.int64).reshape(rows, -1) + OFFSET


def _exact_sum(values):
    """Column sums as Python integers; no step leaves 63 bits."""
    import numpy as np

    most = int(np.abs(values).max(initial=0))
    step = max(1, (1 << 62) // max(most, 1))
    total = np.zeros(values.shape[1], object)
    for i in range(0, len(values), step):
        total += values[i : i + step].sum(axis=0).astype(object)
    return total


def _exact_squares(values):
    """Column sums of squares as Python integers."""
    import numpy as np

    if int(np.abs(values).max(initial=0)) >= 1 << 31:
        values = values.astype(object)
        return (values * values).sum(axis=0)
    return _exact_sum(values * values)


def vectors_of(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, all of one length."""
    rows = table.filter(finite(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0].d if sizes else 0))


def _totals(rows: DataFrame, partial) -> dict[tuple[int, int], int]:
    """Sums over all rows of ``partial`` (a function of a matrix to {(i, j): whole number}), one a pair."""

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        worker_state(("whitening",), dict)  # nothing is kept
        total = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                for key, value in partial(_matrix(batch.column(0).slice(i, 4096))).items():
                    total[key] = total.get(key, 0) + value
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(int(total[k])) for k in keys], pa.decimal128(38, 0))],
                names=["i", "j", "total"],
            )

    parts = rows.select("v").mapInArrow(run, "i int, j int, total decimal(38,0)")
    return {(r.i, r.j): int(r.total) for r in parts.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}


def _sums(values):
    return {(-1, -1): len(values)} | {(i, i): s for i, s in enumerate(_exact_sum(values))}


def _pair_squares(centre):
    """Squares of each centred dimension (i, i) and of each centred sum of two (i, j)."""

    def of(values):
        import numpy as np

        y = values - np.array(centre, np.int64)
        out = {}
        for i in range(y.shape[1]):
            out[i, i] = int(_exact_squares(y[:, i : i + 1])[0])
            for j, s in enumerate(_exact_squares(y[:, i + 1 :] + y[:, i : i + 1]), i + 1):
                out[i, j] = int(s)
        return out

    return of


def covariances(rows: DataFrame) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """(n, S, n * n * covariance for i <= j), all exact, of the whole-number values of ``rows`` (v)."""
    sums = _totals(rows, _sums)
    n = sums.pop((-1, -1), 0)
    if not n:
        return 0, [], {}
    totals = [sums[i, i] for i in range(len(sums))]
    centre = [s // n for s in totals]
    rest = [s - n * c for s, c in zip(totals, centre)]  # sum of what is left after centring
    squares = _totals(rows, _pair_squares(centre))
    spread = {(i, j): n * q - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), q in squares.items()}
    return n, totals, {
        (i, j): v if i == j else (v - spread[i, i] - spread[j, j]) // 2  # polarisation; always even
        for (i, j), v in spread.items()
    }


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows`` (v): eigenvectors of the covariance by falling eigenvalue."""
    import numpy as np

    n, sums, exact = covariances(rows)
    if not n or not sums:
        return Whitening(n, sums, [], [], 0.0)
    cov = np.zeros((len(sums), len(sums)))
    for (i, j), value in exact.items():
        cov[i, j] = cov[j, i] = value / (n * n)  # one correctly rounded division
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = sum(exact[i, i] for i in range(len(sums))) / (n * n)
    return Whitening(n, sums, values.tolist(), vectors.tolist(), trace)


def _whitened(values, model: Whitening):
    """Projections over the roots of the eigenvalues, one row a vector; nan where there is no variance."""
    import numpy as np

    sums = np.array(model.sums, np.int64)
    centred = (values * model.n - sums) / model.n  # whole numbers until the division
    e = np.array(model.values)
    flat = e <= max(e[0], 0.0) * 1e-12
    return (centred @ np.array(model.vectors)) / np.sqrt(np.where(flat, np.nan, e))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, measured on the rows."""
    import numpy as np

    digits = 1 << 60  # partial sums in whole numbers of 2^-60: their total does not depend on the order

    def products(values):
        w = np.nan_to_num(_whitened(values, model))
        out = {(i, j): int(x * digits) for (i, j), x in np.ndenumerate(w.T @ w) if i <= j}
        return out | {(i, -1): int(x * digits) for i, x in enumerate(w.sum(axis=0))}

    total = _totals(rows, products)
    worst = 0.0
    for i in range(len(model.values)):
        for j in range(i, len(model.values)):
            if model.values[i] > model.values[0] * 1e-12 < model.values[j]:
                cov = total[i, j] / digits / model.n - (total[i, -1] / digits / model.n) * (total[j, -1] / digits / model.n)
                worst = max(worst, abs(cov - (i == j)))
    return worst


def whitened(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over the dimensions of (n * x - S)^2; beyond 63 bits it is an error.
    """
    rows = vectors_of(table, vec_id, vector)
    model = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not model.values:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        worker_state(("whitening",), dict)  # nothing is kept
        k = len(model.values)
        explained = [e / model.trace if model.trace else 0.0 for e in model.values]
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                values = _matrix(batch.column(1).slice(i, 2048))
                off = values * model.n - np.array(model.sums, np.int64)
                fits = float(np.abs(off.astype(np.float64)).max(initial=0)) ** 2 * off.shape[1] < 2.0**62
                deviation = (off * off).sum(axis=1) if fits else pa.array([int(x) for x in (off.astype(object) ** 2).sum(axis=1)], pa.int64()).to_numpy()
                w = _whitened(values, model)
                m = len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 2048).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(np.repeat(deviation, k)),
                        pa.array(w.reshape(-1), from_pandas=True),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return rows.mapInArrow(run, schema)
