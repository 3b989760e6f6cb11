"""Operator 11: embedding whitening by the Jacobi-Davidson method.

The covariance is never formed.  Every product with it is one Spark job over
the centred rows (``multiply``); only dim x block numbers reach the driver.
``jacobi_davidson`` finds the leading eigenvectors: Rayleigh-Ritz in a growing
subspace, locking of converged pairs in order, and for the others a correction
equation, projected against all that is locked or being looked for, that inner
MINRES steps solve.  The equations of one round run in step, so a round costs
as many jobs as MINRES steps, whatever the number of pairs.

Exactness: an entry c is x = floor(1024 c) + 100000, sums S and deviations are
integers; rows are centred by quotient and remainder of S by n before any
product, so the large common offset never enters a floating-point sum.

Defined cases: null vectors, those of length 0 and those with null or
non-finite entries drop; so do entries of 2^30 or more in size, whose sums
would leave 64 bits, and vectors of another length than the commonest (of
equally common ones the longest).  A null id stays null.  Repeated rows count
each.  Directions without variance (a single row, equal rows, more dimensions
than rows) give no components, so there may be fewer than asked for or none.
Residuals are measured
against the largest eigenvalue, so a direction with 10^-12 of its variance has a few digits only.
Equal eigenvalues: any orthonormal vectors of their space.  A deviation beyond
64 bits is null.  An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.llm.common import written

COMPONENTS = 8
#: Inner MINRES steps of a round, columns of the subspace before it is cut back, rounds before giving up.
INNER, WIDEST, ROUNDS = 5, 96, 400
#: Entries of this size or more drop: their sums would leave 64 bits.
LARGEST = 2.0 ** 30
EPS = float(np.finfo(np.float64).eps)
#: Values that a task turns to doubles at once.
SLICE = 1 << 21

Multiply = Callable[[np.ndarray], np.ndarray]


def orthonormal(t: np.ndarray, against: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns spanning what ``t`` adds to ``against`` (twice projected); columns that add nothing drop."""
    out = against
    for column in t.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        v = column / size
        for _ in range(3):
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        if left >= 1e-10:
            out = np.column_stack([out, v])
    if out.shape[1] == against.shape[1] and out.shape[1] < len(t):  # nothing new: any direction left
        return orthonormal(rng.standard_normal((len(t), 1)), against, rng)
    return out[:, against.shape[1]:]


def minres(multiply: Multiply, b: np.ndarray, steps: int) -> np.ndarray:
    """MINRES for one symmetric (indefinite) system a column, all columns in step; done columns rest."""
    n, cols = b.shape
    x, beta = np.zeros((n, cols)), np.linalg.norm(b, axis=0)
    live = beta > 0
    before, v = np.zeros((n, cols)), b / np.where(live, beta, 1)
    w_old, w, eta, off = np.zeros((n, cols)), np.zeros((n, cols)), beta.copy(), np.zeros(cols)
    c_old, c, s_old, s = np.ones(cols), np.ones(cols), np.zeros(cols), np.zeros(cols)
    for _ in range(steps):
        if not live.any():
            break
        p = multiply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - off * before
        after = np.linalg.norm(p, axis=0)
        delta, rho2, rho3 = c * alpha - c_old * s * off, s * alpha + c_old * c * off, s_old * off
        rho1 = np.hypot(delta, after)
        live &= rho1 > EPS * np.maximum(beta, np.abs(alpha))
        safe = np.where(rho1 > 0, rho1, 1)
        c_old, c, s_old, s = c, delta / safe, s, after / safe
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        x = x + np.where(live, c * eta, 0) * w
        eta = -s * eta
        live &= after > EPS * np.abs(alpha)
        before, v, off = v, p / np.where(after > 0, after, 1), after
    return x


def jacobi_davidson(multiply: Multiply, dim: int, count: int, inner: int = INNER, widest: int = WIDEST,
                    rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns): the ``count`` largest of a symmetric positive operator.

    ``multiply`` takes and gives dim x k blocks.  A pair is locked once its
    residual is at the rounding of doubles (16 eps sqrt(dim) of the largest
    eigenvalue) and all larger ones are locked; raises if that isn't reached.
    """
    rng = np.random.default_rng(seed)
    widest = max(widest, 3 * count)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    basis = orthonormal(rng.standard_normal((dim, min(dim, 2 * count))), locked, rng)
    image, top = multiply(basis), 0.0
    for _ in range(rounds):
        small, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        small, turn = small[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        top = max(top, float(small[0]), float(values[0]) if len(values) else 0.0)
        residual = image - basis * small
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        done = 0
        while done < min(len(size), count - len(values)) and size[done] <= 16 * EPS * np.sqrt(dim) * top:
            done += 1
        if done:
            locked, values = np.column_stack([locked, basis[:, :done]]), np.concatenate([values, small[:done]])
            basis, image, small, residual = basis[:, done:], image[:, done:], small[done:], residual[:, done:]
        if len(values) == count:
            return values, locked
        want = min(count - len(values), basis.shape[1])
        if basis.shape[1] + len(values) >= dim:  # the whole space: only rounding is left, take the products afresh
            basis = orthonormal(basis, locked, rng)
            image = multiply(basis)
            continue
        if basis.shape[1] + want > widest:
            keep = max(want, widest // 3)
            basis, image = basis[:, :keep], image[:, :keep]
        near = np.column_stack([locked, basis[:, :want]])
        shift = small[:want]

        def across(v: np.ndarray) -> np.ndarray:
            return v - near @ (near.T @ v)

        def corrected(v: np.ndarray) -> np.ndarray:
            v = across(v)
            return across(multiply(v) - v * shift)

        step = across(minres(corrected, -across(residual[:, :want]), inner)) if want else np.zeros((dim, 0))
        fresh = orthonormal(step, np.column_stack([locked, basis]), rng)
        if fresh.shape[1]:
            basis, image = np.column_stack([basis, fresh]), np.column_stack([image, multiply(fresh)])
    raise ArithmeticError(f"{len(values)} of {count} eigenvectors reached double precision in {rounds} rounds")


@dataclass(frozen=True)
class Fit:
    """Number of rows, their sums by dimension, eigenvalues, eigenvectors (columns) and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def rows_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain, as a written table."""
    good = (f"embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) "
            f"AND abs(c) < {LARGEST!r}D)")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.expr(f"coalesce({good}, false)"))
    x = "transform(embedding, c -> CAST(floor(CAST(c AS DOUBLE) * 1024D) AS LONG) + 100000L)"
    rows = written(kept.select("vec_id", F.expr(x).alias("x")), "whitening-rows")
    dim = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("x") == (dim["dim"] if dim else 0))


def _slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their x as an array, of a bounded number of values."""
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, SLICE // dim)):
            part = batch.slice(start, max(1, SLICE // dim))
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for _, x in _slices(batches, dim):
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(total)],
                                         names=["i", "n", "s"])

    parts = rows.select("x").mapInArrow(run, "i int, n long, s long")
    found = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return int(found[0]["n"]), tuple(int(found[i]["s"]) for i in range(dim))


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n in doubles: the whole part of the mean leaves as integers."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([(s % n) / n for s in sums])


def multiplier(rows: DataFrame, n: int, sums: tuple[int, ...], seen: dict) -> Multiply:
    """The covariance's products with blocks, one Spark job each; ``seen['trace']`` gets its trace."""
    dim = len(sums)

    def multiply(block: np.ndarray) -> np.ndarray:
        k = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dim, k + 1))
            for _, x in _slices(batches, dim):
                c = _centred(x, n, sums)
                total[:, :k] += c.T @ (c @ block)
                total[:, k] += np.einsum("ij,ij->j", c, c)
            cols = [pa.array(np.arange(dim, dtype=np.int32))] + [pa.array(total[:, j]) for j in range(k + 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["i"] + [f"v{j}" for j in range(k + 1)])

        names = [f"v{j}" for j in range(k + 1)]
        parts = rows.select("x").mapInArrow(run, "i int, " + ", ".join(f"{v} double" for v in names))
        out = np.zeros((dim, k + 1))
        for r in parts.groupBy("i").agg(*[F.sum(v).alias(v) for v in names]).collect():  # dim rows
            out[r["i"]] = r[1:]
        seen["trace"] = float(out[:, k].sum()) / n
        return out[:, :k] / n

    return multiply


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Eigenvectors of the covariance of all ``rows`` (``rows_of``); None if there are none."""
    first = rows.select(F.size("x").alias("dim")).first()
    if first is None:
        return None
    n, sums = _sums(rows, first["dim"])
    seen: dict = {}
    values, vectors = jacobi_davidson(multiplier(rows, n, sums, seen), first["dim"], min(components, first["dim"]))
    rank = int((values > 64 * EPS * first["dim"] * max(float(values[0]), 0.0)).sum()) if seen["trace"] > 0 else 0
    return Fit(n, sums, values[:rank], vectors[:, :rank], seen["trace"]) if rank else None


def whiten(rows: DataFrame, model: Fit) -> DataFrame:
    """(vec_id, deviation, w): the exact deviation and the whitened coordinates of every row."""
    n, sums, dim = model.n, model.sums, len(model.sums)
    project = model.vectors / np.sqrt(model.values)
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, dim):
            c = _centred(x, n, sums)
            size = np.einsum("ij,ij->i", c, c) * float(n) ** 2
            deviation: list[int | None] = [None] * len(x)
            small = size < 2.0 ** 61
            exact = (n * (x[small] - whole) - np.array(rest, np.int64))
            for at, d in zip(np.nonzero(small)[0], (exact * exact).sum(1).tolist()):
                deviation[at] = d
            for at in np.nonzero(~small)[0]:
                d = sum((n * (int(v) - int(q)) - r) ** 2 for v, q, r in zip(x[at], whole, rest))
                deviation[at] = d if d < 1 << 63 else None
            w = c @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity, centred before multiplying."""
    means = white.agg(*[(F.sum(F.col("w")[i]) / n).alias(f"m{i}") for i in range(k)]).first()
    c = [F.col("w")[i] - F.lit(float(means[i])) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = white.agg(*[(F.sum(c[i] * c[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[at] - (1.0 if i == j else 0.0)) for at, (i, j) in enumerate(pairs))


def components(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that remains of
    ``vectors`` (vec_id, embedding) and component."""
    rows = rows_of(vectors)
    model = fit(rows, count)
    if model is None:
        return rows.where("false").selectExpr("vec_id", "CAST(1 AS INT) AS component", "0L AS n", "0L AS deviation", "0D AS whitened",
                                              "0D AS explained", "0D AS identity_error")
    k = len(model.values)
    white = written(whiten(rows, model), "whitened")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return out.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                      "whitened", F.element_at(share, F.col("_at") + 1).alias("explained"),
                      F.lit(float(identity_error(white, model.n, k))).alias("identity_error"))
