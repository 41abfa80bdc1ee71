"""Whitening of embeddings by their leading principal components, found with a Jacobi-Davidson method.

1. Entries become whole numbers floor(256 c). The fit list holds each different vector once, packed in blocks in the shared folder. Its
   count and sums are exact.
2. The covariance matrix is never formed: ``Centred.times`` multiplies it with a few vectors in one pass over the blocks. Each task adds up its blocks, Spark
   adds up the tasks, and the driver sees one row per dimension.
3. Jacobi-Davidson: Rayleigh-Ritz on a small search space gives approximate pairs and residuals. For every wanted pair not yet locked, the
   correction equation, projected against the wanted vectors, is solved by a few steps of MINRES; one pass serves a step of all pairs. The corrections enlarge the
   space, which is restarted from its best vectors when it is full. Pairs whose residuals are at double precision are locked: they stay in the
   space but get no more corrections.

On the driver lie only vectors of the dimension's length: at most ``SPACE`` + 2 of them per wanted component.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.session import via_table

SCALE, COMPONENTS = 256, 4
#: Search vectors per wanted component when the space is full, and after a restart.
SPACE, RESTART = 6, 2
#: MINRES steps and reduction of the residual per correction; rounds at most, and without progress.
INNER, REDUCE, ROUNDS, STALLED = 4, 1e-3, 60, 3
#: Residual, as a part of the largest eigenvalue, that counts as double precision.
PRECISION = 16 * np.finfo(float).eps
BLOCK_BYTES = 4 << 20


def whole(vector: Column) -> Column:
    """Whole-number entries of a vector; null if it is null or an entry is null or not finite. Beyond 64 bits they stay at the limit."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN counts as larger
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fit_list(vectors: DataFrame, size: int) -> DataFrame:
    """Each different vector x once, in packed blocks (n, data), stored in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * size))
        for batch in batches:
            x = _matrix(batch.column(0), size)
            parts = [x[i:i + step] for i in range(0, len(x), step)]
            if parts:
                yield pa.record_batch([pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["n", "data"])

    return via_table(vectors.select("x").distinct().mapInArrow(run, "n int, data binary"), "fit-list")


class Centred:
    """The fit list less its mean, as an operator on vectors."""

    def __init__(self, blocks: DataFrame, size: int):
        self.blocks, self.size = blocks, size
        self.n = blocks.agg(F.sum("n")).first()[0] or 0

        def sums(x: np.ndarray) -> np.ndarray:  # high and low halves apart, so that no sum leaves 64 bits
            return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)], 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, size)
                    found = sums(x)
                    yield pa.record_batch([pa.array(np.arange(size)), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.abs(x.astype(float)).max(0))], names=["i", "high", "low", "most"])

        rows = blocks.select("data").mapInArrow(run, "i bigint, high bigint, low bigint, most double")
        big = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        found = {r["i"]: r for r in rows.groupBy("i").agg(big("high").alias("high"), big("low").alias("low"), F.max("most").alias("most")).collect()}
        self.sums = [(int(found[i]["high"]) << 32) + int(found[i]["low"]) for i in range(size)] if self.n else [0] * size
        most = int(max([r["most"] for r in found.values()], default=0)) + 1
        #: Whether n x - S and the sum of its squares fit 64 bits with certainty.
        self.exact = 4 * (self.n * most) ** 2 * size < 2**63

    def centring(self):
        """A function from rows x to (n x - S) / n, which holds no session."""
        n, exact, sums = self.n, self.exact, self.sums
        whole_sums, mean = np.array(sums, np.int64 if exact else object), np.array([s / n for s in sums])
        return (lambda x: (n * x - whole_sums) / n) if exact else (lambda x: x - mean)

    def summed(self, each, shape: tuple[int, int]) -> np.ndarray:
        """The sum over the fit list of the ``shape`` matrices that ``each`` makes of centred rows."""
        centre, size, names = self.centring(), self.size, [f"c{j}" for j in range(shape[1])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for data in batch.column(0):
                    out += each(centre(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, size)))
            yield pa.record_batch([pa.array(np.arange(shape[0])), *(pa.array(out[:, j]) for j in range(shape[1]))], names=["i", *names])

        rows = self.blocks.select("data").mapInArrow(run, "i bigint, " + ", ".join(f"{c} double" for c in names))
        out = np.zeros(shape)
        for r in rows.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect():
            out[r["i"]] = r[1:]
        return out

    def times(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance matrix times the columns of ``vectors``: one pass."""
        return self.summed(lambda x: x.T @ (x @ vectors), vectors.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda x: np.full((1, 1), np.square(x).sum()), (1, 1))[0, 0] / self.n)


def minres(rhs: np.ndarray, steps: int = INNER, reduce: float = REDUCE) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for a symmetric operator: yields the vector to multiply, is sent the product, returns the solution."""
    x = np.zeros_like(rhs)
    beta = first = float(np.linalg.norm(rhs))
    if not first:
        return x
    v, before = rhs / beta, np.zeros_like(rhs)
    d1, d2 = np.zeros_like(rhs), np.zeros_like(rhs)
    c1 = c2 = 1.0
    s1 = s2 = old = 0.0
    eta = beta
    for _ in range(steps):
        p = yield v
        alpha = float(v @ p)
        p = p - alpha * v - old * before
        new = float(np.linalg.norm(p))
        # the last two rotations on this column, then the one that removes ``new``
        r3, r2, r1 = s2 * old, s1 * alpha + c1 * c2 * old, c1 * alpha - s1 * c2 * old
        rho = float(np.hypot(r1, new))
        if not rho:
            break
        c, s = r1 / rho, new / rho
        d = (v - r3 * d2 - r2 * d1) / rho
        x = x + c * eta * d
        eta = -s * eta
        if abs(eta) <= reduce * first or new <= 1e-300:
            break
        before, v, old = v, p / new, new
        d2, d1, c2, c1, s2, s1 = d1, d, c1, c, s1, s
    return x


def _corrections(times, pairs: np.ndarray, values: np.ndarray, wanted: list[int], residuals: np.ndarray) -> np.ndarray:
    """Solutions of (I - UU')(V - value)(I - UU') t = -residual for the wanted pairs, orthogonal to all pairs U. One product per step serves them all."""
    project = lambda t: t - pairs @ (pairs.T @ t)
    runs = {j: minres(project(-residuals[:, j])) for j in wanted}
    out, asks = {}, {}
    for j, run in runs.items():
        try:
            asks[j] = next(run)
        except StopIteration as end:
            out[j] = end.value
    while asks:
        order = sorted(asks)
        found = times(np.stack([project(asks[j]) for j in order], 1))
        for k, j in enumerate(order):
            try:
                asks[j] = runs[j].send(project(found[:, k] - values[j] * asks[j]))
            except StopIteration as end:
                out[j] = end.value
                del asks[j]
    return np.stack([out[j] for j in wanted], 1)


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of ``new`` outside the basis, orthonormal; those that vanish are left out."""
    out = np.empty((len(new), 0))
    for column in new.T:
        size = float(np.linalg.norm(column))
        for _ in range(3):
            for done in (basis, out):
                column = column - done @ (done.T @ column)
        if np.linalg.norm(column) > 1e-10 * size > 0:
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out


def jacobi_davidson(times, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator given by its products.

    Starts are fixed, so equal products give equal results. Ends when all residuals are at double precision, or no longer fall.
    """
    count = min(count, size)
    starts = np.random.default_rng(12).standard_normal((size, min(size, RESTART * count)))
    basis = _orthonormal(starts, np.empty((size, 0)))
    images = times(basis)
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        pairs = basis @ turn[:, :count]
        residuals = images @ turn[:, :count] - pairs * values[:count]
        norms = np.linalg.norm(residuals, axis=0)
        limit = PRECISION * max(abs(values[0]), np.finfo(float).tiny)
        locked = norms <= limit
        best, stalled = (norms.max(), 0) if norms.max() < 0.5 * best else (best, stalled + 1)
        if locked.all() or basis.shape[1] == size or (stalled >= STALLED and norms.max() <= 1e3 * limit):
            break
        if basis.shape[1] + count > SPACE * count:
            basis, images = basis @ turn[:, :RESTART * count], images @ turn[:, :RESTART * count]
        new = _orthonormal(_corrections(times, pairs, values, np.flatnonzero(~locked).tolist(), residuals), basis)
        if not new.shape[1]:
            break
        basis, images = np.column_stack([basis, new]), np.column_stack([images, times(new)])
    return values[:count], pairs / np.linalg.norm(pairs, axis=0)


def whitened(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Per row and component: the id column, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, is empty or holds null or non-finite entries are left out, and so are rows whose vector is not of the most frequent length
    (the longer of two equally frequent ones). Rows may repeat and ids be null; other columns are ignored. Each distinct x counts once in the fit. An empty table gives an
    empty result. A component without variance (eigenvalue at rounding level) has null ``whitened`` and does not count in ``identity_error``. A
    ``deviation`` beyond 64 bits is null.
    """
    schema = f"`{id_}` {rows.schema[id_].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    x = rows.select(F.col(id_), whole(F.col(vector)).alias("x")).where(F.size("x") > 0)
    lengths = x.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    size = lengths["length"]
    x = x.where(F.size("x") == size)
    fit = Centred(fit_list(x, size), size)
    values, vectors = jacobi_davidson(fit.times, size, count)
    trace = fit.trace()
    full = values > size * PRECISION * max(trace, np.finfo(float).tiny)
    onto = vectors[:, full] / np.sqrt(values[full])
    k = onto.shape[1]
    error = 0.0
    if k:
        # the sums of z and of its products in one pass
        total = fit.summed(lambda c: (z := c @ onto) is not None and np.vstack([z.T @ z, z.sum(0)]), (k + 1, k)) / fit.n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    explained = [max(0.0, float(v / trace)) if trace else 0.0 for v in values]
    centre, n, exact, sums = fit.centring(), fit.n, fit.exact, fit.sums
    places = [int(np.flatnonzero(full).tolist().index(j)) if full[j] else -1 for j in range(len(values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.int64 if exact else object
        for batch in batches:
            many, c = batch.num_rows, len(places)
            if not many:
                continue
            m = _matrix(batch.column(1), size)
            deviation = np.square(n * m.astype(kind) - np.array(sums, kind)).sum(1)
            deviation = [v if v < 2**63 else None for v in deviation.tolist()]
            z = centre(m) @ onto
            columns = [z[:, p] if p >= 0 else np.full(many, np.nan) for p in places]
            flat = np.stack(columns, 1).ravel()
            take = pa.array(np.repeat(np.arange(many), c))
            yield pa.record_batch([
                batch.column(0).take(take), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), many)), pa.array(np.full(many * c, n, np.int64)),
                pa.array(deviation, pa.int64()).take(take), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, many)), pa.array(np.full(many * c, error)),
            ], names=[id_, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)
