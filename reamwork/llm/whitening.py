"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The vectors become integers, ``floor(64 * c) + 1000000``; their covariance matrix is never formed. Work on Spark:

* One pass gives the exact number of vectors and the exact sums per dimension.
* A pass multiplies the centred vectors with a block Q of narrow width, X'(XQ): each task gives one packed block, the
  blocks of many tasks are added by ``GROUPS`` tasks, and only those few sums of fixed size reach the driver.
* A cycle is a Rayleigh-Ritz step (small eigenproblem of Q'VQ), then a Chebyshev polynomial of V of degree ``DEGREE``, a three-term
  recurrence of passes that damps the spectrum between a lower bound and the smallest Ritz value, then QR. The lower
  bound comes from a Lanczos vector that goes along with the passes of the first cycle.
* Cycles end when the residual of every wanted pair is at the level of rounding. Where ``PATIENCE`` cycles do not
  reach it, the block grows to twice its width; a block of full width needs no filter, so the iteration ends.

The block is wider than the wanted components by half of them, so that the filter has a gap to work with.

Defined results: null vectors and such with a null, NaN or infinite entry, or an entry beyond 2^56, are dropped; so are vectors
of another length than the most frequent one (of equally frequent lengths the longer stands) and empty ones. Repeated rows count and are returned
each; null ids stay; further columns do not matter. A direction without variance (an eigenvalue at the level of rounding) can't be
whitened and is no component, so there are fewer components than asked for where the vectors do not span as many; without any vector,
or with equal vectors alone, the result is empty. A deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
DEGREE = 10
PATIENCE = 6
GROUPS = 16
SEED = 5
OUTPUT_ROWS = 2_048
LARGEST = float(1 << 56)


def scaled(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: usable vectors as integers without the shift, all of the most frequent length."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST), F.lit(False)))
    rows = df.filter(usable).select(
        F.col(vec_id).alias("vec_id"), F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("bigint")).alias("x"))
    rows = settle(rows, "whitening-vectors")
    modal = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    found = modal.collect()
    return rows.filter(F.size("x") == (found[0]["d"] if found else 0))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, exact."""
    import pyarrow as pa

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                small = int(np.abs(x).max()) * len(x) < 1 << 62
                part = (x if small else x.astype(object)).sum(0)
                sums = [int(s) for s in part] if sums is None else [a + int(b) for a, b in zip(sums, part)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([str(s) for s in sums])],
                ["j", "n", "s"])

    parts = rows.select("x").mapInArrow(of_task, "j int, n bigint, s string")
    got = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    return (int(got[0]["n"]), [int(r["s"]) for r in got]) if got else (0, [])


def summed(rows: DataFrame, of_vectors: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of a block of fixed size that a function makes of a batch of them.

    Tasks add their batches, ``GROUPS`` tasks the blocks of all tasks in the order of their numbers, so that the sum does not
    depend on which task ended first.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = of_vectors(_matrix(batch.column(0)))
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "block"])

    def added(group: pa.Table) -> pa.Table:
        blocks = sorted(zip(group["part"].to_pylist(), group["block"].to_pylist()))
        total = sum(np.frombuffer(b) for _, b in blocks)
        return pa.table({"part": pa.array([blocks[0][0]], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    shape = "part int, block binary"
    parts = rows.select("x").mapInArrow(of_task, shape)
    got = parts.groupBy(F.pmod("part", F.lit(GROUPS))).applyInArrow(added, shape).collect()
    return sum(np.frombuffer(r["block"]) for r in sorted(got, key=lambda r: r["part"]))


def _product(rows: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that multiplies the covariance matrix with a block, in one pass over the vectors."""

    def times(block: np.ndarray) -> np.ndarray:
        def of_vectors(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(rows, of_vectors).reshape(block.shape) / n

    return times


class Lanczos:
    """A lower bound of the spectrum from one vector that goes along with the passes."""

    def __init__(self, v: np.ndarray) -> None:
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    def step(self, image: np.ndarray) -> None:
        """Take the image of the last vector of the basis."""
        self.alpha.append(float(self.basis[-1] @ image))
        basis = np.array(self.basis)
        for _ in range(2):
            image = image - basis.T @ (basis @ image)
        size = float(np.linalg.norm(image))
        self.beta.append(size)
        self.basis.append(image / size if size else image)

    def lower_bound(self) -> float:
        k = len(self.alpha)
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(self.beta[:k - 1], 1) + np.diag(self.beta[:k - 1], -1))
        return max(0.0, float(values[0] - self.beta[-1] * abs(vectors[-1, 0])))


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their eigenvectors (columns) of a symmetric matrix without negative ones,
    of which only the products with blocks are known."""
    dice = np.random.default_rng(SEED)
    width = min(d, wanted + max(16, wanted // 2))
    q = np.linalg.qr(dice.standard_normal((d, width)))[0]
    lanczos, low, cycles = Lanczos(dice.standard_normal(d)), None, 0
    while True:
        image = times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = np.linalg.norm(image - q * values, axis=0)[:wanted].max()
        if width == d or residual <= 4 * d * np.finfo(float).eps * values[0]:
            return values[:wanted], q[:, :wanted]
        cycles += 1
        if cycles % PATIENCE == 0:
            more = min(d, 2 * width) - width
            q = np.linalg.qr(np.hstack([q, dice.standard_normal((d, more))]))[0]
            width += more
            continue
        bottom = low or 0.0
        centre, half = (values[-1] + bottom) / 2, (values[-1] - bottom) / 2
        if half <= 0:  # nothing is below the block but the bound itself
            centre, half = values[-1] / 2, values[-1] / 2
        before, now = q, (image - centre * q) / half
        for _ in range(DEGREE - 1):
            if low is None:
                both = times(np.column_stack([now, lanczos.basis[-1]]))
                lanczos.step(both[:, -1])
                image = both[:, :-1]
            else:
                image = times(now)
            before, now = now, 2 / half * (image - centre * now) - before
            size = np.abs(now).max(0)
            if size.max() > 1e100:  # columns grow at their own rates; a common factor keeps the recurrence
                before, now = before / size.max(), now / size.max()
        if low is None:
            low = lanczos.lower_bound()
        q = np.linalg.qr(now)[0]


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    import pyarrow as pa

    rows = scaled(df, vec_id, vector)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    shape = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
             "identity_error double")
    n, sums = exact_sums(rows)
    d = len(sums)
    mean = np.array([float(Fraction(s, max(n, 1))) for s in sums])
    if not n or not (trace := float(summed(rows, lambda x: np.array([np.square(x - mean).sum()]))[0]) / n):
        return df.sparkSession.createDataFrame([], shape)
    values, vectors = leading(_product(rows, mean, n), d, min(components, d))
    kept = values > d * np.finfo(float).eps * trace
    values, vectors = values[kept], vectors[:, kept]
    k = len(values)
    to_white = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ to_white
        return np.vstack([white.T @ white, white.sum(0)])

    found = summed(rows, moments).reshape(k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / trace
    total = np.array(sums, object)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums of squares of n*x - S (the shift cancels out), exact."""
        off = x.astype(object) * n - total if n * (int(np.abs(x).max()) + 1) >= 1 << 61 else x * n - total.astype(np.int64)
        if off.dtype == object or d * int(np.abs(off).max()) ** 2 >= 1 << 63:
            return [s if s < 1 << 63 else None for s in (off.astype(object) ** 2).sum(1)]
        return (off * off).sum(1).tolist()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, OUTPUT_ROWS):
                batch = whole.slice(a, OUTPUT_ROWS)
                x, rows_of = _matrix(batch.column(1)), np.repeat(np.arange(batch.num_rows), k)
                white = (x - mean) @ to_white
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows_of), n, np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(rows_of)),
                    pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows_of), error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(of_batches, shape)
