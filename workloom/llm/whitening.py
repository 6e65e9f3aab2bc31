"""Whitening of embeddings from an incremental eigendecomposition.

1. Each component c becomes the whole number floor(64 c) + 1000000, and each distinct vector of these counts once.
   The number of vectors n and the sums S per dimension are exact; all later work is on vectors minus a whole-number
   shift near their mean, so the large offset costs no digits.
2. A task holds the eigenvalues, eigenvectors and mean of the vectors it has seen. A vector adds a centred rank-one term to
   their scatter: the new eigenvalues are the roots of a secular equation, and eigenvectors follow from them.
   Entries that the term hardly touches, and pairs of equal eigenvalues, are deflated: taken out or rotated away.
3. Spectra of tasks are combined, some at a time, in rounds: each eigenpair of one, and the distance of
   the two means, is a rank-one term for the other.
4. Refinement: one pass projects every vector on the eigenvectors found, centred by the exact mean, and adds up the
   products. The small matrix that comes out, diagonal but for rounding, is diagonalised, which turns the eigenvectors to
   double precision. One more pass measures how far the whitened vectors' covariance is from the identity.

Vectors that are null, or hold null or non-finite components, take no part, nor do those of another length than most (the
longer one of equally frequent lengths). Repeated vectors give rows each but count once in the covariance; a null id
stays null. Components whose eigenvalue is zero up to rounding are left out, so a table with one distinct vector, or an
empty one, gives no rows. A deviation beyond a long is an error. Other columns, whatever their names, are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from workloom.llm.frames import map_batches
from workloom.session import stash

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Vectors per first spectrum, and spectra that one task combines in a round.
ROWS, FAN = 2_048, 8
_EPS = np.finfo(np.float64).eps


def secular_roots(poles: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """Differences poles[j] - root[i] for the roots of 1 + rho * sum(z2 / (poles - x)) = 0, one right of each pole.

    `poles` rise strictly, `z2` and `rho` are positive. A root is found relative to the nearer of its two
    poles, so differences keep their digits: Newton's method on x * f, held inside a shrinking bracket.
    """
    k = len(poles)
    gaps = np.append(poles[1:] - poles[:-1], rho * z2.sum())
    apart = poles[None, :] - poles[:, None]
    left = 1 + rho * (z2 / (apart - gaps[:, None] / 2)).sum(1) >= 0
    left[-1] = True
    origin = np.arange(k) + ~left
    apart = poles[None, :] - poles[origin][:, None]
    low = np.where(left, 0.0, -gaps / 2)
    high = np.where(left, gaps / 2, 0.0)
    high[-1] = gaps[-1] * (1 + 4 * _EPS)
    x = (low + high) / 2
    for _ in range(80):
        away = apart - x[:, None]
        term = z2 / away
        f = 1 + rho * term.sum(1)
        slope = rho * (term / away).sum(1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = slope * x * x / (f + slope * x)
        new = np.where((new >= low) & (new <= high) & (new != 0), new, (low + high) / 2)
        settled = np.abs(new - x) <= 8 * _EPS * np.abs(new)
        settled |= np.abs(f) <= 4 * _EPS * (1 + rho * np.abs(term).sum(1))  # f is rounding
        x = np.where(settled, x, new)
        if settled.all():
            break
    return apart - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) after adding rho * v v' to the matrix; rho is positive."""
    z = vectors.T @ v
    size = float(z @ z)
    tiny = 8 * _EPS * max(float(np.abs(values).max()), rho * size)
    if rho * size <= tiny * _EPS or not np.isfinite(size):
        return values, vectors
    active = np.flatnonzero(rho * np.abs(z) * np.sqrt(size) > tiny)
    if not len(active):
        return values, vectors
    if len(active) > 1 and (np.diff(values[active]) <= tiny).any():
        vectors, kept = vectors.copy(), []
        last = active[0]
        for j in active[1:]:
            if values[j] - values[last] <= tiny:  # equal poles: turn the pair until one has no part
                r = np.hypot(z[last], z[j])
                c, s = z[j] / r, z[last] / r
                a, b = vectors[:, last].copy(), vectors[:, j].copy()
                vectors[:, last], vectors[:, j] = c * a - s * b, s * a + c * b
                z[last], z[j] = 0.0, r
            else:
                kept.append(last)
            last = j
        active = np.array([*kept, last])
    poles, part = values[active], z[active]
    away = secular_roots(poles, part * part, rho)  # poles[j] - root[i]
    # The term that has exactly these roots, so that eigenvectors come out orthogonal.
    k = len(active)
    ratio = np.empty((k, k))
    gap = poles[:, None] - poles[None, :]  # poles[i] - poles[j]
    np.fill_diagonal(gap, 1.0)
    lower = np.tri(k, k=-1, dtype=bool).T  # i < j
    ratio[:] = 1.0
    ratio[lower] = (-away / gap)[lower]
    upper = np.zeros((k, k), bool)
    upper[:-1] = np.tri(k - 1, k, dtype=bool)  # j <= i < k - 1, divided by poles[i + 1] - poles[j]
    above = np.ones((k, k))
    above[:-1][upper[:-1]] = (poles[1:, None] - poles[None, :])[upper[:-1]]
    ratio[upper] = (-away / above)[upper]
    exact = np.sqrt(np.maximum(ratio.prod(0) * -away[-1] / rho, 0.0)) * np.where(part < 0, -1.0, 1.0)
    turn = exact / away
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[active] = poles - np.diagonal(away)
    out_vectors[:, active] = vectors[:, active] @ turn.T
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


class Spectrum:
    """Eigenvalues and eigenvectors of the scatter of n vectors around their mean."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def empty(cls, d: int) -> "Spectrum":
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, y: np.ndarray) -> None:
        off = y - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def combine(self, other: "Spectrum") -> None:
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        off, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / n)
        self.mean, self.n = self.mean + off * (other.n / n), n

    def row(self, part: int) -> pa.RecordBatch:
        pack = [pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (self.mean, self.values, self.vectors)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), *pack], names=_SPECTRUM)

    @classmethod
    def of(cls, n: int, mean: bytes, values: bytes, vectors: bytes) -> "Spectrum":
        mean, values, vectors = (np.frombuffer(x, "<f8") for x in (mean, values, vectors))
        return cls(n, mean, values, vectors.reshape(len(mean), len(mean)))


_SPECTRUM = ["part", "n", "mean", "lambdas", "vectors"]
_SPECTRUM_TYPES = "part bigint, n bigint, mean binary, lambdas binary, vectors binary"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _first_spectra(d: int, shift: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum.empty(d)
        for batch in batches:
            for y in (_matrix(batch.column(0), d) - shift).astype(np.float64):
                spectrum.add(y)
        if spectrum.n:
            yield spectrum.row(TaskContext.get().partitionId())
    return work


def _combining(d: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            for own, _, n, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                if own != group:
                    if held is not None:
                        yield held.row(group)
                    group, held = own, Spectrum.empty(d)
                held.combine(Spectrum.of(n, *packed))
        if held is not None:
            yield held.row(group)
    return work


def _entries(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(matrix.size)), pa.array(matrix.ravel())], names=["at", "v"])


def _summed(df: DataFrame, work, kind: str, size: int) -> list:
    """What tasks give as (at, v), added up per place in Spark; `size` places, which the dimensions bound."""
    out: list = [0] * size
    for r in map_batches(df, work, f"at bigint, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _sums(d: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), d).sum(0)
        yield _entries(total)
    return work


def _products(d: int, shift: np.ndarray, mean: np.ndarray, onto: np.ndarray):
    """Sums of products of the centred vectors' coordinates along the columns of `onto`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((onto.shape[1], onto.shape[1]))
        for batch in batches:
            p = (_matrix(batch.column(0), d) - shift - mean) @ onto
            total += p.T @ p
        yield _entries(total)
    return work


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row, the sum over dimensions of (n * x - sums)**2, exactly."""
    far = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if far * far * max(len(sums), 1) < 2 ** 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]


def _rows(d: int, shift: np.ndarray, mean: np.ndarray, onto: np.ndarray, n: int, sums: list[int], explained: np.ndarray, error: float):
    k = onto.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d) - shift
            m = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(((x - mean) @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return work


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), up to `components` rows per vector.

    Finds the components when called; the result projects every vector. The driver holds matrices of the vectors'
    dimension, never rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    v = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].cast("array<double>").alias("v"))
    v = v.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    lengths = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths.d:
        return spark.createDataFrame([], schema)
    d = lengths.d
    whole = v.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    fit = stash(whole.select("x").distinct(), "fit-list")
    n = fit.count()
    sums = [int(s) for s in _summed(fit, _sums(d), "bigint", d)]
    shift = np.array([round(s / n) for s in sums], np.int64)
    rest = [s - n * int(a) for s, a in zip(sums, shift)]  # sums of the shifted vectors
    mean = np.array([s / n for s in rest])

    dealt = fit.repartition(-(-n // rows), "x")
    spectra = stash(map_batches(dealt, _first_spectra(d, shift), _SPECTRUM_TYPES), "spectra")
    left = spectra.agg(F.max("part") + 1).first()[0]  # numbers of tasks, some of which may have had no vector
    while left > 1:
        groups = -(-left // fan)
        grouped = spectra.select(F.floor(F.col("part") / fan).alias("group"), *_SPECTRUM)
        dealt = grouped.repartition(groups, "group").sortWithinPartitions("group", "part")
        spectra = stash(map_batches(dealt, _combining(d), _SPECTRUM_TYPES), "spectra")
        left = groups
    basis = Spectrum.of(*spectra.drop("part").first()).vectors
    basis = np.linalg.qr(basis)[0]
    products = np.array(_summed(fit, _products(d, shift, mean, basis), "double", d * d)).reshape(d, d) / n
    values, turned = np.linalg.eigh((products + products.T) / 2)
    trace = float(values.sum())
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > 64 * d * _EPS * max(values.max(), 0)][:components]
    if not order:
        return spark.createDataFrame([], schema)
    values, axes = values[order], basis @ turned[:, order]
    onto = axes / np.linalg.norm(axes, axis=0) / np.sqrt(values)
    k = len(order)
    spread = np.array(_summed(fit, _products(d, shift, mean, onto), "double", k * k)).reshape(k, k) / n
    error = float(np.abs(spread - np.eye(k)).max())
    return map_batches(whole, _rows(d, shift, mean, onto, n, rest, values / trace, error), schema)

