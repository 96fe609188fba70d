"""Embedding whitening by a two-pass covariance.

Entries become integers: c is floor(64 c) + 1,000,000. The fit list is each different integer vector once. Pass one
sums it exactly, which gives the mean; pass two sums outer products of centred vectors, one matrix product for a batch.
Each task returns one partial sum, ``treeAggregate`` merges them, LAPACK's symmetric ``eigh`` takes the covariance
apart, and the components are broadcast for the projection. A third pass measures the whitened fit list's covariance.

Sums of the mean are Python integers, and a deviation that 64 bits might not hold is computed with them too.

Defined results. A row whose vector is null, or holds null, NaN or an infinite entry, or one of 2**47 or more in size
(its integer has no exact double), has no result. Vectors of several lengths are fitted length by length. A vector
without entries has no components. A component without variance (its eigenvalue is within rounding of zero) can't be
scaled and has no rows, so a fit list of one vector gives none. Repeated rows, ids and null ids each have their
results. An empty table gives an empty result. Only the id and the vector are read, whatever other columns are called.

What moves: the different vectors once, by a shuffle in which copies meet in the map stage first; then one matrix for
each task. The driver holds one matrix for each length; ``max_bytes`` bounds them, and more is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held

SCALE, SHIFT = 64, 1_000_000
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class WhiteningParams:
    components: int = 16
    #: Bound on the matrices of all lengths together, on the driver and in a task.
    max_bytes: int = 256 << 20


@dataclass(frozen=True)
class Basis:
    """What a length's vectors are projected with."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # dimensions by components
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = [divmod(s, self.n) for s in self.sums]
        return (x - np.array([q for q, _ in whole], np.int64)) - np.array([r / self.n for _, r in whole])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S) squared; null beyond 38 digits."""
        q = np.array([s // self.n for s in self.sums], np.int64)
        r = np.array([s % self.n for s in self.sums], object)
        near = x - q
        most = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            d = near * self.n - r.astype(np.int64)
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        d = near.astype(object) * self.n - r
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in (d * d).sum(1)], pa.decimal128(38, 0))


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that take part."""
    v = F.col("v")
    whole = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < float(1 << 53), F.lit(False)))
    rows = held(df, vec_id, vector).toDF("vec_id", "v").where(v.isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT)).alias("x"))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of a batch's vectors, for each length above zero."""
    lengths = column.value_lengths().to_numpy()
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)


def _exact_sum(x: np.ndarray) -> np.ndarray:
    most = max(abs(int(x.max())), abs(int(x.min())))
    return x.sum(0).astype(object) if most * len(x) < 1 << 62 else x.astype(object).sum(0)


def _merged(partials: DataFrame, decode, add) -> dict:
    """One dictionary by length of all partial sums, merged on executors as a tree."""

    def seen(held: dict, row) -> dict:
        return joined(held, {row["d"]: decode(row)})

    def joined(a: dict, b: dict) -> dict:
        for d, v in b.items():
            a[d] = add(a[d], v) if d in a else v
        return a

    return partials.rdd.treeAggregate({}, seen, joined, depth=3)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for d, _, x in _by_length(b.column("x")):
                n, s = held.get(d, (0, 0))
                held[d] = n + len(x), s + _exact_sum(x)
        if held:
            yield pa.RecordBatch.from_pydict({"d": list(held), "n": [n for n, _ in held.values()], "s": [[str(v) for v in s] for _, s in held.values()]})

    found = _merged(fit.mapInArrow(run, "d long, n long, s array<string>"), lambda r: (r["n"], [int(v) for v in r["s"]]), lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]))
    return dict(sorted(found.items()))


def _products(fit: DataFrame, bases: dict[int, Basis], rows_of) -> dict[int, np.ndarray]:
    """Sum of outer products of ``rows_of(basis, x)`` for each length."""
    shared = fit.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for d, _, x in _by_length(b.column("x")):
                if d in shared.value:
                    c = rows_of(shared.value[d], x)
                    held[d] = held.get(d, 0.0) + c.T @ c
        if held:
            yield pa.RecordBatch.from_pydict({"d": list(held), "m": [np.ascontiguousarray(m).tobytes() for m in held.values()]})

    def decode(row) -> np.ndarray:
        m = np.frombuffer(row["m"])
        return m.reshape(2 * (int(len(m) ** 0.5),))

    return _merged(fit.mapInArrow(run, "d long, m binary"), decode, lambda a, b: a + b)


def bases(fit: DataFrame, p: WhiteningParams = WhiteningParams()) -> dict[int, Basis]:
    """The basis of each length in a list of different vectors (column x)."""
    found = {}
    sums = _sums(fit)
    if (need := sum(8 * d * d for d in sums)) > p.max_bytes:
        raise ValueError(f"covariances of {len(sums)} lengths of vectors take {need} bytes, more than {p.max_bytes}")
    start = {d: Basis(n, s, np.empty((d, 0)), np.empty(0), 0.0) for d, (n, s) in sums.items()}
    for d, m in _products(fit, start, Basis.centred).items():
        values, vectors = np.linalg.eigh(m / start[d].n)
        values, vectors = values[::-1], vectors[:, ::-1]
        real = values > max(values[0], 0) * d * np.finfo(float).eps
        k = min(p.components, int(real.sum()))
        if k:
            found[d] = Basis(start[d].n, start[d].sums, vectors[:, :k].copy(), values[:k].copy(), float(np.trace(m) / start[d].n))
    seen = _products(fit, found, Basis.whitened)
    return {d: Basis(b.n, b.sums, b.vectors, b.values, b.trace, float(np.abs(seen[d] / b.n - np.eye(len(b.values))).max())) for d, b in found.items()}


def project(rows: DataFrame, bases: dict[int, Basis]) -> DataFrame:
    """RESULT for every row (vec_id, x) and component."""
    shared = rows.sparkSession.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in _by_length(b.column("x")):
                if (basis := shared.value.get(d)) is None:
                    continue
                k = len(basis.values)
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("vec_id").take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(each), basis.n)),
                        basis.deviations(x).take(each),
                        pa.array(basis.whitened(x).ravel()),
                        pa.array(np.tile(basis.values / basis.trace, len(at))),
                        pa.array(np.full(len(each), basis.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, RESULT)


def whitened(df: DataFrame, p: WhiteningParams = WhiteningParams(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = integers(df, vec_id, vector)
    scratch = Scratch(df.sparkSession, "whitening")
    fit = scratch.write(rows.select("x").distinct(), "fit")
    found = bases(fit, p)
    scratch.drop(fit)
    return project(rows, found)
