"""Embedding whitening by spectrum slicing.

Two passes over the vectors give their exact sums and the centred covariance V, a matrix of the vectors'
dimension squared whatever the number of rows. Its leading eigenvalues are found one by one: the inertia of
``V - s I``, read off its LDL^T factors, counts the eigenvalues above the shift s, and bisection on these counts
isolates the k-th largest in an interval of its own; Rayleigh quotient iteration from there converges cubically,
and the counts on both sides of the result certify that it is number k. Eigenvalues that no shift can tell
apart get an orthonormal basis of their common space. A third pass measures the covariance of the whitened rows.

Defined results for odd input: a row whose vector is null or empty, or has a null or non-finite entry or one whose step ``64 * c``
is 2^62 or more, which no long holds, is dropped; so are rows of another length than the most frequent one (of ties the longest);
repeated rows count and come back as often as they stand; a null vec_id stays null; components whose eigenvalue isn't above rounding
(fewer different rows than dimensions, constant dimensions) can't be scaled to unit variance and give no rows; ``deviation`` is null where it exceeds a long;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues within this share of the largest are close.
CLOSE = 1e-3
#: Rows of one block of numpy work.
ROWS = 4096

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def ldl_inertia(a: np.ndarray) -> tuple[int, int, int]:
    """The numbers of positive, negative and zero eigenvalues of a symmetric matrix, from P A P^T = L D L^T.

    Pivots are of order one or two, chosen from the whole remainder (Bunch and Parlett), so that the factors stay bounded.
    """
    a = np.array(a, float)
    n, k, counts = len(a), 0, [0, 0, 0]
    alpha = (1 + math.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        rest = a[k:, k:]
        diagonal = np.abs(np.diagonal(rest))
        p = int(diagonal.argmax())
        size = np.abs(rest)
        at = int(size.argmax())
        i, j = divmod(at, n - k)
        largest = size[i, j]
        if largest == 0:
            counts[2] += n - k
            break
        if diagonal[p] >= alpha * largest:
            swap(k, k + p)
            pivot = a[k, k]
            counts[0 if pivot > 0 else 1] += 1
            column = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(column, column) / pivot
            k += 1
        else:  # the pivot of order two around the largest entry, one eigenvalue of either sign
            i, j = min(i, j), max(i, j)
            swap(k, k + i)
            swap(k + 1, k + j)
            counts[0] += 1
            counts[1] += 1
            columns = a[k + 2 :, k : k + 2]
            change = columns @ np.linalg.solve(a[k : k + 2, k : k + 2], columns.T)
            a[k + 2 :, k + 2 :] -= (change + change.T) / 2  # stays symmetric to the last digit
            k += 2
    return counts[0], counts[1], counts[2]


class Slices:
    """The leading eigenpairs of a positive semidefinite matrix by counts of eigenvalues above shifts."""

    def __init__(self, v: np.ndarray) -> None:
        self.v = v
        self.n = len(v)
        radius = np.abs(v).sum(axis=1) - np.abs(np.diagonal(v))
        self.top = float((np.diagonal(v) + radius).max(initial=0.0))  # Gershgorin
        self.unit = self.top * np.finfo(float).eps
        self.counts: dict[float, int] = {-self.unit: self.n, self.top + self.unit: 0}

    def above(self, shift: float) -> int:
        """How many eigenvalues exceed ``shift``."""
        if shift not in self.counts:
            self.counts[shift] = ldl_inertia(self.v - shift * np.eye(self.n))[0]
        return self.counts[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """The narrowest known ``low < high`` with the k-th largest eigenvalue between them."""
        low = max(s for s, c in self.counts.items() if c >= k)
        high = min(s for s, c in self.counts.items() if c < k)
        return low, high

    def isolated(self, k: int) -> tuple[float, float, int, int]:
        """``low, high`` around the k-th largest eigenvalue and the numbers of the first and last in between.

        The slice is halved until it holds one eigenvalue, or can't be told from a point.
        """
        low, high = self.bracket(k)
        while True:
            first, last = self.above(high) + 1, self.above(low)
            if first == last or high - low <= 64 * self.n * self.unit:
                return low, high, first, last
            self.above((low + high) / 2)
            low, high = self.bracket(k)

    def pair(self, low: float, high: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
        """An eigenpair of the slice, orthogonal to ``found``: inverse iteration at its middle, then Rayleigh quotients."""
        eye = np.eye(self.n)
        basis = np.array(found).reshape(-1, self.n)

        def unit(y: np.ndarray) -> np.ndarray:
            y = y / np.abs(y).max()
            for _ in range(2):
                y = y - basis.T @ (basis @ y)
            return y / np.linalg.norm(y)

        def solved(shift: float, y: np.ndarray) -> np.ndarray:
            for nudge in (0.0, self.unit, -self.unit, 16 * self.unit):
                try:
                    x = np.linalg.solve(self.v - (shift + nudge) * eye, y)
                except np.linalg.LinAlgError:
                    continue
                if np.isfinite(x).all() and x.any():
                    return x
            return y

        y = unit(np.random.default_rng(seed).standard_normal(self.n))
        for _ in range(4):
            y = unit(solved((low + high) / 2, y))
        best = None
        for _ in range(12):
            value = float(y @ self.v @ y)
            rest = float(np.linalg.norm(self.v @ y - value * y))
            if best is None or rest < best[0]:
                best = rest, value, y
            elif rest >= best[0] / 2:
                break
            y = unit(solved(value, y))
        return best[1], best[2]

    def leading(self, most: int) -> list[tuple[float, np.ndarray]]:
        """The ``most`` largest eigenvalues above rounding, falling, with unit vectors."""
        out: list[tuple[float, np.ndarray]] = []
        zero = self.n * self.unit * 4
        k = 1
        while k <= min(most, self.n) and self.top > 0:
            low, high, first, last = self.isolated(k)
            if high <= zero:
                break
            if first == last:
                # Of close eigenvalues the vectors found before are kept out, so that all are orthogonal.
                found = self.certified(k, low, high, [y for e, y in out if e - high < CLOSE * self.top])
            else:  # one point of several eigenvalues
                vectors: list[np.ndarray] = []
                for i in range(first, last + 1):
                    vectors.append(self.pair(low, high, [y for _, y in out] + vectors, i)[1])
                found = [(float(y @ self.v @ y), y) for y in vectors]
            out += [x for x in found if x[0] > zero]
            k = last + 1
        return sorted(out[:most], key=lambda x: -x[0])

    def certified(self, k: int, low: float, high: float, found: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Eigenpair number k: its slice is halved until the iteration ends inside and counts confirm the number."""
        for _ in range(64):
            value, y = self.pair(low, high, found, k)
            error = float(np.linalg.norm(self.v @ y - value * y))
            margin = max(4 * error, 4 * self.n * self.unit)
            if low - margin <= value <= high + margin and self.above(value + margin) < k <= self.above(value - margin):
                return [(value, y)]
            self.above((low + high) / 2)
            low, high = self.bracket(k)
        raise ArithmeticError(f"eigenvalue {k} can't be told from its neighbours")


@dataclass
class Whitening:
    """What rows are whitened with: the size and sums of the fit list, and its components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a row a component
    trace: float

    @property
    def near(self) -> np.ndarray:
        """The rounded mean, about which all differences are small."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """``S - n * near``, exact."""
        return np.array([s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` as doubles."""
        return (x - self.near).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of ``(n * x - S)^2`` and whether each exceeds a long."""
        rough = (np.square(self.centred(x) * self.n)).sum(axis=1)
        over = rough >= 2.0**63 * 1.01
        steps = np.where(over[:, None], 0, x - self.near)
        found = np.square(np.abs(steps * self.n - np.where(over[:, None], 0, self.rest)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
        over |= found > np.uint64(2**63 - 1)
        return np.where(over, np.uint64(0), found).astype(np.int64), over

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def steps_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors remain, and their x as a matrix of longs."""
    fits = pc.equal(pc.list_value_length(column), dimension).fill_null(False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten()
    c = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(len(at), dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        c = np.floor(c * SCALE)
        fine = (np.abs(c) < 2.0**62).all(axis=1)
    return at[fine], c[fine].astype(np.int64) + SHIFT


def _blocks(column: pa.Array, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for start in range(0, len(column), ROWS):
        at, x = steps_of(column.slice(start, ROWS), dimension)
        if len(at):
            yield at + start, x


def _lengths(batch: pa.RecordBatch) -> list[int]:
    return [int(x) for x in pc.unique(pc.list_value_length(batch.column("embedding"))).to_pylist() if x]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and sums of a task's remaining vectors by length and dimension."""
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for d in _lengths(batch):
            for _, x in _blocks(batch.column("embedding"), d):
                n[d] = n.get(d, 0) + len(x)
                small = int(np.abs(x).max()) * len(x) < 2**62
                found = x.sum(axis=0).tolist() if small else [sum(v) for v in x.T.tolist()]
                sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), found, strict=True)]
    rows = [(d, i, n[d], Decimal(s)) for d in n for i, s in enumerate(sums[d])]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["length", "dimension", "n", "total"])


def _products(of, width: int, dimension: int):
    """Sums of products of every two columns of ``of(x)`` over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in _blocks(batch.column("embedding"), dimension):
                y = of(x)
                total += y.T @ y
        if total.any():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    return run


def _moments(vectors: DataFrame, of, width: int, dimension: int) -> np.ndarray:
    """The matrix of summed products; only its ``width^2 / 2`` entries reach the driver."""
    found = vectors.mapInArrow(_products(of, width, dimension), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((width, width))
    for i, j, total in found.collect():
        out[i, j] = out[j, i] = total
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all remaining rows of ``embedding array<float or double>``; None if none remains."""
    vectors = vectors.select("embedding")
    with Scratch(vectors.sparkSession) as scratch:
        sums = vectors.mapInArrow(_sums, "length int, dimension int, n long, total decimal(38,0)")
        sums = scratch.written(sums.groupBy("length", "dimension").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")), "sums")
        first = sums.where("dimension = 0").orderBy(F.desc("n"), F.desc("length")).first()
        if first is None:
            return None
        rows = sums.where(F.col("length") == first["length"]).orderBy("dimension").collect()
    d, n = first["length"], first["n"]
    found = Whitening(n, [int(r["total"]) for r in rows], np.zeros(0), np.zeros((0, d)), 0.0)
    v = _moments(vectors, found.centred, d, d) / n
    pairs = Slices(v).leading(components)
    found.trace = float(np.trace(v))
    found.values = np.array([e for e, _ in pairs])
    found.vectors = np.array([y for _, y in pairs]).reshape(-1, d)
    return found


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(fitted.values)

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.concatenate([fitted.whitened(x), np.ones((len(x), 1))], axis=1)

    moments = _moments(vectors.select("embedding"), with_one, k + 1, fitted.vectors.shape[1]) / fitted.n
    mean = moments[:k, k]
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every remaining row and component."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fitted = fit(vectors, components)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    error, k, d = identity_error(vectors, fitted), len(fitted.values), fitted.vectors.shape[1]
    explained = fitted.values / fitted.trace
    names = [x.split()[0] for x in WHITENED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch.column("embedding"), d):
                m = len(at)
                deviation, over = fitted.deviation(x)
                row = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at[row])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)),
                        pa.array(deviation[row], mask=over[row]), pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names,
                )

    return vectors.mapInArrow(run, WHITENED)
