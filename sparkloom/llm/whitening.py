"""Embedding whitening on a compensated covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import bound_batches

#: Rows of one product of slices, bits of a slice, slices of a value: 2 x BITS + 10 <= 53 keeps every product exact.
BLOCK, BITS, SLICES = 1024, 21, 5
COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its exact rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Double-doubles as ``SLICES`` doubles of ``BITS`` bits each over one common scale, largest first."""
    top = float(np.abs(hi).max(initial=0.0))
    if top == 0.0:
        return [np.zeros_like(hi)]
    step = 2.0 ** (int(np.frexp(top)[1]) - BITS)
    out = []
    for _ in range(SLICES):
        big = 1.5 * 2.0**52 * step
        part = (hi + big) - big
        out.append(part)
        hi, lo = two_sum(hi - part, lo)
        step *= 2.0**-BITS
    return out


def gram(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'X of at most ``BLOCK`` rows of double-doubles, as a double-double.

    An error-free transformation of the product: slices are so short that each
    product of two of them, summed over the block, is exact in doubles; these
    exact parts are added smallest first with compensated sums.
    """
    parts = sliced(hi, lo)
    total = np.zeros((hi.shape[1],) * 2), np.zeros((hi.shape[1],) * 2)
    for order in range(len(parts), -1, -1):
        for i in range(order // 2, -1, -1):
            j = order - i
            if j >= len(parts):
                continue
            exact = parts[i].T @ parts[j]
            total = add(total, (exact, np.zeros_like(exact)))
            if i != j:
                total = add(total, (exact.T, np.zeros_like(exact)))
    return total


@dataclass(frozen=True)
class Centre:
    """The exact mean sums / n, as whole part and double-double rest for each dimension."""

    n: int
    sums: tuple[int, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = [s // self.n for s in self.sums]
        high = [(s % self.n) / self.n for s in self.sums]
        low = [float(Fraction(s % self.n, self.n) - Fraction(h)) for s, h in zip(self.sums, high, strict=True)]
        return np.array(whole, np.int64), np.array(high), np.array(low)


def centred(x: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as double-doubles."""
    whole, high, low = parts
    gap = x - whole
    rough = gap.astype(np.float64)
    hi, lo = two_sum(rough, -high)
    return two_sum(hi, lo + (gap - rough.astype(np.int64)) - low)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def grid(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of rows whose vector is whole and finite; x = floor(64 c) + 1,000,000."""
    c = F.col(vector_col)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("bigint") + SHIFT)
    return embeddings.filter(c.isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(c) > 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _totals(rows: DataFrame, width: int) -> Centre:
    """Exact sums by dimension: one row of sums leaves each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += _matrix(batch.column(0), width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    parts = rows.select("x").mapInArrow(work, "n bigint, sums array<bigint>")
    by_place = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = sorted((r["i"], r["n"], r["s"]) for r in by_place.collect())  # one row a dimension
    return Centre(found[0][1], tuple(s for _, _, s in found))


def covariance_sums(rows: DataFrame, width: int, size: int, values: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of outer products of ``values(x)`` over ``rows(x)``: a ``size`` x ``size`` double-double.

    Each task adds up blocks and sends its high and low parts, one row for each
    line of the matrix; tasks' lines are merged by line, one pair of arrays held
    for each line, and only the merged matrix reaches the driver.
    """
    schema = "i int, hi array<double>, lo array<double>"

    def lines(total: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        kind = pa.list_(pa.float64())
        keys = sorted(total)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array([total[i][p] for i in keys], kind) for p in (0, 1))], names=["i", "hi", "lo"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                total = add(total, gram(*values(x[at : at + BLOCK])))
        yield lines({i: (total[0][i], total[1][i]) for i in range(size)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            hi, lo = (_matrix(batch.column(c), size) for c in (1, 2))
            for r, i in enumerate(batch.column(0).to_pylist()):
                total[i] = add(total[i], (hi[r], lo[r])) if i in total else (hi[r], lo[r])
        yield lines(total)

    merged = rows.select("x").mapInArrow(add_up, schema).repartition("i").mapInArrow(merge, schema)
    found = sorted(merged.collect(), key=lambda r: r["i"])  # ``size`` rows
    return np.array([r["hi"] for r in found]), np.array([r["lo"] for r in found])


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric double-double matrix.

    Reduction to tridiagonal form and divide and conquer on it, as in the
    library's symmetric solver; two steps of refinement in extended precision
    then take the vectors to what the low parts bear out.
    """
    values, vectors = np.linalg.eigh(hi + lo)
    exact = np.longdouble(hi) + np.longdouble(lo)
    x = np.longdouble(vectors)
    for _ in range(2):
        r = np.eye(len(x)) - x.T @ x
        s = x.T @ exact @ x
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        rough = 2 * (np.abs(s - np.diag(e)).max(initial=0) + np.abs(e).max(initial=0) * np.abs(r).max(initial=0))
        apart = np.abs(gap) > rough
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
        values = e
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return np.float64(values[order]), np.float64(x)


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    eigenvalues: np.ndarray
    directions: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        hi, lo = centred(x, self.centre.parts())
        return (hi @ self.directions + lo @ self.directions) / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n x - S, exact; null beyond 64 bits."""
        whole = self.centre.sums
        reach = max(abs(self.centre.n * int(x[:, j].max(initial=0)) - s) + abs(self.centre.n * int(x[:, j].min(initial=0)) - s) for j, s in enumerate(whole)) if len(x) else 0
        if reach * reach * len(whole) < 1 << 63:
            gap = self.centre.n * x - np.array(whole, np.int64)
            return (gap * gap).sum(1).tolist()
        sums = [sum((self.centre.n * int(v) - s) ** 2 for v, s in zip(row, whole, strict=True)) for row in x]
        return [s if s < 1 << 63 else None for s in sums]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From all of ``rows(vec_id, x)``, which share one length; None where there are none."""
    first = rows.limit(1).collect()
    if not first:
        return None
    width = len(first[0]["x"])
    centre = _totals(rows, width)
    parts = centre.parts()
    hi, lo = covariance_sums(rows, width, width, lambda x: centred(x, parts))
    values, vectors = eigen(hi, lo)
    # Directions without spread have no unit variance to be scaled to.
    k = min(components, int((values > values[0] * width * 2.0**-52).sum()) if values[0] > 0 else 0)
    n = centre.n
    return Whitening(centre, values[:k] / n, vectors[:, :k], float(np.trace(hi) + np.trace(lo)) / n)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Fit: exact sums, then centred outer products as double-doubles, then the
    eigenvectors of the covariance; a last pass measures how far the whitened
    rows' covariance is from the identity.  A few D x D matrices are all that
    the driver and a task hold.

    Rows whose vector is null, empty or holds null or non-finite entries are
    left out, and so are vectors that are not of the most frequent length (of
    equally frequent ones the longest).  Null and repeated ids are rows like
    others.  Directions without spread are no components, so equal vectors only,
    or one, or none at all give an empty result.  Other columns are ignored.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = grid(embeddings, id_col, vector_col)
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    rows = rows.filter(F.size("x") == (widths[0]["width"] if widths else -1))
    model = fit(rows, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    k, width = len(model.eigenvalues), len(model.centre.sums)

    def whitened_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = model.whiten(x)
        return y, np.zeros_like(y)

    hi, lo = covariance_sums(rows, width, k, whitened_parts)
    error = float(np.abs((hi + lo) / model.centre.n - np.eye(k)).max())
    explained = model.eigenvalues / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), width)
                owner = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [
                    part.column(0).take(owner),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, model.centre.n)),
                    pa.array(model.deviation(x), pa.int64()).take(owner),
                    pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(work, schema)
