"""Embedding whitening (operator 13): leading eigenvectors of the covariance by spectrum slicing.

The covariance is summed by Spark; its size is that of the vectors' dimensions alone. LDL^T inertia counts of the
shifted covariance tell how many eigenvalues lie above a shift: they isolate each leading eigenvalue by bisection,
Rayleigh quotient iteration converges to it, and counts just below and above certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

EPS = np.finfo(np.float64).eps
LONG = 2**63 - 1


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, negative and zero eigenvalues of a symmetric matrix, from the pivots of its LDL^T
    factorisation with symmetric pivoting by 1x1 and 2x2 blocks (Bunch-Kaufman's choice)."""
    a = np.array(a, dtype=np.float64)
    alpha = (1 + np.sqrt(17)) / 8
    tiny = EPS * max(1e-300, np.abs(a).max(initial=0.0)) * 1e-3
    plus = minus = zero = 0
    while len(a):
        n = len(a)
        below = np.abs(a[1:, 0])
        r = 1 + int(below.argmax()) if n > 1 else 0
        most = below[r - 1] if n > 1 else 0.0
        size = 1
        if max(abs(a[0, 0]), most) <= tiny:
            zero += 1
            a = a[1:, 1:]
            continue
        if n > 1 and abs(a[0, 0]) < alpha * most:
            row = np.abs(a[r])
            row[r] = 0.0
            second = row.max()
            if abs(a[0, 0]) * second >= alpha * most * most:
                pass
            elif abs(a[r, r]) >= alpha * second:
                a[[0, r]] = a[[r, 0]]
                a[:, [0, r]] = a[:, [r, 0]]
            else:
                size = 2
                if r != 1:
                    a[[1, r]] = a[[r, 1]]
                    a[:, [1, r]] = a[:, [r, 1]]
        if size == 1:
            plus, minus = plus + (a[0, 0] > 0), minus + (a[0, 0] < 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / a[0, 0])
        else:
            plus, minus = plus + 1, minus + 1  # such a block is indefinite
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return int(plus), int(minus), int(zero)


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[0]


@dataclass
class Component:
    value: float
    vector: np.ndarray
    certified: bool  # counts just below and above the value agree with its number


def leading(v: np.ndarray, k: int) -> list[Component]:
    """The ``k`` leading eigenpairs (fewer if ``v`` is smaller) of a symmetric matrix, by falling value.

    Vectors are unit and orthogonal; the entry of largest absolute value is positive. Values that no count tells apart
    (closer than about 1e-13 of the largest) share an eigenspace; its vectors are some orthonormal basis.
    """
    v = np.array(v, dtype=np.float64)
    d, k = len(v), min(k, len(v))
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if scale == 0.0:
        return [Component(0.0, np.eye(d)[:, i], True) for i in range(k)]
    unit = v / scale  # all eigenvalues in [-1, 1]
    tol = 64 * EPS * max(4, np.sqrt(d))
    counts = {-1.0 - tol: d, 1.0 + tol: 0}

    def count(x: float) -> int:
        if x not in counts:
            counts[x] = above(unit, x)
        return counts[x]

    out: list[Component] = []
    for number in range(1, k + 1):
        low = max(x for x, c in counts.items() if c >= number)
        high = min(x for x, c in counts.items() if c < number and x > low)
        found = None
        while found is None:
            # isolate: one eigenvalue in (low, high), or several that are as good as equal
            while count(low) - count(high) > 1 and high - low > tol:
                middle = (low + high) / 2
                if count(middle) >= number:
                    low = middle
                else:
                    high = middle
            close = high - low <= tol
            value, vector = _rayleigh(unit, (low + high) / 2, [c.vector for c in out], number)
            if close or low < value < high or abs(value - low) <= tol or abs(value - high) <= tol:
                ok = count(value - tol) >= number > count(value + tol)
                if ok or close:
                    found = Component(value * scale, vector, ok)
                    break
            # the iteration went to another eigenvalue: narrow further
            middle = (low + high) / 2
            if count(middle) >= number:
                low = middle
            else:
                high = middle
        found.vector = found.vector * np.sign(found.vector[np.abs(found.vector).argmax()])
        out.append(found)
    return out


def _rayleigh(a: np.ndarray, shift: float, known: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """Eigenpair near ``shift``: inverse iteration at the shift, then Rayleigh quotient iteration, kept orthogonal to ``known``."""
    basis = np.array(known).T if known else np.empty((len(a), 0))

    def clean(x):
        for _ in range(2):
            x = x / np.abs(x).max()
            x = x - basis @ (basis.T @ x)
            x = x / np.linalg.norm(x)
        return x

    def solve(at, x):
        for nudge in (0.0, EPS, 64 * EPS, 4096 * EPS):
            try:
                y = np.linalg.solve(a - (at + nudge) * np.eye(len(a)), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.linalg.norm(y) > 0:
                return y
        return x

    x = clean(np.random.default_rng(seed).standard_normal(len(a)))
    for _ in range(4):
        x = clean(solve(shift, x))
    best = (np.inf, 0.0, x)
    for _ in range(12):
        value = float(x @ a @ x)
        residual = float(np.linalg.norm(a @ x - value * x))
        if residual >= best[0] / 2:  # no further
            if residual < best[0]:
                best = (residual, value, x)
            break
        best = (residual, value, x)
        x = clean(solve(value, x))
    return best[1], best[2]


@dataclass
class Whitening:
    """What is fitted for vectors of one dimension: centre and components, and their exact sums."""

    n: int
    sums: list[int]
    components: list[Component]
    trace: float

    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        """Centre, and one column per component: vector / sqrt(value); NaN where the variance is zero."""
        floor = EPS * len(self.sums) * max(self.trace, 0.0)
        cols = [c.vector / np.sqrt(c.value) if c.value > floor else np.full(len(self.sums), np.nan) for c in self.components]
        return np.array([s / self.n for s in self.sums]), np.array(cols).reshape(len(cols), len(self.sums)).T


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", factor: int = 256) -> DataFrame:
    """``key``, ``dim`` and ``x``: floor(factor * entry) as little-endian integers of the row's least width (2, 4, 8 bytes).

    Rows whose vector is null or holds a null or non-finite entry are dropped; entries beyond a long are its ends.
    """
    small_batches(vectors.sparkSession, 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            ends = col.offsets.to_numpy().astype(np.int64)
            values = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries: NaN
            keep, dims, xs = [], [], []
            for i, there in enumerate(col.is_valid().to_pylist()):
                c = values[ends[i]:ends[i + 1]]
                if not there or not np.isfinite(c).all():
                    continue
                with np.errstate(over="ignore"):
                    f = np.floor(factor * c)
                big = np.abs(f).max(initial=0.0)
                if big < 2**62:
                    x = f.astype(np.int64).astype("<i2" if big < 2**15 else "<i4" if big < 2**31 else "<i8")
                else:
                    x = np.array([min(LONG, max(-LONG - 1, int(e) if np.isfinite(e) else (LONG if e > 0 else -LONG - 1))) for e in f.tolist()], dtype="<i8")
                keep.append(i)
                dims.append(len(c))
                xs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(xs, pa.binary())], names=[key, "dim", "x"])

    cols = vectors.select(key, F.col(column).cast("array<double>").alias("_v"))
    return cols.mapInArrow(run, T.StructType([cols.schema.fields[0], T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())]))


def _groups(batch: pa.RecordBatch, dim: int, x: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, int64 matrix) for each dimension and width in a batch."""
    dims = batch.column(dim).to_numpy(zero_copy_only=False)
    col = batch.column(x).to_pylist()
    sizes = np.fromiter(map(len, col), dtype=np.int64, count=len(col))
    for d, size in sorted(set(zip(dims.tolist(), sizes.tolist()))):
        rows = np.flatnonzero((dims == d) & (sizes == size))
        if d:
            yield d, rows, np.frombuffer(b"".join(col[i] for i in rows.tolist()), dtype=f"<i{size // d}").reshape(len(rows), d).astype(np.int64)
        else:
            yield 0, rows, np.empty((len(rows), 0), dtype=np.int64)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums of the entries, per dimension: one row per entry of a vector reaches the driver."""
    wide = T.DecimalType(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal
        n, total = {}, {}
        for batch in batches:
            for d, rows, x in _groups(batch, 0, 1):
                safe = not len(x) or int(np.abs(x).max(initial=0)) < 2**62 // max(1, len(x)) and x.min(initial=0) > -LONG
                s = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
                n[d], total[d] = n.get(d, 0) + len(rows), total.get(d, np.zeros(d, dtype=object)) + s
        for d in n:
            if d:
                yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()),
                                                  pa.array([decimal.Decimal(int(s)) for s in total[d]], pa.decimal128(38, 0))], names=["dim", "i", "n", "s"])

    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", wide)])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in fit.mapInArrow(run, schema).groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim", "i").collect():
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _covariances(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance per dimension, divisor n; rows are centred before they are multiplied.

    A task sends the rows of its part of the product; the parts of a row meet in one group and are added in the tasks'
    order. The driver gets one row per entry of a vector.
    """
    means = {d: np.array([s / n for s in total]) for d, (n, total) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, scatter = TaskContext.get().partitionId(), {}
        for batch in batches:
            for d, _, x in _groups(batch, 0, 1):
                if d:
                    c = x - means[d]
                    scatter[d] = scatter.get(d, 0.0) + c.T @ c
        for d, m in scatter.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()),
                                              pa.array([row.tobytes() for row in m], pa.binary())], names=["dim", "i", "part", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done():
            return pa.RecordBatch.from_pydict({"dim": pa.array([key[0]], pa.int32()), "i": pa.array([key[1]], pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})

        for batch in batches:
            for d, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (d, i) != key:
                    if key is not None:
                        yield done()
                    key, total = (d, i), np.zeros(d)
                total = total + np.frombuffer(row)
        if key is not None:
            yield done()

    ints = [T.StructField(c, T.IntegerType()) for c in ("dim", "i", "part")]
    parts = fit.mapInArrow(run, T.StructType([*ints, T.StructField("row", T.BinaryType())]))
    rows = parts.repartition("dim", "i").sortWithinPartitions("dim", "i", "part").mapInArrow(add, T.StructType([*ints[:2], T.StructField("row", T.BinaryType())]))
    out = {d: np.zeros((d, d)) for d in sums}
    for r in rows.toLocalIterator():
        out[r["dim"]][r["i"]] = np.frombuffer(r["row"])
    return {d: (m + m.T) / 2 / sums[d][0] for d, m in out.items()}


def _project(fits: dict[int, Whitening], k: int, dim: int, x: int):
    """Function from a batch to per row the whitened entries (rows x k, NaN where there is none)."""
    projections = {d: w.projection() for d, w in fits.items()}

    def run(batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((batch.num_rows, k), np.nan)
        for d, rows, m in _groups(batch, dim, x):
            if d:
                centre, columns = projections[d]
                out[rows, :columns.shape[1]] = (m - centre) @ columns
        return out

    return run


def fit_whitening(rows: DataFrame, k: int = 4) -> tuple[dict[int, Whitening], dict[int, float]]:
    """Fit on the distinct vectors of ``quantised`` rows, per dimension; also the largest absolute entry of the whitened
    fit list's covariance minus the identity, over the components that have a variance."""
    fit = materialize(rows.select("dim", "x").distinct(), "whitening-fit")
    sums = _sums(fit)
    if not sums:
        return {}, {}
    fits = {}
    for d, v in _covariances(fit, sums).items():
        fits[d] = Whitening(*sums[d], leading(v, k), float(np.trace(v)))
        if not all(c.certified for c in fits[d].components):
            raise ArithmeticError(f"inertia counts do not confirm the numbering of the components in dimension {d}")
    project = _project(fits, k, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = project(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(z[:, c]) for c in range(k)]], names=["dim", *[f"z{c}" for c in range(k)]])

    z = fit.mapInArrow(run, T.StructType([T.StructField("dim", T.IntegerType()), *[T.StructField(f"z{c}", T.DoubleType()) for c in range(k)]]))
    both = [(a, b) for a in range(k) for b in range(a, k)]
    errors = {}
    for r in z.groupBy("dim").agg(*[F.covar_pop(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a, b in both]).collect():
        found = [abs(r[f"c{a}_{b}"] - (a == b)) for a, b in both if np.isfinite(r[f"c{a}_{b}"])]
        if found:
            errors[r["dim"]] = float(max(found))
    return fits, errors


def whiten(vectors: DataFrame, k: int = 4, key: str = "vec_id", column: str = "embedding", factor: int = 256) -> DataFrame:
    """Whitened leading components of every vector: ``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    The covariance is that of the distinct vectors floor(factor * c), so copies weigh once; vectors of different
    dimensions are fitted apart. ``n``: vectors fitted on; ``deviation``: exact sum over the entries of (n * x - S)^2, S
    being the entries' sums, null beyond a long; ``explained``: the component's share of the trace, null if that is
    zero; ``whitened``: null where a component has no variance. A vector of d < k entries has d components. Dropped are
    rows with a null vector or a null, infinite or NaN entry; repeated rows and null keys stay; other columns are not
    read; an empty table gives no rows.
    """
    rows = quantised(vectors, key, column, factor)
    fits, errors = fit_whitening(rows, k)
    project = _project(fits, k, 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = project(batch)
            deviation: list[int | None] = [None] * batch.num_rows
            for d, at, x in _groups(batch, 1, 2):
                if d:
                    n, total = fits[d].n, fits[d].sums
                    most = n * int(np.abs(x.astype(np.float64)).max(initial=0.0)) + max(map(abs, total))
                    t = n * (x if most < 2**62 else x.astype(object)) - np.array(total, dtype=np.int64 if most < 2**62 else object)
                    if most * most * d >= 2**63:
                        t = t.astype(object)
                    for i, s in zip(at.tolist(), (t * t).sum(axis=1).tolist()):
                        deviation[i] = int(s) if s <= LONG else None
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            parts = []
            for c in range(k):
                has = np.flatnonzero(dims > c)
                if not len(has):
                    continue
                share = [(fits[d].components[c].value / fits[d].trace if fits[d].trace > 0 else None) for d in dims[has].tolist()]
                white = z[has, c]
                parts.append(pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(has)), pa.array(np.full(len(has), c + 1, dtype=np.int32)), pa.array([fits[d].n for d in dims[has].tolist()], pa.int64()),
                     pa.array([deviation[i] for i in has.tolist()], pa.int64()), pa.array(white, mask=np.isnan(white)), pa.array(share, pa.float64()),
                     pa.array([errors.get(d) for d in dims[has].tolist()], pa.float64())], names=names))
            yield from parts

    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [rows.schema.fields[0].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))
