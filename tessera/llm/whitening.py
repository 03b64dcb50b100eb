"""PCA whitening of embeddings with eigenvectors refined in mixed precision.

Sums and cross products are whole numbers: vectors are moved by a whole number near
their mean before they are multiplied, and what that leaves of the mean is taken off
exactly. So the covariance has no rounding at all, and does not depend on the order of
tasks or on a task run twice.

Its eigenvectors start as those of LAPACK in float32. Each Ogita-Aishima step corrects
all of them by matrix products in extended precision, at quadratic speed. Eigenvalues
that lie closer together than a step can tell apart are first separated by an eigenproblem
of their own: the covariance, shifted by their middle and projected on their span.

Tasks send d(d+1)/2 sums each (d: dimensions), added up by Spark; only these sums and the
eigenvectors reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 64, 1_000_000
#: Beyond this a scaled entry is no exact whole number of a double any more.
LARGEST = float(2**53)
WIDE = np.longdouble


def usable(embeddings: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and holds only finite entries (of a
    size below 2^47, so that the scaled entry is an exact whole number)."""
    ok = F.forall(vec_col, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < F.lit(LARGEST), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(0.0))))
    return embeddings.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(ok)


def _scaled(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers x of the vectors of ``dims`` entries, and which rows these are."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = lengths == dims
    values = flat[np.repeat(rows, lengths)].reshape(-1, dims)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET, rows


def _list_array(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))


def _means(vectors: DataFrame, vec_col: str) -> tuple[int, list[int]]:
    """The commonest length's number of vectors and sums per dimension. Of lengths
    equally common the larger one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            column = _list_array(batch.column(0))
            for dims in set(np.diff(column.offsets.to_numpy()).tolist()):
                x, _ = _scaled(column, dims)
                count[dims] = count.get(dims, 0) + len(x)
                total[dims] = total.get(dims, 0) + x.sum(axis=0).astype(object)
        rows = [(d, -1, n) for d, n in count.items()] + [(d, j, int(v)) for d, t in total.items() for j, v in enumerate(t)]
        yield _sums_batch(rows)

    sums = _summed(vectors.select(vec_col).mapInArrow(run, "i int, j int, v decimal(38,0)"))
    top = sums.where("j = -1").orderBy(F.desc("v"), F.desc("i")).first()
    if top is None:
        return 0, []
    rows = sums.where((F.col("i") == top["i"]) & (F.col("j") >= 0)).orderBy("j").collect()  # one row a dimension
    return int(top["v"]), [int(r["v"]) for r in rows]


def _sums_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, v = list(zip(*rows)) or [(), (), ()]
    values = pa.array([Decimal(x) for x in v], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "v"])


def _products(z: np.ndarray) -> np.ndarray:
    """Exact z'z of whole numbers: float64 products of blocks whose sums stay below 2^53
    are exact; larger entries are multiplied as Python integers."""
    most = int(np.abs(z).max(initial=0)) ** 2
    if most >= 2**52:
        big = z.astype(object)
        return big.T @ big
    block = min(len(z), max(1, 2**52 // max(most, 1)))
    total = np.zeros((z.shape[1],) * 2, object)
    for k in range(0, len(z), block or 1):
        part = z[k:k + block].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def covariance(vectors: DataFrame, n: int, sums: list[int], vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The exact covariance times n^2 (whole numbers), and the middle that was taken off:
    ``n * sum(z z') - sum(z) sum(z)'`` with z = x - middle."""
    dims = len(sums)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            x, _ = _scaled(_list_array(batch.column(0)), dims)
            if len(x):
                total = total + _products(x - middle)
        upper = [(i, j, int(total[i, j])) for i in range(dims) for j in range(i, dims) if total[i, j]]
        yield _sums_batch(upper)

    found = _summed(vectors.select(vec_col).mapInArrow(run, "i int, j int, v decimal(38,0)")).collect()  # d(d+1)/2 at most
    products = np.zeros((dims, dims), object)
    for r in found:
        products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["v"])
    left = np.array([s - n * int(m) for s, m in zip(sums, middle)], object)
    return n * products - np.outer(left, left), middle


def refine(a: np.ndarray, x: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric ``a`` (extended
    precision) from approximate ones ``x``, by Ogita-Aishima steps.

    A step with R = I - X'X and S = X'AX takes X to X + X E, where E_ij is
    (S_ij + v_j R_ij) / (v_j - v_i), or R_ij / 2 where two eigenvalues v are closer than
    the step's own error bound. Vectors of such a cluster are orthonormal after the
    step but mixed; the eigenvectors of (X_c)'(A - m I)X_c unmix them.
    """
    a, x = a.astype(WIDE), x.astype(WIDE)
    dims, eye = len(a), np.eye(len(a), dtype=WIDE)
    size = np.sqrt((a * a).sum())
    if not size:
        return np.zeros(dims, WIDE), eye
    tiny = 4 * dims * np.finfo(WIDE).eps
    change = np.inf
    for step in range(steps):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2  # so that rounding in s turns vectors, but does not stretch them
        v = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(v)
        bound = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = v[None, :] - v[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + v[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(v)[::-1]
        x, v = x[:, order], v[order]
        for lo, hi in _clusters(v, bound):
            x[:, lo:hi] = _separate(a, x[:, lo:hi])
        before, change = change, np.abs(e).max()
        if change < tiny or (step >= 5 and change >= before / 2):
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    v = ((a @ x) * x).sum(axis=0)
    order = np.argsort(-v, kind="stable")
    return v[order], x[:, order]


def _clusters(falling: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Runs of two or more eigenvalues whose neighbours are within ``bound``."""
    cuts = [0, *(np.flatnonzero(falling[:-1] - falling[1:] > bound) + 1).tolist(), len(falling)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1]


def _separate(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cluster's vectors ``x`` turned into eigenvectors of its own small problem: its
    entries are differences from the middle eigenvalue, so float64 tells them apart."""
    x = _orthonormal(x)
    inner = x.T @ (a @ x)
    small = inner - np.eye(len(inner), dtype=WIDE) * (np.trace(inner) / len(inner))
    scale = np.abs(small).max()
    if not scale:
        return x
    turn = np.linalg.eigh((small / scale).astype(np.float64))[1].astype(WIDE)
    return x @ _orthonormal(turn[:, ::-1])


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """``x (x'x)^(-1/2)`` of nearly orthonormal columns, by the series near I."""
    for _ in range(2):
        x = x + x @ ((np.eye(x.shape[1], dtype=WIDE) - x.T @ x) / 2)
    return x


@dataclass
class Whitening:
    n: int
    sums: list[int]
    middle: np.ndarray
    rest: np.ndarray  # S/n - middle
    vectors: np.ndarray  # d x components
    values: np.ndarray  # eigenvalues
    explained: np.ndarray
    floor: float  # eigenvalues up to this are rounding

    def whiten(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.middle).astype(np.float64) - self.rest
        scale = np.where(self.values > self.floor, self.values, np.inf)
        return (centred @ self.vectors) / np.sqrt(scale)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null where it does not fit a long."""
        z = x - self.middle
        left = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.middle)], object)
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, left), default=0)
        if most * most * len(self.sums) < 2**63:
            return ((self.n * z - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
        whole = ((self.n * z.astype(object) - left) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in whole]


def fit(vectors: DataFrame, components: int = 32, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of ``usable`` vectors; None if there are none."""
    n, sums = _means(vectors, vec_col)
    if not n:
        return None
    scaled, middle = covariance(vectors, n, sums, vec_col)
    cov = np.array([[_wide(int(c), n * n) for c in row] for row in scaled])
    start = np.linalg.eigh(cov.astype(np.float32))[1]
    values, found = refine(cov, start)
    k, trace = min(components, len(sums)), np.trace(cov)
    explained = np.where(trace > 0, values[:k] / np.where(trace > 0, trace, 1), 0)
    rest = np.array([float(_wide(s - n * int(m), n)) for s, m in zip(sums, middle)])
    return Whitening(n, sums, middle, rest, found[:, :k].astype(np.float64), values[:k].astype(np.float64),
                     explained.astype(np.float64), float(values[0]) * len(sums) * 2.0**-52)


def _wide(whole: int, divisor: int) -> np.longdouble:
    """``whole / divisor`` to the last bit of extended precision, or nearly."""
    q, r = divmod(whole, divisor)
    high = q >> 53 << 53
    return WIDE(float(high)) + WIDE(q - high) + WIDE(r / divisor)


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest entry of |covariance of the whitened vectors - identity|, over the
    components that have variance, measured on all vectors."""
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))  # products, and sums in the last row
        for batch in batches:
            x, _ = _scaled(_list_array(batch.column(0)), dims)
            y = model.whiten(x)
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total))], names=["i", "row"])

    parts = vectors.select(vec_col).mapInArrow(run, "i int, row array<double>")
    found = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # (k+1) k
    total = np.zeros((k + 1, k))
    for r in found:
        total[r["i"], r["j"]] = r["v"] / model.n
    error = np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k))
    live = model.values > model.floor
    return float(error[np.ix_(live, live)].max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` for each
    vector that takes part and each component up to ``components`` or the dimensions.

    Dropped: vectors that are null, empty, hold a null, non-finite or (above 2^47) huge
    entry, or have another length than the commonest one (of equals the larger). Repeated
    rows and null ids count and return like others. A component without variance (one
    vector, equal vectors, constant dimensions) cannot be whitened: null, explained 0, and
    left out of ``identity_error``. A deviation that does not fit a long is null. Other
    columns are not read. No vector: no row.
    """
    vectors = usable(embeddings.select(id_col, vec_col), vec_col)
    schema = T.StructType([T.StructField(id_col, embeddings.schema[id_col].dataType), *T.DataType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    model = fit(vectors, components, vec_col)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, dims, k = identity_error(vectors, model, vec_col), len(model.sums), len(model.values)
    live = model.values > model.floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _scaled(_list_array(batch.column(1)), dims)
            each = np.repeat(np.arange(len(x)), k)
            count = len(each)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).filter(pa.array(rows)).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(count, model.n, np.int64)),
                pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(model.whiten(x).ravel(), mask=np.tile(~live, len(x))),
                pa.array(np.tile(np.where(live, model.explained, 0.0), len(x))),
                pa.array(np.full(count, error)),
            ], names=schema.names)

    return vectors.mapInArrow(run, schema)
