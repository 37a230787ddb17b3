"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers (``floor(scale * c)``), so equal vectors are equal bytes, sums are exact and
the rows are centred without loss. The fit list (each distinct vector once) is stored as blocks of rows.
With A the centred rows over the square root of their number, each step is one pass over the blocks: a
task multiplies its rows with the current right vector v (A v), and that product with its rows (A' A v).
The driver holds only the right vectors and, for each left vector u, the combination of columns that it is
(u = A w), so a task gets its part of every earlier u by one matrix product, nothing as long as the table
is stored, and a lost executor's part is computed again from the blocks. Both sides are reorthogonalised in
full against all earlier vectors. A' A is never formed.

The steps end when the wanted singular values of the small bidiagonal matrix have no residual at double
precision and the variance outside the right vectors is below the last wanted eigenvalue, so no repeated
eigenvalue is missed; or when the vectors span the space. When a direction is used up, a new one
orthogonal to all others goes on. There are at most as many passes as dimensions.

Cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; so are rows of
another length than the most frequent one (ties: the shorter). Whole numbers beyond 2**52 are held at that
bound. Repeated rows and ids each get their rows. Components of zero variance (below 1e-13 of the first)
are not returned, so equal vectors only, one vector, or an empty table give no rows. A deviation beyond 64
bits is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import settle, sized_parts

_BOUND = 1 << 52
_ENTRIES = 1 << 19  # of a block or a slice
_EPS = float(np.finfo(np.float64).eps)
CODED = "vec_id long, x binary"
_CODED = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])
_BLOCK = pa.schema([("width", pa.int32()), ("x", pa.binary())])


# Vectors as whole numbers ------------------------------------------------------------------------
def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def _encode(size: int, scale: float):
    """Rows as whole numbers of 2, 4 or 8 bytes, the fewest that hold the row: equal rows are equal bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _ENTRIES // size)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                x = np.clip(x, -_BOUND, _BOUND).astype(np.int64)
                most = np.abs(x).max(axis=1)
                rows = [r.astype("<i2" if m < 1 << 15 else "<i4" if m < 1 << 31 else "<i8").tobytes() for r, m in zip(x, most.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], schema=_CODED)
    return run


def _matrix(rows: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(rows), size), dtype=np.int64)
    widths = np.array([len(r) // size for r in rows])
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(rows[k] for k in at), dtype=f"<i{w}").reshape(len(at), size)
    return out


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _ENTRIES // size)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                rows = whole.column(0).slice(at, step).to_pylist()
                width = max(map(len, rows)) // size
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([_matrix(rows, size).astype(f"<i{width}").tobytes()], pa.binary())], schema=_BLOCK)
    return run


# Passes over the blocks --------------------------------------------------------------------------
@dataclass(frozen=True)
class FitList:
    """The distinct vectors: blocks of rows, their number and exact sums by dimension."""
    blocks: DataFrame
    size: int
    tasks: int
    n: int = 0
    sums: tuple[int, ...] = ()

    def total(self, part: Callable[[np.ndarray], np.ndarray], dtype: str) -> np.ndarray:
        """Sum of ``part`` over all blocks: one row per task, in two levels where there are many tasks."""
        size = self.size

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = None
            for batch in batches:
                for width, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    new = part(np.frombuffer(x.as_buffer(), dtype=f"<i{width}").reshape(-1, size))
                    acc = new if acc is None else acc + new
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([acc.astype(dtype).tobytes()], pa.binary())], ["part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for batch in batches for x in batch.column(0)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], ["part"])

        parts = self.blocks.mapInArrow(local, "part binary")
        if self.tasks > 64:
            parts = parts.repartition(isqrt(self.tasks)).mapInArrow(add, "part binary")
        rows = [np.frombuffer(r.part, dtype=dtype) for r in parts.collect()]  # at most 64, or the root of the tasks
        return np.sum(rows, axis=0)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows less their mean, rounded once: the whole part of the mean is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.float64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return lambda x: (x.astype(np.float64) - whole) - rest


def _counts(x: np.ndarray) -> np.ndarray:
    """Rows, and sums by dimension in two halves, so that adding up never overflows."""
    sums = x.sum(axis=0, dtype=np.int64)
    return np.concatenate([[len(x)], sums >> 31, sums & ((1 << 31) - 1)])


def fit_list(coded: DataFrame, size: int, task_bytes: int = 4 << 20) -> FitList:
    blocks = settle(coded.select("x").distinct().mapInArrow(_pack(size), "width int, x binary"))
    stored = blocks.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    fit = FitList(blocks.repartition(sized_parts(stored, task_bytes)), size, sized_parts(stored, task_bytes))
    if not stored:
        return fit
    fit = FitList(settle(fit.blocks), size, fit.tasks)
    found = fit.total(_counts, "<i8").tolist()
    sums = [(hi << 31) + lo for hi, lo in zip(found[1:size + 1], found[size + 1:])]
    return FitList(fit.blocks, size, fit.tasks, found[0], tuple(sums))


# Bidiagonalisation -------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a unit row each
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int


def _products(fit: FitList, v: np.ndarray, combos: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """One pass: (all variance, |A v|**2, U'A v for the earlier left vectors, A'A v)."""
    centre, n, known = fit.centre(), fit.n, len(combos)

    def part(x: np.ndarray) -> np.ndarray:
        c = centre(x)
        u = c @ v
        return np.concatenate([[np.einsum("ij,ij->", c, c), u @ u], (c @ combos.T).T @ u, u @ c])

    out = fit.total(part, "<f8") / n
    return float(out[0]), float(out[1]), out[2:2 + known], out[2 + known:]


def _fresh(right: list[np.ndarray], size: int, rng: np.random.Generator) -> np.ndarray:
    """A unit vector orthogonal to all right vectors."""
    return _orthogonal(rng.standard_normal(size), right)[0]


def _orthogonal(r: np.ndarray, right: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The part of ``r`` outside the span of the right vectors, as a unit vector, and its length."""
    if right:
        basis = np.array(right)
        for _ in range(2):
            r = r - basis.T @ (basis @ r)
    length = float(np.linalg.norm(r))
    return (r / length if length else r), length


def bidiagonalise(fit: FitList, wanted: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(components, eigenvalues, all variance, steps) of the fit list's covariance."""
    size, rng = fit.size, np.random.default_rng(11)
    right: list[np.ndarray] = []
    combos, images = np.empty((0, size)), np.empty((0, size))  # u = A w as rows w, and A'u
    diagonal: list[float] = []
    above: list[float] = []
    v = _fresh(right, size, rng)
    while True:
        trace, length, shares, image = _products(fit, v, combos)
        tiny = 8 * _EPS * size * np.sqrt(trace)
        alpha = np.sqrt(max(length - float(shares @ shares), 0.0))
        if alpha <= tiny:  # A v adds no direction
            alpha, w, back = 0.0, np.zeros(size), np.zeros(size)
        else:
            w, back = (v - shares @ combos) / alpha, (image - shares @ images) / alpha
        right.append(v)
        diagonal.append(alpha)
        combos, images = np.vstack([combos, w]), np.vstack([images, back])
        steps = len(right)
        direction, beta = _orthogonal(back - alpha * v, right)
        matrix = np.diag(diagonal) + np.diag(above, 1)
        left, values, turned = np.linalg.svd(matrix)
        take = min(wanted, steps)
        outside = trace - float((matrix ** 2).sum())
        last = values[take - 1] ** 2 if steps >= wanted else 0.0
        exact = np.abs(beta * left[-1, :take]).max() <= 4 * _EPS * values[0]
        if steps == size or outside <= tiny ** 2 or (exact and outside < last * (1 - 1e-9)):
            return turned[:take] @ np.array(right), values[:take] ** 2, trace, steps
        above.append(beta if beta > tiny else 0.0)
        v = direction if beta > tiny else _fresh(right, size, rng)


def fit_model(fit: FitList, wanted: int) -> Model | None:
    """The leading components, or None where the fit list has no variance."""
    if fit.n < 2:
        return None
    components, values, trace, steps = bidiagonalise(fit, wanted)
    keep = values > 1e-13 * max(values[0], 0.0)
    components, values = components[keep], values[keep]
    if not len(values):
        return None
    centre, scaled = fit.centre(), (components / np.sqrt(values)[:, None]).T
    mean = fit.total(lambda x: (centre(x) @ scaled).sum(axis=0), "<f8") / fit.n

    def spread(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ scaled - mean
        return (z.T @ z).ravel()

    covariance = (fit.total(spread, "<f8") / fit.n).reshape(len(values), -1)
    return Model(fit.n, fit.sums, components, values, values / trace, float(np.abs(covariance - np.eye(len(values))).max()), steps)


# Whitened rows -----------------------------------------------------------------------------------
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                       ("explained", pa.float64()), ("identity_error", pa.float64())])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum of (n * x - sum)**2 over the dimensions of each row."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    off = x - whole
    most = n * (int(np.abs(off).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 63:
        d = n * off - rest
        return (d * d).sum(axis=1).tolist()
    exact = (int(v) for v in ((n * off.astype(object) - rest) ** 2).sum(axis=1))
    return [v if v < 1 << 63 else None for v in exact]


def _whiten(fit: FitList, model: Model):
    centre = FitList(None, fit.size, 0, fit.n, fit.sums).centre()
    size, scaled, k = fit.size, (model.components / np.sqrt(model.variances)[:, None]).T, len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _ENTRIES // (size + k))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x, rows = _matrix(batch.column(1).to_pylist(), size), batch.num_rows
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array((centre(x) @ scaled).ravel()),
                    pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, model.identity_error))], schema=_WHITENED)
    return run


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    rows = vectors.select(vectors[f"`{vec_id}`"].cast("long").alias("vec_id"), vectors[f"`{vector}`"].cast("array<double>").alias("v")).where(usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "size").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    coded = settle(rows.where(F.size("v") == common["size"]).mapInArrow(_encode(common["size"], scale), CODED))
    fit = fit_list(coded, common["size"])
    model = fit_model(fit, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    return coded.mapInArrow(_whiten(fit, model), WHITENED)
