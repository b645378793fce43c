"""Whitening of embeddings: the leading principal components of all vectors, scaled to unit variance.

1. Entries become whole numbers, ``floor(scale * c) + offset``; the fit list is each distinct vector once.
2. Sums are exact (whole numbers). The covariance is added up over centred rows, in every task by itself; the tasks' matrices are
   added row by row, in two steps, and the driver gets one d x d matrix, whatever the number of rows.
3. On that matrix: Householder reflections make it tridiagonal, Sturm counts bisect for the leading eigenvalues, inverse iteration
   finds their vectors, and vectors of close eigenvalues are made orthogonal to each other again.
4. Mean and components (d numbers and d x 16) are sent to all tasks, which project their rows.

Defined results: rows whose vector is null, empty, or holds a null or an entry that is not finite are dropped; if vectors of several lengths
occur, those of the most frequent length stay (of equally frequent ones the longest). Entries beyond the range of a long are held at its ends. Null and
repeated ids stay as they are. Components whose variance is below ``LEAST_SHARE`` of the whole cannot be scaled and are left
out, so equal vectors or a single one give no rows, nor does an empty table. A ``deviation`` beyond the range of a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlerank.llm.arrays import parts
from settlerank.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LEAST_SHARE = 1e-11
_LONG = 1 << 63
_ROWS = 4096


# -- eigenvalues and eigenvectors of one symmetric matrix ------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix. Reflector k acts on the entries from k + 1 on."""
    a = np.array(matrix, dtype=float)
    size, reflectors = len(a), []
    for k in range(size - 2):
        column = a[k + 1:, k].copy()
        length = np.linalg.norm(column)
        reflector = np.zeros_like(column)
        if np.any(column[1:]):
            reflector = column
            reflector[0] += np.copysign(length, column[0])
            reflector /= np.linalg.norm(reflector)
            rest = a[k + 1:, k + 1:]
            moved = 2.0 * (rest @ reflector)
            moved -= (reflector @ moved) * reflector
            rest -= np.outer(reflector, moved) + np.outer(moved, reflector)
            a[k + 1, k] = a[k, k + 1] = -np.copysign(length, column[0])
            a[k + 2:, k] = a[k, k + 2:] = 0.0
        reflectors.append(reflector)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative pivots of a Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = np.ones_like(points)
    below = np.zeros(len(points), int)
    for k in range(len(diagonal)):
        pivot = diagonal[k] - points - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues in falling order, by bisection of all of them at once."""
    size = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    slack = np.finfo(float).eps * max(1e-300, float(np.max(np.abs(diagonal) + reach)))
    low = np.full(count, np.min(diagonal - reach) - slack)
    high = np.full(count, np.max(diagonal + reach) + slack)
    wanted = size - 1 - np.arange(count)                       # so many eigenvalues lie below the one looked for
    for _ in range(2000):
        middle = 0.5 * (low + high)
        if np.all((middle <= low) | (middle >= high)):
            break
        above = count_below(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return 0.5 * (low + high)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """Solves (T - shift) y = b by elimination with row exchanges; pivots stay at ``least`` or more."""
    size = len(diagonal)
    main, above, above2 = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    factors, swapped = np.zeros(size), np.zeros(size, bool)
    below = off.copy()
    for k in range(size - 1):
        if abs(below[k]) > abs(main[k]):
            swapped[k] = True
            factors[k] = main[k] / below[k]
            next_main, next_above = above[k] - factors[k] * main[k + 1], -factors[k] * above[k + 1]
            main[k], above[k], above2[k] = below[k], main[k + 1], above[k + 1]
            main[k + 1], above[k + 1] = next_main, next_above
        else:
            if abs(main[k]) < least:
                main[k] = np.copysign(least, main[k])
            factors[k] = below[k] / main[k]
            main[k + 1] -= factors[k] * above[k]
    if abs(main[-1]) < least:
        main[-1] = np.copysign(least, main[-1])

    def solve(right: np.ndarray) -> np.ndarray:
        b = right.copy()
        for k in range(size - 1):
            if swapped[k]:
                b[k], b[k + 1] = b[k + 1], b[k] - factors[k] * b[k + 1]
            else:
                b[k + 1] -= factors[k] * b[k]
        for k in range(size - 1, -1, -1):
            if k + 1 < size:
                b[k] -= above[k] * b[k + 1]
            if k + 2 < size:
                b[k] -= above2[k] * b[k + 2]
            b[k] /= main[k]
            if abs(b[k]) > 1e200:                              # only the direction matters
                b /= abs(b[k])
        return b
    return solve


def leading_eigenvectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix in falling order and their unit vectors, in columns.

    The first entry that is largest in size is positive. Vectors whose eigenvalues lie within a thousandth of the matrix's norm
    of their neighbour form a cluster and are made orthogonal to each other in every step of the iteration.
    """
    size = len(matrix)
    count = min(count, size)
    scale = float(np.max(np.abs(matrix))) if size else 0.0
    if not scale:
        return np.zeros(count), np.eye(size)[:, :count]
    diagonal, off, reflectors = tridiagonal(np.asarray(matrix, float) / scale)
    values = leading_eigenvalues(diagonal, off, count)
    norm = float(np.max(np.abs(diagonal) + np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))))
    eps, random, vectors, first = np.finfo(float).eps, np.random.default_rng(7), np.zeros((size, count)), 0
    shift = np.inf
    for at, value in enumerate(values):
        if at and values[at - 1] - value > 1e-3 * norm:
            first = at
        # equal eigenvalues get shifts a little apart, so that their iterations differ
        shift = min(value, shift - 10 * eps * norm) if at > first else value
        solve, vector = _solver(diagonal, off, shift, eps * norm), random.standard_normal(size)
        cluster = vectors[:, first:at]
        for step in range(12):
            vector = solve(vector / np.linalg.norm(vector))
            grown = np.linalg.norm(vector)
            vector /= grown
            for _ in range(2):
                vector -= cluster @ (cluster.T @ vector)
                vector /= np.linalg.norm(vector)
            if step >= 3 and grown > 0.01 / (eps * norm * size):
                break
        vectors[:, at] = vector
    for k in range(len(reflectors) - 1, -1, -1):
        vectors[k + 1:] -= 2.0 * np.outer(reflectors[k], reflectors[k] @ vectors[k + 1:])
    for at in range(count):                                    # what rounding left of earlier vectors
        vectors[:, at] -= vectors[:, :at] @ (vectors[:, :at].T @ vectors[:, at])
        vectors[:, at] /= np.linalg.norm(vectors[:, at])
    largest = np.argmax(np.abs(vectors) > np.max(np.abs(vectors), axis=0) * (1 - 1e-9), axis=0)
    return values * scale, vectors * np.where(vectors[largest, np.arange(count)] < 0, -1.0, 1.0)


# -- vectors of whole numbers ----------------------------------------------------------------------------------

def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a sound vector, their lengths, and all entries of those rows one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()).astype(np.int64)
    start, end = column.offsets[0].as_py(), column.offsets[-1].as_py()
    entries = column.values.slice(start, end - start)
    sound = np.asarray(column.is_valid()) & (lengths > 0)
    values = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) > 0
    sound &= ~bad
    return sound, lengths, values[sound[row]]


def whole_numbers(values: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    with np.errstate(over="ignore"):
        low = np.floor(values * float(scale))
    edge = float(_LONG - 2 * offset)
    return np.clip(low, -edge, edge).astype(np.int64) + offset


def _packed(batch: pa.RecordBatch, at: int, length: int | None, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of the wanted length and their whole-number vectors."""
    sound, lengths, values = _vectors(batch.column(at))
    places = np.flatnonzero(sound)
    fits = lengths[places] == length
    row_fits = np.repeat(fits, lengths[places])
    return places[fits], whole_numbers(values[row_fits], scale, offset).reshape(-1, length)


def vector_length(rows: DataFrame, vector_col: str) -> int | None:
    """The most frequent length of a sound vector."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    sizes = rows.filter((F.size(vector) > 0) & finite).groupBy(F.size(vector).alias("s")).agg(F.count("*").alias("c"))
    best = sizes.agg(F.max(F.struct("c", "s"))).first()[0]
    return best and best["s"]


def fit_list(rows: DataFrame, vector_col: str, length: int, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """x: every distinct whole-number vector once, as little-endian longs. Equal ones are dropped before the shuffle already."""
    def pack(batches):
        for batch in parts(batches, _ROWS):
            _, x = _packed(batch, 0, length, scale, offset)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * length), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary())], ["x"])
    return rows.select(F.col(f"`{vector_col}`")).mapInArrow(pack, "x binary").distinct()


def _unpacked(batches, length: int):
    for batch in parts(batches, _ROWS):
        column = batch.column(0)
        if batch.num_rows:
            data = np.frombuffer(b"".join(column.to_pylist()), np.int64)
            yield data.reshape(-1, length)


def exact_sums(fit: DataFrame, length: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, as Python integers. Each task sends one row for a dimension."""
    def add(batches):
        n, sums = 0, [0] * length
        for x in _unpacked(batches, length):
            # halves of 32 bits cannot overflow in a part of 4096 rows
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            n, sums = n + len(x), [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                                          pa.array([str(s) for s in sums])], ["dim", "n", "total"])
    added = (fit.mapInArrow(add, "dim int, n long, total string").groupBy("dim")
             .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    if not added:
        return 0, [0] * length
    return int(added[0]["n"]), [int(r["total"]) for r in sorted(added, key=lambda r: r["dim"])]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding; Python integers where longs could overflow."""
    most = max((int(np.abs(x).max()) if x.size else 0) * n, max(map(abs, sums), default=0))
    if most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def sum_of_products(rows: DataFrame, products, size: int) -> np.ndarray:
    """The sum over all tasks of the size x size matrices that ``products(batch)`` yields.

    Every task sends its own sum as one array a matrix row; the arrays are added in two steps, the first of them salted, so that
    no task gets more than a share of the tasks' arrays. The driver gets one matrix.
    """
    schema = "line int, salt int, data binary"

    def lines(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        salt = int(np.random.default_rng().integers(0, 1 << 16))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([salt] * len(sums), pa.int32()),
                                           pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["line", "salt", "data"])

    def fill(batches):
        total = np.zeros((size, size))
        for found in products(batches):
            total += found
        yield lines(dict(enumerate(total)))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[line] = sums.get(line, 0.0) + np.frombuffer(data)
        yield lines(sums)

    filled = rows.mapInArrow(fill, schema)
    first = filled.repartition(F.col("line"), F.col("salt") % 64).mapInArrow(add, schema)
    out = np.zeros((size, size))
    for row in first.repartition("line").mapInArrow(add, schema).collect():
        out[row["line"]] += np.frombuffer(row["data"])
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; its size does not depend on the number of rows."""
    n: int
    sums: list[int]
    components: np.ndarray                 #: d x k, unit columns
    variances: np.ndarray                  #: k, falling
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = _deviations(x, self.n, self.sums).astype(float) / self.n
        return (centred @ self.components) / np.sqrt(self.variances)


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
        offset: int = OFFSET) -> Whitening | None:
    """The whitening of a table's distinct vectors; None without a sound vector."""
    length = vector_length(rows, vector_col)
    if length is None:
        return None
    distinct = cut_lineage(fit_list(rows, vector_col, length, scale, offset), "fit-list")
    n, sums = exact_sums(distinct, length)

    def centred(batches):
        for x in _unpacked(batches, length):
            c = _deviations(x, n, sums).astype(float) / n
            yield c.T @ c
    covariance = sum_of_products(distinct, centred, length) / n
    covariance = 0.5 * (covariance + covariance.T)
    values, vectors = leading_eigenvectors(covariance, components)
    trace = float(np.trace(covariance))
    kept = int(np.sum(values > LEAST_SHARE * trace)) if trace > 0 else 0
    model = Whitening(n, sums, vectors[:, :kept], values[:kept], trace, 0.0)
    if not kept:
        return model

    def whitened(batches):
        for x in _unpacked(batches, length):
            w = model.project(x)
            yield w.T @ w
    error = sum_of_products(distinct, whitened, kept) / n - np.eye(kept)
    return Whitening(n, sums, model.components, model.variances, trace, float(np.max(np.abs(error))))


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each sound row and component."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[id_col]
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    sent, length, k = spark.sparkContext.broadcast(model), len(model.sums), len(model.variances)

    def project(batches):
        m = sent.value
        share = m.variances / m.trace
        for batch in parts(batches, _ROWS):
            places, x = _packed(batch, 1, length, scale, offset)
            apart = _deviations(x, m.n, m.sums)
            if apart.dtype != object and (not apart.size or int(np.abs(apart).max()) ** 2 * length < _LONG):
                squares = pa.array((apart * apart).sum(axis=1), pa.int64())
            else:
                squares = (apart.astype(object) ** 2).sum(axis=1)
                squares = pa.array([int(s) if s < _LONG else None for s in squares], pa.int64())
            values, count = m.project(x), len(places)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()),
                 pa.array(np.full(count * k, m.n), pa.int64()), squares.take(pa.array(np.repeat(np.arange(count), k))),
                 pa.array(values.ravel()), pa.array(np.tile(share, count)), pa.array(np.full(count * k, m.identity_error))],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    picked = rows.select(rows[id_col].alias("_id"), F.col(f"`{vector_col}`"))
    return picked.mapInArrow(project, schema).withColumnRenamed("_id", id_col)
