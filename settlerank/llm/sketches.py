"""Arrays of a fixed size that tasks fill and Spark adds up."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_PIECES = 64


def _add(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if piece not in sums:
                sums[piece] = np.zeros(size // _PIECES, np.uint64)
            sums[piece] += np.frombuffer(zlib.decompress(data), np.uint64)
    yield _pieces(sums)


def _pieces(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    salt = np.random.default_rng().integers(0, 1 << 16)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([int(salt)] * len(sums), pa.int32()),
         pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["piece", "salt", "data"])


def bucket_counts(rows: DataFrame, buckets: Callable, bits: int) -> np.ndarray:
    """How often each of 2**bits buckets occurs, as ``buckets(batch)`` yields them in arrays.

    Each task adds up its rows first; its array then moves in 64 pieces. Pieces are added in two steps, the first
    spread by a random salt over as many tasks as the session shuffles with, always as a stream. The driver gets the 64
    sums, a size that does not depend on the input.
    """
    size, schema = 1 << bits, "piece int, salt int, data binary"

    def fill(batches):
        sums = np.zeros(size, np.uint64)
        for batch in batches:
            for found in buckets(batch):
                found = found.astype(np.int64)
                if len(found) > size // 8:
                    sums += np.bincount(found, minlength=size).astype(np.uint64)
                else:
                    at, n = np.unique(found, return_counts=True)
                    sums[at] += n.astype(np.uint64)
        step = size // _PIECES
        yield _pieces({k: sums[k * step:(k + 1) * step] for k in range(_PIECES) if sums[k * step:(k + 1) * step].any()})

    def add(batches):
        return _add(batches, size)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = rows.mapInArrow(fill, schema)
    first = filled.repartition(n, F.col("piece"), F.col("salt") % 16).mapInArrow(add, schema)
    out = np.zeros(size, np.uint64)
    for row in first.repartition(_PIECES, "piece").mapInArrow(add, schema).collect():
        step = size // _PIECES
        out[row["piece"] * step:(row["piece"] + 1) * step] += np.frombuffer(zlib.decompress(row["data"]), np.uint64)
    return out
