"""Approximate nearest neighbours: random-hyperplane tables with query-directed probes.

A table has ``bits`` random hyperplanes; the signs of a vector on them are its bucket. Two vectors agree in one sign with
a chance of 1 - angle / 180, so near ones share buckets. A training row is in one bucket of every table; a query also probes the
buckets that its smallest margins could flip it to, cheapest first. The bits grow with the logarithm of the training rows, so
that a bucket holds about ``bucket_rows`` of them whatever their number, and the pairs compared grow in proportion to the
queries.

How many probes a recall takes depends on how near the neighbours are; ``tuned_probes`` finds it on a bounded sample of
queries, whose exact neighbours it looks up first. Buckets that hold far more rows than meant (clusters of near copies) are split by
as many further hyperplanes as it takes; a query is compared with its own part of such a bucket only. What queries and rows meet is compared exactly, in chunks of bounded size.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlerank.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of the package

#: Margins that probes choose flips from.
_FLIPPED = 10
#: Further hyperplanes of a table for crowded buckets.
_DEEP_BITS = 24
_DEPTHS = (3, 6, 12, _DEEP_BITS)
#: Numbers of a batch's margins or probe costs.
_CELLS = 1 << 20
#: What a query's copy for one more bucket costs, in comparisons.
_COPY = 128


def matrix(column: pd.Series, dtype) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    rows = column.to_numpy()
    return np.array(rows.tolist(), dtype=dtype).reshape(len(rows), -1) if len(rows) else np.empty((0, 0), dtype=dtype)


@dataclass(frozen=True)
class Hyperplanes:
    tables: int = 8
    bits: int = 8
    probes: int = 4
    bucket_rows: int = 64
    crowded: int = 16               # times bucket_rows at which a bucket is split
    seed: int = 42

    def for_rows(self, rows: int) -> "Hyperplanes":
        return replace(self, bits=int(min(32, max(0, round(np.log2(max(1, rows) / self.bucket_rows))))))

    @cached_property
    def _width(self) -> int:
        return self.bits + _DEEP_BITS

    def projections(self, codes: np.ndarray, numbers: np.ndarray, space) -> np.ndarray:
        """Rows x tables x (bits and deep bits): the side and margin of every vector on every hyperplane."""
        columns = self.tables * self._width
        planes = np.random.default_rng(self.seed).standard_normal((numbers.shape[1], columns))
        out = np.sqrt(space.num_weight) * (numbers @ planes)
        for j in range(codes.shape[1]):                              # a category is one of many orthogonal axes
            values, at = np.unique(codes[:, j].astype(str), return_inverse=True)
            axes = np.array([self._axis(j, v, columns) for v in values])
            out += np.sqrt(space.cat_weight / codes.shape[1]) * axes[at]
        return out.reshape(len(out), self.tables, self._width)

    def _axis(self, column: int, value: str, columns: int) -> np.ndarray:
        digest = hashlib.md5(f"{self.seed}|{column}|{value}".encode()).digest()
        return np.random.default_rng(int.from_bytes(digest, "big")).standard_normal(columns)

    def buckets(self, projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x tables: the bucket, and the deep bits."""
        signs = (projected > 0).astype(np.int64)
        return signs[..., :self.bits] @ (1 << np.arange(self.bits, dtype=np.int64)), signs[..., self.bits:] @ (1 << np.arange(_DEEP_BITS, dtype=np.int64))

    def probed(self, projected: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Rows x tables x probes: the buckets of a query, cheapest first. A bucket costs the squares of the margins that it flips."""
        probes = min(probes or self.probes, 1 << min(self.bits, _FLIPPED))
        own, _ = self.buckets(projected)
        margins = np.abs(projected[..., :self.bits])
        near = np.argsort(margins, axis=-1, kind="stable")[..., :_FLIPPED]
        flips = (np.arange(1 << near.shape[-1])[:, None] >> np.arange(near.shape[-1])) & 1
        cost = np.square(np.take_along_axis(margins, near, axis=-1)) @ flips.T
        order = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
        masks = np.einsum("pb,rtb->rtp", flips, np.int64(1) << near.astype(np.int64)) if near.shape[-1] else np.zeros((*own.shape, 1), np.int64)
        return own[..., None] ^ np.take_along_axis(masks, order, axis=-1)

    def keyed(self, vectors: DataFrame, space, probing: bool) -> DataFrame:
        """The rows once for each of their buckets: ``table``, ``bucket``, ``deep``."""
        names = vectors.columns
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tried = self.tables * max(1 << min(self.bits, _FLIPPED), self._width) if probing else self.tables * self._width
            step = max(1, min(2048, _CELLS // tried))        # a batch of any number of probes stays bounded
            for whole in batches:
                for start in range(0, len(whole), step):
                    batch = whole.iloc[start:start + step]
                    projected = self.projections(matrix(batch["codes"], object), matrix(batch["numbers"], float), space)
                    own, deep = self.buckets(projected)
                    found = self.probed(projected) if probing else own[..., None]
                    n, tables, probes = found.shape
                    rows = batch.iloc[np.repeat(np.arange(n), tables * probes)].reset_index(drop=True)
                    yield rows.assign(table=np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), n), bucket=found.ravel(),
                                      deep=np.repeat(deep.ravel(), probes))[[*names, "table", "bucket", "deep"]]

        return vectors.mapInPandas(run, f"{schema}, table int, bucket long, deep long")


def _named(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
    """``grp`` becomes group, table, bucket and as many deep bits as the bucket is split by."""
    keys = ["grp", "table", "bucket"]
    split = keyed.join(crowded, keys, "left").withColumn("more", F.coalesce("more", F.lit(0)))
    part = F.col("deep").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more")) - 1)
    return split.withColumn("grp", F.concat_ws("|", "grp", "table", "bucket", "more", part)).drop("table", "bucket", "deep", "more")


def meeting_rows(points: DataFrame, reps: DataFrame, space, planes: Hyperplanes) -> tuple[DataFrame, DataFrame]:
    """Queries and training rows keyed by bucket in ``grp``; rows of equal ``grp`` are to be compared."""
    known = cut_lineage(planes.keyed(reps, space, probing=False), "lsh-rows")
    asked = cut_lineage(planes.keyed(points, space, probing=True), "lsh-queries")
    most, keys = planes.bucket_rows * planes.crowded, ["grp", "table", "bucket"]
    large = known.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys)
    depths = [F.struct(F.lit(d).alias("more"), F.col("deep").bitwiseAND(F.lit((1 << d) - 1)).alias("part")) for d in _DEPTHS]
    tried = known.join(large, keys, "left_semi").select(*keys, F.explode(F.array(*depths)).alias("d")).select(*keys, "d.more", "d.part")
    fullest = tried.groupBy(*keys, "more", "part").agg(F.count("*").alias("n")).groupBy(*keys, "more").agg(F.max("n").alias("n"))
    enough = F.coalesce(F.min(F.when(F.col("n") <= most, F.col("more"))), F.lit(_DEEP_BITS))
    crowded = cut_lineage(fullest.groupBy(*keys).agg(enough.alias("more")), "lsh-crowded")
    return _named(asked, crowded), _named(known, crowded)


def compared_pairs(asked: DataFrame, known: DataFrame) -> int:
    """How many (query, row) pairs the buckets bring together, repeated ones included."""
    a, b = (df.groupBy("grp").agg(F.count("*").alias(n)) for df, n in ((asked, "a"), (known, "b")))
    return a.join(b, "grp").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def tuned_probes(queries: DataFrame, train: DataFrame, k: int, space, planes: Hyperplanes, recall: float = 0.95,
                 sample: int = 200, group: str | None = None, rows: int | None = None) -> Hyperplanes:
    """The planes with the least probes that find ``recall`` of the k nearest of at most ``sample`` queries.

    The sample is the queries with the smallest md5 of their id; their exact neighbours are looked up among all rows. At most
    sample * k pairs of vectors come to the driver. The most probes are 2 ** min(bits, 10), which with up to ten bits is every bucket.

    With ``rows`` (training rows of a group) bits and tables may also be fewer, whichever reaches the recall with the least work:
    a copy of a query for each bucket that it probes, and the rows of these buckets. Where neighbours are so far that nearly
    all buckets would be probed, that ends at one bucket of all rows instead of a copy of every query for every bucket.
    """
    from settlerank.operators.knn import nearest
    some = cut_lineage(queries.orderBy(F.md5("node_id"), "node_id").limit(sample), "lsh-sample")
    near = nearest(some, train, k, space, group).select("node_id", "neighbour_id").distinct()
    pairs = near.join(some.select("node_id", F.col("codes").alias("qc"), F.col("numbers").alias("qn")).dropDuplicates(["node_id"]),
                      "node_id").join(train.select(F.col("node_id").alias("neighbour_id"), "codes", "numbers"), "neighbour_id") \
        .dropDuplicates(["node_id", "neighbour_id"]).toPandas()
    if not len(pairs):
        return planes
    sides = [(matrix(pairs[c], object), matrix(pairs[n], float)) for c, n in (("qc", "qn"), ("codes", "numbers"))]

    def first_meeting(tried: Hyperplanes) -> np.ndarray:
        """Pairs x tables: the probes before the pair meets."""
        known, _ = tried.buckets(tried.projections(*sides[1], space))
        first = []
        for start in range(0, len(pairs), 256):
            met = tried.probed(tried.projections(*(x[start:start + 256] for x in sides[0]), space), 1 << min(tried.bits, _FLIPPED)) \
                == known[start:start + 256, :, None]
            first.append(np.where(met.any(axis=-1), met.argmax(axis=-1), met.shape[-1]))
        return np.concatenate(first)

    options = []
    for bits in range(planes.bits, -1, -1) if rows is not None else [planes.bits]:
        tried = replace(planes, bits=bits)
        first, most = first_meeting(tried), 1 << min(bits, _FLIPPED)
        for tables in ([t for t in (planes.tables, planes.tables // 2, planes.tables // 4, 1) if t] if rows is not None else [planes.tables]):
            met = np.sort(first[:, :tables].min(axis=1))
            needed = int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) + 1
            held = max(planes.bucket_rows, -(-(rows or 0) // (1 << bits)))
            found = replace(tried, tables=tables, probes=min(needed, most), bucket_rows=held)
            options.append((needed > most, tables * found.probes * (held + _COPY), len(options), found))
    return min(options, key=lambda o: o[:3])[-1]


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, wanted (exact neighbours), hits, recall. A found row as similar as the last exact one is a hit too."""
    last = exact.groupBy("node_id").agg(F.min("similarity").alias("last"), F.count("*").alias("n"))
    good = found.groupBy("node_id").agg(F.collect_list("similarity").alias("got"))
    each = last.join(good, "node_id", "left").select("n", F.least(F.col("n"), F.coalesce(
        F.size(F.filter("got", lambda s: s >= F.col("last"))), F.lit(0))).alias("hits"))
    return each.agg(F.count("*").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("wanted"),
                    F.coalesce(F.sum("hits"), F.lit(0)).alias("hits")).withColumn("recall", F.try_divide("hits", "wanted"))
