"""Near-duplicate documents by an exact Jaccard join of word-shingle sets, size-aware: light and heavy sets.

Two documents link when intersection / union of their distinct five-word shingles is 0.8 or more. The join returns the
connected groups of these links.

* Equal sets collapse into one node first (64 bits of a digest of the sorted shingles), so exact copies never pair.
* **Light sets** (at most ``boundary`` shingles) enumerate fixed-size subsets: for each partner size the overlap c
  that the threshold asks for is known, and two sets that reach it share a c-subset.
* **Heavy sets** enter inverted lists with a prefix of their shingles, rare ones first: n - ceil(0.8 n) + 1 of them, of
  which linked sets share one. Light sets that may link to heavy ones enter as well.
* The boundary is where enumerating costs more keys than the lists are long (``boundary_by_cost``). Frequencies come from
  a sketch of fixed size (2**22 bucket counts over all documents); any order that is the same everywhere gives exact
  results, the sketch only keeps lists short.
* Per key, members are compared to the smallest node first, then members of different groups with each other
  (``groups_of_keys``), which gives the groups of all links without all pairs of a list. Two members meet only where what
  follows the key in both orders leaves room for the overlap: if it is the first shingle they share, all others come after it.
* Before the exact check, pairs are pruned by parity bitmaps: bits that differ bound the symmetric difference from below.

Results: one row per input row. Null and empty texts have no set and stand alone. Rows with a null id are counted, but
never link (their component is null). Repeated rows get equal rows. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlerank.llm.arrays import mix, parts, slices
from settlerank.llm.groups import groups_of_keys, live_keys
from settlerank.llm.sketches import bucket_counts
from settlerank.session import cut_lineage

WIDTH = 5
#: Jaccard threshold as a fraction.
UP, DOWN = 4, 5
SKETCH_BITS, FILTER_BITS = 22, 22
#: Longs of the short parity bitmap that joins can compare.
FOLDS = 8
LARGEST_LIGHT = 12
_FOLD_COLUMNS = [f"f{k}" for k in range(FOLDS)]


def least_overlap(n: int, m: int) -> int:
    """Shared shingles that two sets of these sizes need: J >= UP / DOWN."""
    return -(-UP * (n + m) // (UP + DOWN))


def partner_sizes(n: int) -> range:
    return range(-(-UP * n // DOWN), DOWN * n // UP + 1)


def prefix_length(n: int) -> int:
    return n - -(-UP * n // DOWN) + 1


def subset_cost(n: int) -> int:
    """Keys that a set of n shingles enumerates."""
    return sum(math.comb(n, c) for m in partner_sizes(n) if (c := least_overlap(n, m)) <= min(n, m))


def boundary_by_cost(list_length: float, largest: int = LARGEST_LIGHT) -> int:
    """Largest size up to which subsets are cheaper than scanning the lists of the prefix."""
    light = 0
    while light < largest and subset_cost(light + 1) <= prefix_length(light + 1) * (1 + list_length):
        light += 1
    return light


def subset_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the subsets of a light set, one family for each pair of sizes."""
    n, keys, values = len(shingles), [], shingles.tolist()
    for m in partner_sizes(n):
        c = least_overlap(n, m)
        if c <= min(n, m):
            low, high = min(n, m), max(n, m)
            chosen = np.array(list(itertools.combinations(values, c)), np.uint64)
            key = np.full(len(chosen), low * 1000003 + high, np.uint64)
            for k in range(c):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
            keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def prefix_keys(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, in one order for all sets: frequency class, then hash."""
    rank = (classes[shingles >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
    return shingles[np.argsort(rank, kind="stable")[:prefix_length(len(shingles))]]


def shingle_sets(column):
    """For each text of an Arrow column: its distinct shingle hashes in order."""
    for part in slices(column, lower=True):
        hashes, at = part.windows(WIDTH)
        cuts = np.searchsorted(at, part.first_word)
        counts = part.n_words()
        for i in range(part.n):
            if counts[i] >= WIDTH:
                yield np.unique(hashes[cuts[i]:cuts[i + 1]])
            elif counts[i]:
                whole = np.uint64(counts[i])
                for w in part.words[part.first_word[i]:part.first_word[i + 1]]:
                    whole = mix(np.array([whole], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of B buckets, B the power of two at least as large as the set (64 at least)."""
    size = 64
    while size < len(shingles):
        size *= 2
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1,
                       bitorder="little").tobytes()


def folded(shingles: np.ndarray) -> np.ndarray:
    """The same in FOLDS longs, whatever the size of the set."""
    bits = np.bincount((shingles & np.uint64(64 * FOLDS - 1)).astype(np.int64), minlength=64 * FOLDS).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def may_link(a: bytes, b: bytes, total: int) -> bool:
    """Whether the bits that differ leave room for a link of sets with ``total`` shingles together."""
    if len(a) < len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint8).reshape(-1, len(b))
    x = np.bitwise_xor.reduce(x, axis=0) ^ np.frombuffer(b, np.uint8)
    return (UP + DOWN) * int(np.bitwise_count(x).sum()) <= (DOWN - UP) * total


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * shared >= UP * (len(a) + len(b) - shared) and shared > 0


def _may_link(x: dict, y: dict):
    """The sizes fit, and the parity bitmaps leave room for a link."""
    differ = sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in _FOLD_COLUMNS), F.lit(0))
    return (DOWN * F.least(x["n"], y["n"]) >= UP * F.greatest(x["n"], y["n"])) \
        & ((UP + DOWN) * differ <= (DOWN - UP) * (x["n"] + y["n"]))


def _may_meet(x: dict, y: dict):
    """Whether sets whose first common shingle is at places ``at`` of their prefixes can link: none before it is in both."""
    most = F.least(x["n"] - F.greatest(x["at"], F.lit(0)), y["n"] - F.greatest(y["at"], F.lit(0)))
    return (DOWN * F.least(x["n"], y["n"]) >= UP * F.greatest(x["n"], y["n"])) & ((UP + DOWN) * most >= UP * (x["n"] + y["n"]))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))


def _sets(rows: DataFrame) -> DataFrame:
    """Per row: id, size, node and bitmap of its set."""
    def measure(batches):
        for batch in parts(batches):
            n, nodes, maps, folds = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                maps.append(bitmap(s) if len(s) else None)
                folds.append(folded(s))
            folds = np.array(folds, np.int64).reshape(-1, FOLDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                                              pa.array(maps, pa.binary()),
                                              *(pa.array(folds[:, k]) for k in range(FOLDS))],
                                             ["_id", "n", "node", "bits", *_FOLD_COLUMNS])
    return rows.mapInArrow(measure, "_id long, n long, node long, bits binary, "
                           + ", ".join(f"{c} long" for c in _FOLD_COLUMNS))


def _frequency_classes(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The class (four to a doubling of the bucket count) of each bucket, and the mean length of a posting's list."""
    def buckets(batch):
        for part in parts([batch]):
            found = [s >> np.uint64(64 - SKETCH_BITS) for s in shingle_sets(part.column(1))]
            yield np.concatenate(found) if found else np.zeros(0, np.uint64)
    counts = bucket_counts(rows, buckets, SKETCH_BITS)
    total = float(counts.sum())
    mean = float((counts.astype(np.float64) ** 2).sum() / total) if total else 0.0
    return np.floor(4 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8), mean


def _postings(rows: DataFrame, classes: np.ndarray, light: int) -> DataFrame:
    """(key, node, at) of every row: subsets of light sets, prefixes of heavy ones and of those that may meet them.

    ``at`` is the place in the prefix, -1 for a subset.
    """
    shared = rows.sparkSession.sparkContext.broadcast(classes)      # 2**SKETCH_BITS bytes, whatever the input
    meets = -(-UP * (light + 1) // DOWN)

    def emit(batches):
        for batch in parts(batches):
            keys, nodes, places = [], [], []
            for s in shingle_sets(batch.column(1)):
                own, at = [], []
                if 0 < len(s) <= light:
                    own.append(subset_keys(s))
                    at.append(np.full(len(own[0]), -1, np.int32))
                if len(s) > light or len(s) >= meets and len(s):
                    own.append(prefix_keys(s, shared.value))
                    at.append(np.arange(len(own[-1]), dtype=np.int32))
                if own:
                    own = np.concatenate(own)
                    keys.append(own)
                    places += at
                    nodes.append(np.full(len(own), node_of(s), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places))],
                    ["key", "node", "at"])

    return rows.filter(F.col("_id").isNotNull()).mapInArrow(emit, "key long, node long, at int")


def _verify(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that link. ``nodes``: node, _id (of one text with that set), n, bits."""
    maps = nodes.select("node", "n", "bits")
    left = maps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = maps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def prune(batches):
        for batch in batches:
            keep = [DOWN * min(n, m) >= UP * max(n, m) and may_link(x, y, n + m)
                    for x, y, n, m in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb", "na", "nb")
                         .mapInArrow(prune, "a long, b long"), "likely-pairs")
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct().join(nodes, "node") \
        .select(F.col("_id").alias("_rep"), "node")
    wanted = cut_lineage(wanted, "wanted-sets")
    # texts that no pair asks for stay where they are: a filter of fixed size goes ahead of the exact join
    seen = bucket_counts(wanted.select("_rep"), lambda b: [_filter_place(b.column(0))], FILTER_BITS) > 0
    passed = rows.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def read(batches):
        bits = np.unpackbits(passed.value)
        for batch in parts(batches):
            batch = batch.filter(pa.array(bits[_filter_place(batch.column(0).fill_null(0))].astype(bool)))
            sets = list(shingle_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["_rep", "node", "shingles"])

    sets = rows.mapInArrow(read, "_rep long, node long, shingles binary").join(wanted, ["_rep", "node"]) \
        .drop("_rep").dropDuplicates(["node"])
    sets = cut_lineage(sets, "sets")

    def check(batches):
        for batch in parts(batches, 256):
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (likely.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def _filter_place(ids) -> np.ndarray:
    return (mix(np.asarray(ids.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64))
            >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (smallest id that links lead to) of every row."""
    rows = _texts(docs, id_col, text_col)
    sets = cut_lineage(_sets(rows), "shingle-sets")
    nodes = sets.filter(F.col("node").isNotNull() & F.col("_id").isNotNull()).groupBy("node").agg(
        F.min("_id").alias("_id"), F.min("n").alias("n"), F.first("bits").alias("bits"), *[F.min(c).alias(c) for c in _FOLD_COLUMNS])
    nodes = cut_lineage(nodes, "nodes")
    classes, list_length = _frequency_classes(rows)
    light = boundary_by_cost(list_length)

    live = live_keys(_postings(rows, classes, light))
    groups = groups_of_keys(live, lambda pairs: _verify(pairs, nodes, rows), nodes.select("node", "n", *_FOLD_COLUMNS), _may_link,
                            quick_test=_may_meet, order="at")
    named = groups.join(nodes.select("node", "_id"), "node").groupBy("root").agg(F.min("_id").alias("component"))
    named = groups.join(named, "root").select("node", "component")
    of_node = nodes.select("node", F.col("_id").alias("least_id")).join(named, "node", "left") \
        .select("node", F.coalesce("component", "least_id").alias("component"))
    of_node = cut_lineage(of_node, "components")        # so that AQE can split a set with very many rows in the last join
    return sets.select("_id", "n", "node").join(of_node, "node", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")).alias("component_id"))
