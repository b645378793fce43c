"""Exact nearest neighbours by cosine similarity, as partitioned Spark work.

The similarity of two nodes is the cosine of (sqrt(w_cat) * one-hot categories, sqrt(w_num) * unit numbers),
so 1 - cosine is half the squared Euclidean distance and the triangle inequality holds. That gives an exact
pruned join:

1. Equal vectors collapse to one profile. Only the k smallest ids of a training profile can be among
   anyone's k nearest, so heavily copied profiles cost one row with k ids, and equal queries are answered once.
2. Rows with categories are searched inside equal combinations of categories first. Fewer equal categories bound the
   similarity from above, so a query whose k results beat the bound is done; only the others look further.
3. Large groups are cut into cells around pivots, in number as the square root of the group. With ``reach`` = the farthest
   query of the cell from its pivot and ``kth`` = the k-th smallest training distance from that pivot, every query of the
   cell has k neighbours within ``reach + kth``; training rows farther than ``2 * reach + kth`` from the pivot
   cannot matter to it and are not sent.
4. Cells are cut into tiles of bounded size on both sides, at least a chunk and ``tile`` rows long. A task compares one query tile
   with one training tile, a bounded product at a time, and returns at most k rows per query; the parts are merged by rank.
   A row travels once for each tile of the other side, so tiles grow with a cell until they are full. Small groups share tasks.

Similarities are rounded to nine digits before ranking, so that the order of summation cannot move a tie; ties
go to the smaller id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlerank.operators.lsh import Hyperplanes, matrix, meeting_rows, tuned_probes
from settlerank.operators.ranking import top_k
from settlerank.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of the package

SLACK = 1e-6
DIGITS = 9
#: Rows of one product in a task, queries and training rows.
_PRODUCT = (256, 16384)
#: A cell is cut into about this many tiles a side before tiles grow beyond ``tile``, up to so many numbers each.
_TILES, _TILE_NUMBERS = 16, 1 << 22


@dataclass(frozen=True)
class CosineSpace:
    cat_weight: float = 0.65
    num_weight: float = 0.35

    def similarity(self, a: "Block", b: "Block") -> np.ndarray:
        """All similarities of two blocks whose category codes share one numbering."""
        width = a.codes.shape[1]
        base = self.cat_weight if width else 0.0
        sizes = np.maximum(a.codes.max(axis=0, initial=-1), b.codes.max(axis=0, initial=-1)) + 1
        if width and sizes.sum() <= 256:        # few categories: one product of one-hot and number columns
            left, right = (np.hstack([x.one_hot(sizes, np.sqrt(base / width)), np.sqrt(self.num_weight) * x.numbers])
                           for x in (a, b))
            out = left @ right.T
        else:
            out = self.num_weight * (a.numbers @ b.numbers.T)
            for j in range(width):
                out += (base / width) * (a.codes[:, j][:, None] == b.codes[:, j][None, :])
        out *= self.inverse_length(a, base)[:, None]
        out *= self.inverse_length(b, base)[None, :]
        return out

    def inverse_length(self, block: "Block", base: float) -> np.ndarray:
        length = self.length(block, base)
        return np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)

    def length(self, block: "Block", base: float) -> np.ndarray:
        return np.sqrt(base + self.num_weight * (np.square(block.numbers).sum(axis=1) > 0))

    def distance(self, a: "Block", b: "Block") -> np.ndarray:
        base = self.cat_weight if a.codes.shape[1] else 0.0
        ones = np.add.outer((self.length(a, base) > 0) * 1.0, (self.length(b, base) > 0) * 1.0)
        return np.sqrt(np.maximum(ones - 2.0 * self.similarity(a, b), 0.0))


@dataclass
class Block:
    codes: np.ndarray       # numbered categories
    numbers: np.ndarray

    @classmethod
    def of(cls, *frames: pd.DataFrame) -> list["Block"]:
        """Blocks of several frames with one common numbering of each category column."""
        codes = [matrix(f["codes"], object) for f in frames]
        width, ends = codes[0].shape[1], np.cumsum([len(f) for f in frames])
        both = np.concatenate([c.reshape(len(f), width) for c, f in zip(codes, frames)])
        coded = np.empty(both.shape, dtype=np.int64)
        for j in range(width):
            coded[:, j] = pd.factorize(both[:, j])[0]
        parts = np.split(coded, ends[:-1])
        return [cls(c, matrix(f["numbers"], float)) for c, f in zip(parts, frames)]

    def rows(self, start: int, stop: int) -> "Block":
        return Block(self.codes[start:stop], self.numbers[start:stop])

    def one_hot(self, sizes: np.ndarray, value: float) -> np.ndarray:
        out = np.zeros((len(self.codes), int(sizes.sum())))
        for j, start in enumerate(np.cumsum(sizes) - sizes):
            out[np.arange(len(out)), start + self.codes[:, j]] = value
        return out


def best_in_block(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest rounded values per row; equal values go to the smaller column.

    Everything within one rounding step of the k-th value is kept until it has been rounded.
    """
    n = sims.shape[1]
    floor = np.partition(sims, n - k, axis=1)[:, n - k] if n > k else np.full(len(sims), -np.inf)
    rows, cols = np.nonzero(sims >= floor[:, None] - 10.0 ** -DIGITS)
    values = np.round(sims[rows, cols], DIGITS)
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[kept], cols[kept], values[kept]


def _best_of(rows: np.ndarray, keys: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row, equal ones by key, in that order."""
    order = np.lexsort((keys, -values, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k]


def _best_ids(space: CosineSpace, queries: Block, train: Block, ids: np.ndarray, k: int,
              more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(row, id, value) of the k best ids per query, where a training row stands for the sorted ids of its profile.

    ``more`` has a number for each of the ids, which comes along. The k best rows hold the k best ids, since a row that is ahead has an id ahead of all ids of the next.
    """
    parts = []
    for start in range(0, len(ids), _PRODUCT[1]):
        rows, cols, values = best_in_block(space.similarity(queries, train.rows(start, start + _PRODUCT[1])), k)
        parts.append((rows, start + cols, values))
    rows, cols, values = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:
        kept = _best_of(rows, cols, values, k)
        rows, cols, values = rows[kept], cols[kept], values[kept]
    counts = np.array([len(ids[c]) for c in cols], dtype=int)
    names = np.array([i for c in cols for i in ids[c]], dtype=object)
    carried = None if more is None else np.array([x for c in cols for x in more[c]], dtype=float)
    if counts.max(initial=1) > 1:
        rows, values = np.repeat(rows, counts), np.repeat(values, counts)
        kept = _best_of(rows, np.unique(names.astype(str), return_inverse=True)[1], values, k)
        rows, names, values = rows[kept], names[kept], values[kept]
        carried = None if more is None else carried[kept]
    return rows, names, values, carried


def _profiles(vectors: DataFrame, group: str | None, *more: str) -> DataFrame:
    grp = F.col(group).cast("string") if group else F.lit("")
    return vectors.select(grp.alias("grp"), "node_id", "codes", "numbers", *more,
                          F.md5(F.to_json(F.struct("codes", "numbers"))).alias("profile"))


def _representatives(vectors: DataFrame, group: str | None, depth: int, carry: str | None = None) -> DataFrame:
    """One row per group and profile: its ``depth`` smallest ids, and the first of them as its node_id; ``more`` are their ``carry``."""
    more = [carry] if carry else []
    first = top_k(_profiles(vectors, group, *more), ["grp", "profile"], [F.asc("node_id")], depth, "rn")
    ids = F.array_sort(F.collect_list(F.struct(F.col("node_id").isNull().alias("last"), F.col("node_id").alias("id"),
                                               *[F.col(c).cast("double").alias("more") for c in more])))
    return first.groupBy("grp", "profile").agg(ids.alias("ids"), F.first("codes").alias("codes"), F.first("numbers").alias("numbers")).select(
        "grp", F.get("ids", F.lit(0))["id"].alias("node_id"), F.col("ids")["id"].alias("ids"),
        *[F.col("ids")["more"].alias("more") for _ in more], "codes", "numbers")


def _to_pivots(df: DataFrame, pivots: pd.DataFrame, space: CosineSpace, all_pivots: bool) -> DataFrame:
    """Add the nearest pivot and its distance, or the distances to all pivots."""
    extra = "dists array<double>" if all_pivots else "cell int, dist double"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = space.distance(*Block.of(batch, pivots))
            if all_pivots:
                yield batch.assign(dists=list(d))
            else:
                near = d.argmin(axis=1)
                yield batch.assign(cell=near.astype("int32"), dist=d[np.arange(len(d)), near])

    return df.mapInPandas(run, schema)


def _kth_distance(placed: DataFrame, k: int) -> DataFrame:
    """The k-th smallest training distance per group and pivot; each task first cuts to k per group and pivot."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for grp, part in batch.groupby("grp"):
                d = np.array([list(x) for x in part["dists"]])
                d = np.vstack([kept[grp], d]) if grp in kept else d
                kept[grp] = np.partition(d, k - 1, axis=0)[:k] if len(d) > k else d
        for grp, d in kept.items():
            cells = np.repeat(np.arange(d.shape[1]), d.shape[0]).astype("int32")
            yield pd.DataFrame({"grp": grp, "cell": cells, "dist": d.T.ravel()})

    parts = placed.select("grp", "dists").mapInPandas(run, "grp string, cell int, dist double")
    best = top_k(parts, ["grp", "cell"], [F.asc("dist")], k, "rn")
    return best.where(F.col("rn") == k).select("grp", "cell", F.col("dist").alias("kth"))


def nearest(queries: DataFrame, train: DataFrame, k: int, space: CosineSpace = CosineSpace(),
            group: str | None = None, exclude_self: bool = False, n_cells: int | None = None,
            query_chunk: int = 1024, train_chunk: int = 16384, method: str = "exact",
            planes: Hyperplanes | None = None, target_recall: float = 0.95, tile: int = 8192,
            carry: str | None = None) -> DataFrame:
    """(group?, node_id, neighbour_id, similarity, rank) for the k most similar training rows of each query.

    Both inputs have node_id, codes and numbers. With ``group`` neighbours are sought inside the same
    group value only. ``exclude_self`` leaves out the training row with the query's own id.

    ``method="lsh"`` compares each query only with the rows that share a bucket of random hyperplanes with it, and may miss
    some; without ``planes``, their bits follow the number of rows and their probes are tuned on a sample of queries
    to ``target_recall``. The default finds all.

    ``carry`` names a number of the training rows, of which there is one for each node (and group); it comes with the neighbours, so
    that these need no join.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method!r}")
    depth = k + 1 if exclude_self else k
    asked = _profiles(queries, group).withColumn("profile", F.unhex(F.md5(F.concat_ws("|", "grp", "profile"))))
    reps = cut_lineage(_representatives(train, group, depth, carry), "profiles")
    points = cut_lineage(asked.groupBy("grp", "profile").agg(F.first("codes").alias("codes"),
                                                             F.first("numbers").alias("numbers")))
    sizes = (query_chunk, train_chunk, tile)
    if method == "lsh":
        if planes is None:
            rows = reps.count() // max(1, reps.select("grp").distinct().count())
            planes = tuned_probes(queries, train, depth, space, Hyperplanes().for_rows(rows), target_recall, group=group, rows=rows)
        best = _search(*meeting_rows(points, reps, space, planes), depth, space, 1, sizes, repeats=True)
    else:
        width = points.agg(F.max(F.size("codes"))).first()[0] or 0
        search = _by_category if width else _search
        best = search(points, reps, depth, space, n_cells, sizes)
    result = _handed_out(asked.select("grp", "node_id", "profile"), best, k, exclude_self)
    keep = [F.col("grp").alias(group)] if group else []
    return result.select(*keep, "node_id", "neighbour_id", "similarity", "rank", *[F.col(c).alias(carry) for c in _more(best)])


def _more(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "more"]


def _handed_out(asked: DataFrame, best: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The rows of profiles for their nodes.

    A profile's rows travel as one list. With ``exclude_self`` a node takes the first k of it without itself, which
    needs no order and no shuffle of the widened rows; only a node that asks more than once is ranked over all its lists.
    """
    row = F.struct("rank", "neighbour_id", "similarity", *_more(best))
    lists = best.groupBy("profile").agg(F.array_sort(F.collect_list(row)).alias("found"))
    if not exclude_self:
        return asked.join(lists, "profile").select("grp", "node_id", F.inline("found"))

    def others(some: DataFrame) -> DataFrame:
        left = F.filter("found", lambda x: x["neighbour_id"] != F.col("node_id"))
        return some.join(lists, "profile").select("grp", "node_id", left.alias("found"))

    keys = ["grp", "node_id"]
    twice = cut_lineage(asked.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "asked-twice")
    repeated = not twice.isEmpty()
    once = others(asked.join(twice, keys, "left_anti") if repeated else asked)
    result = once.select(*keys, F.posexplode(F.slice("found", 1, k)).alias("at", "x")).select(
        *keys, "x.neighbour_id", "x.similarity", *[F.col("x.more")] * len(_more(best)), (F.col("at") + 1).alias("rank"))
    if repeated:
        rows = others(asked.join(twice, keys, "left_semi")).select(*keys, F.inline("found")).drop("rank")
        ranked = top_k(rows, keys, [F.desc("similarity"), F.asc("neighbour_id")], k)
        result = result.unionByName(ranked)
    return result


def _by_category(points: DataFrame, reps: DataFrame, depth: int, space: CosineSpace, n_cells: int | None,
                 sizes: tuple[int, int, int]) -> DataFrame:
    """Search inside equal combinations of categories first, and only as far as a query's own results demand.

    With m of w categories equal the similarity is at most ``_bound(m)``. A query whose ``depth`` results are all better
    than the bound for one equal category less is done; the others go on to combinations with one column masked, then two,
    and what is left is compared to its whole group.
    """
    width = points.agg(F.max(F.size("codes"))).first()[0]
    order, best, waiting = [F.desc("similarity"), F.asc("neighbour_id")], None, points
    levels = sorted({0, min(1, width), min(2, width), width})
    for masked in levels:
        def keyed(df: DataFrame) -> DataFrame:
            keys = [F.md5(F.to_json(F.struct("grp", F.lit(i).alias("mask"), F.array(
                *[F.lit("") if j in mask else F.get("codes", j) for j in range(width)]).alias("rest"))))
                for i, mask in enumerate(combinations(range(width), masked))]
            return df.withColumn("grp", F.explode(F.array(*keys)))
        asked = cut_lineage(keyed(waiting), "asked")
        known = cut_lineage(keyed(reps).join(asked.select("grp").distinct(), "grp", "left_semi"), "known")
        found = _search(asked, known, depth, space, n_cells, sizes, repeats=0 < masked < width).drop("rank")
        if best is not None:
            found = found.unionByName(best.drop("rank")).dropDuplicates(["profile", "neighbour_id"])
        best = cut_lineage(top_k(found, "profile", order, depth), "best")
        if masked == width:
            break
        done = best.groupBy("profile").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
        limit = _bound(space, F.col("numbers"), (width - masked - 1) / width)
        waiting = waiting.join(done, "profile", "left").where(
            F.col("n").isNull() | (F.col("n") < depth) | (F.col("least") <= limit + SLACK)).drop("n", "least")
        waiting = cut_lineage(waiting, "waiting")
        if waiting.isEmpty():
            break
    return best


def _bound(space: CosineSpace, numbers: Column, share: float) -> Column:
    """The largest similarity of a query with any row that has this share of the categories equal."""
    whole, half = space.cat_weight + space.num_weight, space.cat_weight
    filled = F.exists(numbers, lambda x: x != 0)
    same = half * share
    with_numbers = max((same + space.num_weight) / whole, same / np.sqrt(whole * half) if half else 0.0)
    without = max(same / np.sqrt(half * whole), same / half) if half else 0.0
    return F.when(filled, F.lit(float(with_numbers))).otherwise(F.lit(float(without)))


def _search(points: DataFrame, reps: DataFrame, depth: int, space: CosineSpace, n_cells: int | None,
            sizes: tuple[int, int, int], repeats: bool = False) -> DataFrame:
    """(profile, neighbour_id, similarity, rank): the best ``depth`` training rows of the same ``grp`` for each query.

    A group that fits one tile on both sides shares its task with others; a larger one is split into cells and tiles.
    ``repeats``: a query and a training row may meet in several groups.
    """
    query_chunk, train_chunk, tile = sizes
    rows, more = points.count(), _more(reps)
    if n_cells is None:
        largest = reps.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        n_cells = max(1, round((largest / train_chunk) ** 0.5))
    dims = reps.agg(F.max(F.size("numbers"))).first()[0] or 1
    longest = max(tile, _TILE_NUMBERS // max(64, dims))

    def tiles(chunk: int) -> Column:
        n = F.count("*")
        rows_a_tile = F.greatest(F.lit(min(max(tile, chunk), longest)), F.least(F.ceil(n / _TILES), F.lit(longest)))
        return F.ceil(n / rows_a_tile).cast("int")

    if n_cells == 1:
        placed = points.withColumn("cell", F.lit(0))
        sent = reps.withColumn("cell", F.lit(0))
    else:
        sample = reps.orderBy(F.md5("node_id"), "node_id", "grp").limit(n_cells).toPandas()
        pivots = sample[["codes", "numbers"]]
        placed = _to_pivots(points, pivots, space, all_pivots=False)
        far = _to_pivots(reps, pivots, space, all_pivots=True)
        reach = placed.groupBy("grp", "cell").agg(F.max("dist").alias("reach"))
        radius = reach.join(_kth_distance(far, depth), ["grp", "cell"], "left").select(
            "grp", "cell", F.coalesce(2 * F.col("reach") + F.col("kth") + SLACK, F.lit(float("inf"))).alias("radius"))
        radii = radius.groupBy("grp").agg(F.collect_list(F.struct("cell", "radius")).alias("radii"))
        needed = F.filter("radii", lambda r: F.element_at("dists", r["cell"] + 1) <= r["radius"])
        sent = far.join(radii, "grp").select("grp", "node_id", "ids", *more, "codes", "numbers",
                                             F.explode(needed).alias("to")).select("*", "to.cell").drop("to")

    sizes_q = placed.groupBy("grp", "cell").agg(tiles(query_chunk).alias("q_parts"))
    sizes_t = sent.groupBy("grp", "cell").agg(tiles(train_chunk).alias("t_parts"))
    bins = max(1, rows // 2048)
    small = (F.col("q_parts") == 1) & (F.col("t_parts") == 1)
    task = F.when(small, F.pmod(F.xxhash64("grp", "cell"), F.lit(bins)).cast("string")).otherwise(
        F.concat_ws("|", F.lit("own"), "grp", "cell"))
    parts = cut_lineage(sizes_q.join(sizes_t, ["grp", "cell"]).withColumn("task", task), "tiles")

    def numbered(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    keys = ["task", "q_part", "t_part"]
    left = (placed.join(parts, ["grp", "cell"])
            .withColumn("q_part", F.pmod(F.xxhash64("profile"), F.col("q_parts")).cast("int"))
            .withColumn("t_part", numbered("t_parts")).select(*keys, "grp", "cell", "profile", "codes", "numbers"))
    right = (sent.join(parts.select(*[F.col(c).alias(c) for c in parts.columns]), ["grp", "cell"])
             .withColumn("t_part", F.pmod(F.xxhash64("node_id"), F.col("t_parts")).cast("int"))
             .withColumn("q_part", numbered("q_parts")).select(*keys, "grp", "cell", "node_id", "ids", *more, "codes", "numbers"))

    def match(asked_part: pd.DataFrame, train_part: pd.DataFrame) -> pd.DataFrame:
        columns = ["profile", "neighbour_id", "similarity", *more]
        out = [pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(columns, (object, object, float, float))})]
        known = dict(list(train_part.sort_values("node_id", kind="stable").groupby(["grp", "cell"])))
        for block, some in asked_part.groupby(["grp", "cell"]):
            if block not in known:
                continue
            ids, names = known[block]["ids"].to_numpy(), some["profile"].to_numpy()
            a, b = Block.of(some, known[block])
            extra = known[block]["more"].to_numpy() if more else None
            for start in range(0, len(names), _PRODUCT[0]):
                rows, found, values, carried = _best_ids(space, a.rows(start, start + _PRODUCT[0]), b, ids, depth, extra)
                part = {"profile": names[start + rows], "neighbour_id": found, "similarity": values}
                out.append(pd.DataFrame(part | ({"more": carried} if more else {})).drop_duplicates(["profile", "neighbour_id"]))
        return pd.concat(out)[columns] if len(out) > 1 else out[0]

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        match, "profile binary, neighbour_id string, similarity double" + ", more double" * len(more))
    if repeats:
        found = found.dropDuplicates(["profile", "neighbour_id"])
    return top_k(found, "profile", [F.desc("similarity"), F.asc("neighbour_id")], depth)


def shared_profiles(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, profiles): node_id to profile_id, and one vector per distinct profile with that id as node_id.

    Equal vectors have the same neighbours, so later joins can work per profile and widen to nodes at the end.
    """
    keyed = vectors.select("node_id", "codes", "numbers",
                           F.md5(F.to_json(F.struct("codes", "numbers"))).alias("profile_id"))
    profiles = keyed.groupBy(F.col("profile_id").alias("node_id")).agg(F.first("codes").alias("codes"),
                                                                       F.first("numbers").alias("numbers"))
    return keyed.select("node_id", "profile_id"), profiles


def pair_similarity(pairs: DataFrame, space: CosineSpace = CosineSpace()) -> DataFrame:
    """Similarity of given pairs (a_codes, a_numbers, b_codes, b_numbers) with built-in expressions only."""
    width = F.size("a_codes")
    same = F.size(F.filter(F.zip_with("a_codes", "b_codes", lambda a, b: a == b), lambda x: x))
    dot = F.aggregate(F.zip_with("a_numbers", "b_numbers", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    base = F.when(width > 0, F.lit(space.cat_weight)).otherwise(F.lit(0.0))

    def length(numbers):
        filled = F.exists(numbers, lambda x: x != 0)
        return F.sqrt(base + F.when(filled, F.lit(space.num_weight)).otherwise(F.lit(0.0)))

    raw = base * F.coalesce(F.try_divide(same, width), F.lit(0.0)) + F.lit(space.num_weight) * dot
    value = F.coalesce(F.try_divide(raw, length("a_numbers") * length("b_numbers")), F.lit(0.0))
    return pairs.withColumn("similarity", F.round(value, DIGITS))


def unit_length(vectors: DataFrame) -> DataFrame:
    """Scale ``numbers`` to length one; a zero vector stays. The length is computed once per row."""
    squares = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x * x)
    scaled = F.transform("numbers", lambda x: F.when(F.col("_length") > 0, x / F.col("_length")).otherwise(F.lit(0.0)))
    return vectors.withColumn("_length", F.sqrt(squares)).withColumn("numbers", scaled).drop("_length")


def dense_vectors(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """Plain vectors in the same layout: no categories, unit length, in double precision."""
    rows = df.where(F.col(vector).isNotNull()).select(
        F.col(ident).cast("string").alias("node_id"), F.array().cast("array<string>").alias("codes"),
        F.transform(vector, lambda x: x.cast("double")).alias("numbers"))
    return unit_length(rows)
