"""A Merkle manifest of a table: leaf digests, a tree per group, one root, and a proof for every row.

Places of the leaves come from rank queries on bitmaps, so no row is sorted:

* Each group (``group_col``) has a bitmap of its ids, held as the non-empty 64-bit words alone. Words are built by a plain
  aggregate (``bit_or``), which merges the parts of a group before and after the shuffle.
* Directories of popcounts lie over the words, each entry over 4096 below it, as many levels as the span of ids asks for: a
  word knows how many ids come before it. The rank of an id is that number and the bits before its own.
* Ids that repeat within a group, and null ids, have no bit of their own. Their rows are counted by digest, and counts per
  16-bit prefix of the digest give their places.

Levels are reduced by keyed slot arrays: (group, place / 512) holds 512 slots and is three levels of the tree at once, so 10**11
rows take four rounds. The groups' roots are the leaves of a last tree, in order of the group.

Every run of ``FAN`` nodes (the last may be shorter) becomes the digest of their joined hex texts, as long as several nodes
remain. A proof is the list of the other nodes of each run up to the root.

Defined results: null values are digested as ``-``, so they differ from empty text; rows with a null group are a group of their own,
which comes first; in a group null ids come first, rows that share an id follow by digest, and equal rows take one place each.
An empty table has no root and gives no rows. Other columns of the table are not part of the manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlerank.session import cut_lineage

FAN = 8
LEVELS = 3                                  #: levels of the tree in one slot array
SLOTS = FAN ** LEVELS
WORD_BITS = 6
DIRECTORY_BITS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Copies of one row that are numbered by one task.
_COPIES = 1 << 16


def encoded(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and its text; a null as a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _group(value: Column) -> Column:
    """A group as text that is never null and sorts as the group does, nulls first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def leaves(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS,
           other: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """g, id, leaf of every row, and ``other_leaf``: the digest with the columns ``other`` in place of the named ones ``where`` asks for it."""
    swapped = row_digest([(other or {}).get(c, rows[c]) for c in columns])
    return rows.select(_group(rows[group_col]).alias("g"), rows[id_col].cast("long").alias("id"),
                       row_digest([rows[c] for c in columns]).alias("leaf"),
                       F.when(where if where is not None else F.lit(False), swapped).alias("other_leaf"))


def _shifted(value: int) -> Column:
    """A number moved to the bit of an id in its word."""
    return F.call_function("shiftleft", F.lit(value).cast("long"), F.col("id").bitwiseAND(F.lit(63)).cast("int"))


def bitmap_words(rows: DataFrame) -> DataFrame:
    """g, word (id / 64), bits, n: the non-empty words of each group's bitmap, and the number of rows behind each."""
    return (rows.filter("id IS NOT NULL").select("g", F.shiftright("id", WORD_BITS).alias("word"), _shifted(1).alias("bit"))
            .groupBy("g", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n")))


def with_directory(words: DataFrame) -> DataFrame:
    """The words and ``before``: the rows of the group in earlier words. Each directory entry sums 4096 of the level below."""
    ends = words.agg(F.min("word"), F.max("word")).first()
    if ends[0] is None:
        return words.withColumn("before", F.lit(0).cast("long"))
    low, high, levels = ends[0], ends[1], [words.select("g", F.col("word").alias("k0"), "n")]
    while high - low >= 1 << DIRECTORY_BITS:
        low, high, at = low >> DIRECTORY_BITS, high >> DIRECTORY_BITS, len(levels)
        levels.append(levels[-1].withColumn(f"k{at}", F.shiftright(f"k{at - 1}", DIRECTORY_BITS))
                      .groupBy("g", f"k{at}").agg(F.sum("n").alias("n")))
    before = None
    for at in range(len(levels) - 1, -1, -1):
        parent = F.shiftright(f"k{at}", DIRECTORY_BITS) if before is not None else F.lit(0).cast("long")
        earlier = Window.partitionBy("g", "up").orderBy(f"k{at}").rowsBetween(Window.unboundedPreceding, -1)
        here = levels[at].withColumn("up", parent).select("g", f"k{at}", "up", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("own"))
        if before is not None:
            here = here.join(before.withColumnRenamed(f"k{at + 1}", "up"), ["g", "up"]).withColumn("own", F.col("own") + F.col("before"))
        before = here.select("g", f"k{at}", F.col("own").alias("before"))
    return words.join(before.withColumnRenamed("k0", "word"), ["g", "word"])


def _places_of_ties(rows: DataFrame) -> DataFrame:
    """g, word, id, leaf, other_leaf, ``place`` in its word: of rows in words that hold an id more than once.

    A word has at most 64 ids and an id at most 65536 prefixes, so what a window sorts is bounded but for rows that agree in id
    and prefix, a 65536th of an id's rows.
    """
    ids = ["g", "word", "id"]
    alike = cut_lineage(rows.groupBy(*ids, "leaf", "other_leaf").agg(F.count("*").alias("copies"))
                        .withColumn("prefix", F.substring("leaf", 1, 4)), "tied-rows")

    def running(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("copies").over(earlier), F.lit(0)))

    prefixes = running(alike.groupBy(*ids, "prefix").agg(F.sum("copies").alias("copies")), ids, ["prefix"], "of_prefix").drop("copies")
    of_ids = running(alike.groupBy(*ids).agg(F.sum("copies").alias("copies")), ["g", "word"], ["id"], "of_id").drop("copies")
    null_safe = lambda x, y, keys: [x[k].eqNullSafe(y[k]) for k in keys]
    placed = running(alike, [*ids, "prefix"], ["leaf", "other_leaf"], "of_leaf")
    placed = placed.join(prefixes, null_safe(placed, prefixes, [*ids, "prefix"])).select(*[placed[c] for c in placed.columns], "of_prefix")
    placed = placed.join(of_ids, null_safe(placed, of_ids, ids)).select(*[placed[c] for c in placed.columns], "of_id")
    first = F.col("of_id") + F.col("of_prefix") + F.col("of_leaf")
    # equal rows take one place each; very many of them are dealt out first
    spread = placed.withColumn("first", first).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_COPIES).cast("long"))))
    spread = cut_lineage(spread, "spread-rows").repartition("g", "id", "leaf", "from")
    copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + _COPIES, F.col("copies")) - 1))
    return spread.select(*ids, "leaf", "other_leaf", "first", copy.alias("copy")).select(
        *ids, "leaf", "other_leaf", (F.col("first") + F.col("copy")).alias("place"))


def with_places(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with ``i``, the place in the group, and g, size of every group."""
    words = cut_lineage(with_directory(cut_lineage(bitmap_words(rows), "bitmap-words")), "ranked-words")
    sizes = cut_lineage(rows.groupBy("g").agg(F.count("*").alias("size"), F.count_if(F.col("id").isNull()).alias("nulls")), "group-sizes")
    rows = rows.withColumn("word", F.shiftright("id", WORD_BITS))
    place = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(_shifted(-1))))
    single = words.filter("n = bit_count(bits)")
    found = rows.join(single, ["g", "word"]).select("g", "id", "leaf", "other_leaf", place.alias("i"))
    tied = words.filter("n > bit_count(bits)")
    any_tied, any_null = not tied.isEmpty(), not sizes.filter("nulls > 0").isEmpty()
    if any_tied or any_null:
        many = rows.filter("id IS NULL").unionByName(rows.join(tied.select("g", "word"), ["g", "word"], "left_semi"))
        many = _places_of_ties(many).join(tied.select("g", "word", "before"), ["g", "word"], "left")
        found = found.union(many.select("g", "id", "leaf", "other_leaf", F.coalesce("before", F.lit(0)) + F.col("place")))
    if any_null:                              # null ids come first, all others behind them
        shift = F.when(F.col("id").isNotNull(), F.col("nulls")).otherwise(F.lit(0))
        found = found.join(sizes.select("g", "nulls"), "g").select("g", "id", "leaf", "other_leaf", (F.col("i") + shift).alias("i"))
    return found, sizes.select("g", "size")


def _runs(nodes: Column) -> Column:
    """The digest of every run of FAN nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda k: F.sha2(F.array_join(F.slice(nodes, k * FAN + 1, FAN), ""), 256))


def _beside(nodes: Column, slot: Column) -> Column:
    """The joined nodes before and after a slot in its run."""
    at = slot % FAN
    return F.struct(F.array_join(F.slice(nodes, slot - at + 1, at), "").alias("l"),
                    F.array_join(F.slice(nodes, slot + 2, F.lit(FAN - 1) - at), "").alias("r"))


def slot_arrays(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """g, block, levels, slots, l0, l1, l2, top: nodes (g, i, depth, digest) in arrays of SLOTS.

    ``slots`` holds the columns ``carried`` in order of i, ``l0`` the digests, ``l1`` and ``l2`` those of the next levels as far as
    the group's ``depth`` has them, ``top`` the block's own node.
    """
    block = nodes.groupBy("g", F.floor(F.col("i") / SLOTS).alias("block")).agg(
        F.min(F.least(F.lit(LEVELS), F.col("depth"))).alias("levels"),
        F.sort_array(F.collect_list(F.struct((F.col("i") % SLOTS).cast("int").alias("slot"), "digest", *carried))).alias("slots"))
    none = F.array().cast("array<string>")
    block = block.withColumn("l0", F.transform("slots", lambda s: s["digest"]))
    block = block.withColumn("l1", F.when(F.col("levels") > 1, _runs(F.col("l0"))).otherwise(none))
    block = block.withColumn("l2", F.when(F.col("levels") > 2, _runs(F.col("l1"))).otherwise(none))
    top = F.coalesce(*[F.when(F.col("levels") == k + 1, _runs(F.col(f"l{k}"))[0]) for k in range(LEVELS)], F.col("l0")[0])
    return cut_lineage(block.withColumn("top", top), "slot-arrays")


def _path(slot: Column) -> Column:
    """The sides of a slot on each of the block's levels."""
    sides = F.array(*[_beside(F.col(f"l{k}"), F.floor(slot / FAN ** k).cast("int")) for k in range(LEVELS)])
    return F.slice(sides, 1, F.col("levels"))


class Forest:
    """The trees over nodes (g, i, digest) of groups of the given sizes: one root for each group."""

    def __init__(self, nodes: DataFrame, sizes: DataFrame, carried: list[str]):
        # the depth is the number of times that the size can be divided by FAN, rounding up
        steps = F.sequence(F.lit(1), F.lit(22))
        depth = F.size(F.filter(steps, lambda k: F.col("size") > F.pow(F.lit(float(FAN)), k - 1)))
        depths = sizes.select("g", depth.alias("depth"))
        deepest = depths.agg(F.max("depth")).first()[0] or 0
        self.rounds = [slot_arrays(nodes.join(depths, "g"), carried)]
        for done in range(LEVELS, deepest, LEVELS):
            below = self.rounds[-1].join(depths.filter(F.col("depth") > done), "g").select(
                "g", F.col("block").alias("i"), (F.col("depth") - done).alias("depth"), F.col("top").alias("digest"))
            self.rounds.append(slot_arrays(below, []))
        last = F.greatest(F.lit(0), F.ceil(F.col("depth") / LEVELS) - 1)                    # the round that ends in the root
        ended = [r.join(depths.filter(last == k), "g", "left_semi").select("g", F.col("top").alias("root")) for k, r in enumerate(self.rounds)]
        self.roots = cut_lineage(reduce(DataFrame.union, ended), "roots")

    def paths(self) -> DataFrame:
        """g, the carried columns, digest and ``path``, the sides of every node up to the root of its group."""
        above = None
        for at in range(len(self.rounds) - 1, -1, -1):
            blocks = self.rounds[at]
            if above is None:
                blocks = blocks.withColumn("up", F.array().cast("array<struct<l:string,r:string>>"))
            else:
                blocks = blocks.join(above, ["g", "block"], "left").withColumn(
                    "up", F.coalesce("up", F.array().cast("array<struct<l:string,r:string>>")))
            each = blocks.select("g", "block", "levels", "l0", "l1", "l2", "up", F.explode("slots").alias("s"))
            each = each.select("g", "block", "s", F.concat(_path(F.col("s.slot")), F.col("up")).alias("path"))
            above = each.select("g", (F.col("block") * SLOTS + F.col("s.slot")).alias("block"), F.col("path").alias("up"))
        return each.select("g", "s.*", "path").drop("slot")


def _in_order(roots: DataFrame) -> DataFrame:
    """g, root, i: the groups numbered in their order, by ranges and not in one task."""
    parts = cut_lineage(roots.repartitionByRange("g").withColumn("part", F.spark_partition_id()), "ordered-roots")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)         # a row for each range
    offsets = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1
    return parts.withColumn("own", own).join(offsets, "part").select("g", "root", (F.col("first") + F.col("own")).alias("i"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, side: F.sha2(F.concat(side["l"], node, side["r"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS,
             other: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """id, leaf, other_leaf, subroot, root and ``path`` of every row of the table.

    ``path`` has the two sides (l, r) of each run on the way from the leaf to the root. ``other_leaf`` is the digest of the changed
    row (see ``leaves``), or null.
    """
    hashed = cut_lineage(leaves(rows, id_col, group_col, columns, other, where), "leaves")
    placed, sizes = with_places(hashed)
    trees = Forest(placed.withColumnRenamed("leaf", "digest"), sizes, ["id", "other_leaf"])
    tops = _in_order(trees.roots).select(F.lit("").alias("g"), "i", F.col("root").alias("digest"), F.col("g").alias("of"))
    tops = cut_lineage(tops, "subroots")
    whole = Forest(tops, tops.groupBy("g").agg(F.count("*").alias("size")), ["of"])
    ends = whole.paths().join(whole.roots, "g").select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root",
                                                       F.col("path").alias("to_root"))
    return trees.paths().join(cut_lineage(ends, "group-paths"), "g").select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "other_leaf", "subroot", "root",
        F.concat("path", "to_root").alias("path"))


def verified_rows(proofs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's own or changed leaf folded along its path."""
    folded = proofs.withColumn("folded_root", fold(F.coalesce("other_leaf", "leaf"), F.col("path")))
    return folded.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))

