"""Connected groups of linked nodes, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlerank.session import cut_lineage

#: Members of a key's largest group that those outside it meet.
MORE_PIVOTS = 4
#: A node's first keys, by which the last join tells at which of several common keys a pair is given out.
LOW_KEYS = 8


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node; none from a node to itself."""
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct())


def connected_groups(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is the smallest node that links lead to.

    Large and small stars in turn: each round hangs the neighbours of every node under the smallest one, until nothing
    changes, in a number of rounds that grows with the logarithm of the longest chain. Minima are combined before the
    shuffle; the joins on a node are plain equi-joins, which AQE splits at a node with very many links. Each round is
    stored in the shared folder. Links with a null end are dropped.
    """
    edges, before = cut_lineage(_tidy(edges.select("a", "b").dropna()), "links"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _tidy(both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = cut_lineage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(_tidy(small.union(least.select("a", F.col("m").alias("b")))), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def live_keys(keyed: DataFrame, unique: bool = False) -> DataFrame:
    """key, node, pivot of the keys (key, node) that two or more nodes share; pivot is the smallest of them.

    ``unique`` says that no row of ``keyed`` repeats.

    Minima and maxima are combined before the shuffle, and the join back is one that AQE splits at a hot key.
    """
    shared = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")) \
        .filter("pivot < _last").drop("_last")
    live = keyed.join(shared, "key")
    return cut_lineage(live if unique else live.distinct(), "live-keys")


def live_keys_by_window(keyed: DataFrame, *more: str) -> DataFrame:
    """As ``live_keys``, with rows that may repeat, from one shuffle of ``keyed``; ``more`` are columns that depend on key and node.

    For keys that are dear to make. A key's rows are sorted in one task, so none may have a large share of all rows by repeats.
    """
    same = Window.partitionBy("key")
    live = keyed.select("key", "node", *more, F.min("node").over(same).alias("pivot"), F.max("node").over(same).alias("_last"))
    return cut_lineage(live.filter("pivot < _last").drop("_last").dropDuplicates(["key", "node"]), "live-keys")


def groups_of_keys(live: DataFrame, verify: Callable[[DataFrame], DataFrame], traits: DataFrame,
                   may_link: Callable[[dict, dict], Column], verify_tested: Callable[[DataFrame], DataFrame] | None = None,
                   quick_test: Callable[[dict, dict], Column] | None = None, low_keys: bool = True,
                   order: str | None = None, place: str | None = None) -> DataFrame:
    """node, root of the connected groups of all links between nodes that share a key.

    ``verify`` gives those of the distinct pairs (a, b) that link. First each node meets the pivot of its keys, so a list
    costs its length. Then those outside their key's largest group meet a few pseudo-random members of it, which joins most
    of a large group whose pivot lies at its rim. At last members of one key that are still in different groups meet: those
    outside the key's largest group all others, each pair at one key if they share one of their smallest. A pair that is
    left out lies in one group already, so these are the groups of all links. ``traits`` has a row of short columns for each
    node, and ``may_link`` a condition on those of two nodes that every link meets; the last join tests it before it gives
    out a pair, so that ``verify_tested``, if given, verifies these pairs and need not test it again; ``quick_test`` is a
    part of ``may_link`` that is tested in the join itself. Without ``low_keys`` the rows of that join stay short, and a pair comes once
    for each key in common.

    ``order`` names a further column of ``live``: the place of a key among its node's keys, such that the keys two nodes share
    come in the same order in both, by that column and then the key. Every link must pass ``quick_test``, which gets the column
    as well, at the first of these. A key's pivot is then the node in which it comes first: the fewer keys of its own a node
    has before those of many nodes, the nearer it is to all of them. ``place`` names a column of ``live`` that ``quick_test`` gets
    and that changes nothing else.
    """
    carried = [c for c in (order, place) if c]
    if order:
        live = live.drop("pivot").join(live.groupBy("key").agg(F.min(F.struct(order, "node"))["node"].alias("pivot")), "key")
        live = cut_lineage(live, "ordered-keys")
    tried = cut_lineage(live.filter(F.col("node") != F.col("pivot")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
                        .distinct(), "pivot-pairs")
    links = cut_lineage(verify(tried), "pivot-links")
    groups = cut_lineage(connected_groups(links), "groups")

    placed = _mixed_keys(live, groups, carried)
    inside = placed.filter("root = main").groupBy("key").agg(F.array_distinct(F.array(*[
        F.min_by("node", F.xxhash64("node", F.lit(seed))) for seed in range(MORE_PIVOTS)])).alias("pivots"))
    again = (placed.filter("root != main").select("key", "node").join(inside, "key").select("node", F.explode("pivots").alias("other"))
             .select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
             .join(tried, ["a", "b"], "left_anti"))
    again = cut_lineage(again, "more-pivot-pairs")
    found = cut_lineage(verify(again), "more-pivot-links")
    if not found.isEmpty():
        links, tried = links.union(found), tried.union(again)
        groups = cut_lineage(connected_groups(links), "groups")
        placed = _mixed_keys(live, groups, carried)

    if low_keys:
        first = F.slice(F.sort_array(F.collect_list(F.struct(*[order] * bool(order), "key"))), 1, LOW_KEYS)["key"]
        traits = traits.join(placed.groupBy("node").agg(first.alias("low")), "node")
    names = [c for c in (*traits.columns, *carried) if c != "node"]
    of = lambda side: {c: F.col(f"{side}_{c}") for c in names}
    placed = placed.join(traits, "node")
    x = placed.filter("root != main").select("key", F.col("node").alias("a"), F.col("root").alias("ra"),
                                             *[F.col(c).alias(f"x_{c}") for c in names])
    y = placed.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), "main", *[F.col(c).alias(f"y_{c}") for c in names])
    apart = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") > F.col("b")))
    # nodes that share several keys mostly share one of their first; of these the first gives the pair, the others not again
    once = (~F.arrays_overlap("x_low", "y_low") | (x["key"] == F.array_intersect("x_low", "y_low")[0])) if low_keys else F.lit(True)
    if quick_test:
        once = once & quick_test(of("x"), of("y"))
    met = x.join(y, (x["key"] == y["key"]) & apart & once)
    # a generator of one row between join and filter keeps the test out of the join's loop, which would grow too long to be compiled
    met = met.select("a", "b", F.explode(F.array(may_link(of("x"), of("y")))).alias("_ok")).filter("_ok")
    more = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    others = cut_lineage((verify_tested or verify)(cut_lineage(more, "other-pairs")), "other-links")
    return groups if others.isEmpty() else cut_lineage(connected_groups(links.union(others)), "groups")


def _mixed_keys(live: DataFrame, groups: DataFrame, carried: list[str]) -> DataFrame:
    """key, node, root, main of the keys whose nodes are in more than one group; main is the group with most of them.

    Keys of two nodes are left out: these two have met, as one of them is the pivot.
    """
    placed = live.select("key", "node", *carried).join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("_m"), F.count("*").alias("_k"), F.sum("c").alias("_n")) \
        .filter("_k > 1 AND _n > 2").select("key", F.col("_m.root").alias("main"))
    return cut_lineage(placed.join(largest, "key"), "mixed-keys")
