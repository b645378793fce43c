"""The candidate pairs of the set join and the links they must hold."""

import numpy as np
import pytest

pytest.importorskip("settlerank.llm")


def near_copies(dice, n, length=120):
    """Texts of which each replaces up to six words of one common text by words of its own, and unrelated ones around its passage."""
    base = [f"w{i}" for i in range(length)]
    texts = [" ".join(base)]
    for k in range(n):
        words = list(base)
        for at in dice.sample(range(length), dice.randint(1, 6)):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words[:dice.choice((length, length, length - 8))]))
    return texts + [" ".join([f"u{k}v{i}" for i in range(60)] + base[20:32]) for k in range(20)]


def roots(n, links):
    root = list(range(n))
    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def sets_of(texts):
    from settlerank.llm.setjoin import shingle_sets
    import pyarrow as pa
    return list(shingle_sets(pa.array(texts)))


def test_every_link_passes_at_the_first_common_key(dice):
    """The positional test: places in the prefixes of the first shingle in common leave room for every link."""
    from settlerank.llm.setjoin import DOWN, SKETCH_BITS, UP, linked, prefix_keys
    sets = sets_of(near_copies(dice, 60))
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for s in sets:
        classes[s >> np.uint64(64 - SKETCH_BITS)] += 1
    keys, ruled_out = [prefix_keys(s, classes).tolist() for s in sets], 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            shared = [k for k in keys[i] if k in set(keys[j])]
            assert shared == [k for k in keys[j] if k in set(keys[i])]
            most = min(len(x) - keys[i].index(shared[0]), len(y) - keys[j].index(shared[0])) if shared else 0
            fits = (UP + DOWN) * most >= UP * (len(x) + len(y))
            assert fits or not linked(x, y)
            ruled_out += bool(shared) and not fits
    assert ruled_out > 100


def test_groups_of_near_copies_take_few_pairs(spark, dice):
    from pyspark.sql import functions as F
    from settlerank.llm.groups import groups_of_keys, live_keys
    from settlerank.llm.setjoin import _frequency_classes, _may_meet, _postings, linked, node_of
    texts = near_copies(dice, 250)
    sets = sets_of(texts)
    node = [node_of(s) for s in sets]
    rows = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    traits = spark.createDataFrame([(a, len(s)) for a, s in zip(node, sets)], "node long, n long")
    by_node, tested = dict(zip(node, sets)), []

    def verify(pairs):
        found = [(r["a"], r["b"]) for r in pairs.collect()]
        tested.append(len(found))
        return spark.createDataFrame([p for p in found if linked(by_node[p[0]], by_node[p[1]])], "a long, b long")

    live = live_keys(_postings(rows, _frequency_classes(rows)[0], 0))
    groups = {r["node"]: r["root"] for r in groups_of_keys(
        live, verify, traits, lambda x, y: F.lit(True), quick_test=_may_meet, order="at").collect()}
    links = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])]
    expected = roots(len(sets), links)
    assert len(links) > 500 and len(set(expected)) > 20
    for i, j in ((i, j) for i in range(len(sets)) for j in range(i)):
        assert (expected[i] == expected[j]) == (groups.get(node[i], node[i]) == groups.get(node[j], node[j]))
    assert sum(tested) < 8 * len(sets)                      # all pairs of the 250 copies are 31 000
