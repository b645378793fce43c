"""Hyperplane tables: recall against the exact search, candidates in proportion, crowded buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from settlerank.operators.knn import CosineSpace, _profiles, nearest, unit_length
from settlerank.operators.lsh import Hyperplanes, compared_pairs, meeting_rows, recall_of


def vectors(spark, x, codes=None):
    rows = [(str(i), codes[i] if codes else [], [float(c) for c in v]) for i, v in enumerate(x)]
    return unit_length(spark.createDataFrame(rows, "node_id string, codes array<string>, numbers array<double>")).repartition(4)


def clustered(rng, n, dim=24, spread=0.35):
    centres = rng.standard_normal((max(1, n // 20), dim))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))


def pairs_compared(df, planes):
    points = _profiles(df, None).groupBy("grp", "profile").agg(F.first("codes").alias("codes"), F.first("numbers").alias("numbers"))
    return compared_pairs(*meeting_rows(points, _profiles(df, None).drop("profile"), CosineSpace(), planes))


def test_recall_of_plain_vectors(spark):
    df = vectors(spark, clustered(np.random.default_rng(1), 1500))
    got = recall_of(nearest(df, df, 15, method="lsh"), nearest(df, df, 15)).first()
    assert got["queries"] == 1500 and got["wanted"] == 22500 and got["recall"] >= 0.9


def test_recall_with_categories(spark):
    rng = np.random.default_rng(2)
    codes = [[str(rng.integers(0, 4)), str(rng.integers(0, 6)), "x"] for _ in range(800)]
    df = vectors(spark, clustered(rng, 800, 4), codes)
    got = recall_of(nearest(df, df, 10, method="lsh"), nearest(df, df, 10)).first()
    assert got["recall"] >= 0.9


def test_similarities_are_exact_and_self_is_left_out(spark):
    df = vectors(spark, clustered(np.random.default_rng(3), 400))
    exact = {(r["node_id"], r["neighbour_id"]): r["similarity"] for r in nearest(df, df, 400).collect()}
    found = nearest(df, df, 5, exclude_self=True, method="lsh").collect()
    assert all(r["node_id"] != r["neighbour_id"] and exact[r["node_id"], r["neighbour_id"]] == r["similarity"] for r in found)


def test_candidates_grow_in_proportion(spark):
    rng = np.random.default_rng(4)
    counts = {}
    for n in (2000, 8000):
        planes = Hyperplanes(tables=4, probes=2).for_rows(n)
        counts[n] = pairs_compared(vectors(spark, rng.standard_normal((n, 24))), planes) / n
    assert counts[8000] < 1.6 * counts[2000] and counts[8000] < 4 * 2 * 64 * 2


def test_crowded_bucket_is_split(spark):
    rng = np.random.default_rng(5)
    near_copies = np.ones(24) + 0.25 * rng.standard_normal((2000, 24))
    df = vectors(spark, np.vstack([near_copies, rng.standard_normal((1000, 24))]))
    planes = Hyperplanes(tables=4, probes=2, crowded=4).for_rows(3000)
    whole = pairs_compared(df, Hyperplanes(tables=4, probes=2, crowded=10 ** 6).for_rows(3000))
    assert pairs_compared(df, planes) < whole / 4


def test_groups_and_odd_rows(spark):
    df = vectors(spark, [[0.0, 0.0], [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]]).withColumn("business", F.lit("b"))
    got = nearest(df, df, 2, group="business", method="lsh").collect()
    assert len(got) == 8 and {r["business"] for r in got} == {"b"}
    none = df.limit(0)
    assert nearest(none, df, 2, method="lsh").count() == 0 and nearest(df, none, 2, method="lsh").count() == 0
    with pytest.raises(ValueError):
        nearest(df, df, 2, method="other")


def test_probes_are_in_order_of_cost():
    planes = Hyperplanes(tables=2, bits=5)
    projected = planes.projections(np.empty((6, 0), object), np.random.default_rng(0).standard_normal((6, 3)), CosineSpace())
    own, _ = planes.buckets(projected)
    probed = planes.probed(projected, 32)
    assert (probed[..., 0] == own).all() and all(len(set(p)) == 32 for row in probed for p in row)
    bits = (probed[..., None] ^ own[..., None, None]) >> np.arange(5) & 1
    cost = (bits * np.square(projected[..., None, :5])).sum(axis=-1)
    assert (np.diff(cost, axis=-1) >= -1e-12).all()
