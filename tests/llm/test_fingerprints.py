"""Fingerprints against a plain version, merging of parts, and edge rows."""

import re
from hashlib import sha256

import pytest
import xxhash

pytest.importorskip("settlerank.llm")
K = 128


def chain(values):
    """Spark's xxhash64 of several values: each one's hash is the seed of the next."""
    seed = 42
    for v in values:
        data = v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def shingle_set(text):
    words = [chain([w.encode()]) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())]
    return {chain(words[i:i + 5]) for i in range(len(words) - 4)} or ({chain(words)} if words else set())


def sketch(text):
    return sorted(shingle_set(text))[:K]


def printed(hashes):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in hashes)


def near(a, b):
    union = sorted(set(a) | set(b))[:K]
    return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0


def brute(rows):
    def tag(text):
        return chain([(text or "").encode()])
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tag(r[1])))
    out = []
    for at, (i, text) in enumerate(order):
        other = order[(at + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + other[:cut]
        a, b, c = sketch(text), sketch(edited), sketch(other)
        out.append((i, len(text), sha256(edited.encode()).hexdigest(), printed(a), printed(b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def found(df):
    from settlerank.llm.fingerprints import edited_fingerprints
    return sorted((tuple(r) for r in edited_fingerprints(df).collect()), key=repr)


def texts(dice, n):
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]
    return [" ".join(dice.choice(words) for _ in range(dice.choice([0, 1, 4, 5, 6, 60, 200, 700]))) for _ in range(n)]


def test_fingerprints_equal_brute_force(documents, dice, monkeypatch):
    from settlerank.llm import fingerprints
    ids = dice.sample(range(-500, 5000), 150)
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts(dice, 150))]
    rows[10], rows[11] = (rows[10][0], None, None, None, None), (rows[11][0], "🎉🎉 日本 word\x0bmore\tof it", "en", "s", 1)
    expected = brute([(r[0], r[1]) for r in rows])
    assert found(documents(rows)) == expected
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    assert found(documents(rows)) == expected


@pytest.mark.parametrize("range_rows", [3, 2000])
def test_ties_and_copies(documents, dice, monkeypatch, range_rows):
    from settlerank.llm import fingerprints
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(fingerprints, "_COPIES", 3)
    some = texts(dice, 6)
    rows = [(dice.choice([None, 1, 2, 3]), dice.choice([*some, None]), "en", "s", 1) for _ in range(120)] + [(9, some[0], "en", "s", 1)] * 20
    assert found(documents(rows)) == brute([(r[0], r[1]) for r in rows])


def test_edge_rows(edge, nothing, documents):
    assert found(edge) == brute([(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()])
    assert found(nothing) == []
    single = [(5, "one two three four five six seven", "en", "s", 1)]
    assert found(documents(single)) == brute([r[:2] for r in single])


def test_ranges_are_looked_up(spark, monkeypatch):
    from pyspark.sql import functions as F
    from settlerank.llm.fingerprints import _range_of
    for n in (1, 2, 256, 257, 600):
        bounds = [(None, -5), *[(10 * i, 0) for i in range(1, n)]][:n]
        rows = spark.createDataFrame([(None, -5), (None, 9), *[(10 * i + d, 0) for i in range(1, n) for d in (0, 1)], (10 ** 9, 3)], "id long, tag long")
        got = [tuple(r) for r in rows.select("id", _range_of(F.struct("id", "tag"), bounds, "bigint")).collect()]
        assert all(r == (0 if i is None else min(i // 10, n - 1)) for i, r in got)


def test_parts_merge_to_the_whole(spark, dice):
    from pyspark.sql import functions as F
    from settlerank.llm.fingerprints import as_text, distinct_shingles, from_text, merge_sketches, with_sketch
    rows = [(g, t) for g, n in (("a", 90), ("b", 3), (None, 40)) for t in texts(dice, n)]
    df = with_sketch(spark.createDataFrame(rows, "g string, text string"), "text", "sketch")
    got = {r["g"]: r for r in merge_sketches(df, ["g"]).select("g", "sketch", as_text(F.col("sketch")).alias("t"),
                                                               distinct_shingles(F.col("sketch")).alias("n")).collect()}
    for g in ("a", "b", None):
        whole = set().union(*[shingle_set(t) for k, t in rows if k == g])
        assert got[g]["sketch"] == sorted(whole)[:K]
        assert abs(got[g]["n"] / len(whole) - 1) < 0.3
    back = spark.createDataFrame([(r["t"], r["sketch"]) for r in got.values()] + [("", [])], "t string, sketch array<bigint>")
    assert back.filter(~(from_text(F.col("t")) == F.col("sketch"))).count() == 0


def test_estimates(spark, dice):
    from pyspark.sql import functions as F
    from settlerank.llm.fingerprints import containment, likeness, with_sketch
    words = [f"v{i}" for i in range(20000)]
    pairs = []
    for shared in (0, 200, 1000, 3000):
        a, b, c = ([dice.choice(words) for _ in range(n)] for n in (shared, 1000, 400))
        pairs.append((" ".join(a + b), " ".join(a + c)))
    df = spark.createDataFrame([*pairs, ("", ""), ("", "a b"), ("a b", "")], "a string, b string")
    df = with_sketch(with_sketch(df, "a", "sa"), "b", "sb")
    got = df.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("j"), containment(F.col("sa"), F.col("sb")).alias("c")).collect()
    for r in got[:4]:
        x, y = shingle_set(r["a"]), shingle_set(r["b"])
        assert abs(r["j"] - len(x & y) / len(x | y)) < 0.16 and abs(r["c"] - len(x & y) / len(x)) < 0.2
    assert [(r["j"], r["c"]) for r in got[4:]] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
