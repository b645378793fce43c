"""The Merkle manifest against a plain version, and on edge rows."""

import zlib
from hashlib import sha256

import pytest

pytest.importorskip("settlerank.llm")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def tree(nodes):
    """The root, and for each leaf its path of (left, right)."""
    paths, members, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [(level[k:k + 8], members[k:k + 8]) for k in range(0, len(level), 8)]
        for run, of in runs:
            for k, inside in enumerate(of):
                for i in inside:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
        level = [sha256("".join(run).encode()).hexdigest() for run, _ in runs]
        members = [sum(of, []) for _, of in runs]
    return level[0], paths


def brute(rows):
    """Sorted result rows for (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for i, text, lang, source, n in rows:
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None
        leaf = digest([i, source, lang, n, text])
        groups.setdefault(lang, []).append((i, leaf, digest([i, source, lang, n, text.translate(LOW)]) if changed else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: tree([leaf for _, leaf, _ in groups[g]]) for g in order}
    root, to_root = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, ending in zip(order, to_root):
        for (i, leaf, shown), path in zip(groups[g], trees[g][1]):
            node = shown
            for left, right in path + ending:
                node = sha256((left + node + right).encode()).hexdigest()
            proof = sha256("".join(a + b for a, b in path + ending).encode()).hexdigest()
            out.append((i, leaf, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def found(df):
    from pyspark.sql import functions as F
    from settlerank.llm.manifest import manifest, verified_rows
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = verified_rows(manifest(df, other={"text": low}, where=changed)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest_equals_brute_force(documents, dice):
    sizes = {"en": 700, "de": 512, "fr": 64, "é": 9, "z": 8, "": 1, None: 3}
    rows, ids = [], dice.sample(range(-2000, 4000), sum(sizes.values()))
    for lang, n in sizes.items():
        for _ in range(n):
            i = ids.pop()
            rows.append((i, f"Text {i} of É" if i % 2 else f"plain {i}", lang, f"s{i % 3}", i))
    dice.shuffle(rows)
    assert found(documents(rows)) == brute(rows)


def test_sparse_and_extreme_ids(documents):
    ids = [-(1 << 63), -(1 << 62), -65, -64, -1, 0, 63, 64, 1 << 18, (1 << 18) + 63, 1 << 40, (1 << 63) - 1]
    rows = [(i, "A text", "en" if k % 2 else "de", "s", 1) for k, i in enumerate(ids)]
    assert found(documents(rows)) == brute(rows)


def test_edge_rows(edge, nothing, documents):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in edge.collect()]
    assert found(edge) == brute(rows)
    assert found(nothing) == []
    single = [(5, "One ROW", "en", "s", 1)]
    assert found(documents(single)) == brute(single)


def test_many_ties(documents, dice, monkeypatch):
    from settlerank.llm import manifest
    monkeypatch.setattr(manifest, "_COPIES", 7)
    rows = [(None, f"T{k % 40}", dice.choice(["en", None]), "s", 1) for k in range(200)]
    rows += [(12, "same", "en", "s", 1)] * 50 + [(12, f"Other {k}", "en", "s", k) for k in range(60)]
    rows += [(k, "x", "en", "s", 1) for k in range(8, 20)] + [(None, None, None, None, None)] * 20
    dice.shuffle(rows)
    assert found(documents(rows)) == brute(rows)


def test_null_differs_from_empty(documents):
    from settlerank.llm.manifest import leaves
    found = leaves(documents([(1, text, "en", "s", 0) for text in (None, "", "-")])).select("leaf").distinct()
    assert found.count() == 3
