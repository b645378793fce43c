"""Plain Python versions of the operators for small inputs."""

from __future__ import annotations

import re

import regex
import xxhash

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def groups(nodes, linked):
    """Smallest node that links lead to, for each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def jaccard_groups(docs):
    sets = {i: shingles(t) for i, t in docs}
    def linked(a, b):
        shared = len(sets[a] & sets[b])
        return shared > 0 and 100 * shared >= 80 * len(sets[a] | sets[b])
    return {i: (len(sets[i]), g) for i, g in groups(list(sets), linked).items()}


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def contaminated(doc, item, window=13, allowed=2):
    d, b = tokens(doc), tokens(item)
    if not b:
        return False
    if len(b) < window:
        return any(d[i:i + len(b)] == b for i in range(len(d) - len(b) + 1))
    return any(sum(x != y for x, y in zip(d[i:i + window], b[j:j + window])) <= allowed
               for i in range(len(d) - window + 1) for j in range(len(b) - window + 1))


def norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def simhash(line):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(line.split(" "))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def deduplicated(docs):
    """id -> text; ids are distinct."""
    first = {}
    for i, text in sorted(docs, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            if norm(line):
                first.setdefault(norm(line), (i, at))
    sims = {n: simhash(n) for n in first}
    order = sorted(first, key=first.get)
    place = {n: k for k, n in enumerate(order)}

    def linked(a, b):
        a, b = order[a], order[b]
        longer = max(len(a), len(b))
        return (sims[a] ^ sims[b]).bit_count() <= 3 and edit_distance(a, b) <= longer * 10 // 100
    root = groups(list(range(len(order))), linked)
    out = {}
    for i, text in docs:
        out[i] = text if text is None else "\n".join(
            line for at, line in enumerate(text.split("\n"))
            if not norm(line) or first[order[root[place[norm(line)]]]] == (i, at))
    return out
