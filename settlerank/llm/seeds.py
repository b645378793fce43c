"""Benchmark decontamination with spaced seeds.

A text's tokens are its words in lower case, parted by blanks and ASCII punctuation. Over each window of 13 tokens lie 13
fixed masks: mask s ignores the positions s, s + 1, s + 3 and s + 9 (modulo 13). These differences occur once each, so any
two positions are ignored together by a mask, and **every window with at most two substitutions hits** at least one.
The hash of the nine tokens that a mask sees is looked up among those of the benchmark: first in a bit array of fixed
size that is sent to the tasks, then by a join on hash and mask.

Each hit names an alignment of a test item and a document; the many hits of one overlap are one alignment. Documents that have
one are read again, and around it the two are compared token by token: every run of windows with at most two
substitutions is taken as overlap. Items shorter than a window have to occur as a whole: a
short item's hash is over all its tokens. Items without a token match nothing.

A document is contaminated by an item if it holds such an overlap. Null and empty texts hold none. Repeated rows (one id, equal
or different texts) give one result row a pair of ids, the widest overlap. Rows with a null id are searched as well, and
their id stays null. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlerank.llm.arrays import PUNCTUATED, mix, parts, plain, slices
from settlerank.llm.sketches import bucket_counts

WINDOW, ALLOWED = 13, 2
#: A perfect difference set modulo 13.
IGNORED = (0, 1, 3, 9)
#: The bit array has 2**FILTER_BITS bits, and each hash sets PROBES of them.
FILTER_BITS, PROBES = 24, 3
#: Document ids fall into so many buckets when documents are read again.
BUCKETS = 1 << 20

_STEP = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
_MASK_SALT = mix(np.arange(101, 101 + WINDOW, dtype=np.uint64))


def mask_hashes(words: np.ndarray) -> np.ndarray:
    """One row per mask, one column per window of the words."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros((WINDOW, 0), np.uint64)
    terms = np.stack([words[k:k + n] * _STEP[k] for k in range(WINDOW)])
    whole = terms.sum(axis=0, dtype=np.uint64)
    return np.stack([mix(whole - sum(terms[(s + i) % WINDOW] for i in IGNORED) + _MASK_SALT[s]) for s in range(WINDOW)])


def whole_hash(words: np.ndarray) -> int:
    """Of all tokens of a short item."""
    return int(window_hash(words, len(words))[0])


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(31) + words[k:k + n])
    return out


def token_slices(column):
    """Slices of an Arrow column with the hashes of its normalised tokens."""
    import pyarrow.compute as pc
    return slices(pc.utf8_lower(plain(column)), breaks=PUNCTUATED)


def _place(hashes: np.ndarray, probe: int) -> np.ndarray:
    return (mix(hashes + np.uint64(probe)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """key (of item and text), item, all its tokens: one row for each item that has tokens."""
    kind = dict(benchmark.dtypes)[item_col]

    def tokens(batches):
        for batch in parts(batches, 500):
            found = [part.words[a:b].tobytes() for part in token_slices(batch.column(2))
                     for a, b in zip(part.first_word[:-1], part.first_word[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["key", "item", "tokens"])

    rows = benchmark.select(F.xxhash64(benchmark[item_col], benchmark[text_col]).alias("key"), benchmark[item_col].alias("item"),
                            benchmark[text_col].alias("text"))
    return rows.mapInArrow(tokens, f"key long, item {kind}, tokens binary").filter(F.length("tokens") > 0).distinct()


def _item_hashes(items: DataFrame) -> DataFrame:
    """hash, key, place of the window in the item, tokens of the item: one row for each window and mask."""
    def hashes(batches):
        for batch in parts(batches, 500):
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(tokens, np.uint64)
                if len(words) < WINDOW:
                    found, at = np.array([whole_hash(words)], np.uint64), np.zeros(1, np.int64)
                else:
                    found = mask_hashes(words)
                    at, found = np.tile(np.arange(found.shape[1]), WINDOW), found.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.full(len(found), key, np.int64)), pa.array(at),
                     pa.array(np.full(len(found), len(words), np.int64))], ["hash", "key", "item_at", "length"])
    return items.select("key", "tokens").mapInArrow(hashes, "hash long, key long, item_at long, length long")


def overlaps(doc: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Runs of overlap of an item and a stretch of a document, item token i lying on document token i + shift.

    (first token in the document, tokens, substitutions) of every run of windows with at most ALLOWED substitutions.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return []
    differ = (item[low:high] != doc[low + shift:high + shift]).astype(np.int64)
    if len(item) < WINDOW:
        return [(shift, len(item), 0)] if high - low == len(item) and not differ.any() else []
    if high - low < WINDOW:
        return []
    sums = np.concatenate([[0], np.cumsum(differ)])
    good = np.concatenate([[False], sums[WINDOW:] - sums[:-WINDOW] <= ALLOWED, [False]])
    edges = np.flatnonzero(good[1:] != good[:-1])
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        end = b + WINDOW - 1
        while differ[a]:                    # a substitution at the rim is not part of the overlap
            a += 1
        while differ[end - 1]:
            end -= 1
        out.append((low + shift + a, end - a, int(sums[end] - sums[a])))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, first_token, n_tokens, n_substituted) for each document and item that overlap: the longest overlap.

    Documents are not shuffled, only their hits. Hits of one passage in very many documents have one hash: the join is a plain
    equi-join that AQE splits, and its other side has the few items. The documents with an alignment are found again by
    their bucket, of which there are at most BUCKETS, and then joined exactly.
    """
    from settlerank.session import cut_lineage
    items = cut_lineage(_items(benchmark, item_col, item_text_col), "test-items")
    hashes = cut_lineage(_item_hashes(items), "test-hashes")
    seen = bucket_counts(hashes.select("hash"), lambda b: [np.concatenate(
        [_place(b.column(0).to_numpy().view(np.uint64), k) for k in range(PROBES)])], FILTER_BITS) > 0
    widths = [r["length"] for r in hashes.filter(F.col("length") < WINDOW).select("length").distinct().collect()]
    passed = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))     # 2**FILTER_BITS bits, whatever the input
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("tag"), docs[text_col].alias("text"))

    def search(batches):
        bits = np.unpackbits(passed.value).astype(bool)
        for batch in parts(batches, 1000):
            for part in token_slices(batch.column(2)):
                words = part.words
                word_doc = np.repeat(np.arange(part.n), part.n_words())
                found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for width in (WINDOW, *widths):
                    for row in mask_hashes(words) if width == WINDOW else window_hash(words, width)[None, :]:
                        at = np.flatnonzero(bits[_place(row, 0)])
                        for k in range(1, PROBES):
                            at = at[bits[_place(row[at], k)]]
                        at = at[word_doc[at] == word_doc[at + width - 1]]
                        found.append(row[at])
                        places.append(at)
                found, places = np.concatenate(found), np.concatenate(places)
                doc = word_doc[places]
                index = pa.array(part.first + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), batch.column(0).take(index), batch.column(1).take(index),
                     pa.array((places - part.first_word[doc]).astype(np.int64))], ["hash", "doc", "tag", "at"])

    hits = rows.mapInArrow(search, f"hash long, doc {kind}, tag long, at long")
    aligned = cut_lineage(hits.join(hashes.drop("length"), "hash")
                          .select("doc", "tag", "key", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "alignments")
    asked = aligned.join(items, "key").groupBy("doc", "tag").agg(
        F.collect_list(F.struct("item", "shift", "tokens")).alias("asked")).toDF("_doc", "_tag", "asked")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    near = rows.withColumn("bucket", bucket("doc")).join(
        F.broadcast(aligned.select(bucket("doc").alias("bucket")).distinct()), "bucket", "left_semi")
    near = near.join(asked, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))).select("doc", "text", "asked")

    def verify(batches):
        for batch in parts(batches, 200):
            lists = batch.column(2)
            for part in token_slices(batch.column(1)):
                keep, names, out = [], [], []
                for i in range(part.n):
                    words = part.words[part.first_word[i]:part.first_word[i + 1]]
                    for one in lists[part.first + i].as_py():
                        for found in overlaps(words, np.frombuffer(one["tokens"], np.uint64), one["shift"]):
                            keep.append(part.first + i)
                            names.append(one["item"])
                            out.append(found)
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(names, lists.type.value_type.field("item").type),
                     *(pa.array(c, pa.int64()) for c in columns)], ["doc", "item", "first_token", "n_tokens", "n_substituted"])

    found = near.mapInArrow(verify, f"doc {kind}, item {item_kind}, first_token long, n_tokens long, n_substituted long")
    longest = F.max_by(F.struct("first_token", "n_tokens", "n_substituted"),
                       F.struct("n_tokens", -F.col("n_substituted"), -F.col("first_token"))).alias("_o")
    return found.groupBy("doc", "item").agg(longest).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "_o.first_token", "_o.n_tokens", "_o.n_substituted")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **names) -> DataFrame:
    """The rows that overlap with no item, each judged by its own text, whatever its id."""
    named = docs.withColumn("__row", F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("tag")))
    found = find_contamination(named, benchmark, "__row", text_col, **names).select(F.col("__row").alias("__found")).distinct()
    return named.join(found, F.col("__row").eqNullSafe(F.col("__found")), "left_anti").select(docs.columns)
