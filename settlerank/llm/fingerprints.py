"""Fingerprints of documents: the k smallest hashes of their word shingles, in DataFrame functions only.

A text's words are its runs of anything but ASCII white space, in lower case; its shingles are all runs of ``WIDTH`` words, and of
a text with fewer words the whole of them. The sketch is the sorted array of the ``K`` smallest distinct 64-bit hashes. Two
sketches tell the share of common shingles, how far one text holds the other, and how many distinct shingles each has. A sketch of
several parts is the K smallest hashes of their sketches, so sketches of parts, or of whole sources, are merged without the texts.

Of sets of up to K shingles the figures are exact (but for chance hits of hashes); beyond, the likeness has a standard error of
at most 0.5 / sqrt(K), 0.045.

Defined results: a null text counts as empty; a text without words has an empty sketch and the fingerprint ``""``; two empty sketches
have likeness and containment 1, an empty and another 0. Rows with null or repeated ids keep a row each. An empty table gives an empty result.
A task holds the words of one text at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from settlerank.session import cut_lineage

WIDTH = 5
K = 128
#: Sketches that one task merges at a time.
FAN_IN = 32
#: Rows of one range of documents in order, and the most ranges.
RANGE_ROWS, MOST_RANGES = 2_000, 1 << 16
#: Copies of one row that are written out by one task.
_COPIES = 1 << 16


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """A hash for every run of ``width`` of the word hashes; one of all of them where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))) \
        .otherwise(F.array().cast("array<bigint>"))


def with_sketch(rows: DataFrame, text_col: str, name: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """The rows and the sketch of a text column."""
    words = rows.withColumn("__words", word_hashes(F.col(f"`{text_col}`")))
    return words.withColumn(name, bottom_k(shingle_hashes(F.col("__words"), width), k)).drop("__words")


def as_text(sketch: Column) -> Column:
    """The fingerprint: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def from_text(fingerprint: Column) -> Column:
    """The sketch of a fingerprint."""
    starts = F.sequence(F.lit(0), F.floor(F.length(fingerprint) / 16).cast("int") - 1)
    # two halves of 32 bits, since 16 digits do not fit in a signed number
    def half(at: Column) -> Column:
        return F.conv(F.substring(fingerprint, at, F.lit(8)), 16, 10).cast("long")
    read = F.transform(starts, lambda i: F.shiftleft(half(i * 16 + 1), 32).bitwiseOR(half(i * 16 + 9)))
    return F.when(F.length(fingerprint) > 0, read).otherwise(F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """The estimated resemblance: the share of the k smallest hashes of both that both have."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the shingles of ``a`` that ``b`` has too, from the hashes up to the end of the shorter reach."""
    def reach(s: Column) -> Column:
        return F.when(F.size(s) < k, F.lit((1 << 63) - 1)).otherwise(F.array_max(s))
    end = F.least(reach(a), reach(b))
    own = F.filter(a, lambda h: h <= end)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, b)) / F.size(own)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    share = (F.array_max(sketch).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def merge_sketches(rows: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """keys, sketch: one sketch for each key, of all its parts.

    Parts are merged some dozens at a time, dealt out by their own hashes, until each key has one; a key with a third of all rows takes
    some more rounds (their number grows with the logarithm of its parts), and no task gets more of it than others.
    """
    parts = cut_lineage(rows.select(*keys, F.col(sketch_col).alias("sketch")), "sketches")
    while True:
        sizes = parts.groupBy(*keys).agg(F.count("*").alias("__n"))
        most = sizes.agg(F.max("__n")).first()[0] or 0
        if most <= FAN_IN:
            break
        dealt = F.pmod(F.xxhash64("sketch", F.monotonically_increasing_id()), F.lit(-(-most // FAN_IN)))
        parts = cut_lineage(_merge(parts.withColumn("__deal", dealt), [*keys, "__deal"], k).drop("__deal"), "sketches")
    return _merge(parts, keys, k)


def _merge(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    return parts.groupBy(*keys).agg(F.collect_list("sketch").alias("sketch")).withColumn("sketch", bottom_k(F.flatten("sketch"), k))


# -- each document beside the next one -------------------------------------------------------------------------

_KEY = "struct<id:{kind},tag:bigint>"


def _range_bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """The first (id, tag) of each of at most that many ranges of the keys, in order; null ids come first."""
    dealt = keys.repartitionByRange(ranges, "id", "tag").select(F.struct("id", "tag").alias("key"), F.spark_partition_id().alias("part"))
    first = [r["key"] for r in dealt.groupBy("part").agg(F.min("key").alias("key")).collect()]
    return sorted(((k["id"], k["tag"]) for k in first), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


def _range_of(key: Column, bounds: list[tuple], kind: str) -> Column:
    """The number of the range that a key falls in: looked up among every 256th bound, then among the 256 from there."""
    step, of_key = 1 << 8, _KEY.format(kind=kind)

    def literal(value: list, schema: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), schema)

    named = [{"id": i, "tag": t} for i, t in bounds]
    coarse = literal([named[at] for at in range(step, len(named), step)], f"array<{of_key}>")
    fine = literal([named[at + 1:at + step] for at in range(0, len(named), step)], f"array<array<{of_key}>>")
    chunk = F.size(F.filter(coarse, lambda b: b <= key))
    return chunk * step + F.size(F.filter(F.get(fine, chunk), lambda b: b <= key))


def _without_copies(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """id, tag, text, copies: rows equal in id and text once, with their number. Only texts of repeated rows are grouped."""
    repeated = cut_lineage(keys.groupBy("id", "tag").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated-rows")
    once = docs.withColumn("copies", F.lit(1).cast("long"))
    if repeated.isEmpty():
        return once
    same = docs["id"].eqNullSafe(repeated["id"]) & (docs["tag"] == repeated["tag"])
    groups = docs.join(repeated, same, "left_semi").groupBy("id", "tag").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return once.join(repeated, same, "left_anti").unionByName(groups)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id, text, sketch, next_text, next_sketch: each document and the next one by id, the last one beside the first.

    Null ids come first; rows that share an id follow by the hash of their text, equal rows one after the other. Texts are
    shuffled once, to ranges of documents in order. Ranges are cut by (id, hash), of which equal rows were taken out before, so no id makes a
    large range. Each range also gets the first document of the next one. The driver holds the ranges' first keys.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    keys = cut_lineage(rows.select("id", "tag"), "document-keys")
    ranges = min(MOST_RANGES, -(-keys.count() // RANGE_ROWS))
    if not ranges:
        none = rows.select(F.col("id").alias(id_col), "text", "text", "text", "text").toDF(id_col, "text", "sketch", "next_text", "next_sketch")
        return none.select(id_col, "text", *[F.lit(None).cast("array<bigint>").alias(c) if "sketch" in c else c for c in none.columns[2:]])
    bounds = _range_bounds(keys, ranges)
    rows = _without_copies(rows, keys)
    placed = rows.withColumn("range", _range_of(F.struct("id", "tag"), bounds, kind)).withColumn("tail", F.lit(False))
    heads = docs.sparkSession.createDataFrame([(i, t, (at - 1) % len(bounds)) for at, (i, t) in enumerate(bounds)],
                                              f"hid {kind}, htag bigint, before int")
    tails = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("hid")) & (F.col("tag") == F.col("htag")))     # at most MOST_RANGES keys
    tails = tails.select("id", "tag", "text", "copies", F.col("before").alias("range"), F.lit(True).alias("tail"))
    both = with_sketch(placed.unionByName(tails), "text", "sketch", k, width)
    order = Window.partitionBy("range").orderBy("tail", "id", "tag")
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter("NOT tail")
    names = ["id", "text", "sketch", "next_text", "next_sketch"]
    # of several equal rows, all but the last have themselves as the next
    spread = F.explode(F.concat(F.array(F.struct(F.lit(1).cast("long").alias("n"), F.lit(False).alias("own"))), F.transform(
        F.when(F.col("copies") > 1, F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(_COPIES).cast("long")))
        .otherwise(F.array().cast("array<bigint>")),
        lambda at: F.struct(F.least(F.lit(_COPIES).cast("long"), F.col("copies") - at).alias("n"), F.lit(True).alias("own")))))
    each = both.select(*names, spread.alias("c"))
    each = each.select(*names, "c.own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.n"))).alias("copy"))
    return each.select(F.col("id").alias(id_col), "text", "sketch", F.when(F.col("own"), F.col("text")).otherwise(F.col("next_text")).alias("next_text"),
                       F.when(F.col("own"), F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4, k: int = K,
                        width: int = WIDTH) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last characters, one in ``share``, replaced by as many of the next document's first ones.
    """
    rows = beside_next(docs, id_col, text_col, k, width).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select(id_col, "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch", k, width)
    return rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
                       as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
