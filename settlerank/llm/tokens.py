"""Token counts with a cache of digests.

A text's key is a digest of its normalised content and of the tokenizer file. Known keys take their stored count; of
the others each distinct one is encoded once and appended to the cache, a Parquet table that later runs join again.

Normalising drops only what the tokenizer drops itself (runs of ASCII blanks become one, outer ones go), so equal keys
have equal counts. In a task, texts are cut at blanks, which no token crosses, and each different word goes through the
tokenizers library once for as long as it stays in a bounded table.

A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get a row. Empty tables give empty results. Clashing
column names do not matter: only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from settlerank.llm.arrays import parts, plain

#: Words kept between batches by one Python worker, and the longest word kept.
KEPT_WORDS, KEPT_CHARS = 400_000, 64
#: Control characters at which str.split parts words but the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
_PART = "\x01"


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer's version: a digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class WordEncoder:
    """What the tokenizers library gives for each word of a text, remembered in a bounded table.

    A word's value is its number of ids (``width`` 0) or the ids themselves, as little-endian integers of ``width`` bytes.
    Words go to the library in lines of 100, parted by a control character that has an id of its own; tokenizers in which
    it has none, and words that hold it, are encoded one by one. If the tokenizer lower-cases and always parts a last
    full stop or comma from letters, as probes show, then Latin-1 words are looked up without both.
    """

    def __init__(self, path: str, width: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.width, self.known = Tokenizer.from_file(path), width, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        part, a, b = self._ids([_PART, "a", "b"])
        probes = self._ids(["Ab", "ab", "\u00c9", "\u00e9", "ab.", ".", "ab,", ",", "\u00e9."])
        self.folds = (probes[0] == probes[1] and probes[2] == probes[3] and probes[4] == probes[1] + probes[5]
                      and probes[6] == probes[1] + probes[7] and probes[8] == probes[3] + probes[5])
        self.part = part[0] if len(part) == 1 and self._ids([f"a {_PART} b"])[0] == a + part + b else None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _value(self, ids: list[int]):
        return np.array(ids, f"<u{self.width}").tobytes() if self.width else len(ids)

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.part is None or _PART in w]
        words = [w for w in words if self.part is not None and _PART not in w]
        known, width, part = self.known, self.width, self.part
        for at in range(0, len(words), 4000):
            lines = [words[k:k + 100] for k in range(at, min(at + 4000, len(words)), 100)]
            for line, ids in zip(lines, self._ids([f" {_PART} ".join(line) for line in lines])):
                values, a = self._value(ids), 0
                cuts = [i for i, x in enumerate(ids) if x == part]
                cuts.append(len(ids))
                for word, b in zip(line, cuts):
                    known[word] = values[width * a:width * b] if width else b - a
                    a = b + 1
        for at in range(0, len(alone), 1000):
            for word, ids in zip(alone[at:at + 1000], self._ids(alone[at:at + 1000])):
                known[word] = self._value(ids)

    def words(self, text: str) -> list[str]:
        """The text cut at blanks that no token crosses, in lower case where that changes nothing."""
        if any(c in text for c in _ODD):
            return [w for w in text.translate(_BLANKS).split(" ") if w]
        if self.folds and _latin(text):
            lower = text.lower()
            text = text if any(s in lower for s in self.special) else lower
        return text.split()

    def encode(self, texts: Iterable[str]) -> list[list]:
        """For each text, the values of its words in order."""
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        texts = [self.words(t) for t in texts]
        missing = set().union(*texts).difference(known)
        if self.folds:
            bases = {w: w[:-1] for w in missing if w[-1] in ".," and w[-2:-1].isalpha() and _latin(w)}
            needed = {".", ",", *bases.values(), *(missing - bases.keys())}
            self._learn([w for w in needed if w not in known])
            for word, base in bases.items():
                known[word] = known[base] + known[word[-1]]
        else:
            needed = missing
            self._learn(list(missing))
        out = [list(map(known.__getitem__, words)) for words in texts]
        for word in (w for some in (missing, needed) for w in some if len(w) > KEPT_CHARS):
            known.pop(word, None)
        return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, width: int = 0) -> WordEncoder:
    """One per Python worker, kept between tasks."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]


def content_digest(text: bytes, version: str) -> bytes:
    """128 bits of the normalised text and the tokenizer's version."""
    return hashlib.md5(version.encode() + b":" + b" ".join(text.split())).digest()


def count_table(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache; an empty one where nothing is stored yet."""
    schema = "digest binary, n_tokens long"
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; new texts' counts are appended to ``cache_path``.

    Only ids and digests are shuffled to find the distinct misses (one row stands for each, by a minimum that is combined
    before the shuffle); texts move once, each to the task of its own row, so that thousands of copies of one text do not
    meet. A row is named by its id and the hash of its text, so rows with null or shared ids are as any others. Two runs that append the same text at once leave two equal rows; the reader takes one.
    """
    from settlerank.session import cut_lineage
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"),
                       F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_tag"))

    def measure(batches):
        for batch in parts(batches):
            texts = plain(batch.column(1)).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([content_digest(t, version) for t in texts], pa.binary()),
                 pa.array([len(t) for t in texts], pa.int64())], ["_id", "_tag", "digest", "n_bytes"])

    keyed = cut_lineage(rows.mapInArrow(measure, f"_id {kind}, _tag long, digest binary, n_bytes long"), "digests")
    first = (keyed.groupBy("digest").agg(F.min(F.struct("_id", "_tag")).alias("_first"))
             .join(count_table(spark, cache_path), "digest", "left_anti"))
    same_row = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_tag") == F.col("_first._tag"))
    misses = rows.join(first, same_row).select("digest", "_text")

    def encode(batches):
        words = encoder(tokenizer_path)
        for batch in parts(batches, 500):
            texts = plain(batch.column(1))
            # another row with this id and hash may have another text, however unlikely
            same = [content_digest(t, version) == d for t, d in
                    zip(texts.cast(pa.binary()).to_pylist(), batch.column(0).to_pylist())]
            counts = [sum(c) for c in words.encode(texts.filter(pa.array(same)).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same)), pa.array(counts, pa.int64())],
                                             ["digest", "n_tokens"])

    misses.mapInArrow(encode, "digest binary, n_tokens long").write.mode("append").parquet(cache_path)
    # stored, so that the join deals both sides anew and AQE can split a digest with very many rows
    stored = cut_lineage(count_table(spark, cache_path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
                         .join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    return keyed.join(stored, "digest").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def new_cache(spark: SparkSession) -> str:
    from settlerank.session import shared_folder
    return f"{shared_folder(spark)}/settlerank/token-counts-{uuid.uuid4().hex}"
