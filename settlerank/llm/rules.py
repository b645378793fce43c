"""Quality rules of documents, and of the hosts they come from.

Word and line counts of each whole text give its own failures. Failures are then summed by host (``source``), the
rates of all hosts give a beta prior by the method of moments, and each host's rate is shrunk by it. Documents of a host
whose shrunken rate is over ``max_host_rate`` are rejected with it.

Null and empty texts have no words and fail. Documents without a host are judged by their own text alone. Repeated rows
count as often as they occur. An empty table gives an empty result; other columns of the input are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from settlerank.llm.arrays import SPACE, parts, slices

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys) + 1, bool)
    flags[1:-1] |= same
    flags[:-2] |= same
    out = np.zeros(len(keys), bool)
    out[order] = flags[:-1]
    return out


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def text_counts(column) -> dict[str, np.ndarray]:
    """The counts of every text of an Arrow column."""
    found: dict[str, list] = {name: [np.zeros(0, np.int64)] for name in _COUNTS}
    for part in slices(column):
        data, n_words = part.data, part.n_words()
        doc_key = np.arange(part.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        word_doc = np.repeat(np.arange(part.n), n_words)
        inside = ~SPACE[data]
        found["n_words"].append(n_words)
        found["word_chars"].append(part.per_document(inside & ((data & 0xC0) != 0x80)))
        found["n_symbols"].append(part.per_document(_SYMBOL[data]))
        keys, at = part.windows(3)
        twice = at[_repeated(keys ^ doc_key[word_doc[at]])]
        covered = np.zeros(len(part.words), bool)
        for k in range(3):
            covered[twice + k] = True
        found["n_repeat_words"].append(np.bincount(word_doc[covered], minlength=part.n))
        feeds = np.flatnonzero(data == 10)
        begins = np.union1d(part.bounds[:-1], feeds + 1)
        begins = begins[begins < len(data)]
        line_doc = np.searchsorted(part.bounds, begins, "right") - 1
        ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, begins)], part.bounds[line_doc + 1])
        has_word = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, begins)
        begins, ends, line_doc = begins[has_word], ends[has_word], line_doc[has_word]
        again = _earlier(part.span_hash(begins, ends) ^ doc_key[line_doc])
        found["n_dup_lines"].append(np.bincount(line_doc[again], minlength=part.n))
    return {name: np.concatenate(values).astype(np.int64) for name, values in found.items()}


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", min_words: int = MIN_WORDS,
                   max_repeated_percent: int = MAX_REPEATED_PERCENT) -> DataFrame:
    """id, host, the counts and ``base_failed`` of every row."""
    schema = "_id " + dict(docs.dtypes)[id_col] + ", _host string, " + ", ".join(f"{c} long" for c in _COUNTS)

    def count(batches):
        for batch in parts(batches):
            counts = text_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()),
                                              *(pa.array(counts[c]) for c in _COUNTS)], ["_id", "_host", *_COUNTS])

    rows = docs.select(docs[id_col].alias("_id"), docs[host_col].cast("string").alias("_host"),
                       docs[text_col].alias("_text")).mapInArrow(count, schema)
    return rows.withColumn("base_failed", (F.col("n_words") < min_words)
                           | (100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")))


def host_rates(rules: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by a beta prior fitted to all hosts.

    With mean m and variance v of the hosts' rates, the prior has the weight m(1-m)/v - 1 (at least 1; hosts that all
    agree give the weight of a mean host). The moments are one row, so joining them to the hosts is a join to one row.
    """
    hosts = (rules.filter(F.col("_host").isNotNull()).groupBy("_host")
             .agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("_m"), F.var_pop(rate).alias("_v"), F.avg("host_docs").alias("_n"))
    weight = F.when(F.col("_v") > 0, F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1)) \
        .otherwise(F.col("_n"))
    prior = prior.select("_m", weight.alias("_w"))
    return hosts.crossJoin(F.broadcast(prior)).select(
        "_host", "host_docs", "host_failed",
        ((F.col("host_failed") + F.col("_m") * F.col("_w")) / (F.col("host_docs") + F.col("_w"))).alias("host_rate"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  max_host_rate: float = MAX_HOST_RATE, **limits) -> DataFrame:
    """Per row: id, the counts, ``base_failed``, the host's shrunken rate (null without a host) and ``kept``."""
    from settlerank.session import cut_lineage
    rules = cut_lineage(document_rules(docs, id_col, text_col, host_col, **limits), "rules")
    # stored, so that its size is known: few hosts are sent to the tasks, many are joined, and AQE can split a hot one
    joined = rules.join(cut_lineage(host_rates(rules), "hosts"), "_host", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate)
    return joined.select(F.col("_id").alias(id_col), *_COUNTS, "base_failed", F.col("_host").alias("host"), "host_rate",
                         kept.alias("kept"))
