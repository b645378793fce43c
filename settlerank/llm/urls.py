"""URL filter: path rules first, then naive Bayes over segmented host and path words.

1. A url is cut into host and path. Listed rules fit a host, its subdomains and a path prefix; the longest rule wins.
2. Words are counted over the titles of all pages and the words that urls part themselves. Each distinct host name that
   runs words together is split into the most probable words (Viterbi over unigram probabilities; letters that no word covers
   cost more than any word). Candidates come from joining the substrings of host names to the word counts, so no
   vocabulary is cut or sent around.
3. Seed words in a segmented host label it as blocked, the other hosts are the background. The multinomial model counts
   hashed words (``FEATURES`` buckets, so its size is fixed) of hosts and paths over all pages, smoothed by one over the buckets
   that occur; with rows of one kind only, no url is blocked by it.
4. The sum of log odds of a url's words decides where no rule does.

Null urls, or such without ``://``, have an empty host and path; nothing fits them and they are allowed. Repeated rows each
get a row. Equal splits go to the one with the longer last word. Empty tables give empty results. Only the id, the
url and the title are read, so clashing columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from settlerank.llm.arrays import parts, plain

#: Rules of the contract: verdict, host, path prefix.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words that label a host as unwanted for training.
SEEDS = ["casino", "poker", "bets", "betting", "pills", "viagra", "porn", "adult", "xxx", "spam", "ads", "warez", "loans"]
FEATURES = 1 << 16
#: What a part of a host name can have.
LONGEST_WORD = 63


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. The list is a parameter of a few lines, tried in order of length."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(of + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over the titles of all pages and over words that urls part by themselves."""
    title = F.regexp_extract(F.col("_html"), r"(?is)<title[^>]*>([^<]*)", 1)
    words = F.concat(_letters(F.coalesce(title, F.lit(""))), _letters(F.col("_path")),
                     F.when(F.col("_host").contains("-"), _letters(F.col("_host"))).otherwise(F.array().cast("array<string>")))
    return (pages.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST_WORD)
            .groupBy("word").agg(F.count("*").alias("n")))


def split_name(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name; a letter that no word covers costs ``unknown`` and joins its neighbours."""
    best = [(0.0, 0, True)] + [(math.inf, 0, False)] * len(name)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            price, known = (cost[word], True) if word in cost else (unknown, False) if end - start == 1 else (math.inf, False)
            if best[start][0] + price < best[end][0]:
                best[end] = (best[start][0] + price, start, known)
    words, end, loose = [], len(name), ""
    while end:
        _, start, known = best[end]
        if known:
            if loose:
                words.append(loose)
            words, loose = words + [name[start:end]], ""
        else:
            loose = name[start:end] + loose
        end = start
    return ([loose] if loose else []) + words[::-1]


def segment_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """For each distinct host: its words. Parts of a host are at most 63 letters, so a group has a bounded size."""
    names = (hosts.select(F.explode(_letters(F.col("_host"))).alias("name")).distinct())
    n = F.length("name")
    spans = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), n - i + 1)), lambda k: F.substring(F.col("name"), i, k)))
    pieces = names.select("name", F.explode(F.array_distinct(F.flatten(spans))).alias("word"))
    total = counts.agg(F.sum("n").alias("total"))               # one row
    found = (pieces.join(counts, "word").groupBy("name")
             .agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known")))
    priced = names.join(found, "name", "left").crossJoin(F.broadcast(total))

    def split(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                total = max(row["total"] or 1, 1)
                # a word costs its surprise; each one also pays one doubling, so that rare fragments do not win
                cost = {w: math.log(total / c) + math.log(2) for w, c in (row["known"] or [])
                        if len(w) > 1 or w in "ai"}
                out.append(split_name(row["name"], cost, math.log(total) + 10))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    split_names = priced.select("name", "known", "total").mapInArrow(split, "name string, words array<string>")
    return (hosts.select("_host", F.posexplode(_letters(F.col("_host"))).alias("at", "name"))
            .join(split_names, "name").groupBy("_host")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]))
                 .alias("_words")))


def feature(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % FEATURES


def url_tokens(words: list[str] | None, path: str, left_out: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The features of a url. Numbers in a path are one token, since each page has its own."""
    cut = "".join(c if c.isalnum() else " " for c in path.lower()).split()
    return [f"h:{w}" for w in words or [] if w not in left_out] + ["p:#" if w.isdigit() else f"p:{w}" for w in cut]


def _feature_ids(hosts: list[list[str] | None], paths: list[str], left_out: frozenset[str] = frozenset()) -> list[np.ndarray]:
    found = [url_tokens(words, path, left_out) for words, path in zip(hosts, paths)]
    return [np.fromiter((feature(t) for t in tokens), np.int64, len(tokens)) for tokens in found]


def train(rows: DataFrame, seeds: list[str] = SEEDS, seed_features: bool = True) -> tuple[np.ndarray, float]:
    """Log odds (blocked to allowed) of each feature bucket, and of the classes, from all rows.

    Counts are smoothed by one over the buckets that occur; others have no say. Without ``seed_features`` the seeds label
    rows but are not features, so that what is learned comes from the words beside them. Without rows of both kinds nothing can be told
    apart, and all log odds are 0.

    Tasks add up their rows into the fixed buckets before the shuffle; the driver gets at most 2 x FEATURES + 2 sums.
    """
    marked = set(seeds)
    left_out = frozenset() if seed_features else frozenset(seeds)

    def count(batches):
        sums, docs = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for batch in parts(batches):
            hosts = batch.column(0).to_pylist()
            for words, ids in zip(hosts, _feature_ids(hosts, plain(batch.column(1)).to_pylist(), left_out)):
                kind = int(not marked.isdisjoint(words or []))
                np.add.at(sums[kind], ids, 1)
                docs[kind] += 1
        for kind in (0, 1):
            at = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) + 1, kind), pa.int32()), pa.array(np.append(at, -1), pa.int32()),
                 pa.array(np.append(sums[kind][at], docs[kind]), pa.int64())], ["kind", "bucket", "n"])

    found = (rows.select("_words", "_path").mapInArrow(count, "kind int, bucket int, n long")
             .groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect())
    sums, docs = np.zeros((2, FEATURES)), np.zeros(2)
    for r in found:
        if r["bucket"] < 0:
            docs[r["kind"]] += r["n"]
        else:
            sums[r["kind"], r["bucket"]] += r["n"]
    if not docs.all():
        return np.zeros(FEATURES, np.float32), float(-np.inf if docs[0] else 0.0)
    occurs = sums.sum(axis=0) > 0
    share = (sums + 1) / (sums.sum(axis=1, keepdims=True) + occurs.sum())
    odds = np.where(occurs, np.log(share[1]) - np.log(share[0]), 0.0)
    return odds.astype(np.float32), float(np.log(docs[1] / docs[0]))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: list[str] = SEEDS,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html", seed_features: bool = True) -> DataFrame:
    """id, host, path, rule, verdict, the words of the host and the score of every row."""
    from settlerank.session import cut_lineage
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].alias("_id"), host_of(pages[url_col]).alias("_host"),
                        path_of(pages[url_col]).alias("_path"), pages[html_col].alias("_html"))
    hosts = cut_lineage(segment_hosts(rows.select("_host").distinct(), word_counts(rows)), "hosts")
    cut = rows.drop("_html").join(hosts, "_host", "left")
    odds, prior = train(cut, seeds, seed_features)
    left_out = frozenset() if seed_features else frozenset(seeds)
    model = spark.sparkContext.broadcast(odds)                  # FEATURES numbers, whatever the input

    def score(batches):
        for batch in parts(batches):
            ids = _feature_ids(batch.column(2).to_pylist(), plain(batch.column(1)).to_pylist(), left_out)
            scores = [float(model.value[x].sum() + prior) if len(x) else prior for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())],
                                             ["_host", "_path", "_words", "_id", "score"])

    schema = f"_host string, _path string, _words array<string>, _id {dict(pages.dtypes)[id_col]}, score double"
    scored = cut.select("_host", "_path", "_words", "_id").mapInArrow(score, schema)
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    method = F.when((F.col("score") > 0) & (F.col("_host") != ""), "block").otherwise("allow")
    return scored.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                         rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                         F.col("_words").alias("host_words"), "score")
