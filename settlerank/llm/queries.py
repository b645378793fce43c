"""The registered queries of the pipeline operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from settlerank.llm.fingerprints import edited_fingerprints
from settlerank.llm.html import extract_main_text
from settlerank.llm.lines import deduplicate_lines
from settlerank.llm.manifest import manifest, verified_rows
from settlerank.llm.pieces import decode_pieces, encode_pieces
from settlerank.llm.pii import pseudonymise
from settlerank.llm.records import read_records, write_records
from settlerank.llm.rules import quality_rules
from settlerank.llm.seeds import find_contamination
from settlerank.llm.setjoin import jaccard_groups
from settlerank.llm.tokens import new_cache, token_counts
from settlerank.llm.urls import url_filter
from settlerank.llm.whitening import fit, whiten
from settlerank.session import shared_folder

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return add


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap; clean documents have none."""
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that its figures are those of a whole corpus."""
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), new_cache(spark))


@query("op3_pieces")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and compare with the text."""
    docs, model = _table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model")
    coded = encode_pieces(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), model)
    return decode_pieces(coded, model, keep=["text_crc32"]).select(
        "doc_id", "n_tokens", "ids_crc32", (F.crc32("text") == F.col("text_crc32")).alias("round_trip"))


@query("op4_url_filter")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


@query("op5_token_records")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/settlerank/records-{uuid.uuid4().hex}"
    write_records(_table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"))
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op6_pseudonyms")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), "production-key").select("doc_id", "text", "n_pseudonyms")


@query("op7_fuzzy_lines")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(_table(spark, sf_dir, "documents"), by="grams").select("doc_id", "text", "n_removed_lines")


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id
"""


@query("op9_jaccard_join", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS t
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, source, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         (len([x for x in lines if regexp_matches(x, '[^\x20\x09-\x0D]')])
          - len(list_distinct([x for x in lines if regexp_matches(x, '[^\x20\x09-\x0D]')])))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM base b LEFT JOIN rep ON rep.doc_id = b.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, count(*) AS n, count_if(base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(n) AS an FROM hosts),
rates AS (
  SELECT source, (f + m * pw) / (n + pw) AS rate
  FROM hosts, (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE an END AS pw FROM prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept
FROM judged LEFT JOIN rates USING (source)
"""


@query("op10_host_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")



OP11_SQL = r"""
WITH RECURSIVE enc AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') ||
         coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
         xor(4294967295, list_reduce([4294967295] || [ascii(c) FOR c IN string_split(doc_id::VARCHAR, '')],
           lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 3 = 0 AS changed
  FROM documents),
hashed AS MATERIALIZED (
  SELECT doc_id, g, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN changed THEN sha256(front || coalesce(strlen(text) || ':' ||
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS low
  FROM enc),
leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
tree AS (
  SELECT g, 0 AS h, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM leaf
  UNION ALL
  SELECT g, h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, h, i // 8),
tops AS MATERIALIZED (SELECT g, h, d, row_number() OVER (ORDER BY g) - 1 AS i FROM tree WHERE n = 1),
top_tree AS (
  SELECT 0 AS h, i, d, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top_tree WHERE n > 1 GROUP BY h, i // 8),
runs AS MATERIALIZED (
  SELECT g, h, i // 8 AS run, list(d ORDER BY i) AS ds FROM tree WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, h, i // 8, list(d ORDER BY i) FROM top_tree WHERE n > 1 GROUP BY ALL),
place AS (
  SELECT leaf.g, leaf.i, r.h, leaf.i // (8 ^ r.h)::BIGINT % 8 AS pos, ds
  FROM leaf JOIN runs r ON r.g = leaf.g AND r.run = leaf.i // (8 ^ (r.h + 1))::BIGINT
  UNION ALL
  SELECT leaf.g, leaf.i, tops.h + r.h, tops.i // (8 ^ r.h)::BIGINT % 8, ds
  FROM leaf JOIN tops ON tops.g = leaf.g JOIN runs r ON r.g IS NULL AND r.run = tops.i // (8 ^ (r.h + 1))::BIGINT),
side AS MATERIALIZED (
  SELECT g, i, h, array_to_string(ds[1:pos], '') AS l, array_to_string(ds[pos + 2:], '') AS r FROM place),
proof AS (SELECT g, i, sha256(string_agg(l || r, '' ORDER BY h)) AS proof_sha256 FROM side GROUP BY g, i),
fold AS (
  SELECT g, i, 0 AS h, coalesce(low, leaf) AS d FROM leaf
  UNION ALL
  SELECT g, i, h + 1, sha256(l || d || r) FROM fold JOIN side USING (g, i, h)),
folded AS (SELECT g, i, arg_max(d, h) AS d FROM fold GROUP BY g, i),
root AS (SELECT d FROM top_tree WHERE n = 1)
SELECT doc_id, leaf, tops.d AS subroot, root.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       folded.d AS folded_root, folded.d = root.d AS verified
FROM leaf JOIN tops ON tops.g = leaf.g CROSS JOIN root JOIN folded ON folded.g = leaf.g AND folded.i = leaf.i
LEFT JOIN proof ON proof.g = leaf.g AND proof.i = leaf.i
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows is checked in a changed form: with the text's A-Z in lower case."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verified_rows(manifest(_table(spark, sf_dir, "documents"), other={"text": low}, where=changed))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return whiten(rows, fit(rows))


@query("op13_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))
