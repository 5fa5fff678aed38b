"""The registered queries of this subpackage, with their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    byte_bpe, decontaminate, line_dedup, ngram_join, packing, quality, secret_scan, substring_dedup, suffix_dedup, token_counts, url_rules, variants, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabularies() -> tuple[str, str, str]:
    """The SentencePiece model, the byte-level ranks and their pattern that the quality rules use."""
    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility measures and verdict of every text of ``documents``."""
    return quality.fertility_rules(table(spark, sf_dir, "documents"), *vocabularies())


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of every text of ``documents`` that have a near duplicate elsewhere."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of ``documents`` under word_bpe_49k."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without the boilerplate lines of its host (``source``)."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")) \
        .select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))


OP4_SQL = r"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
on_pages AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT DISTINCT source, text, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
        FROM pages, unnest(string_split(text, chr(10))) AS t(x)
        WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))
  GROUP BY source, line),
plain AS (
  SELECT o.source, o.line FROM on_pages o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source
  WHERE o.n >= 3 AND o.n > 0.05::DOUBLE * t.pages),
lines AS (
  SELECT doc_id, source, x AS line, i, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
marked AS (
  SELECT l.*, p.line IS NOT NULL AND regexp_matches(l.line, '[^\x20\x09-\x0D]') AS drop,
         length(regexp_replace(l.line, '[\x20\x09-\x0D]+', '', 'g')) AS size
  FROM lines l LEFT JOIN plain p ON l.source IS NOT DISTINCT FROM p.source AND l.key = p.line),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n,
         coalesce(sum(size) FILTER (NOT drop), 0) AS left_size, sum(size) AS size,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop) AS left_text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN p.n > 0 AND p.left_size >= 0.5::DOUBLE * p.size THEN coalesce(p.left_text, '') ELSE d.text END AS text,
       coalesce(p.n_lines, 0)::BIGINT AS n_lines,
       CASE WHEN p.n > 0 AND p.left_size >= 0.5::DOUBLE * p.size THEN p.n ELSE 0 END::BIGINT AS n_dropped
FROM documents d LEFT JOIN per p USING (doc_id)
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded by byte_bpe_multi_50k and decoded again: counts and digests."""
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                     public_tokenizers.PATTERN, keep_ids=False, spaces_split=True)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``; the source owns a text, source and language stand for its repository."""
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    return secret_scan.digests(secret_scan.secret_spans(docs, repo_col="repository"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of ``benchmark`` that every text of ``documents`` holds, within a fifth of their words in edits."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under five-word shingle Jaccard of at least 0.8, one row per document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without the bytes of 200-byte strings that start twice: counts and digest."""
    out = suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL of ``pages``; the labels of the documents that pages show teach the association rules."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    shown = pages.withColumn("doc_id", F.expr("try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)', 1) AS bigint)"))
    labelled = shown.join(labels, "doc_id").select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return url_rules.judge_urls(pages, labelled)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` on the 16 leading components of the distinct ones, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, one run in 199 misspelt, with their more frequent form at one error and the root of their chain."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"), misspell=199)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, each with its end id, concatenated and cut into sequences of 2048 tokens: the pieces."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_fertility_rules": op2_fertility_rules,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_rules": op10_url_rules,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
}
