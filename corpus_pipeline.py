"""The corpus pipeline: documents to token ids in five stages, each one operator of ``cohortlens.llm``.

A stage takes (spark, docs, sf_dir) and returns the rows that the next one
gets, with the columns of ``documents``; the last returns the encoded rows.
Between stages rows are written as Parquet and read again, so a stage that
loses executors goes back to its own input only. Stages keep rows with null
texts or ids where their operator says so, and all extra columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from cohortlens.llm.common import saved
from cohortlens.llm.queries import table, vocabularies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser-fertility rules keep."""
    return quality.keep_good(docs, *vocabularies())


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars`` follows the text."""
    cut = line_dedup.drop_boilerplate(docs)
    length = F.when(F.col("__n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests and whether they decode to the text."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, spaces_split=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Tokenisers and edit distances are beyond SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs)
    return docs
