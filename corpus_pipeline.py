"""The corpus pipeline: five stages from raw documents to tokens, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from thicket.llm import byte_bpe, line_dedup, minhash, mixing, quality_rules
from thicket.llm.queries import BPE_RANKS
from thicket.llm.storage import discard, recorded, written

#: Word shingles of near-duplicate detection, and the similarity in per cent.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Null and empty texts are rejected; repeated rows are judged alike; an empty table stays empty."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go from the texts; all documents stay, those of which nothing is left with empty text.

    Of equal windows the smallest doc_id keeps it, null ids last, ties by the hash of the text; null texts stay null.
    """
    return line_dedup.dedup_lines_keeping_columns(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id, with all rows alike in id and words.

    Null, empty and blank texts are near to nothing and stay; a null id goes where a member of its group has an id.
    """
    return minhash.keep_one_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    Null sources are one source, the last; rows of one id, and those without, go together; no words add nothing.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, for each document of the mix; null text has none."""
    return byte_bpe.encode_and_decode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL has neither the quality score's hash nor byte-pair merges; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on the documents of `sf_dir`; what a stage returns is written and read again.

    Once a stage's rows are written, all tables that it and the stages before have made for it are deleted.
    """
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir))
        for table in old + made[:-1]:
            discard(table)
        old = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
