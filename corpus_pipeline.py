"""The corpus pipeline: stages that each read the table the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitloom.llm import bpe, exact_dedup, langid, mixing, neardup
from hitloom.llm.common import read
from hitloom.runtime import Scratch


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that the mix has taken: key, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of nothing; repeated
    rows and null keys stay as they are, other columns are not read, and an
    empty table gives an empty result.
    """
    return bpe.digests(docs, bpe.word_bpe_path())


STAGES = [
    ("language_id", langid.language_stage),
    ("exact_dedup", exact_dedup.dedup_stage),
    ("near_dedup", neardup.neardup_stage),
    ("mixing", mixing.mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot state the language, near-duplicate and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
