"""From raw documents to token files: quality rules, near-dedup, benchmark decontamination, mixing, token output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marram.llm.common import Workspace, table, workspaces_dropped
from marram.llm.decontaminate import decontaminated
from marram.llm.mixing import mixed
from marram.llm.near_dedup import deduplicated
from marram.llm.quality_rules import passing
from marram.llm.token_output import token_output

#: The vocabulary's file.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the learned decision list reject."""
    return passing(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return deduplicated(spark, docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    return decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources meet their target weights."""
    return mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in ascending doc_id order and returns what reading them gives: doc_id, start, n_tokens, ids_crc32."""
    return token_output(spark, docs, TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: The learned rules, MinHash bands and the tokenizer have no SQL counterpart; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage leaves is removed once the next is written."""
    ws = Workspace(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with workspaces_dropped():
            docs = ws.stage(stage(spark, docs, sf_dir), name)
        ws.drop(last)
        last = docs
    return docs
