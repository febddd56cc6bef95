"""Corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, BPE.

Each stage gets the table that the stage before it kept, and its decisions take
effect on texts: rejected documents and near-duplicates go, repeated spans and
benchmark spans are cut out.

Defined results: every row is judged by its own text.  Null, empty and short
texts fail the base rules and go; rows with a null id, and all but one of the
rows of a repeated id, count as documents behind all others, so repeated rows
leave one; only null ids never lose words to substring dedup; an empty table
gives an empty table; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkogram.llm.bpe_trie import encode
from sparkogram.llm.decontam_sam import decontaminate
from sparkogram.llm.minhash_tensor import drop_near_duplicates
from sparkogram.llm.quality_rules import keep_good
from sparkogram.llm.queries import tokenizer_path
from sparkogram.llm.substring_rlz import remove_repeated_spans
from sparkogram.runtime import cut, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base checks or the decision list learned from ``labels``."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return keep_good(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each near-duplicate component, five words and a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages of 50 words and more that a smaller document has."""
    return _measured(remove_repeated_spans(docs, min_words=50))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out benchmark passages; drop documents that are benchmark for the larger part."""
    return _measured(decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), window=10, max_coverage=0.5))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the training sequences."""
    return encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: BPE has no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
