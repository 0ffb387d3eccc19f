"""From raw documents to packed training sequences, in five stages; each works on all that the one before it kept.

Quality rules drop rejected documents and boilerplate lines, one document stays of each group of near copies (five-word shingles alike
to 0.8 or more), secrets are masked, sources are mixed to their target weights by repeating rows, and what is left is packed into sequences of tokens.

Defined results: a null or empty text fails the quality rules; near-duplicates keep one text without words, and of equal texts the row with the least id,
null last; a null text has no secrets and stays null; null sources are a source of their own; a null text packs as the end id alone. Repeated
rows are judged alike, of which near-duplicates keep one. Other columns go through all stages but the last. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import mixing, packing, quality, secrets, simhash
from claimloom.llm.common import shared_folder
from claimloom.llm.registry import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the shingles' hashes; tests/llm holds the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table of documents; what each stage returns is written as Parquet in the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
    return docs
