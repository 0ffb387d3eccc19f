"""The queries of this subpackage, one for each operator, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import alignment, fingerprint, language, licences, mixing, packing, quality, ranking, secrets, sharding, simhash, substring, toxicity
from claimloom.llm.common import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("row.doc_id", "row.source", "row.text", "copies", "copy", "mix_key")


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir), (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(documents(spark, sf_dir))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ALL = (op1_fingerprint, op2_toxicity, op3_quality, op4_substring, op5_simhash, op6_mixing, op7_jump_sharding, op8_packing, op9_secrets, op10_language, op11_alignment, op12_licences, op13_ranking)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": quality.ORACLE_SQL, "op4_substring": substring.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op7_jump_sharding": sharding.ORACLE_SQL, "op12_licences": licences.ORACLE_SQL, "op13_ranking": ranking.ORACLE_SQL}
