"""The thin queries of the ten operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, neardup, pii, quality_model, quality_rules, secret_scan, sql, substring_dedup, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = (F.col("times") * F.col("size")).alias("taken")
    return mix.select("doc_id", "size", "source_size", "target", taken, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mixing": op1_cube_mixing,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_output": op9_token_output,
    "op10_chat_format": op10_chat_format,
}

#: The others draw at random, hash with a seed, run a tokenizer or a fitted model, or return offsets of disguised spans; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": sql.QUALITY_RULES,
    "op7_decontamination": sql.DECONTAMINATION,
    "op8_substring_dedup": sql.SUBSTRINGS,
    "op10_chat_format": sql.CHAT,
}
