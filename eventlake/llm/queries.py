"""The queries opN_<name> over the driver's tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, bpe, chat_format, decontaminate, line_dedup, quality_crf, quality_rules, secrets, simhash, toxicity
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.digests(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_hostile(table(spark, sf_dir, "conversations")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


#: The vocabulary of op10, as installed on every machine.
BPE_PATH, BPE_PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BPE_PATH, BPE_PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_backoff_lm,
        op3_toxicity,
        op4_simhash,
        op5_chat_format,
        op6_quality_rules,
        op7_quality_crf,
        op8_line_dedup,
        op9_secrets,
        op10_byte_bpe,
    )
}

SQL: dict[str, str] = {"op5_chat_format": chat_format.SQL, "op8_line_dedup": line_dedup.SQL}
