"""One query per operator: production parameters over the whole intended table.

Each callable takes (spark, sf_dir), gets its rows through its operator and derives the digest
columns of its contract from the operator's real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import tables


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import near_duplicates

    return near_duplicates(tables(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract

    return extract(tables(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import round_trip

    return round_trip(tables(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(tables(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_output

    return token_output(tables(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edited_fingerprints

    return edited_fingerprints(tables(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(tables(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(tables(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
