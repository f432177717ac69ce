"""The operN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, language, lines, media, merkle, minhash, packing, quality, resampling, scoring, simhash, suffix
from .tables import read

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = packing.added_tokens(public_tokenizers.path(TOKENIZER))
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), added)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(read(spark, sf_dir, "documents"))


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "documents"), stable=True)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(read(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op8_scoring": op8_scoring,
    "op4_suffix": op4_suffix,
    "op2_html": op2_html,
    "op3_language": op3_language,
    "op6_lines": op6_lines,
    "op9_quality": op9_quality,
    "op7_media": op7_media,
    "op5_simhash": op5_simhash,
    "op10_packing": op10_packing,
    "op11_minhash": op11_minhash,
    "op12_resampling": op12_resampling,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {"op6_lines": lines.REPORT_SQL, "op11_minhash": minhash.REPORT_SQL, "op12_resampling": resampling.REPORT_SQL, "op13_merkle": merkle.REPORT_SQL}
