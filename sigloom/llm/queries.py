"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import crf, gam, html, imatch, linededup, media, packing, sentences, simhash, substrings
from sigloom.llm.common import table


def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.predict(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("_lines_removed", "n_removed")


def op4_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_crf": op1_crf, "op2_sentencepiece": op2_sentencepiece, "op3_line_dedup": op3_line_dedup, "op4_gam": op4_gam, "op5_media": op5_media, "op6_simhash": op6_simhash, "op7_packing": op7_packing, "op8_suffix_dedup": op8_suffix_dedup, "op9_imatch": op9_imatch, "op10_html": op10_html, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
