"""Registered queries of the training-data operators: thin callers over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, collocations, decontaminate, language_id, lexical_search, license_scan, preference, quality_rules, secret_scan,
               simhash, suffix_dedup, token_files, url_lists)
from .common import checkpoint, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return keep


@register("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.PATTERN)


@register("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


@register("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


@register("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpoint(quality_rules.text_stats(table(spark, sf_dir, "documents")))
    rules = quality_rules.learn(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@register("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("removed")


@register("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_url_lists", url_lists.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_lists.evaluate(url_lists.captures_of(pages), url_lists.entries_of(pages))
    return found.withColumns({c: found[c].cast("string") for c in ("day", "valid_from", "valid_to")})


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@register("op9_secret_ownership", secret_scan.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@register("op10_preference", preference.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_rows(*preference.pairs_of(table(spark, sf_dir, "conversations")))


@register("op11_collocations", collocations.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(collocations.collocations(table(spark, sf_dir, "documents")))


@register("op12_lexical_search", lexical_search.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@register("op13_license_scan", license_scan.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))
