"""Queries of the training-data operators: thin calls with production
parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from envspark.llm import (bpe, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, merkle, periodic_runs,
                          quality, secret_scan, substring_dedup, superminhash, vector_codes)
from envspark.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.license_report(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_units(table(spark, sf_dir, "documents"), min_words=0)


@query
def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark, sf_dir):
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), exact_chars=1)


@query
def op7_html_extract(spark, sf_dir):
    return html_extract.extract_main(table(spark, sf_dir, "pages"))


@query
def op8_quality(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_merkle(spark, sf_dir):
    return merkle.neighbour_report(table(spark, sf_dir, "documents"))


@query
def op10_byte_bpe(spark, sf_dir):
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                            public_tokenizers.PATTERN, with_ids=False)


@query
def op11_superminhash(spark, sf_dir):
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, share=80)


@query
def op12_vector_codes(spark, sf_dir):
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


ORACLE["op12_vector_codes"] = vector_codes.ORACLE_SQL


@query
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), edit=periodic_runs.planted_period)
    return periodic_runs.run_report(found)
