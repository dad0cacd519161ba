"""The operators applied to whole tables, one query each, with production parameters.

Where DuckDB can express a query, its SQL is in ``ORACLE``; the others are tested in
``tests/llm`` against brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, langid, lines, nbsvm, neardup, packing, periodic, pieces, rules, topk, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return nbsvm.score(documents, nbsvm.fit(documents, table(spark, sf_dir, "labels")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), 85)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return rules.judge(documents, rules.fit(documents, table(spark, sf_dir, "labels")))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.clean(table(spark, sf_dir, "documents"), F.col("source"), count=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return periodic.digests(periodic.find(documents, periodic.planted(F.col("doc_id"), F.col("text"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_top_k": op2_top_k,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_language": op5_language,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_pieces": op7_pieces,
    "op8_rules": op8_rules,
    "op9_lines": op9_lines,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_whitening": op12_whitening,
    "op13_warc": op13_warc,
}
ORACLE: dict[str, str] = {"op2_top_k": topk.SQL, "op9_lines": lines.SQL, "op13_warc": warc.SQL}
