"""The corpus pipeline: language ID, toxicity, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the ``docs`` of the next.  All but the last return the columns of ``docs``; the last returns
one row for each piece with its place in a packed sequence.  Any column may be null, and other columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import langid, lines, neardup, packing, shared, toxicity

#: Documents this alike (shingles in common, per cent of all) are near duplicates; ``op6_near_duplicates`` has a limit of its own.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with some margin; learns from the documents' own ``lang``."""
    return langid.keep_known(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not scored as toxic; learns from ``labels``."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source from the texts; ``n_chars`` follows the text."""
    kept = lines.clean(docs, F.col("source"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, linked from a similarity of 0.8 on."""
    return neardup.keep_one(docs, NEAR_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packed)]
#: Compression, learned weights and token ids are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage has written goes when the next has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with shared.scope(spark) as keep:
            docs, path = keep(stage(spark, docs, sf_dir), name)
        if last:
            shared.drop(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
