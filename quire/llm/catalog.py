"""One query for every operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, jaccard, knn, langid, linededup, ogg, packing, pii, sstable, toxicity
from quire.llm.common import vocabulary
from quire.session import table


KEY = b"a key of the caller's; this one is for the registered query"


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.query(table(spark, sf_dir, "documents"))


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.build(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return knn.classify(docs, knn.fit(docs, table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.classify(docs, langid.fit(docs, vocabulary(spark, "piece_bpe_32k.model")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(spark, "byte_bpe_50k.tiktoken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), KEY)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dropped(table(spark, sf_dir, "documents"))


QUERIES = {"op3_quality": op3_quality, "op6_language": op6_language, "op4_decontamination": op4_decontamination, "op9_line_dedup": op9_line_dedup, "op5_jaccard": op5_jaccard, "op10_pii": op10_pii, "op1_ogg": op1_ogg, "op2_sstable": op2_sstable, "op7_packing": op7_packing, "op8_toxicity": op8_toxicity}
ORACLES = {"op4_decontamination": decontam.ORACLE, "op9_line_dedup": linededup.ORACLE, "op5_jaccard": jaccard.ORACLE, "op1_ogg": ogg.ORACLE}
