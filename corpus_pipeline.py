"""Corpus pipeline: language, exact and near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns documents with their columns; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.block_dedup import BlockNames
from tesserae.llm.common import keep, table
from tesserae.llm.decontaminate import Decontamination
from tesserae.llm.langid import LanguageId
from tesserae.llm.near_copies import NearCopies
from tesserae.llm.packing import Packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: A text's fit to its best language, 1 being that language's labelled texts, below which it is rejected. Of the
#: first 4,000 texts of sf0.1 the lowest is 0.4; Russian, Chinese, Greek, Polish and Italian sentences and random letters
#: are at 0.12 at most (at 0.22 under the labels of sf0.001).
LEAST_FIT = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the languages that the table's own labels teach; no letters or another language: out.

    A table without labels teaches none, and then all texts with letters stay.
    """
    model = LanguageId(VOCABULARY).fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.select(F.struct(*docs.columns).alias("doc"), model.predict(spark, fit=True).alias("language"))
    return found.where((F.col("language.lang") != "und") & (F.col("language.fit") >= LEAST_FIT)).select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of those with equal texts (null: empty); of rows that repeat it, one."""
    return BlockNames().distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies, which share 0.8 or more of the five-word shingles of both."""
    return NearCopies(shingle=5, over=4, under=5).drop(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold an item of the benchmark table."""
    return Decontamination().clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens; each text ends with id 2."""
    pieces = Packing(VOCABULARY, end_id=2).pack(docs)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: Language models, fingerprints and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
