"""Language stage of the pipeline: texts of languages that no label teaches go, short ones of taught languages stay."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline

OTHER = [
    "Москва является столицей России и крупнейшим городом страны по численности населения",
    "中国是世界上人口最多的国家之一 北京是中国的首都",
    "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και η μεγαλύτερη πόλη",
    "Warszawa jest stolicą Polski i największym miastem w kraju pod względem liczby ludności",
]


def test_only_taught_languages_stay(spark, sf_dir):
    draw = random.Random(1)
    noise = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for _ in range(20)) for n in (4, 8, 12)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.where("lang is not null").select("lang", F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w rlike '^[a-z]+$'")
    often = words.groupBy("w").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("k")).where("k > 1").orderBy(F.desc("n"), "w").limit(20)
    short = [x.w for x in often.collect()]  # in several languages, so that none is sure
    texts = [*OTHER, *noise, "12 !", *short]
    planted = spark.createDataFrame([(10**9 + i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.language(spark, docs.unionByName(planted, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    stayed = {texts[x - 10**9] for x in kept if x >= 10**9}
    assert stayed == set(short)
    assert len(kept) == docs.count() + len(short)
