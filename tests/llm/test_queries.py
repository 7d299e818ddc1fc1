"""Registered queries over whole tables: against SQL, or what they promise."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tesserae.llm import queries

from ..oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def test_held_out_accuracy_of_the_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out")
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_every_operator_is_registered():
    names = queries.queries()
    assert {int(x[2:].split("_")[0]) for x in names} == set(range(1, 14))


def test_pipeline(spark, sf_dir):
    """Stage by stage against brute force; near copies by the shingles that they share."""
    import corpus_pipeline as pipeline

    from tesserae.llm.common import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    items = [" ".join(x.text.split()) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        kept[name], docs = {x.doc_id for x in out.collect()}, out
    assert kept["language"] == set(texts)
    last = {text: doc for doc, text in sorted(texts.items())}
    assert kept["exact"] == set(last.values())
    shingles = {d: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(texts[d].lower().split()) for d in kept["exact"]}
    alike = lambda a, b: 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    root = {d: d for d in kept["exact"]}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for x, y in combinations(sorted(kept["exact"]), 2):
        if min(len(shingles[x]), len(shingles[y])) * 5 >= max(len(shingles[x]), len(shingles[y])) * 4 and alike(x, y):
            low, high = sorted((top(x), top(y)))
            root[high] = low
    assert kept["near"] == {d for d in kept["exact"] if top(d) == d}
    assert kept["decontaminate"] == {d for d in kept["near"] if not any(x in " ".join(texts[d].split()) for x in items)}
    pieces = pipeline.pack(spark, docs, sf_dir)
    assert {x.doc_id for x in pieces.select("doc_id").distinct().collect()} == kept["decontaminate"]


def test_pipeline_stages_take_rows_of_any_kind(spark, sf_dir):
    """Nulls in any column, repeated rows and ids, empty and long texts, clashing extra columns, empty tables."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = docs.where("lang is not null").orderBy(F.desc("n_chars")).first()["text"]
    odd = [(None, text), (7, text), (7, text), (7, text + " and a few more words"), (8, None), (None, None), (9, ""), (10, "  "), (11, "one two"), (12, (text + " ") * 40)]
    rows = docs.unionByName(spark.createDataFrame([(k if k is None else k + 10**9, t) for k, t in odd], "doc_id long, text string"), allowMissingColumns=True)
    for name in ("node", "rid", "doc", "label", "cell", "hash", "rank", "kept"):
        rows = rows.withColumn(name, F.lit("x"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns and stage(spark, rows.limit(0), sf_dir).count() == 0
        found = [(x.doc_id, x.text) for x in out.where("doc_id is null or doc_id > 999999999").collect()]
        if name == "language":
            assert len(found) in (5, 6) and all(t and t.strip() for _, t in found)  # two words may fit no taught language
        elif name == "exact":
            assert len(found) == 6 and sum(t == text for _, t in found) == 1 and sum(not t for _, t in found) == 1
        elif name == "near":
            assert len(found) <= 4
        assert pipeline.pack(spark, out.limit(50), sf_dir).count() >= 50
    assert pipeline.pack(spark, rows.limit(0), sf_dir).count() == 0
