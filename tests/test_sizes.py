"""What keeps a query's tasks, driver and passes bounded on larger tables."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import bootstrap, contours, contract_documents, distance, manifests, masks, neighbors, ranking, tiles
from tesserae.plans import quality, structure
from tesserae.storage import keep


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_draws_are_not_broadcast(spark):
    """Their estimate is that of the clusters, which many replicates exceed."""
    rows = spark.range(3000).select((F.col("id") % 2).alias("s"), F.col("id").alias("c"), F.col("id").alias("v"))
    drawn = bootstrap.resample(rows, ["s"], "c", 50, 1).groupBy("s", "replicate").agg(F.count("*").alias("n"))
    plan = final_plan(drawn)
    assert {(r["s"], r["n"]) for r in drawn.collect()} == {(0, 1500), (1, 1500)} and drawn.count() == 100
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


def test_cells_are_not_broadcast(spark):
    """Their files are far smaller than their rows."""
    cells = keep(spark.range(10_000).selectExpr("0L AS image", "cast(id div 100 AS int) AS y", "cast(id % 100 AS int) AS x", "id % 7 > 0 AS mask"), "cells")
    found = masks.fill_holes(tiles.sized(cells), "mask")
    plan = final_plan(found)
    assert "BroadcastHashJoin LeftOuter" not in plan
    assert "SortMergeJoin" in plan and found.count() == 10_000


def test_members_of_contracts_are_not_broadcast(spark):
    """The files of documents are far smaller than their rows; documents are dealt out to all tasks."""
    text = F.lit('{"modalities": [{"id": "he", "input_variants": [{"id": "a"}, {"id": "a"}]}], "regimes": {"lora": {}}}')
    docs = spark.range(200).coalesce(1).select(F.col("id").alias("contract"), text.alias("document"))
    found = contract_documents.audit(docs)
    assert "BroadcastHashJoin" not in final_plan(found)
    counts = {r["code"]: r["count"] for r in found.groupBy("code").count().collect()}
    assert (counts["duplicate_id"], counts["missing_required_modality"], counts["missing_required_regime"]) == (200, 400, 1000)


def analyzed(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_members_of_manifests_are_looked_up_once(spark):
    """Not once for each mention in a rule."""
    rows = spark.createDataFrame([(1, "{}")], "line long, text string")
    found = manifests.read(rows).transform(manifests.spread("record", {"a": "$.a", "b": "$.b"}))
    assert found.columns == ["line", "record", "state", "kind_a", "kind_b", "text_a", "text_b"]
    assert analyzed(found).count("$.a") == 1
    plan = analyzed(manifests.audit(rows))
    assert "$.split" not in plan and "kind_split" in plan


def test_quantiles_take_few_rows_times_levels(spark):
    """Rows that hold no level are dropped before the levels are exploded."""
    rows = spark.range(5000).selectExpr("id % 2 AS g", "CAST(id % 977 AS double) AS v")
    levels = [k / 32 for k in range(33)]
    found = ranking.quantiles(rows, ["g"], "v", levels)
    plan = analyzed(found)
    assert "CASE WHEN" in plan[plan.index("Generate explode") :]
    asked = rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, levels))).alias("p"))
    right = {(r["g"], k): r["p"][k] for r in asked.collect() for k in range(33)}
    got = {(r["g"], round(r["level"] * 32)): r["value"] for r in found.collect()}
    assert got.keys() == right.keys() and all(abs(got[k] - right[k]) < 1e-9 for k in got)


def test_issues_shuffle_keys_only(spark, sf_dir):
    """Records do not go through a join for each key that they share with others."""
    plan = analyzed(structure.manifest_issues(spark, sf_dir))
    assert "Join LeftOuter" not in plan and plan.count("Join LeftSemi") == 3


def test_rows_are_not_joined_by_few_strata(spark, sf_dir):
    """Thresholds of strata or folds are few rows: a shuffled join puts all rows of a stratum in one task."""
    for query in (quality.locked_eval, quality.logo_eval, quality.calibration_quantile):
        plan = analyzed(query(spark, sf_dir))
        assert "rightHint=(strategy=broadcast)" in plan, query.__name__


def test_spans_are_small_and_not_broadcast(spark, monkeypatch):
    """Rows over the size of a span are dealt out to more of them, each of its own task, whatever the number of tasks."""
    monkeypatch.setattr(ranking, "SPAN", 500)
    rows = spark.range(10_000).selectExpr("id % 3 AS g", "id AS v", "id % 7 AS x")
    found = ranking.running(rows, ["g"], F.col("v"), ["x"])
    plan = final_plan(found)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("up_x").alias("count"), F.max("up_x")).collect()]
    assert len(sizes) > 4 and max(sizes) <= 5 * 500
    ups = {(r["g"], r["v"]): r["up_x"] for r in found.collect()}
    assert len(ups) == 10_000 and ups[0, 9999] == sum(v % 7 for v in range(0, 10_000, 3)) and ups[2, 5] == 7


def test_ranks_count_both_sides_at_once(spark):
    """One aggregate of the rows of both sides, not one for each and another of these."""
    rows = spark.range(1000).selectExpr("CAST(id % 50 AS double) AS score", "id % 2 AS side")
    found = ranking.percentile_rank(rows.where("side = 0"), rows.where("side = 1"))
    assert {r["score"]: r["percentile"] for r in found.collect()} == {float(v): sum(u % 2 for u in range(v + 1)) / 25 for v in range(0, 50, 2)}


def test_draws_of_each_bootstrap_are_not_broadcast(spark, sf_dir):
    """Neither those of strata nor those of samples; the estimate of samples is one row."""
    for query in (quality.bootstrap_stratified, quality.bootstrap_ci):
        plan = final_plan(query(spark, sf_dir))
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan, query.__name__


def test_cells_of_images_are_not_broadcast_for_distances(spark):
    """What is broadcast is a row for each image, whatever the sizes of the files."""
    cells = keep(spark.range(10_000).selectExpr("0L AS image", "cast(id div 100 AS int) AS y", "cast(id % 100 AS int) AS x"), "cells")
    found = distance.nearest(cells.where("x % 2 = 0"), cells.where("x % 10 = 1"))
    assert "rightHint=(strategy=broadcast)" in analyzed(found)
    assert found.count() == 5000 and found.agg(F.max("distance")).first()[0] == 7.0


def test_images_of_one_tile_are_thinned_in_one_round(spark, monkeypatch):
    """Both masks at once, to the end, however many passes that takes."""
    rounds = []
    monkeypatch.setattr(contours, "keep", lambda df, name: rounds.append(name) or keep(df, name))
    rows = spark.range(6400).selectExpr("0L AS image", "cast(id div 80 AS int) AS y", "cast(id % 80 AS int) AS x", "80 AS height", "80 AS width").withColumns({"a": F.lit(True), "b": F.col("x") < 60})
    got = contours.skeletons(rows, ["a", "b"], 2).collect()
    assert len(rounds) == 1
    for name, mask in (("a", np.ones((80, 80))), ("b", np.arange(6400).reshape(80, 80) % 80 < 60)):
        assert {(r.y, r.x) for r in got if r[f"line_{name}"]} == {tuple(map(int, c)) for c in np.argwhere(contours.thinned(mask))}


def test_neighbours_hold_few_distances():
    """Not those of a whole block of rows to a whole block of the bank."""
    draws = np.random.default_rng(3)
    rows, bank = (neighbors._unit(draws.normal(size=(n, 4))) for n in (1024, neighbors.BLOCK))
    tracemalloc.start()
    near = neighbors._nearest(rows, bank, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * neighbors.CELLS < 8 * 1024 * neighbors.BLOCK
    for i in (0, 127, 128, 1023):  # on both sides of a step's end
        right = np.sort(np.linalg.norm(bank - rows[i], axis=1))[:5]
        assert np.allclose(np.sort(near[i]), right, atol=1e-7)
    assert neighbors._nearest(rows[:3], bank[:2], 5).shape == (3, 2)


def test_draws_of_all_strata_together_are_not_broadcast(spark, sf_dir):
    """Without strata too, whether a draw's cluster is a row of counts or of methods."""
    for query in (quality.bootstrap_cluster, quality.bootstrap_paired):
        plan = final_plan(query(spark, sf_dir))
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan, query.__name__
