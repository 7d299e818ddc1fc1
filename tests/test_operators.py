"""Hand-computed cases, edges and plans of the library's operators."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import schema
from tesserae.functions import attempts, checks, rates
from tesserae.operators import anomaly, audits, balance, bootstrap, boxes, confusion, grid, linking, neighbors, probe, ranking, reservoirs, splits


def one(df):
    return df.collect()[0]


def test_confusion_of_one_each(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, p boolean")
    got = one(confusion.metrics(confusion.confusion(rows, [], F.col("t"), F.col("p"), F.lit(True))))
    assert (got.tp, got.fp, got.fn, got.tn, got.n_valid) == (1, 1, 1, 1, 4)
    assert (got.dice, got.iou, got.mcc) == (0.5, round(1 / 3, 6), 0.0)


def test_two_empty_sides_agree(spark):
    counts = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 3, 2)], "tp long, fp long, fn long, tn long")
    both = confusion.metrics(counts).orderBy("fn").collect()
    assert (both[0].dice, both[0].precision, both[0].mcc) == (1.0, 1.0, 1.0)
    assert (both[1].dice, both[1].precision, both[1].recall) == (0.0, 0.0, 0.0)


def test_average_precision_ignores_the_order_of_ties(spark):
    rows = spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True), (0.1, False)], "score double, target boolean").withColumn("g", F.lit(1))
    assert one(ranking.average_precision(rows, ["g"])).average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert one(ranking.auroc(rows, ["g"])).auroc == pytest.approx(0.875)
    assert one(ranking.average_precision(rows.where("NOT target"), ["g"])).average_precision is None
    assert one(ranking.auroc(rows.where("target"), ["g"])).auroc is None


def test_best_threshold_breaks_ties_upwards(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False)], "score double, target boolean").withColumn("g", F.lit(1))
    got = one(ranking.best_threshold(rows, ["g"]))
    assert (got.dice, got.threshold) == (1.0, 0.8)


def test_wilson_interval(spark):
    got = one(spark.range(1).select(F.struct(*[x.alias(k) for k, x in rates.wilson(F.lit(8), F.lit(10)).items()]).alias("w"), F.struct(*[x.alias(k) for k, x in rates.wilson(F.lit(0), F.lit(0)).items()]).alias("e")))
    assert got.w.lower == pytest.approx(0.490162, abs=1e-6) and got.w.upper == pytest.approx(0.943318, abs=1e-6)
    assert got.e.estimate is None and got.e.lower is None and got.e.upper is None


def test_gates(spark):
    cases = [(0.9, 5), (0.1, 5), (0.9, 1), (None, 5)]
    rows = spark.createDataFrame(cases, "v double, n int").select(rates.gate(F.col("v"), 0.5, True, F.col("n"), 3).alias("g"))
    assert [x.g for x in rows.collect()] == ["PASS", "FAIL", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"]


def test_spellings(spark):
    rows = spark.createDataFrame([("H&E", "DAPI", "Crack-Tear"), ("Nope", "what", "nope"), (None, None, None)], "m string, r string, a string")
    got = rows.select(schema.modality(F.col("m")), schema.channel_role(F.col("r")), schema.artifact(F.col("a"))).collect()
    assert [tuple(x) for x in got] == [("he", "nuclear", "crack"), (None, "unknown", None), (None, "unknown", None)]


def test_predicates(spark):
    rows = spark.createDataFrame([("a/b",), ("../b",), ("/a",), ("a/../b",), ("",), (None,)], "p string")
    assert [x[0] for x in rows.select(checks.is_safe_path(F.col("p"))).collect()] == [True, False, False, False, False, False]
    values = spark.createDataFrame([(0.5,), (math.nan,), (math.inf,), (None,)], "v double")
    assert [x[0] for x in values.select(checks.is_fraction(F.col("v"))).collect()] == [True, False, False, True]
    assert [x[0] for x in values.select(checks.finite(F.col("v"))).collect()] == [0.5, None, None, None]


@pytest.mark.parametrize(("length", "expected"), [(10, [0]), (64, [0]), (65, [0, 1]), (160, [0, 48, 96]), (170, [0, 48, 96, 106])])
def test_window_starts(spark, length, expected):
    assert one(spark.range(1).select(grid.window_starts(F.lit(length), 64, 48))) [0] == expected


def test_split_sizes():
    assert splits.split_sizes(10, (0.6, 0.2, 0.2)) == [6, 2, 2]
    assert splits.split_sizes(3, (0.8, 0.1, 0.1)) == [1, 1, 1]
    with pytest.raises(ValueError):
        splits.split_sizes(2, (0.6, 0.2, 0.2))


def test_first_record_owns_a_leaked_key(spark):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "test"), (4, None, "test")], "record int, patient string, split string")
    assert [(x.record, x.owner) for x in splits.leaks(rows, "patient", "split", "record").collect()] == [(2, "train")]


def test_components_follow_chains_and_nulls_link_nothing(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (5, "z", None)], "id int, p string, q string")
    got = {x.id: x.component for x in linking.shared_components(rows, "id", ["p", "q"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize("part", [7, 8192])
def test_knn_is_exact_over_blocks(spark, part):
    rng = np.random.default_rng(0)
    rows, bank = rng.normal(size=(9, 4)), rng.normal(size=(30, 4))
    make = lambda a: spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(a)], "id long, embedding array<double>")
    got = {x.id: x.score for x in neighbors.knn_scores(make(rows), make(bank), 3, part).collect()}
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    far = np.linalg.norm(unit(rows)[:, None] - unit(bank)[None], axis=2)
    assert [got[i] for i in range(9)] == pytest.approx(np.sort(far, axis=1)[:, :3].mean(axis=1).tolist())
    assert neighbors.knn_scores(make(rows), make(bank[:0]), 3).count() == 0


def test_bootstrap_of_one_cluster_is_its_value(spark):
    rows = spark.createDataFrame([("a", 1, 5.0)], "s string, c int, v double")
    got = one(bootstrap.bootstrap(rows, ["s"], "c", F.avg("v"), 10, 1))
    assert (got.n, got.mean, got.lower, got.upper) == (10, 5.0, 5.0, 5.0)


def test_issues_and_status(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    rules = [audits.Rule("missing", "error", "v", F.col("v").isNull()), audits.Rule("small", "warning", "v", F.col("v") < 10)]
    found = audits.issues(rows, "k", rules)
    assert sorted((x.k, x.code) for x in found.collect()) == [(1, "small"), (2, "missing")]
    assert one(audits.status(found)).status == "INVALID"
    assert one(audits.status(found.limit(0))).status == "READY"


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "g int, score double, target boolean, y int, x int, v double")
    for df in (ranking.average_precision(rows, ["g"]), ranking.best_threshold(rows, ["g"]), grid.otsu(rows, ["g"], "v"), splits.reservoir(rows, 3, F.col("g"))):
        assert df.count() == 0


def test_scans_read_few_columns_and_push_filters(spark, sf_dir):
    from tesserae.plans.image import tile_region_scan
    from tesserae.plans.quality import confusion_counts

    plan = confusion_counts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "partial_count" in plan
    assert "props" not in tile_region_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_running_sums_of_a_hot_group(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1990, "a").otherwise("b").alias("g"), "id", (F.col("id") % 7).alias("n"))
    got = ranking.running(rows, ["g"], F.col("id").desc(), ["n"]).collect()
    up = 0
    for x in sorted((x for x in got if x.g == "a"), key=lambda x: -x.id):
        up += x.n
        assert x.up_n == up and x.all_n == sum(i % 7 for i in range(1990))


def test_quantiles_are_linear(spark):
    values = [3.0, 1.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, None]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)], "g string, v double")
    got = {(x.g, x.level): x.value for x in ranking.quantiles(rows, ["g"], "v", [0.0, 0.25, 0.3, 0.5, 0.99, 1.0]).collect()}
    for q in (0.0, 0.25, 0.3, 0.5, 0.99, 1.0):
        assert got["a", q] == pytest.approx(np.quantile([v for v in values if v is not None], q)) and got["b", q] == 2.0


def test_split_sizes_of_tables(spark):
    rows = spark.createDataFrame([(n, n) for n in range(3, 60)], "g int, n long")
    shares = {"fit": 0.7, "calibration": 0.2, "test": 0.1}
    got = {}
    for x in splits.sizes_by_remainder(rows, ["g"], shares).collect():
        got.setdefault(x.g, {})[x.role] = x["size"]
    assert got == {n: dict(zip(shares, splits.split_sizes(n, tuple(shares.values())), strict=True)) for n in range(3, 60)}


def all_deals(weights, sizes, targets):
    """Least deviation, and the deals that have it with the least preference, by trying all."""
    roles = [r for r, n in enumerate(sizes) for _ in range(n)]
    cost = lambda deal: sum(abs(sum(w for w, q in zip(weights, deal, strict=True) if q == r) - targets[r]) for r in range(len(sizes)))
    prefer = lambda deal: sum((g + 1) * (r + 1) for g, r in enumerate(deal))
    every = set(permutations(roles))
    least = min(map(cost, every))
    best = min(prefer(x) for x in every if cost(x) <= least + 1e-9)
    return least, {x for x in every if cost(x) <= least + 1e-9 and prefer(x) == best}


@pytest.mark.parametrize("seed", range(25))
def test_deals_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 9))
    sizes = splits.split_sizes(n, (0.6, 0.25, 0.15)) if seed % 2 else splits.split_sizes(n, (0.5, 0.5))
    weights = rng.integers(1, int(rng.choice([4, 30, 1000])), n).astype(float).tolist()
    targets = [sum(weights) * x for x in ((0.6, 0.25, 0.15) if seed % 2 else (0.5, 0.5))]
    least, best = all_deals(weights, sizes, targets)
    deal = balance.best_deal(weights, sizes, targets)
    assert tuple(deal) in best
    assert balance.deviation([sum(w for w, r in zip(weights, deal, strict=True) if r == q) for q in range(len(sizes))], targets) == pytest.approx(least)


def test_ten_groups_and_sixty():
    weights, sizes = [31.0, 27, 26, 25, 15, 13, 12, 11, 9, 2], [5, 3, 2]
    targets = [sum(weights) * x for x in (0.6, 0.25, 0.15)]
    deal = balance.best_deal(weights, sizes, targets)
    cost = lambda deal: sum(abs(sum(w for w, q in zip(weights, deal, strict=True) if q == r) - targets[r]) for r in range(3))
    every = {(a, b) for a in combinations(range(10), 5) for b in combinations([x for x in range(10) if x not in a], 3)}
    assert cost(deal) == pytest.approx(min(cost([0 if g in a else 1 if g in b else 2 for g in range(10)]) for a, b in every))
    weights = np.random.default_rng(1).integers(1, 40, 60).astype(float).tolist()
    sizes = splits.split_sizes(60, (0.6, 0.25, 0.15))
    deal = balance.best_deal(weights, sizes, [round(sum(weights) * 0.6), round(sum(weights) * 0.25), sum(weights) - round(sum(weights) * 0.6) - round(sum(weights) * 0.25)])
    assert [deal.count(r) for r in range(3)] == sizes


def test_balanced_groups_are_as_good_as_the_best(spark):
    weights, sizes = [9, 7, 6, 5, 5, 3, 2, 1], {"a": 3, "b": 3, "c": 2}
    groups = spark.createDataFrame([(s, k, w) for s in "st" for k, w in enumerate(weights)], "s string, k int, w int")
    places = spark.createDataFrame([(s, r, n) for s in "st" for r, n in sizes.items()], "s string, role string, size int")
    got = balance.balanced(groups, ["s"], "k", "w", places, 1).where("s = 's'").collect()
    least, _ = all_deals(weights, list(sizes.values()), [sum(weights) * n / 8 for n in sizes.values()])
    assert sorted(x.role for x in got) == list("aaabbbcc") and [x.objective for x in got] == pytest.approx([least] * 8)
    with pytest.raises(Exception, match="more or fewer places"):
        balance.balanced(groups.where("k > 0"), ["s"], "k", "w", places, 1).collect()


def test_anomaly_scores_match_numpy(spark):
    rng = np.random.default_rng(3)
    clean, rows = rng.normal(size=(80, 6)) * [1, 5, 0.1, 2, 0, 3], rng.normal(size=(7, 6)) * 4
    make = lambda a: spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(a)], "id long, embedding array<double>")
    got = {x.id: x.score for x in anomaly.scores(make(rows), anomaly.fit(make(clean))).collect()}
    center = np.median(clean, axis=0)
    mad = 1.4826 * np.median(np.abs(clean - center), axis=0)
    scale = np.where(mad > 1e-12, mad, np.where(clean.std(axis=0) > 1e-12, clean.std(axis=0), 1))
    z = np.clip((clean - center) / scale, -20, 20)
    _, size, directions = np.linalg.svd(z, full_matrices=False)
    directions = directions[: int(np.searchsorted(np.cumsum(size**2) / (size**2).sum(), 0.98)) + 1].T
    low = z @ directions
    middle = np.median(low, axis=0)
    spread = (low - middle).T @ (low - middle) / (len(low) - 1)
    precision = np.linalg.pinv(0.85 * spread + 0.15 * np.diag(np.diag(spread)) + 1e-6 * np.eye(len(middle)))
    far = np.clip((rows - center) / scale, -50, 50) @ directions - middle
    assert [got[i] for i in range(7)] == pytest.approx(np.sqrt(np.einsum("ij,jk,ik->i", far, precision, far)).tolist(), rel=1e-6)


def test_probe_separates_and_balances(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(300, 3)), rng.normal(size=(20, 3)) + [2, 0, 0]))
    x[:, 2] = 4 + 1e-8 * x[:, 2]  # it does not vary: not scaled
    rows = spark.createDataFrame([(i, [float(v) for v in r], i >= 300) for i, r in enumerate(x)], "id long, embedding array<double>, positive boolean")
    got = {r.id: r.score for r in probe.scores(rows, probe.fit(rows, "positive")).collect()}
    scale = np.where(x.std(axis=0) < 1e-6, 1.0, x.std(axis=0))
    z, y = (x - x.mean(axis=0)) / scale, np.arange(320) >= 300
    weight, w, b = np.where(y, 0.5 / 20, 0.5 / 300), np.zeros(3), 0.0
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-(z @ w + b)))
        design = np.column_stack((z, np.ones(320)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * np.array([*w, 0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.diag([1, 1, 1, 0])
        w, b = (np.array([*w, b]) - np.linalg.solve(hessian, gradient))[:3], (np.array([*w, b]) - np.linalg.solve(hessian, gradient))[3]
    assert [got[i] for i in range(320)] == pytest.approx((1 / (1 + np.exp(-(z @ w + b)))).tolist(), abs=1e-4)
    with pytest.raises(ValueError):
        probe.fit(rows.where("positive"), "positive")


def test_reservoirs_hold_the_smallest_keys_of_one_pass(spark):
    kinds = [reservoirs.Reservoir("a", F.col("k") < 7, 11, 3), reservoirs.Reservoir("b", F.col("k") >= 2, 40, 5), reservoirs.Reservoir("c", F.col("k") > 100, 4, 5), reservoirs.Reservoir("d", F.lit(True), 10_000, 9)]
    rows = spark.range(500).select(F.col("id"), F.array((F.col("id") * 0.5).cast("double")).alias("embedding"), (F.col("id") % 10).alias("k"))
    rows = rows.unionByName(rows.where("id < 3")).unionByName(spark.createDataFrame([(None, [1.0], 3)], "id long, embedding array<double>, k long")).repartition(19)
    kept, seen = reservoirs.gather(rows, kinds, fan_in=3)
    ids = [*range(500), 0, 1, 2]
    key = lambda seed, i: (hashlib.sha256(f"{seed}|{i}".encode()).hexdigest(), i)
    found = {"a": lambda k: k < 7, "b": lambda k: k >= 2, "c": lambda k: k > 100, "d": lambda k: True}
    counts = {r.name: (r.seen, r.stored) for r in seen.collect()}
    for x in kinds:
        own = [i for i in ids if found[x.name](i % 10)]
        some = kept.where(F.col("name") == x.name).collect()
        assert sorted((r.order_key, r.id) for r in some) == sorted(key(x.seed, i) for i in own)[: x.capacity]
        assert all(r.embedding == [r.id * 0.5] for r in some) and counts[x.name] == (len(own), min(len(own), x.capacity))
    assert {r.name: (r.seen, r.stored) for r in reservoirs.gather(rows.limit(0), kinds)[1].collect()} == dict.fromkeys("abcd", (0, 0))


def test_calibrated_neighbours(spark):
    rng = np.random.default_rng(6)
    bank, calm, test = rng.normal(size=(40, 5)), rng.normal(size=(30, 5)), rng.normal(size=(20, 5)) * [1, 1, 1, 1, 9]
    test[3] = calm[4]
    make = lambda a, first: spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(a)], "id long, embedding array<double>")
    rows = [make(test, 0), make(bank, 100), make(calm, 200)]
    got = {r.id: r for r in neighbors.calibrated_knn(*rows, 3, 0.8, ("fit", "calibration")).collect()}
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    score = lambda a: np.sort(np.linalg.norm(unit(a)[:, None] - unit(bank)[None], axis=2), axis=1)[:, :3].mean(axis=1).round(9)
    clean, limit = score(calm), np.quantile(score(calm), 0.8)
    for i, x in enumerate(score(test)):
        assert (got[i].score, got[i].percentile, got[i].flagged) == (pytest.approx(x), pytest.approx((clean <= x).mean()), bool(x > limit))
    for wrong in ((rows[1], rows[1]), (rows[1], rows[1].limit(9)), (rows[1], rows[2].limit(1)), (rows[1].limit(2), rows[2]), (rows[1], rows[1].withColumn("id", F.col("id") + 900))):
        with pytest.raises(ValueError):
            neighbors.calibrated_knn(rows[0], *wrong, 3)
    with pytest.raises(ValueError):
        neighbors.calibrated_knn(*rows, 3, splits=("fit", "fit"))


def test_boxes_of_any_size(spark):
    rng = np.random.default_rng(3)
    cells = [(int(k), int(y), int(x)) for k, y, x in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), rng.integers(0, 200, 400), strict=True)]
    some = [(b, int(rng.integers(0, 3)), *(int(v) for v in (y, x, y + h, x + w))) for b, (y, x, h, w) in enumerate(zip(rng.integers(-5, 60, 60), rng.integers(-5, 200, 60), rng.choice([0, 1, 3, 64, 500], 60), rng.choice([1, 2, 17, 300], 60), strict=True))]
    some.append((99, 1, None, 0, 5, 5))
    rows = spark.createDataFrame(cells, "image long, y int, x int").withColumn("size", F.lit("x"))
    found = boxes.in_boxes(rows, spark.createDataFrame(some, "box int, image long, y0 int, x0 int, y1 int, x1 int"))
    expected = Counter((*c, "x", b) for c in cells for b, k, y0, x0, y1, x1 in some if y0 is not None and c[0] == k and y0 <= c[1] < y1 and x0 <= c[2] < x1)
    assert Counter(tuple(r) for r in found.collect()) == expected and len(expected) > 300
    assert boxes.in_boxes(rows, spark.createDataFrame([], "box int, image long, y0 int, x0 int, y1 int, x1 int")).count() == 0


def test_a_failure_is_a_row():
    calls = []

    def score(matrix):
        calls.append(len(matrix))
        if (matrix[:, 0] < 0).any():
            raise RuntimeError("below zero")
        return np.log(matrix[:, 0])

    vectors = [[float(i), 1.0] for i in range(1, 513)]
    vectors[7] = vectors[300] = [-1.0, 1.0]
    vectors[9], vectors[10], vectors[11] = None, [1.0], [0.0, 1.0]
    with np.errstate(divide="ignore"):
        got = attempts.attempted(score, vectors)
    bad = {7: "RuntimeError: below zero", 300: "RuntimeError: below zero", 9: "no vector", 10: "1 dimensions in place of 2", 11: "not a finite score"}
    assert {i: r for i, (_, s, r) in enumerate(got) if s == "failed"} == bad and len(calls) < 45
    assert all(got[i] == (math.log(i + 1), "scored", None) for i in range(512) if i not in bad)
    assert attempts.attempted(score, []) == []


def test_few_links_are_joined_in_one_task(spark):
    rng = np.random.default_rng(4)
    for links in ([(i, i + 1) for i in range(300)], [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))], [(9, 9), (None, 3)], [(5, 2), (2, 5), (7, 2)]):
        rows = spark.createDataFrame(links, "u long, v long")
        one, rounds = linking.components(rows, 1 << 17), linking.components(rows)
        assert {(r.node, r.label) for r in one.collect()} == {(r.node, r.label) for r in rounds.collect()}


@pytest.mark.parametrize("seed", range(12))
def test_deals_near_the_relaxed_one_are_the_best(seed):
    """Those that are proven are as good as those of the table, in sums too."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(8, 16))
    shares = (0.6, 0.25, 0.15) if seed % 2 else (0.5, 0.5)
    sizes, weights = splits.split_sizes(n, shares), (3 * rng.integers(1, int(rng.choice([6, 12, 30])), n) + 1).astype(float).tolist()
    targets = [sum(weights) * x for x in shares]

    def worth(deal):
        sums = [sum(w for w, q in zip(weights, deal, strict=True) if q == r) for r in range(len(sizes))]
        return round(balance.deviation(sums, targets), 6), sum((g + 1) * (r + 1) for g, r in enumerate(deal)), sums, [deal.count(r) for r in range(len(sizes))]

    deal = balance.near_relaxed(weights, sizes, targets)
    assert deal is None or worth(deal) == worth(balance.best_deal(weights, sizes, targets))


def test_a_stratum_of_thousands_of_groups_is_dealt():
    """Each role's sum is next to its target, which no deal betters."""
    weights = np.random.default_rng(2).poisson(600, 6000).astype(float).tolist()
    targets = [sum(weights) * x for x in (0.6, 0.25, 0.15)]
    sizes = splits.split_sizes(6000, (0.6, 0.25, 0.15))
    deal = balance.best_deal(weights, sizes, targets)
    sums = [sum(w for w, q in zip(weights, deal, strict=True) if q == r) for r in range(3)]
    assert [deal.count(r) for r in range(3)] == sizes and all(abs(a - b) < 1 for a, b in zip(sums, targets, strict=True))
    assert balance.near_relaxed([w + 0.5 * (g % 2) for g, w in enumerate(weights)], sizes, targets) is None
