"""Ranking metrics, quantiles and threshold sweeps.

All first count rows of equal values, in partial aggregates. Running sums over the distinct values of a group then go by
spans: a range partitioning deals the values out evenly, however few the groups are, and a span adds the sums of the spans
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import pixel_metrics, ratio
from ..storage import keep

#: Rows of a span, or so.
SPAN = 1 << 18


def running(rows: DataFrame, by: list[str], order: Column, sums: list[str]) -> DataFrame:
    """``rows`` with ``up_<x>``, the sum of x up to and with each row in ``order`` within its group, and ``all_<x>``.

    ``order`` must tell the rows of a group apart. No group is in one task: spans are, of which there are as many as tasks, or
    more where they would exceed ``SPAN`` rows; these are not put together again in few tasks.
    """
    deal = lambda some, *n: keep(some.repartitionByRange(*n, *[F.col(x) for x in by], order).withColumn("span", F.spark_partition_id()), "spans")
    rows, tasks = deal(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = -(-rows.count() // SPAN)
    if spans > tasks:
        rows = deal(rows.drop("span"), spans)
    total = rows.groupBy(*by, "span").agg(*[F.sum(x).alias(f"sum_{x}") for x in sums])
    whole = Window.partitionBy(*by)
    before = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "span", *[F.coalesce(F.sum(f"sum_{x}").over(before), F.lit(0)).alias(f"before_{x}") for x in sums], *[F.sum(f"sum_{x}").over(whole).alias(f"all_{x}") for x in sums])
    if spans > 1:
        rows = rows.repartition(max(tasks, spans), *by, "span")
    within = Window.partitionBy(*by, "span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"in_{x}": F.sum(x).over(within) for x in sums})
    # sorted by group and span already; a file of spans is far smaller than its rows, which Spark would broadcast
    rows = rows.join(total.hint("merge"), [*by, "span"])
    up = {f"up_{x}": F.col(f"before_{x}") + F.col(f"in_{x}") for x in sums}
    return rows.withColumns(up).drop("span", *[f"{k}_{x}" for k in ("in", "before") for x in sums])


def score_counts(rows: DataFrame, by: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """``n`` rows and ``p`` positives of each distinct score."""
    positive = F.sum(F.col(target).cast("int")).alias("p")
    return rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), positive)


def average_precision(rows: DataFrame, by: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """Step average precision at the ends of equal scores; null without positives."""
    steps = running(score_counts(rows, by, score, target), by, F.col("score").desc(), ["n", "p"])
    gain = F.sum(F.col("p") * F.col("up_p") / F.col("up_n"))
    return steps.groupBy(*by).agg(ratio(gain, F.sum("p"), None).alias("average_precision"), F.sum("n").alias("n"), F.sum("p").alias("positives"))


def auroc(rows: DataFrame, by: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """Area under the ROC curve by mid-ranks; null without both classes."""
    steps = running(score_counts(rows, by, score, target), by, F.col("score").asc(), ["n", "p"])
    negative = F.col("n") - F.col("p")
    won = F.sum(F.col("p") * (F.col("up_n") - F.col("up_p") - negative / 2.0))
    p, n = F.sum("p"), F.sum("n")
    return steps.groupBy(*by).agg(ratio(won, p * (n - p), None).alias("auroc"), n.alias("n"), p.alias("positives"))


def _below(x: Column, levels: list[float], first: int = 0) -> Column:
    """How many of the sorted levels are below x; by halving, so that a row is not held against every level."""
    if not levels:
        return F.lit(first)
    half = len(levels) // 2
    return F.when(x <= levels[half], _below(x, levels[:half], first)).otherwise(_below(x, levels[half + 1 :], first + half + 1))


def quantiles(rows: DataFrame, by: list[str], value: str | Column, levels: list[float]) -> DataFrame:
    """``level, value``: exact linear quantiles of the values that are not null, of each group."""
    value = F.col(value) if isinstance(value, str) else value
    counts = rows.select(*by, value.cast("double").alias("value")).where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("n"))
    steps = running(counts, by, F.col("value").asc(), ["n"])
    place = lambda q: F.lit(q) * (F.col("all_n") - 1)
    asked = F.array(*[F.struct(F.lit(q).alias("level"), F.floor(place(q)).alias("low"), F.ceil(place(q)).alias("high"), (place(q) - F.floor(place(q))).alias("share")) for q in levels])
    here = lambda at: (at >= F.col("up_n") - F.col("n")) & (at < F.col("up_n"))
    # few rows hold a level: only those are taken times all levels
    last, known = F.greatest(F.col("all_n") - 1, F.lit(1)), sorted(set(levels))
    some = steps.where(_below(F.col("up_n") / last + 1e-9, known) > _below((F.col("up_n") - F.col("n") - 1) / last - 1e-9, known))
    found = some.select(*by, "value", "n", "up_n", F.explode(asked).alias("q")).where(here(F.col("q.low")) | here(F.col("q.high")))
    ends = found.groupBy(*by, "q.level", "q.share").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return ends.select(*by, "level", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("value"))


def quantile_columns(rows: DataFrame, by: list[str], value: str | Column, **levels: float) -> DataFrame:
    """A row for each group, with the quantiles as columns."""
    at = lambda q: F.max(F.when(F.col("level") == q, F.col("value")))
    return quantiles(rows, by, value, sorted(set(levels.values()))).groupBy(*by).agg(*[at(q).alias(k) for k, q in levels.items()])


def mid_ranks(rows: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """Average rank of each distinct value of a group."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return running(counts, by, F.col(column).asc(), ["n"]).select(*by, column, (F.col("up_n") - (F.col("n") - 1) / 2.0).alias(out))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null for fewer than two rows or a constant side."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.join(mid_ranks(rows, by, x, "rx"), [*by, x]).join(mid_ranks(rows, by, y, "ry"), [*by, y])
    constant = (F.stddev_pop("rx") == 0) | (F.stddev_pop("ry") == 0)
    return ranked.groupBy(*by).agg(F.when((F.count("*") < 2) | constant, None).otherwise(F.corr("rx", "ry")).alias("rho"))


def sweep(counts: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of ``score >= threshold`` for each row of ``score_counts``."""
    steps = running(counts, by, F.col("score").desc(), ["n", "p"])
    fp, fn = F.col("up_n") - F.col("up_p"), F.col("all_p") - F.col("up_p")
    return steps.select(*by, F.col("score").alias("threshold"), F.col("up_p").alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("all_n") - F.col("up_n") - fn).alias("tn"))


def best_of_counts(counts: DataFrame, by: list[str], first: str = "dice", second: str = "precision") -> DataFrame:
    """Of ``score_counts``, the threshold with the largest (first, second, threshold)."""
    steps = sweep(counts, by)
    found = pixel_metrics(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    steps = steps.withColumns({"a": F.round(found[first], 12), "b": F.round(found[second], 12)})
    best = F.max(F.struct("a", "b", "threshold")).alias("best")
    return steps.groupBy(*by).agg(best).select(*by, F.col("best.a").alias(first), F.col("best.b").alias(second), "best.threshold")


def threshold_counts(rows: DataFrame, by: list[str], score: str = "score", target: str = "target") -> DataFrame:
    """tp, fp, fn, tn of ``score >= threshold`` for every distinct score, by one cumulative pass."""
    return sweep(score_counts(rows, by, score, target), by)


def best_threshold(rows: DataFrame, by: list[str], first: str = "dice", second: str = "precision", **names: str) -> DataFrame:
    """The threshold with the largest (first, second, threshold)."""
    return best_of_counts(score_counts(rows, by, **names), by, first, second)


def percentile_rank(rows: DataFrame, reference: DataFrame, score: str = "score") -> DataFrame:
    """Share of reference scores that are not above each distinct score of ``rows``."""
    one = lambda some, n, asked: some.select(score, F.lit(n).cast("long").alias("n"), F.lit(asked).alias("asked"))
    both = one(rows, 0, True).unionByName(one(reference, 1, False)).groupBy(score).agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")).withColumn("one", F.lit(1))
    out = running(both, ["one"], F.col(score).asc(), ["n"]).where("asked")
    return out.select(score, (F.col("up_n") / F.col("all_n")).alias("percentile"))
