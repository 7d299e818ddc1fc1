"""Bootstrap intervals over sufficient statistics of clusters, with draws that are functions of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .splits import draw, ranked


def resample(clusters: DataFrame, by: list[str], cluster: str, replicates: int, seed: int) -> DataFrame:
    """``replicate`` and the columns of a drawn cluster, as many draws for a replicate as a stratum has clusters.

    Clusters are rows of counts, so that a replicate costs their number and not that of their members. They are numbered by
    spans, and each draw finds its cluster by number. Spark estimates the draws by the rows that they are exploded from: so
    that it neither broadcasts them nor makes them in one task, clusters are dealt out first and the join is a shuffled one.
    """
    numbered = keep(ranked(clusters, by, cluster).withColumn("place", F.col("place") - 1), "clusters")
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(x).cast("string") for x in by], F.col("replicate").cast("string"), F.col("place").cast("string")), 256)
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = numbered.select(*by, "place", "n").repartition(tasks, *by, "place").select(*by, "place", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = slots.select(*by, "replicate", F.pmod(draw(key), F.col("n")).cast("int").alias("place"))
    return drawn.join(numbered.drop("n").hint("shuffle_hash"), [*by, "place"])


def interval(replicates: DataFrame, by: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Linear percentiles of a statistic's replicates, which are as many as were asked for."""
    alpha = (1 - confidence) / 2
    q = lambda p: F.percentile(value, F.lit(p))
    out = {"mean": F.avg(value), "lower": q(alpha), "upper": q(1 - alpha)}
    return replicates.groupBy(*by).agg(F.count(value).alias("n"), *[F.round(x, 6).alias(k) for k, x in out.items()])


def by_sample(rows: DataFrame, sample: str, value: Column, replicates: int, seed: int) -> DataFrame:
    """``estimate``, the mean of the samples with a value, and its interval over replicates of as many draws from them."""
    some = keep(rows.select(F.col(sample).alias("sample"), value.cast("double").alias("v")).where("v is not null"), "samples")
    found = bootstrap(some, [], "sample", F.avg("v"), replicates, seed)
    return found.crossJoin(some.agg(F.round(F.avg("v"), 6).alias("estimate")))  # one row each


def paired(clusters: DataFrame, by: list[str], cluster: str, method: str, value: str, replicates: int, seed: int) -> DataFrame:
    """``a, b`` and the interval of the mean difference a - b of two methods' values, over clusters that both have.

    One draw of clusters serves all methods. ``clusters``: a row for each cluster and method.
    """
    wide = clusters.groupBy(*by, cluster).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(method).alias("m"), F.col(value).alias("v"))))).alias("values"))
    drawn = resample(wide, by, cluster, replicates, seed)
    entries = F.map_entries("values")
    a, b = F.explode(entries).alias("x"), F.explode("other").alias("y")
    pairs = drawn.select("replicate", entries.alias("other"), a).select("replicate", "x", b).where("x.key < y.key")
    means = pairs.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"), "replicate").agg(F.avg(F.col("x.value") - F.col("y.value")).alias("value"))
    return interval(means, ["a", "b"], "value")


def bootstrap(clusters: DataFrame, by: list[str], cluster: str, statistic: Column, replicates: int, seed: int) -> DataFrame:
    """Interval of an aggregate over resampled clusters, for each stratum."""
    drawn = resample(clusters, by, cluster, replicates, seed)
    return interval(drawn.groupBy(*by, "replicate").agg(statistic.alias("value")), by, "value")
