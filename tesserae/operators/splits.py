"""Deterministic orders, samples and splits, by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles, running


def order_key(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts, joined by the pipe character."""
    return F.sha2(F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]), 256)


def draw(key: Column) -> Column:
    """48 bits of a digest as a long."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def ranked(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """``rows`` with their ``place`` from 1 in the order within their group, and the group's size ``n``; by spans, so that no
    group is in one task. The order must tell rows apart."""
    key = F.struct(*order)
    found = running(rows.withColumn("one", F.lit(1).cast("long")), by, key, ["one"])
    return found.select(*rows.columns, F.col("up_one").cast("int").alias("place"), F.col("all_one").alias("n"))


def reservoir(rows: DataFrame, capacity: int, *key: Column | str | int) -> DataFrame:
    """The ``capacity`` rows with the smallest keys; tasks keep no more each."""
    return rows.withColumn("order_key", order_key(*key)).orderBy("order_key").limit(capacity)


def limit_per_group(rows: DataFrame, by: list[str], limit: int, *key: Column | str | int) -> DataFrame:
    """The first ``limit`` rows of each group by key."""
    w = Window.partitionBy(*by).orderBy("order_key")
    rows = rows.withColumn("order_key", order_key(*key))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def even_places(rows: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """``count`` rows of each group at even places from first to last, as linspace truncates them; all of fewer rows."""
    rows = ranked(rows, by, *order).withColumn("place", F.col("place") - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("n") - 1) / float(max(1, count - 1))).cast("int"))
    return rows.where((F.col("n") <= count) | F.array_contains(places, F.col("place"))).drop("n")


def every(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every k-th row of a group, k its size over ``most``, rounded down, at least 1."""
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(most)))
    rows = ranked(rows, by, *order).withColumns({"place": F.col("place") - 1, "stride": stride}).drop("n")
    return rows.where(F.col("place") % F.col("stride") == 0)


def group_split(groups: DataFrame, by: list[str], share: float, *key: Column | str | int) -> DataFrame:
    """Distinct groups, ordered by hash: a rounded share for calibration, one for test, and the rest to fit."""
    rows = ranked(groups.withColumn("order_key", order_key(*key)), by, "order_key")
    rows = rows.withColumn("size", F.bround(F.col("n") * F.lit(share)).cast("int")).drop("n")
    role = F.when(F.col("place") <= F.col("size"), "calibration").when(F.col("place") <= 2 * F.col("size"), "test").otherwise("fit")
    return rows.withColumn("role", role).drop("size", "place")


def leave_one_out(groups: DataFrame, by: list[str], group: str, seed: int) -> DataFrame:
    """A fold for each group: it is tested, the one with the smallest hash among the rest calibrates, others fit.

    Folds multiply the groups of each ``by`` with themselves; groups are few, unlike their rows.
    """
    folds = groups.select(*by, F.col(group).alias("fold"))
    both = groups.join(folds, by).withColumn("order_key", order_key(seed, F.col("fold"), F.col(group)))
    rest = F.when(F.col(group) != F.col("fold"), F.col("order_key"))
    least = F.min(rest).over(Window.partitionBy(*by, "fold"))
    role = F.when(F.col(group) == F.col("fold"), "test").when(F.col("order_key") == least, "calibration").otherwise("fit")
    return both.select(*by, "fold", group, role.alias("role"))


def split_sizes(n: int, shares: tuple[float, ...]) -> list[int]:
    """Sizes by largest remainder, at least one each; ``n`` must allow that."""
    if n < len(shares):
        raise ValueError("too few groups for the splits")
    wanted = [n * x for x in shares]
    sizes = [max(1, int(x + 1e-9)) for x in wanted]
    while sum(sizes) != n:
        step = 1 if sum(sizes) < n else -1
        able = [i for i in range(len(sizes)) if sizes[i] + step >= 1]
        best = max(able, key=lambda i: (round(step * (wanted[i] - sizes[i]), 9), -i))
        sizes[best] += step
    return sizes


def overlap(rows: DataFrame, role: str, keys: list[str]) -> DataFrame:
    """For each key: its distinct values, and how many of them occur in more than one role."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(k).cast("string").alias("value")) for k in keys]))
    found = rows.select(pairs.alias("x"), role).where("x.value is not null").groupBy("x.family", "x.value")
    found = found.agg(F.count_distinct(role).alias("roles"))
    return found.groupBy("family").agg(F.count("*").alias("n_values"), F.count_if(F.col("roles") > 1).alias("n_shared"))


def leaks(rows: DataFrame, key: str, split: str, order: str) -> DataFrame:
    """Rows whose key another split owns: the first row of a key, by ``order``, is its owner's."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, split)).alias("first"))
    found = rows.join(first, key).where(F.col(split) != F.col(f"first.{split}"))
    return found.select(order, key, split, F.col(f"first.{split}").alias("owner"))


def quantile_grid(rows: DataFrame, by: list[str], value: str, count: int) -> DataFrame:
    """Distinct quantiles of each group at ``count`` even levels from 0 to 1."""
    found = quantiles(rows, by, value, [k / (count - 1) for k in range(count)])
    return found.select(*by, F.col("value").alias("candidate")).distinct()


def sizes_by_remainder(groups: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``role, size`` of each ``by``: its ``n`` groups split by largest remainder, at least one each (``split_sizes``).

    ``groups``: ``by, n``; an error where n is less than the roles. Sizes that are too large or small are mended one by one,
    those first that are farthest from their share.
    """
    names, k = list(shares), len(shares)
    wanted = F.array(*[F.col("n") * F.lit(float(x)) for x in shares.values()])
    start = F.transform(wanted, lambda w: F.greatest(F.lit(1), F.floor(w + 1e-9).cast("int")))
    rows = groups.select(*by, F.when(F.col("n") < k, F.raise_error(F.lit("too few groups for the splits")).cast("long")).otherwise(F.col("n")).alias("n"))
    rows = rows.select(*by, "n", wanted.alias("wanted"), start.alias("sizes"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    step = F.signum(F.col("n") - total(F.col("sizes"))).cast("int")
    rank = lambda i: F.struct(F.round((F.get("wanted", i) - F.get("sizes", i)) * F.col("step"), 9).alias("gap"), (-i).alias("i"))
    for _ in range(k):  # floors miss less than one group a role, and a least size of one exceeds less than one
        rows = rows.withColumn("step", step)
        able = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get("sizes", i) + F.col("step") >= 1)
        best = -F.array_max(F.transform(able, rank))["i"]
        rows = rows.withColumn("best", best).withColumn("sizes", F.transform("sizes", lambda x, i: F.when(i == F.col("best"), x + F.col("step")).otherwise(x)))
    out = F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("role"), F.col("sizes").alias("size")))
    return rows.select(*by, out.alias("o")).select(*by, F.col("o.role").alias("role"), F.col("o.size").alias("size"))
