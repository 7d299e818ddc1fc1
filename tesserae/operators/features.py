"""Features of image patches: a fixed vector for each window of sized images with channels ``r, g, b`` and a mask ``tissue``.

A patch is an image of its own: its texture and gradients are mirrored at its edges. A patch holds few cells, so that exact
percentiles of its cells are small aggregates. Patches without tissue have zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intensity
from ..storage import keep
from . import grid, tiles

_KEYS = ["image", "y0", "x0"]
_CELL = ["patch", "y", "x"]


def patches(plane: DataFrame, size: int, stride: int) -> DataFrame:
    """Cells of all windows, by ``patch`` and place in it; an image has up to 2^20 rows and columns."""
    rows = grid.in_patches(plane, size, stride)
    patch = F.shiftleft(F.col("image").cast("long"), 40) + F.shiftleft(F.col("y0").cast("long"), 20) + F.col("x0")
    own = {"y": F.col("y") - F.col("y0"), "x": F.col("x") - F.col("x0"), "height": F.least(F.lit(size), "height"), "width": F.least(F.lit(size), "width")}
    return rows.withColumn("patch", patch).withColumns(own)


def _textured(rows: DataFrame, value: str) -> DataFrame:
    """Cells with the local deviation ``contrast`` and the ``gradient`` of a value within their patch."""
    one = rows.select(F.col("patch").alias("image"), "y", "x", "height", "width", value)
    named = lambda found, old, new: found.select(F.col("image").alias("patch"), "y", "x", F.col(old).alias(new))
    rows = tiles.on_cells(rows, named(tiles.local_moments(one, value), "sd", "contrast"), by=tuple(_CELL))
    return keep(tiles.on_cells(rows, named(tiles.gradient(one, value), "magnitude", "gradient"), by=tuple(_CELL)), "patch-cells")


def _q(column: str | Column, level: float) -> Column:
    return F.percentile(column, F.lit(level))


def _with_shares(rows: DataFrame, least_edge: float) -> DataFrame:
    """``patch, edge_fraction``: cells whose gradient is over the third quartile of their patch's and over a least value."""
    limit = rows.groupBy("patch").agg(F.greatest(_q("gradient", 0.75), F.lit(least_edge)).alias("limit"))
    return rows.join(limit, "patch").groupBy("patch").agg(F.avg((F.col("gradient") > F.col("limit")).cast("double")).alias("edge_fraction"))


def _all_patches(rows: DataFrame, found: DataFrame) -> DataFrame:
    base = rows.groupBy("patch", *_KEYS).agg(F.avg(F.col("tissue").cast("double")).alias("tissue_fraction"))
    return base.join(found, "patch", "left").drop("patch").na.fill(0.0)


def bright(plane: DataFrame, size: int = 64, stride: int = 64) -> DataFrame:
    """``image, y0, x0`` and 17 features of density, stains, colour, texture and edges."""
    rgb = [F.col(c) for c in "rgb"]
    od = [intensity.optical_density(c) for c in rgb]
    h, e = (intensity.linear(od, w) for w in intensity.stain_weights())
    rows = patches(plane, size, stride).select("patch", *_KEYS, "y", "x", "height", "width", "tissue", (od[0] + od[1] + od[2]).alias("od"), h.alias("h"), e.alias("e"), intensity.saturation(*rgb).alias("saturation"), intensity.gray(*rgb).alias("gray"))
    rows = _textured(rows, "gray")
    inside = rows.where("tissue")
    plain = {"od_mean": F.avg("od"), "od_std": F.stddev_pop("od"), "od_p90": _q("od", 0.9)}
    plain |= {f"{c}_{k}": x for c in ("h", "e", "saturation", "contrast", "gradient") for k, x in (("mean", F.avg(c)), ("p90", _q(c, 0.9)))}
    found = inside.groupBy("patch").agg(*[x.alias(k) for k, x in plain.items()], _q("od", 0.5).alias("middle"))
    away = inside.join(found.select("patch", "middle"), "patch")
    spread = away.groupBy("patch").agg(_q(F.abs(F.col("od") - F.col("middle")), 0.5).alias("mad"))
    dark = away.join(spread, "patch").groupBy("patch").agg(F.avg((F.col("od") > F.greatest(F.col("middle") + 2.5 * F.col("mad"), F.lit(1.25))).cast("double")).alias("dark_fraction"))
    for part in (grid.entropy(inside, ["patch"], F.col("gray")), _with_shares(inside, 0.025), dark):
        found = found.join(part, "patch")
    return _all_patches(rows, found.drop("middle"))


def _unit_scaled(rows: DataFrame, channels: list[str]) -> DataFrame:
    """Channels between their 1st and 99.5th percentile of a patch's positive cells, or their range if those are few."""
    def ends(c: str) -> list[Column]:
        positive, some = F.when(F.col("tissue") & (F.col(c) > 0), F.col(c)), F.when(F.col("tissue"), F.col(c))
        many = F.count(positive) >= 16
        return [F.when(many, _q(positive, 0.01)).otherwise(F.min(some)).alias(f"{c}_low"), F.when(many, _q(positive, 0.995)).otherwise(F.max(some)).alias(f"{c}_high")]

    rows = rows.join(rows.groupBy("patch").agg(*[x for c in channels for x in ends(c)]), "patch")
    width = lambda c: F.col(f"{c}_high") - F.col(f"{c}_low")
    scaled = {f"s_{c}": F.when(width(c) > 2.3e-16, intensity.clip((F.col(c) - F.col(f"{c}_low")) / width(c))).otherwise(0.0) for c in channels}
    return rows.withColumns(scaled).drop(*[f"{c}_{k}" for c in channels for k in ("low", "high")])


def fluorescence(plane: DataFrame, size: int = 64, stride: int = 64, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """``image, y0, x0`` and 16 features of the channels' strongest signal, texture, edges, ranges and correlations."""
    names = list(channels)
    rows = patches(plane, size, stride).select("patch", *_KEYS, "y", "x", "height", "width", "tissue", *names)
    rows = _unit_scaled(rows, names).withColumn("aggregate", F.greatest(*[F.col(f"s_{c}") for c in names]) if len(names) > 1 else F.col(f"s_{names[0]}"))
    rows = _textured(rows, "aggregate")
    inside, a = rows.where("tissue"), F.col("aggregate")
    plain = {"mean": F.avg(a), "std": F.stddev_pop(a), "p90": _q(a, 0.9), "p99": _q(a, 0.99), "over_tenth": F.avg((a > 0.1).cast("double"))}
    plain |= {f"{c}_{k}": x for c in ("contrast", "gradient") for k, x in (("mean", F.avg(c)), ("p90", _q(c, 0.9)))}
    own = {c: (F.avg(f"s_{c}"), _q(f"s_{c}", 0.99) - _q(f"s_{c}", 0.01), F.avg((F.col(c) >= 0.995).cast("double"))) for c in names}
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    alike = [F.when((F.stddev_pop(f"s_{x}") > 1e-8) & (F.stddev_pop(f"s_{y}") > 1e-8) & (F.count("*") >= 4), F.corr(f"s_{x}", f"s_{y}")) for x, y in pairs]
    listed = [F.array(*[own[c][k] for c in names]).alias(f"list_{k}") for k in range(3)]
    found = inside.groupBy("patch").agg(*[x.alias(k) for k, x in plain.items()], *listed, F.array_sort(F.array_compact(F.array(*alike))).alias("alike") if pairs else F.array().cast("array<double>").alias("alike"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    half = F.size("alike") / 2
    middle = (F.get("alike", F.floor(half - 0.5).cast("int")) + F.get("alike", F.floor(half).cast("int"))) / 2
    deviation = F.sqrt(F.greatest(mean(F.transform("list_0", lambda x: x * x)) - mean("list_0") * mean("list_0"), F.lit(0.0)))
    found = found.withColumns({"channel_mean": mean("list_0"), "channel_std": deviation, "channel_range": mean("list_1"), "channel_saturation": mean("list_2"), "correlation": F.when(F.size("alike") > 0, middle).otherwise(0.0)})
    found = found.drop("alike", "list_0", "list_1", "list_2").join(_with_shares(inside, 0.03), "patch")
    return _all_patches(rows, found)
