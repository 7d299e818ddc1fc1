"""Windows over images, grids of other sizes, and histograms. Images are rows ``image, y, x, v``; sized ones have their
``height`` and ``width`` (``tiles.sized``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_starts(length: Column, size: int, stride: int) -> Column:
    """Starts 0, stride, ... and one that ends flush; only 0 if the length fits one window."""
    steps = F.sequence(F.lit(0), length - size, F.lit(stride))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.array_append(steps, length - size)))


def patch_grid(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Half-open boxes of all windows of ``height, width`` rows."""
    rows = images.withColumn("y0", F.explode(window_starts(F.col("height"), size, stride)))
    rows = rows.withColumn("x0", F.explode(window_starts(F.col("width"), size, stride)))
    return rows.withColumns({"y1": F.least(F.col("y0") + size, "height"), "x1": F.least(F.col("x0") + size, "width")})


def halo_tiles(images: DataFrame, core: int, halo: int) -> DataFrame:
    """Cores that cover an image once, with halos that its edges clip."""
    starts = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.col(c) - 1, F.lit(0)), F.lit(core)))
    rows = images.withColumn("y0", starts("height")).withColumn("x0", starts("width"))
    rows = rows.withColumns({"y1": F.least(F.col("y0") + core, "height"), "x1": F.least(F.col("x0") + core, "width")})
    outer = {"hy0": F.greatest(F.col("y0") - halo, F.lit(0)), "hx0": F.greatest(F.col("x0") - halo, F.lit(0))}
    outer |= {"hy1": F.least(F.col("y1") + halo, "height"), "hx1": F.least(F.col("x1") + halo, "width")}
    return rows.withColumns(outer)


def in_patches(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """Each pixel of sized images (``height, width``) with the y0, x0 of every window over it, by division: a cell costs
    as many rows as windows hold it, whatever the image's size. A cell outside its image is an error.
    """

    def starts(at: str, length: str) -> Column:
        at, length = F.col(at), F.col(length)
        tail = length - size
        first = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride).cast("int"))
        last = F.least(F.floor(at / stride), F.floor(tail / stride)).cast("int")
        even = F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
        found = F.when(tail <= 0, F.array(F.lit(0))).when((tail % stride != 0) & (at >= tail), F.array_append(even, tail.cast("int"))).otherwise(even)
        return F.when((at >= 0) & (at < length), found).otherwise(F.raise_error(F.lit("a cell is outside its image")).cast("array<int>"))

    return pixels.withColumn("y0", F.explode(starts("y", "height"))).withColumn("x0", F.explode(starts("x", "width")))


def area_resample(plane: DataFrame, rows: Column | int, cols: Column | int) -> DataFrame:
    """Exact area means of sized images on coarser grids of ``rows`` by ``cols``. A cell outside its image is an error."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)

    def parts(at: str, length: str, count: Column) -> Column:
        scale = count.cast("double") / F.col(length)
        low, high = F.col(at) * scale, (F.col(at) + 1) * scale
        cells = F.sequence(F.floor(low).cast("int"), F.least(F.ceil(high).cast("int") - 1, count - 1))
        cut = F.transform(cells, lambda k: F.struct(k.alias("cell"), (F.least(high, k + 1.0) - F.greatest(low, k + 0.0)).alias("share")))
        inside = (F.col(at) >= 0) & (F.col(at) < F.col(length))
        return F.explode(F.when(inside, cut).otherwise(F.raise_error(F.lit("a cell is outside its image")).cast("array<struct<cell:int,share:double>>")))

    cut = plane.withColumn("rows", wrap(rows)).withColumn("cols", wrap(cols))
    cut = cut.withColumn("a", parts("y", "height", F.col("rows"))).withColumn("b", parts("x", "width", F.col("cols")))
    weight = F.col("a.share") * F.col("b.share")
    return cut.groupBy("image", F.col("a.cell").alias("y"), F.col("b.cell").alias("x")).agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("v"))


def bilinear(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """``image, y, x, v``: a coarse grid (``image, ty, tx, score``) at each of the ``cells`` of sized images, linear between
    the grid's centres and level beyond the outer ones. A cell looks up the four places around it."""
    shape = grid.groupBy("image").agg((F.max("ty") + 1).alias("rows"), (F.max("tx") + 1).alias("cols"))

    def corners(at: str, length: str, count: str) -> Column:
        place = F.least(F.greatest((F.col(at) + 0.5) * F.col(count) / F.col(length) - 0.5, F.lit(0.0)), F.col(count) - 1.0)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.col(count) - 1).cast("int")
        near = F.array(F.struct(low.alias("k"), (1 - (place - low)).alias("w")), F.struct(high.alias("k"), (place - low).alias("w")))
        return F.explode(F.filter(near, lambda c: c["w"] > 0))

    rows = cells.select("image", "y", "x", "height", "width").join(shape, "image")
    rows = rows.withColumn("a", corners("y", "height", "rows")).withColumn("b", corners("x", "width", "cols"))
    rows = rows.select("image", "y", "x", F.col("a.k").alias("ty"), F.col("b.k").alias("tx"), (F.col("a.w") * F.col("b.w")).alias("w"))
    return rows.join(grid, ["image", "ty", "tx"]).groupBy("image", "y", "x").agg(F.sum(F.col("w") * F.col("score")).alias("v"))


def otsu(values: DataFrame, by: list[str], value: str, bins: int = 128) -> DataFrame:
    """The centre of the histogram bin that parts values best, for each group: largest variance between, the last bin left out,
    the first of ties; the largest value where all are alike."""
    ends = values.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    step = (F.col("high") - F.col("low")) / bins
    place = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("low")) / F.when(step > 0, step)), F.lit(bins - 1))).otherwise(0)
    rows = values.join(ends, by)
    counts = rows.groupBy(*by, "low", "high", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    middle = F.col("low") + (F.col("bin") + 0.5) * step
    up, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    sums = counts.withColumns(
        {"w": F.sum("n").over(up), "s": F.sum(F.col("n") * middle).over(up), "all_n": F.sum("n").over(whole), "all_s": F.sum(F.col("n") * middle).over(whole)}
    ).where(F.col("bin") < bins - 1)
    rest = F.col("all_n") - F.col("w")
    between = F.when(rest > 0, F.col("w") * rest * F.pow(F.col("s") / F.col("w") - (F.col("all_s") - F.col("s")) / F.when(rest > 0, rest), F.lit(2)))
    best = F.max_by(middle, F.struct(F.round(between, 6), -F.col("bin")))
    found = sums.where(between.isNotNull()).groupBy(*by).agg(best.alias("threshold"))
    return ends.join(found, by, "left").select(*by, F.coalesce("threshold", "high").alias("threshold"))


def entropy(values: DataFrame, by: list[str], value: Column, bins: int = 32) -> DataFrame:
    """Entropy, in bits, of a histogram of values in [0, 1]."""
    place = F.least(F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).alias("bin")
    counts = values.groupBy(*by, place).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", share).groupBy(*by).agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"))
