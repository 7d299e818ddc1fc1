"""Queries of masks: parts, holes, instances, lines and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, candidates, confusion, contours, evaluation, features, masks, matching, ranking, tiles
from ..functions.rates import ratio
from ..storage import keep
from .image import _MIRROR, _OD, _around, disk_sql
from .views import SIZED, plane

_KEYS = ["image", "y", "x"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sized images with a target, a prediction near it and a valid region."""
    kind, v = F.col("event_type"), F.col("v")
    target = kind == "click"
    return tiles.sized(plane(spark, sf_dir)).select(*_KEYS, "height", "width", "v", target.alias("t"), (target & (v > 8) | (kind == "error") & (v > 120)).alias("p"), (v < 350).alias("valid"))


_ROWS = f"""{SIZED}, rows AS (
    SELECT image, y, x, height, width, v, event_type = 'click' AS t, (event_type = 'click' AND v > 8) OR (event_type = 'error' AND v > 120) AS p, v < 350 AS valid FROM sized)"""


def _first(name: str) -> list[F.Column]:
    """Row and column of the first cell of a part."""
    return [F.shiftright(name, 20).bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias(f"{name}_y"), F.col(name).bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias(f"{name}_x")]


def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two cells or more."""
    found = masks.by_area(_rows(spark, sf_dir).where("t"), 2, None, 8)
    return found.select("image", "part", "area").distinct().select("image", *_first("part"), "area")


def small_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes of up to four cells."""
    rows = _rows(spark, sf_dir).withColumn("mask", F.col("v") > 12)
    return masks.holes(rows, "mask", 4)


def elongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plane(spark, sf_dir).where("event_type IN ('click', 'view')").select(*_KEYS)
    found = masks.shapes(masks.label(rows, 4)).where("area >= 5")
    return found.select("image", *_first("part"), "area", F.round(F.col("elongation") + 1e-9, 5).alias("elongation"), F.round(F.col("occupancy") + 1e-9, 6).alias("occupancy"))


def elongated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.elongated(plane(spark, sf_dir).where("event_type IN ('click', 'view')").select(*_KEYS), 5)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = keep(_rows(spark, sf_dir).where("valid"), "sides")
    return rows, *[keep(matching.instances(rows.where(c).select(*_KEYS)), "instances") for c in "tp"]


def instance_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every pair of instances that meet."""
    _, target, prediction = _sides(spark, sf_dir)
    return matching.overlaps(target, prediction).select("image", *_first("t"), *_first("p"), F.round("iou", 6).alias("iou"))


def instance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.instance_counts(*_sides(spark, sf_dir), threshold=0.6)
    return found.select("image", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "mean_iou")])


def instance_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At an overlap of a tenth, where instances compete for partners."""
    found = matching.instance_counts(*_sides(spark, sf_dir))
    return found.select("image", "tp", "fp", "fn", *[F.round(F.col(x) + 1e-9, 6).alias(x) for x in ("precision", "recall", "f1", "mean_iou")])


def froc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks found among clicks and high values by steps of the value, at each of its thresholds and an overlap of a tenth."""
    rows = _rows(spark, sf_dir)
    scored = rows.where("valid AND (t OR v > 100)").select(*_KEYS, F.floor(F.col("v") / 25).cast("double").alias("score"))
    found = matching.froc_curve(rows, rows.where("t").select(*_KEYS), scored)
    return found.withColumns({x: F.round(F.col(x) + 1e-9, 6) for x in ("sensitivity", "fp_per_image")})


def froc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks found by their values at three thresholds."""
    rows = _rows(spark, sf_dir)
    scored = rows.where("t OR v > 60").select(*_KEYS, F.col("v").alias("score"))
    found = matching.froc(rows, rows.where("t").select(*_KEYS), scored, [0.0, 10.0, 40.0], 0.6)
    return found.withColumns({x: F.round(x, 6) for x in ("sensitivity", "fp_per_image")})


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("mask", F.col("v") > 12)
    return contours.skeleton(rows, "mask").where("line").select(*_KEYS)


def centerline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contours.centerline_metrics(_rows(spark, sf_dir), "t", "p", "valid", 1.0)
    return found.select("image", "n_target", "n_predicted", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "assd", "hd95", "cl_dice")])


def evaluate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested evaluation of each image, its main members as columns."""
    found = evaluation.evaluate(_rows(spark, sf_dir), "t", "p", "valid", 1.0, 0.6, pixel_area=0.25)
    members = ("pixel.dice", "pixel.iou", "boundary.f1", "boundary.hd95", "centerline.f1", "centerline.cl_dice", "instance.f1", "burden.absolute_error", "burden.true_area")
    return found.select("image", "pixel.tp", "pixel.fp", "pixel.fn", *[F.round(F.col(x) + 1e-9, 6).alias(x.replace(".", "_")) for x in members])


def fold_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of folds on the cells that pass as tissue."""
    rows = candidates.channels(plane(spark, sf_dir)).withColumn("support", (F.col("od") > 0.18) | (F.col("saturation") > 0.055))
    return candidates.fold_scores(rows).select(*_KEYS, F.round("score", 5).alias("score"))


def fold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed parts of three cells or more that score as folds."""
    rows = candidates.channels(plane(spark, sf_dir)).withColumn("support", (F.col("od") > 0.18) | (F.col("saturation") > 0.055))
    return candidates.folds(rows, 3, 0.45).where("fold").select(*_KEYS)


def candidate_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissue, folds and cracks of each image, by the whole procedure."""
    found = candidates.both(plane(spark, sf_dir), 8)
    return found.groupBy("image").agg(*[F.count_if(c).alias(c) for c in ("support", "fold", "crack", "review")], F.round(F.sum("score"), 3).alias("fold_score"), F.round(F.sum("crack_score"), 3).alias("crack_score"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("image", "y0", "x0", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in found.columns if c not in ("image", "y0", "x0")])


def _tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.sized(plane(spark, sf_dir)).withColumn("tissue", F.col("event_type") != "signup")


def he_patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventeen features of each window."""
    return _rounded(features.bright(_tissue(spark, sf_dir), 32, 24))


def fluorescence_patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen features of each window."""
    return _rounded(features.fluorescence(_tissue(spark, sf_dir), 32, 24))


def response_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of folds put into each image at each severity: precision of the increments as scores, overlap at a threshold, the share
    of the fold's parts that it hits, and the shares of increments and of called cells outside it."""
    rows = artifacts.inject(tiles.sized(plane(spark, sf_dir)), "v", [0.5, 1.0]).where("artifact = 'fold'")
    rows = rows.withColumn("case", (F.col("image") * 2 + (F.col("severity") > 0.7).cast("int"))).withColumn("score", F.round(F.greatest(F.col("new") - F.col("v"), F.lit(0.0)), 9))
    rows = keep(rows.select("case", "image", "severity", "y", "x", (F.col("inside") & (F.col("v") > 20)).alias("target"), "score", (F.col("score") >= 30).alias("called")), "responses")
    ap = ranking.average_precision(rows, ["case"]).select("case", "average_precision")
    parts = masks.label(rows.where("target").select(F.col("case").alias("image"), "y", "x"), 8)
    hit = parts.join(rows.select(F.col("case").alias("image"), "y", "x", "called"), ["image", "y", "x"]).groupBy("image", "part").agg(F.max("called").alias("hit"))
    hit = hit.groupBy(F.col("image").alias("case")).agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    n = lambda c: F.count_if(c)
    t, p = F.col("target"), F.col("called")
    found = rows.groupBy("case", "image", "severity").agg(
        F.when(n(t) > 0, ratio(2 * n(t & p), n(t) + n(p), 1.0)).alias("dice"), ratio(F.sum(F.when(~t, F.col("score")).otherwise(0.0)), F.sum("score"), None).alias("outside_mass"), ratio(n(~t & p), n(p), None).alias("outside_cells")
    )
    found = found.join(ap, "case", "left").join(hit, "case", "left").drop("case")
    return found.select("image", "severity", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("dice", "outside_mass", "outside_cells", "average_precision", "hit_rate")])


def feasibility_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios of artifact and severity, by modality: pooled counts of changed cells found by a threshold, and their metrics."""
    rows = artifacts.inject(tiles.sized(plane(spark, sf_dir)), "v", [0.25, 0.5, 1.0])
    rows = rows.withColumn("modality", F.element_at(F.array(F.lit("he"), F.lit("comet"), F.lit("cosmx")), (F.col("image") % 3 + 1).cast("int")))
    counts = confusion.confusion(rows, ["modality", "artifact", "severity"], F.col("inside"), F.abs(F.col("new") - F.col("v")) >= 15, F.col("v") < 350)
    return confusion.metrics(counts, ["dice", "recall", "precision"])


def analysis_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within four of a target or a prediction, in the square norm."""
    rows = _rows(spark, sf_dir).withColumn("mask", (F.col("t") | F.col("p")) & (F.col("v") > 60))
    return tiles.morphology(rows, "mask", tiles.square(4)).where("mask").groupBy("image").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max("x").alias("right"))


QUERIES = {
    f.__name__: f
    for f in (
        grid_components, small_holes, elongation, elongated_cells, instance_iou, instance_metrics, instance_assignment, froc_sweep, froc_curve, skeleton, centerline_metrics, evaluate_sample,
        fold_score, fold_candidates, candidate_masks, analysis_region, he_patch_features, fluorescence_patch_features, response_metrics, feasibility_grid,
    )
}


def _parts(name: str, cells: str, connectivity: int, key: str = "image") -> str:
    """CTEs of the cells of ``cells`` (key, y, x) with the first cell of their part (fy, fx) and its area."""
    near = "abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1" if connectivity == 8 else "abs(n.y - c.y) + abs(n.x - c.x) <= 1"
    return f"""{name}_c AS ({cells}), {name}_e AS (SELECT c.{key}, c.y * 1000000 + c.x AS a, n.y * 1000000 + n.x AS b FROM {name}_c c JOIN {name}_c n ON n.{key} = c.{key} AND {near}),
        {name}_r AS (SELECT {key}, a, a AS b FROM {name}_e WHERE a = b UNION SELECT r.{key}, r.a, e.b FROM {name}_r r JOIN {name}_e e ON e.{key} = r.{key} AND e.a = r.b),
        {name} AS (SELECT {key}, a // 1000000 AS y, a % 1000000 AS x, min(b) // 1000000 AS fy, min(b) % 1000000 AS fx, count(*) AS area FROM {name}_r GROUP BY {key}, a)"""


def _distance(name: str, a: str, b: str) -> str:
    """CTE of the cells of ``a`` and ``b`` with their distance to the other set."""
    near = lambda s, o, side: f"SELECT s.image, '{side}' AS side, s.y, s.x, min(sqrt(pow(s.y - o.y, 2) + pow(s.x - o.x, 2))) AS d FROM {s} s LEFT JOIN {o} o ON s.image = o.image GROUP BY ALL"
    return f"{name} AS ({near(a, b, 'a')} UNION ALL {near(b, a, 'b')})"


def _match(name: str, distances: str, tolerance: float) -> str:
    hit = lambda side: f"CASE WHEN count(*) FILTER (side = '{side}') = 0 THEN 1.0 ELSE count(*) FILTER (side = '{side}' AND d <= {tolerance})::DOUBLE / count(*) FILTER (side = '{side}') END"
    both = "count(*) FILTER (side = 'a') > 0 AND count(*) FILTER (side = 'b') > 0"
    return f"""{name}_m AS (SELECT image, count(*) FILTER (side = 'a') AS n_target, count(*) FILTER (side = 'b') AS n_predicted, {hit("a")} AS r, {hit("b")} AS p,
            CASE WHEN {both} THEN avg(d) END AS assd, CASE WHEN {both} THEN quantile_cont(d, 0.95) END AS hd95 FROM {distances} GROUP BY image),
        {name} AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM {name}_m)"""


def _thin(name: str, cells: str, passes: int = 8) -> str:
    """CTEs of a skeleton: as many double passes as thick masks take; further ones change nothing."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    place = " ".join(f"WHEN n.y - c.y = {dy} AND n.x - c.x = {dx} THEN {1 << k}" for k, (dy, dx) in enumerate(ring))
    out, before = [f"{name}_0 AS ({cells})"], f"{name}_0"
    for k in range(2 * passes):
        free = "(b & 21) <> 21 AND (b & 84) <> 84" if k % 2 == 0 else "(b & 69) <> 69 AND (b & 81) <> 81"
        now = f"{name}_{k + 1}" if k + 1 < 2 * passes else name
        out.append(
            f"{now}_b AS (SELECT c.image, c.y, c.x, coalesce(sum(CASE {place} END), 0)::INT AS b FROM {before} c LEFT JOIN {before} n ON n.image = c.image AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 AND (n.y <> c.y OR n.x <> c.x) GROUP BY ALL),"
            f" {now} AS MATERIALIZED (SELECT image, y, x FROM {now}_b WHERE NOT (bit_count(b) BETWEEN 2 AND 6 AND bit_count((255 - b) & ((b >> 1) | ((b & 1) * 128))) = 1 AND {free}))"
        )
        before = now
    return ",\n".join(out)


_T, _P = "SELECT image, y, x FROM rows WHERE t AND valid", "SELECT image, y, x FROM rows WHERE p AND valid"
_SIDES = f"""WITH RECURSIVE {_ROWS}, {_parts("t", _T, 8)}, {_parts("p", _P, 8)},
    o AS (SELECT image, t.fy AS ty, t.fx AS tx, p.fy AS py, p.fx AS px, count(*)::DOUBLE / (any_value(t.area) + any_value(p.area) - count(*)) AS iou FROM t JOIN p USING (image, y, x) GROUP BY ALL)"""
_INSTANCE = """inst_n AS (SELECT i.image, (SELECT count(DISTINCT (fy, fx)) FROM t WHERE t.image = i.image) AS nt, (SELECT count(DISTINCT (fy, fx)) FROM p WHERE p.image = i.image) AS np,
        (SELECT count(*) FROM o WHERE o.image = i.image AND iou >= 0.6) AS tp, (SELECT avg(iou) FROM o WHERE o.image = i.image AND iou >= 0.6) AS overlap FROM (SELECT DISTINCT image FROM rows) i),
    inst_r AS (SELECT *, CASE WHEN np = 0 THEN 1.0 ELSE tp::DOUBLE / np END AS p, CASE WHEN nt = 0 THEN 1.0 ELSE tp::DOUBLE / nt END AS r FROM inst_n),
    inst AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM inst_r)"""


def _assigned(name: str, pairs: str, key: str) -> str:
    """CTE ``name`` (key, tp, total): of all deals of the pairs (key, t, p, iou) of each connected part, the one with most pairs
    and then the largest total."""
    return f"""{name}_l AS (SELECT DISTINCT a.{key}, a.t AS a, b.t AS b FROM {pairs} a JOIN {pairs} b USING ({key}, p)),
    {name}_r AS (SELECT {key}, a, a AS b FROM {name}_l WHERE a = b UNION SELECT r.{key}, r.a, l.b FROM {name}_r r JOIN {name}_l l ON l.{key} = r.{key} AND l.a = r.b),
    {name}_t AS (SELECT {key}, a AS t, min(b) AS part FROM {name}_r GROUP BY ALL),
    {name}_e AS (SELECT {key}, part, t, p, iou, row_number() OVER (PARTITION BY {key}, part ORDER BY t, p) AS k FROM {pairs} JOIN {name}_t USING ({key}, t)),
    {name}_m AS (
        SELECT DISTINCT {key}, part, 0::BIGINT AS k, []::BIGINT[] AS ts, []::BIGINT[] AS ps, 0 AS n, 0.0::DOUBLE AS w FROM {name}_e
        UNION ALL
        SELECT m.{key}, m.part, e.k, list_append(ts, e.t), list_append(ps, e.p), n + 1, w + iou FROM {name}_m m JOIN {name}_e e ON e.{key} = m.{key} AND e.part = m.part
        WHERE e.k > m.k AND NOT list_contains(ts, e.t) AND NOT list_contains(ps, e.p)),
    {name}_b AS (SELECT {key}, part, max(struct_pack(n := n, w := w)) AS b FROM {name}_m GROUP BY ALL),
    {name} AS (SELECT {key}, sum(b.n)::BIGINT AS tp, sum(b.w) AS total FROM {name}_b GROUP BY ALL)"""


def _boundary(name: str, mask: str) -> str:
    return f"""{name} AS (SELECT a.image, a.y, a.x FROM rows a JOIN rows c ON c.image = a.image AND abs(c.y - a.y) <= 1 AND abs(c.x - a.x) <= 1
        WHERE a.{mask} AND a.valid GROUP BY a.image, a.y, a.x HAVING count(*) FILTER (c.{mask} AND c.valid) < 9 AND bool_and(c.valid))"""


_LINES = f"""{_thin("lt", _T)}, {_thin("lp", _P)}, {_distance("ld", "lt", "lp")}, {_match("line", "ld", 1.0)},
    held AS (SELECT i.image,
        (SELECT count(*) FILTER (rows.t AND rows.valid)::DOUBLE / nullif(count(*), 0) FROM lp JOIN rows USING (image, y, x) WHERE lp.image = i.image) AS hp,
        (SELECT count(*) FILTER (rows.p AND rows.valid)::DOUBLE / nullif(count(*), 0) FROM lt JOIN rows USING (image, y, x) WHERE lt.image = i.image) AS ht FROM (SELECT DISTINCT image FROM rows) i),
    cl AS (SELECT image, 2 * hp * ht / (hp + ht) AS cl_dice FROM held)"""
_FOLD = f"""{SIZED}, ch AS (SELECT image, y, x, height, width, {_OD.format("r")} + {_OD.format("g")} + {_OD.format("b")} AS v, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6) AS sat FROM plane JOIN (SELECT image, y, x, height, width FROM sized) USING (image, y, x)),
    tx AS (SELECT a.image, a.y, a.x, any_value(a.v) AS od, any_value(a.sat) AS sat, stddev_pop(b.v) AS texture {_around(2).replace("sized", "ch")} GROUP BY ALL),
    sup AS (SELECT *, od > 0.18 OR sat > 0.055 AS support FROM tx),
    q AS (SELECT image, quantile_cont(od, [0.65, 0.985]) AS o, quantile_cont(sat, [0.65, 0.985]) AS s, quantile_cont(texture, [0.7, 0.99]) AS t FROM sup WHERE support GROUP BY image),
    fold AS (SELECT sup.image, y, x, support, CASE WHEN support THEN least(greatest(0.57::DOUBLE * least(greatest((od - o[1]) / (o[2] - o[1]), 0.0), 1.0) + 0.28::DOUBLE * least(greatest((sat - s[1]) / (s[2] - s[1]), 0.0), 1.0)
        + 0.15::DOUBLE * least(greatest((texture - t[1]) / (t[2] - t[1]), 0.0), 1.0), 0.0), 1.0) ELSE 0.0 END AS score FROM sup JOIN q USING (image))"""

_PATCHES = f"""{SIZED}, cells AS (
    SELECT s.image, y0, x0, s.y - y0 AS y, s.x - x0 AS x, least(32, height) AS height, least(32, width) AS width, event_type <> 'signup' AS tissue, r, g, b FROM sized s,
        (SELECT DISTINCT image AS i, unnest(CASE WHEN height <= 32 THEN [0] ELSE list_distinct(list_append(range(0, height - 31, 24), height - 32)) END)::INT AS y0 FROM sized) p,
        (SELECT DISTINCT image AS j, unnest(CASE WHEN width <= 32 THEN [0] ELSE list_distinct(list_append(range(0, width - 31, 24), width - 32)) END)::INT AS x0 FROM sized) q
    WHERE i = s.image AND j = s.image AND s.y >= y0 AND s.y < y0 + 32 AND s.x >= x0 AND s.x < x0 + 32)"""


def _texture(cells: str) -> str:
    """CTE ``t``: cells with the deviation and the gradient of their value within their mirrored patch."""
    near = lambda reach: f"FROM {cells} a, range(-{reach}, {reach + 1}) AS r(dy), range(-{reach}, {reach + 1}) AS q(dx), {cells} o WHERE o.image = a.image AND o.y0 = a.y0 AND o.x0 = a.x0 AND o.y = {_MIRROR.format('a.y + dy', 'a.height')} AND o.x = {_MIRROR.format('a.x + dx', 'a.width')} GROUP BY ALL"
    return f"""tc AS (SELECT a.image, a.y0, a.x0, a.y, a.x, stddev_pop(o.value) AS contrast {near(2)}),
        tg AS (SELECT a.image, a.y0, a.x0, a.y, a.x, sqrt(pow(sum(o.value * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END) / 8, 2) + pow(sum(o.value * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END) / 8, 2)) AS gradient {near(1)}),
        t AS (SELECT * FROM {cells} JOIN tc USING (image, y0, x0, y, x) JOIN tg USING (image, y0, x0, y, x))"""


_BRIGHT = "tissue_fraction od_mean od_std od_p90 h_mean h_p90 e_mean e_p90 saturation_mean saturation_p90 entropy contrast_mean contrast_p90 gradient_mean gradient_p90 edge_fraction dark_fraction".split()
_FLUORESCENT = "tissue_fraction mean std p90 p99 over_tenth contrast_mean contrast_p90 gradient_mean gradient_p90 edge_fraction channel_mean channel_std channel_range channel_saturation correlation".split()

SQL = {
    "grid_components": f"WITH RECURSIVE {_ROWS}, {_parts('c', 'SELECT image, y, x FROM rows WHERE t', 8)} SELECT DISTINCT image, fy::INT AS part_y, fx::INT AS part_x, area FROM c WHERE area >= 2",
    "small_holes": f"""WITH RECURSIVE {_ROWS}, {_parts("h", "SELECT image, y, x FROM rows WHERE NOT v > 12", 4)},
        k AS (SELECT h.*, bool_or(h.y = 0 OR h.x = 0 OR h.y = height - 1 OR h.x = width - 1) OVER (PARTITION BY h.image, fy, fx) AS border FROM h JOIN rows USING (image, y, x))
        SELECT image, y::INT AS y, x::INT AS x FROM k WHERE NOT border AND area <= 4""",
    "elongation": f"""WITH RECURSIVE {SIZED}, {_parts("c", "SELECT image, y, x FROM sized WHERE event_type IN ('click', 'view')", 4)},
        s AS (SELECT image, fy, fx, count(*) AS area, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS box, var_samp(y) AS yy, var_samp(x) AS xx, covar_samp(y, x) AS xy FROM c GROUP BY ALL)
        SELECT image, fy::INT AS part_y, fx::INT AS part_x, area, round(area::DOUBLE / box + 1e-9, 6) AS occupancy,
               round(sqrt(((yy + xx) / 2 + sqrt(pow((yy - xx) / 2, 2) + pow(xy, 2)) + 1e-6) / (greatest((yy + xx) / 2 - sqrt(pow((yy - xx) / 2, 2) + pow(xy, 2)), 0) + 1e-6)) + 1e-9, 5) AS elongation FROM s WHERE area >= 5""",
    "elongated_cells": f"""WITH RECURSIVE {SIZED}, {_parts("c", "SELECT image, y, x FROM sized WHERE event_type IN ('click', 'view')", 4)},
        s AS (SELECT image, fy, fx, count(*) AS area, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, var_samp(y) AS yy, var_samp(x) AS xx, covar_samp(y, x) AS xy FROM c GROUP BY ALL),
        k AS (SELECT * FROM s WHERE area >= 5 AND greatest(h, w) >= 5 AND (area::DOUBLE / (h * w) <= 0.38
            OR sqrt(((yy + xx) / 2 + sqrt(pow((yy - xx) / 2, 2) + pow(xy, 2)) + 1e-6) / (greatest((yy + xx) / 2 - sqrt(pow((yy - xx) / 2, 2) + pow(xy, 2)), 0) + 1e-6)) >= 1.7))
        SELECT c.image, y::INT AS y, x::INT AS x FROM c JOIN k USING (image, fy, fx)""",
    "instance_iou": f"{_SIDES} SELECT image, ty::INT AS t_y, tx::INT AS t_x, py::INT AS p_y, px::INT AS p_x, round(iou, 6) AS iou FROM o",
    "instance_metrics": f"""{_SIDES}, {_INSTANCE}
        SELECT image, tp, np - tp AS fp, nt - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(CASE WHEN nt = 0 AND np = 0 THEN 1.0 ELSE overlap END, 6) AS mean_iou FROM inst""",
    "instance_assignment": f"""{_SIDES}, pairs AS (SELECT image, ty * 1000000 + tx AS t, py * 1000000 + px AS p, iou FROM o WHERE iou >= 0.1), {_assigned("a", "pairs", "image")},
        n AS (SELECT i.image, (SELECT count(DISTINCT (fy, fx)) FROM t WHERE t.image = i.image) AS nt, (SELECT count(DISTINCT (fy, fx)) FROM p WHERE p.image = i.image) AS np FROM (SELECT DISTINCT image FROM rows) i),
        m AS (SELECT image, nt, np, coalesce(tp, 0) AS tp, total / tp AS overlap FROM n LEFT JOIN a USING (image)),
        r AS (SELECT *, CASE WHEN np = 0 THEN 1.0 ELSE tp::DOUBLE / np END AS pr, CASE WHEN nt = 0 THEN 1.0 ELSE tp::DOUBLE / nt END AS re FROM m)
        SELECT image, tp, np - tp AS fp, nt - tp AS fn, round(pr + 1e-9, 6) AS precision, round(re + 1e-9, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END + 1e-9, 6) AS f1,
               round(CASE WHEN nt = 0 AND np = 0 THEN 1.0 ELSE overlap END + 1e-9, 6) AS mean_iou FROM r""",
    "froc_curve": f"""WITH RECURSIVE {_ROWS}, s AS (SELECT image, y, x, floor(v / 25)::DOUBLE AS score FROM rows WHERE valid AND (t OR v > 100)), l AS (SELECT DISTINCT score AS threshold FROM s), {_parts("t", "SELECT image, y, x FROM rows WHERE t", 8)},
        {_parts("p", "SELECT image || '/' || threshold AS key, y, x FROM s, l WHERE score >= threshold", 8, "key")},
        o AS (SELECT p.key, t.fy * 1000000 + t.fx AS t, p.fy * 1000000 + p.fx AS p, count(*)::DOUBLE / (any_value(t.area) + any_value(p.area) - count(*)) AS iou FROM p JOIN t ON split_part(p.key, '/', 1)::BIGINT = t.image AND p.y = t.y AND p.x = t.x GROUP BY ALL),
        pairs AS (SELECT * FROM o WHERE iou >= 0.1), {_assigned("a", "pairs", "key")},
        nt AS (SELECT count(*) AS n FROM (SELECT DISTINCT image, fy, fx FROM t)), ni AS (SELECT count(DISTINCT image) AS n FROM rows),
        c AS (SELECT threshold, (SELECT coalesce(sum(tp), 0) FROM a WHERE split_part(key, '/', 2)::DOUBLE = threshold)::BIGINT AS tp, (SELECT count(*) FROM (SELECT DISTINCT key, fy, fx FROM p) WHERE split_part(key, '/', 2)::DOUBLE = threshold) AS np FROM l)
        SELECT threshold, tp, np - tp AS fp, nt.n - tp AS fn, round(tp::DOUBLE / nt.n + 1e-9, 6) AS sensitivity, round((np - tp)::DOUBLE / ni.n + 1e-9, 6) AS fp_per_image FROM c, nt, ni""",
    "froc_sweep": f"""WITH RECURSIVE {_ROWS}, l AS (SELECT unnest([0.0, 10.0, 40.0])::DOUBLE AS threshold), {_parts("t", "SELECT image, y, x FROM rows WHERE t", 8)},
        {_parts("p", "SELECT image || '/' || threshold AS key, y, x FROM rows, l WHERE (t OR v > 60) AND v >= threshold", 8, "key")},
        o AS (SELECT p.key, p.fy, p.fx, t.fy AS ty, t.fx AS tx, count(*)::DOUBLE / (any_value(t.area) + any_value(p.area) - count(*)) AS iou FROM p JOIN t ON split_part(p.key, '/', 1)::BIGINT = t.image AND p.y = t.y AND p.x = t.x GROUP BY ALL),
        nt AS (SELECT count(*) AS n FROM (SELECT DISTINCT image, fy, fx FROM t)), ni AS (SELECT count(DISTINCT image) AS n FROM rows),
        c AS (SELECT threshold, (SELECT count(*) FROM o WHERE split_part(key, '/', 2)::DOUBLE = threshold AND iou >= 0.6) AS tp, (SELECT count(*) FROM (SELECT DISTINCT key, fy, fx FROM p) WHERE split_part(key, '/', 2)::DOUBLE = threshold) AS np FROM l)
        SELECT threshold, tp, np - tp AS fp, nt.n - tp AS fn, round(tp::DOUBLE / nt.n, 6) AS sensitivity, round((np - tp)::DOUBLE / ni.n, 6) AS fp_per_image FROM c, nt, ni""",
    "skeleton": f"WITH {_ROWS}, {_thin('s', 'SELECT image, y, x FROM rows WHERE v > 12')} SELECT image, y, x FROM s",
    "centerline_metrics": f"""WITH {_ROWS}, {_LINES} SELECT image, n_target, n_predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(assd, 6) AS assd, round(hd95, 6) AS hd95, round(cl_dice, 6) AS cl_dice FROM line JOIN cl USING (image)""",
    "evaluate_sample": f"""{_SIDES}, {_INSTANCE}, {_LINES}, {_boundary("bt", "t")}, {_boundary("bp", "p")}, {_distance("bd", "bt", "bp")}, {_match("edge", "bd", 1.0)},
        c AS (SELECT image, count(*) FILTER (valid AND t AND p) AS tp, count(*) FILTER (valid AND p AND NOT t) AS fp, count(*) FILTER (valid AND t AND NOT p) AS fn, count(*) FILTER (valid) AS n FROM rows GROUP BY image)
        SELECT c.image, c.tp, c.fp, c.fn, round(2.0::DOUBLE * c.tp / (2 * c.tp + c.fp + c.fn) + 1e-9, 6) AS pixel_dice, round(c.tp::DOUBLE / (c.tp + c.fp + c.fn) + 1e-9, 6) AS pixel_iou, round(edge.f1 + 1e-9, 6) AS boundary_f1,
               round(edge.hd95 + 1e-9, 6) AS boundary_hd95, round(line.f1 + 1e-9, 6) AS centerline_f1, round(cl_dice + 1e-9, 6) AS centerline_cl_dice, round(inst.f1 + 1e-9, 6) AS instance_f1,
               round(abs(c.fp - c.fn)::DOUBLE / n + 1e-9, 6) AS burden_absolute_error, round((c.tp + c.fn) * 0.25::DOUBLE + 1e-9, 6) AS burden_true_area
        FROM c JOIN edge USING (image) JOIN line USING (image) JOIN cl USING (image) JOIN inst USING (image)""",
    "fold_score": f"WITH {_FOLD} SELECT image, y, x, round(score, 5) AS score FROM fold",
    "fold_candidates": f"""WITH RECURSIVE {_FOLD}, f AS (SELECT image, y, x FROM fold WHERE score >= 0.45),
        grown AS (SELECT DISTINCT b.image, b.y, b.x FROM f a, {disk_sql(1)} d, fold b WHERE b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx),
        {_parts("c", f"SELECT a.image, a.y, a.x FROM grown a, {disk_sql(1)} d, grown b WHERE b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 5", 4)}
        SELECT c.image, c.y::INT AS y, c.x::INT AS x FROM c JOIN fold USING (image, y, x) WHERE area >= 3 AND support""",
    "analysis_region": f"""WITH {_ROWS}, d AS (SELECT DISTINCT b.image, b.y, b.x FROM rows a JOIN rows b ON b.image = a.image AND abs(b.y - a.y) <= 4 AND abs(b.x - a.x) <= 4 WHERE (a.t OR a.p) AND a.v > 60)
        SELECT image, count(*) AS n, min(y) AS top, max(x) AS "right" FROM d GROUP BY image""",
    "he_patch_features": f"""WITH {_PATCHES}, v AS (SELECT *, {_OD.format("r")} AS dr, {_OD.format("g")} AS dg, {_OD.format("b")} AS db, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6) AS sat, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS value FROM cells),
        {_texture("v")}, n AS (SELECT 0.650*0.650+0.704*0.704+0.286*0.286 AS hh, 0.650*0.072+0.704*0.990+0.286*0.105 AS he, 0.072*0.072+0.990*0.990+0.105*0.105 AS ee),
        c AS (SELECT t.*, dr + dg + db AS od, greatest((ee * (0.650::DOUBLE * dr + 0.704::DOUBLE * dg + 0.286::DOUBLE * db) - he * (0.072::DOUBLE * dr + 0.990::DOUBLE * dg + 0.105::DOUBLE * db)) / (hh * ee - he * he), 0.0) AS h,
                     greatest((hh * (0.072::DOUBLE * dr + 0.990::DOUBLE * dg + 0.105::DOUBLE * db) - he * (0.650::DOUBLE * dr + 0.704::DOUBLE * dg + 0.286::DOUBLE * db)) / (hh * ee - he * he), 0.0) AS e FROM t, n WHERE tissue),
        m AS (SELECT *, quantile_cont(od, 0.5) OVER p AS middle, greatest(quantile_cont(gradient, 0.75) OVER p, 0.025) AS edge, least(floor(least(greatest(value, 0.0), 1.0) * 32), 31) AS bin FROM c WINDOW p AS (PARTITION BY image, y0, x0)),
        d AS (SELECT *, greatest(middle + 2.5::DOUBLE * quantile_cont(abs(od - middle), 0.5) OVER (PARTITION BY image, y0, x0), 1.25) AS dark FROM m),
        b AS (SELECT image, y0, x0, bin, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY image, y0, x0) AS p FROM m GROUP BY image, y0, x0, bin), en AS (SELECT image, y0, x0, -sum(p * log2(p)) AS entropy FROM b GROUP BY ALL),
        f AS (SELECT image, y0, x0, avg(od) AS od_mean, stddev_pop(od) AS od_std, quantile_cont(od, 0.9) AS od_p90, avg(h) AS h_mean, quantile_cont(h, 0.9) AS h_p90, avg(e) AS e_mean, quantile_cont(e, 0.9) AS e_p90,
                     avg(sat) AS saturation_mean, quantile_cont(sat, 0.9) AS saturation_p90, avg(contrast) AS contrast_mean, quantile_cont(contrast, 0.9) AS contrast_p90, avg(gradient) AS gradient_mean, quantile_cont(gradient, 0.9) AS gradient_p90,
                     avg((gradient > edge)::INT::DOUBLE) AS edge_fraction, avg((od > dark)::INT::DOUBLE) AS dark_fraction FROM d GROUP BY ALL),
        a AS (SELECT image, y0, x0, avg(tissue::INT::DOUBLE) AS tissue_fraction FROM cells GROUP BY ALL)
        SELECT image, y0, x0, {", ".join(f"round(coalesce({c}, 0) + 1e-9, 5) AS {c}" for c in _BRIGHT)} FROM a LEFT JOIN f USING (image, y0, x0) LEFT JOIN en USING (image, y0, x0)""",
    "fluorescence_patch_features": f"""WITH {_PATCHES}, k AS (SELECT image, y0, x0, {", ".join(f"CASE WHEN count(*) FILTER (tissue AND {c} > 0) >= 16 THEN quantile_cont({c}, {q}) FILTER (tissue AND {c} > 0) ELSE {m}({c}) FILTER (tissue) END AS {c}_{k}" for c in "rgb" for k, q, m in (("low", 0.01, "min"), ("high", 0.995, "max")))} FROM cells GROUP BY ALL),
        u AS (SELECT cells.*, {", ".join(f"CASE WHEN {c}_high - {c}_low > 2.3e-16 THEN least(greatest(({c} - {c}_low) / ({c}_high - {c}_low), 0.0), 1.0) ELSE 0.0 END AS s_{c}" for c in "rgb")} FROM cells JOIN k USING (image, y0, x0)),
        v AS (SELECT *, greatest(s_r, s_g, s_b) AS value FROM u), {_texture("v")},
        m AS (SELECT *, greatest(quantile_cont(gradient, 0.75) OVER (PARTITION BY image, y0, x0), 0.03) AS edge FROM t WHERE tissue),
        g AS (SELECT image, y0, x0, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, avg((value > 0.1)::INT::DOUBLE) AS over_tenth, avg(contrast) AS contrast_mean, quantile_cont(contrast, 0.9) AS contrast_p90,
                     avg(gradient) AS gradient_mean, quantile_cont(gradient, 0.9) AS gradient_p90, avg((gradient > edge)::INT::DOUBLE) AS edge_fraction, [avg(s_r), avg(s_g), avg(s_b)] AS means,
                     [{", ".join(f"quantile_cont(s_{c}, 0.99) - quantile_cont(s_{c}, 0.01)" for c in "rgb")}] AS ranges, [{", ".join(f"avg(({c} >= 0.995)::INT::DOUBLE)" for c in "rgb")}] AS full_, [corr(s_r, s_g), corr(s_r, s_b), corr(s_g, s_b)] AS alike FROM m GROUP BY ALL),
        f AS (SELECT *, list_avg(means) AS channel_mean, list_stddev_pop(means) AS channel_std, list_avg(ranges) AS channel_range, list_avg(full_) AS channel_saturation, list_median(alike) AS correlation FROM g),
        a AS (SELECT image, y0, x0, avg(tissue::INT::DOUBLE) AS tissue_fraction FROM cells GROUP BY ALL)
        SELECT image, y0, x0, {", ".join(f"round(coalesce({c}, 0) + 1e-9, 5) AS {c}" for c in _FLUORESCENT)} FROM a LEFT JOIN f USING (image, y0, x0)""",
    "response_metrics": f"""WITH RECURSIVE {SIZED}, s AS (SELECT *, abs(y - (height / 2.0::DOUBLE + height / 6.0::DOUBLE * sin(2 * pi() * x / width))) <= greatest(1.0, height / 12.0::DOUBLE) AS inside FROM sized),
        sh AS (SELECT s.*, o.v AS shifted FROM s JOIN sized o ON o.image = s.image AND o.y = s.y AND o.x = (s.x - 3 + s.width) % s.width),
        n AS (SELECT image, severity, y, x, inside AND v > 20 AS target, round(CASE WHEN inside THEN greatest((v + (0.35::DOUBLE + 0.85::DOUBLE * severity) * shifted) - v, 0.0) ELSE 0.0 END, 9) AS score FROM sh, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) AS t(severity)),
        r AS (SELECT *, score >= 30 AS called FROM n), {_parts("t", "SELECT DISTINCT image, y, x FROM r WHERE target", 8)},
        h AS (SELECT image, severity, fy, fx, max(called) AS hit FROM t JOIN r USING (image, y, x) GROUP BY ALL), hr AS (SELECT image, severity, avg(hit::INT::DOUBLE) AS hit_rate FROM h GROUP BY ALL),
        c AS (SELECT image, severity, score, count(*) AS n, count(*) FILTER (target) AS p FROM r GROUP BY ALL), st AS (SELECT *, sum(n) OVER d AS cn, sum(p) OVER d AS cp FROM c WINDOW d AS (PARTITION BY image, severity ORDER BY score DESC)),
        ap AS (SELECT image, severity, sum(p * cp::DOUBLE / cn) / nullif(sum(p), 0) AS average_precision FROM st GROUP BY ALL),
        m AS (SELECT image, severity, CASE WHEN count(*) FILTER (target) > 0 THEN 2.0::DOUBLE * count(*) FILTER (target AND called) / (count(*) FILTER (target) + count(*) FILTER (called)) END AS dice,
                     coalesce(sum(score) FILTER (NOT target), 0) / nullif(sum(score), 0) AS outside_mass, count(*) FILTER (called AND NOT target)::DOUBLE / nullif(count(*) FILTER (called), 0) AS outside_cells FROM r GROUP BY ALL)
        SELECT image, severity, {", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("dice", "outside_mass", "outside_cells", "average_precision", "hit_rate"))} FROM m LEFT JOIN ap USING (image, severity) LEFT JOIN hr USING (image, severity)""",
    "feasibility_grid": f"""WITH {SIZED}, s AS (SELECT *, abs(y - (height / 2.0::DOUBLE + height / 6.0::DOUBLE * sin(2 * pi() * x / width))) <= greatest(1.0, height / 12.0::DOUBLE) AS inside FROM sized),
        sh AS (SELECT s.*, o.v AS shifted FROM s JOIN sized o ON o.image = s.image AND o.y = s.y AND o.x = (s.x - 3 + s.width) % s.width),
        n AS (SELECT ['he', 'comet', 'cosmx'][(image % 3 + 1)::INT] AS modality, artifact, severity, v < 350 AS valid, inside AS target,
                     abs(CASE WHEN NOT inside THEN v WHEN artifact = 'fold' THEN v + (0.35::DOUBLE + 0.85::DOUBLE * severity) * shifted ELSE v * 0.30::DOUBLE * (1 - severity) END - v) >= 15 AS called
              FROM sh, (VALUES ('fold'), ('crack')) AS k(artifact), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS t(severity)),
        c AS (SELECT modality, artifact, severity, count(*) FILTER (valid AND target AND called) AS tp, count(*) FILTER (valid AND called AND NOT target) AS fp, count(*) FILTER (valid AND target AND NOT called) AS fn,
                     count(*) FILTER (valid AND NOT target AND NOT called) AS tn, count(*) FILTER (valid) AS n_valid FROM n GROUP BY ALL)
        SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS dice, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
               round(CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision FROM c""",
}
