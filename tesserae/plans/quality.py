"""Queries of metrics, ranking, gates and bootstrap intervals."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates
from ..operators import bootstrap, confusion, ranking
from .views import FIELDS, OBS, RECORDS, fields, obs, records, table


def _counts(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return confusion.confusion(obs(spark, sf_dir), list(by), F.col("target"), F.col("score") >= 0.6, F.col("valid"))


COUNTS = """count(*) FILTER (valid AND target AND score >= 0.6) AS tp, count(*) FILTER (valid AND NOT target AND score >= 0.6) AS fp,
    count(*) FILTER (valid AND target AND NOT score >= 0.6) AS fn, count(*) FILTER (valid AND NOT target AND NOT score >= 0.6) AS tn"""
METRICS = """
    round(CASE WHEN tp + fp = 0 THEN CASE WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
    round(CASE WHEN tn + fp = 0 THEN 1.0 ELSE tn::DOUBLE / (tn + fp) END, 6) AS specificity,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS dice,
    round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp + fn) END, 6) AS iou"""
NAMES = ["precision", "recall", "specificity", "dice", "iou"]


def operational_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe sensitivity and auto-pass value with bounds, referral and fail rates, gates and status, by source."""
    d = F.col("decision")
    rows = records(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n"),
        F.count_if("severe").alias("n_severe"),
        F.count_if(F.col("severe") & (d != "PASS")).alias("severe_flagged"),
        F.count_if(d == "PASS").alias("n_pass"),
        F.count_if((d == "PASS") & ~F.col("actionable")).alias("true_pass"),
        F.avg((d == "REVIEW").cast("double")).alias("referral_rate"),
        F.avg((d == "FAIL").cast("double")).alias("fail_rate"),
    )
    severe = rates.wilson(F.col("severe_flagged"), F.col("n_severe"))
    npv = rates.wilson(F.col("true_pass"), F.col("n_pass"))
    rows = rows.withColumns({"severe_lower": severe["lower"], "npv": npv["estimate"], "npv_lower": npv["lower"]})
    rows = rows.withColumns({
        "severe_gate": rates.gate(F.col("severe_lower"), 0.3, True, F.col("n_severe"), 2),
        "npv_gate": rates.gate(F.col("npv"), 0.8, True, F.col("n_pass"), 5),
        "referral_gate": rates.gate(F.col("referral_rate"), 0.25, False, F.col("n"), 5),
    })
    rows = rows.withColumn("status", rates.worst(F.col("severe_gate"), F.col("npv_gate"), F.col("referral_gate")))
    names = ["referral_rate", "fail_rate", "severe_lower", "npv", "npv_lower"]
    return rows.withColumns({x: F.round(x, 6) for x in names}).orderBy("source")


def _wilson_sql(hits: str, n: str, sign: str) -> str:
    z = "1.959963984540054"
    bound = f"(({hits}::DOUBLE / {n}) + {z}*{z}/(2.0*{n}) {sign} {z}*sqrt(({hits}::DOUBLE/{n})*(1-{hits}::DOUBLE/{n})/{n} + {z}*{z}/(4.0*{n}*{n}))) / (1 + {z}*{z}/{n})"
    limit = f"greatest(0.0, {bound})" if sign == "-" else f"least(1.0, {bound})"
    return f"CASE WHEN {n} > 0 THEN {limit} END"


def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).groupBy("lang").agg(F.count_if("actionable").alias("hits"), F.count("*").alias("n"))
    return rows.withColumns({k: F.round(x, 6) for k, x in rates.wilson(F.col("hits"), F.col("n")).items()})


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, "stratum")


def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion.metrics(_counts(spark, sf_dir, "slide"), [*NAMES, "mcc", "balanced_accuracy", "false_positive_rate"])


def pooled_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields(spark, sf_dir).where("n_valid > 0")
    return confusion.metrics(confusion.pooled(rows, ["stratum"]), NAMES)


def _macro(rows: DataFrame, by: list[str]) -> DataFrame:
    return confusion.distribution(rows, by, rates.pixel_metrics(*[F.col(x) for x in confusion.COUNTS])["dice"])


_DISTRIBUTION = """count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(quantile_cont(d, 0.25), 6) AS q1,
    round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3,
    round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr"""
_DICE = "CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"


def field_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _macro(fields(spark, sf_dir).where("n_valid > 0 AND label = 1"), ["stratum"])


def slide_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _macro(confusion.pooled(fields(spark, sf_dir).where("n_valid > 0"), ["stratum", "slide"]), ["stratum"])


def clean_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion.clean_burden(fields(spark, sf_dir), ["stratum"])


def binary_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, called = F.col("label") == 1, F.col("image_prediction") == 1
    rows = confusion.confusion(fields(spark, sf_dir), ["stratum"], label, called, F.lit(True))
    return confusion.metrics(rows, ["recall", "specificity", "balanced_accuracy"]).drop("n_valid")


def aggregate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled counts and the mean of per-sample overlap, nulls left out."""
    rows = fields(spark, sf_dir).withColumn("iou", F.when(F.col("n_valid") > 0, rates.pixel_metrics(*[F.col(x) for x in confusion.COUNTS])["iou"]))
    return rows.groupBy("slide").agg(*[F.sum(x).alias(x) for x in confusion.COUNTS], F.round(F.avg("iou"), 6).alias("mean_iou"), F.count("iou").alias("n_samples"))


def burden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion.burden(fields(spark, sf_dir), ["slide"])


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by stratum and by slide, in one pass."""
    rows = _counts(spark, sf_dir, "stratum", "slide")
    rows.createOrReplaceTempView("tesserae_counts")
    sums = ", ".join(f"sum({x}) AS {x}" for x in confusion.COUNTS)
    return spark.sql(
        f"SELECT coalesce(stratum, 'all') AS stratum, coalesce(slide, -1) AS slide, {sums} FROM tesserae_counts GROUP BY GROUPING SETS ((), (stratum), (slide))"
    )


def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario counts as a JSON text in key order."""
    rows = records(spark, sf_dir).groupBy("source", "lang", "decision").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("decision", "n")))
    return rows.groupBy("source", "lang").agg(F.sum("n").alias("n"), F.to_json(F.map_from_entries(pairs)).alias("decisions"))


def runtime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, value = table(spark, sf_dir, "events"), F.col("value")
    middle = ranking.quantile_columns(rows, ["event_type"], "value", median=0.5, p95=0.95)
    found = rows.groupBy("event_type").agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("max"), F.round(F.sum(value), 3).alias("total"))
    return found.join(middle, "event_type").withColumns({x: F.round(x, 6) for x in ("median", "p95")})


def finite_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median of finite quotients only."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.try_divide("s_acctbal", F.col("s_suppkey") % 3).alias("v"))
    middle = ranking.quantile_columns(rows, ["s_nationkey"], "v", median=0.5)
    found = rows.groupBy("s_nationkey").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))
    return found.join(middle, "s_nationkey", "left").withColumn("median", F.round("median", 6))


def rollup_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir).rollup("stratum").agg(F.count("*").alias("n"), F.count_if("target").alias("positives"), F.count_distinct("sample").alias("samples"), F.count_distinct("slide").alias("slides"))
    return rows.withColumn("stratum", F.coalesce("stratum", F.lit("all")))


def group_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over slides of the mean over their samples."""
    rows = fields(spark, sf_dir).groupBy("stratum", "slide").agg(F.avg("image_score").alias("mean"))
    return rows.groupBy("stratum").agg(F.round(F.avg("mean"), 6).alias("macro"), F.count("*").alias("n_groups"))


def aggregate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, s, by = fields(spark, sf_dir), F.col("image_score"), ["stratum", "label"]
    found = rows.groupBy(*by).agg(F.count(s).alias("n"), *[F.round(x, 6).alias(k) for k, x in {"mean": F.avg(s), "low": F.min(s), "high": F.max(s)}.items()])
    return found.join(ranking.quantile_columns(rows, by, "image_score", median=0.5), by, "left").withColumn("median", F.round("median", 6))


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.average_precision(obs(spark, sf_dir), ["stratum"])
    return found.withColumn("average_precision", F.round("average_precision", 6))


def ap_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether average precision beats prevalence and a floor, and clean false alarms stay below a cap."""
    rows = obs(spark, sf_dir)
    found = ranking.average_precision(rows, ["slide"]).withColumn("prevalence", F.col("positives") / F.col("n"))
    clean = rows.where(~F.col("target")).groupBy("slide").agg(F.avg((F.col("score") >= 0.6).cast("double")).alias("clean_fpr"))
    found = found.join(clean, "slide", "left")
    good = (F.col("average_precision") > F.greatest(F.lit(0.3), "prevalence")) & (F.col("clean_fpr") <= 0.75)
    return found.select("slide", *[F.round(x, 6).alias(x) for x in ("average_precision", "prevalence", "clean_fpr")], good.alias("ok"))


def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.auroc(obs(spark, sf_dir), ["slide"]).withColumn("auroc", F.round("auroc", 6))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("slide"), F.col("l_quantity").alias("severity"), F.col("l_discount").alias("response"))
    return ranking.spearman(rows, ["slide"], "severity", "response").withColumn("rho", F.round("rho", 6))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.best_threshold(obs(spark, sf_dir).where("valid"), ["stratum"])
    return found.withColumns({x: F.round(x, 6) for x in ("dice", "precision", "threshold")})


def image_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fields(spark, sf_dir).select("stratum", (F.col("label") == 1).alias("target"), F.col("image_score").alias("score"))
    found = ranking.best_threshold(rows, ["stratum"], "balanced_accuracy", "specificity")
    return found.withColumns({x: F.round(x, 6) for x in ("balanced_accuracy", "specificity", "threshold")})


def ecdf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = obs(spark, sf_dir)
    found = ranking.percentile_rank(rows.where("stratum = 'O'"), rows.where("stratum = 'F'"))
    return found.withColumn("percentile", F.round("percentile", 9))


def presence_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rates.category(F.col("label") == 1, F.col("image_prediction") == 1).alias("category")
    return fields(spark, sf_dir).groupBy("stratum", kind).agg(F.count("*").alias("n"))


def outcome_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose reported overlap differs from that of their counts."""
    rows = confusion.metrics(fields(spark, sf_dir), ["dice"], 12).withColumn("reported", F.when(F.col("sample") % 97 == 0, F.col("dice") + 0.001).otherwise(F.col("dice")))
    return rows.where(F.abs(F.col("reported") - F.col("dice")) > 1e-12).select("sample", "tp", "fp", "fn")


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference between strata of the same slide; slides without both are left out."""
    rows = fields(spark, sf_dir).groupBy("slide").pivot("stratum", ["F", "O"]).agg(F.avg("image_score"))
    return rows.where("F IS NOT NULL AND O IS NOT NULL").select("slide", F.round(F.col("F") - F.col("O"), 9).alias("difference"))


def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of event types, i before j, on the users that have both."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a = rows.select("user_id", F.col("event_type").alias("a"), F.col("v").alias("va"))
    b = rows.select("user_id", F.col("event_type").alias("b"), F.col("v").alias("vb"))
    found = a.join(b, "user_id").where("a < b").groupBy("a", "b")
    return found.agg(F.count("*").alias("n"), F.round(F.avg(F.col("va") - F.col("vb")), 6).alias("difference"))


def sensitivity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language in which the fail rate of a source moves most between decisions on halves of the records."""
    rows = records(spark, sf_dir)
    half = rows.groupBy("source", "lang", (F.col("n_chars") % 2).alias("half")).agg(F.avg((F.col("decision") == "FAIL").cast("double")).alias("rate"))
    a, b = half.where("half = 0").drop("half"), half.where("half = 1").select("source", "lang", F.col("rate").alias("other"))
    found = a.join(b, ["source", "lang"]).withColumn("delta", F.round(F.col("other") - F.col("rate"), 6))
    best = F.max_by(F.struct("lang", "delta"), F.struct(F.abs("delta"), "lang"))
    return found.groupBy("source").agg(best.alias("m")).select("source", "m.lang", "m.delta")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the slides of each stratum."""
    return confusion.pooled(fields(spark, sf_dir).where("n_valid > 0"), ["stratum", "slide"])


_DRAWS = f"""WITH {FIELDS}, clusters AS (
        SELECT stratum, slide, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, avg(image_score) AS v FROM fields WHERE n_valid > 0 GROUP BY ALL
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY slide) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n FROM clusters
    ), drawn AS (
        SELECT stratum, replicate, (('0x' || substr(sha256('7|' || stratum || '|' || replicate || '|' || place), 1, 12))::BIGINT % n) AS place
        FROM numbered, range(100) AS r(replicate)
    ), replicates AS (SELECT drawn.replicate, numbered.* FROM drawn JOIN numbered USING (stratum, place))"""
_INTERVAL = "count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper"


def bootstrap_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled overlap of slides resampled within strata."""
    dice = rates.ratio(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), 1.0)
    return bootstrap.bootstrap(_clusters(spark, sf_dir), ["stratum"], "slide", dice, 100, 7)


def bootstrap_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of slide means."""
    rows = fields(spark, sf_dir).where("n_valid > 0").groupBy("stratum", "slide").agg(F.avg("image_score").alias("v"))
    return bootstrap.bootstrap(rows, ["stratum"], "slide", F.avg("v"), 100, 7)


def image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.quantile_columns(obs(spark, sf_dir).where("valid"), ["slide"], "score", image_score=0.995)
    return found.withColumn("image_score", F.round("image_score", 6))


def calibration_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold at the 99th percentile of calibration rows, and the share of the others above it."""
    rows = obs(spark, sf_dir).withColumn("calibration", F.col("slide") % 4 == 0)
    limit = ranking.quantile_columns(rows.where("calibration"), ["stratum"], "score", threshold=0.99)
    found = rows.where("NOT calibration").join(F.broadcast(limit), "stratum")  # a row for each stratum
    return found.groupBy("stratum").agg(F.round(F.first("threshold"), 6).alias("threshold"), F.round(F.avg((F.col("score") > F.col("threshold")).cast("double")), 6).alias("alert_rate"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of samples with a valid area, samples drawn anew."""
    rows = fields(spark, sf_dir).where("n_valid > 0")
    dice = rates.pixel_metrics(*[F.col(x) for x in confusion.COUNTS])["dice"]
    return bootstrap.by_sample(rows, "sample", dice, 40, 7)


def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and mean score of all strata together, slides drawn anew."""
    rows = fields(spark, sf_dir).where("n_valid > 0").groupBy("slide").agg(*[F.sum(x).alias(x) for x in confusion.COUNTS], F.avg("image_score").alias("v"))
    drawn = bootstrap.resample(rows, [], "slide", 100, 7)
    dice = rates.ratio(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), 1.0)
    values = drawn.groupBy("replicate").agg(dice.alias("pooled_dice"), F.avg("v").alias("mean_score"))
    return bootstrap.interval(values.unpivot(["replicate"], ["pooled_dice", "mean_score"], "metric", "value"), ["metric"], "value")


def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of three thresholds' overlap, as methods, on the same drawn slides."""
    rows, named = obs(spark, sf_dir), {"low": 0.4, "middle": 0.6, "high": 0.8}
    rows = rows.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.lit(x).alias("cut")) for k, x in named.items()]))).select("*", "m.*")
    counts = confusion.confusion(rows, ["slide", "method"], F.col("target"), F.col("score") >= F.col("cut"), F.col("valid")).where("n_valid > 0")
    values = counts.select("slide", "method", rates.pixel_metrics(*[F.col(x) for x in confusion.COUNTS])["dice"].alias("dice"))
    return bootstrap.paired(values, [], "slide", "method", "dice", 100, 7)


def _slide_role() -> F.Column:
    """Calibration or test, by the slide's hash."""
    return F.when(F.substring(F.sha2(F.col("slide").cast("string"), 256), 1, 1) < "8", "calibration").otherwise("test")


def locked_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold chosen on the calibration slides of each stratum, locked, and applied to its test slides: pooled counts,
    metrics, clean alert rate and the samples of each presence category."""
    rows = obs(spark, sf_dir).withColumn("role", _slide_role())
    locked = ranking.best_threshold(rows.where("role = 'calibration' AND valid"), ["stratum"]).select("stratum", "threshold")
    # a row for each stratum is broadcast: rows joined by stratum would be as many tasks as strata
    test = rows.where("role = 'test'").join(F.broadcast(locked), "stratum")
    counts = confusion.confusion(test, ["stratum", "threshold"], F.col("target"), F.col("score") >= F.col("threshold"), F.col("valid"))
    samples = test.groupBy("stratum", "sample").agg((F.count_if("target") > 2).alias("label"), (F.max("score") >= F.first("threshold")).alias("called"))
    kinds = samples.groupBy("stratum").agg(*[F.count_if(rates.category(F.col("label"), F.col("called")) == k).alias(f"samples_{k.lower()}") for k in ("TP", "FP", "FN", "TN")])
    found = confusion.metrics(counts, ["dice", "precision", "recall"]).join(kinds, "stratum")
    return found.withColumn("threshold", F.round("threshold", 6))


def logo_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of seven groups of slides held out in turn: the threshold of the others, and the held-out group's overlap."""
    rows = obs(spark, sf_dir).where("valid").withColumn("fold", F.col("slide") % 7)
    counts = ranking.score_counts(rows, ["fold"]).withColumnRenamed("fold", "own")
    # a fold's calibration is all counts of the other folds
    folds = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(6)))).where("fold <> own")
    locked = ranking.best_of_counts(folds.groupBy("fold", "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), ["fold"]).select("fold", "threshold")
    held = confusion.confusion(rows.join(F.broadcast(locked), "fold"), ["fold", "threshold"], F.col("target"), F.col("score") >= F.col("threshold"), F.lit(True))
    return confusion.metrics(held, ["dice", "recall"]).withColumn("threshold", F.round("threshold", 6))


QUERIES = {
    f.__name__: f
    for f in (
        operational_eval, wilson_interval, confusion_counts, pixel_metrics, pooled_micro, field_macro, slide_macro, clean_burden, binary_rates,
        aggregate_results, burden_metrics, grouping_sets, comparison_rows, runtime_summary, finite_mean, rollup_support, group_macro, aggregate_rows,
        average_precision, ap_diagnostics, auroc_rank, spearman, threshold_sweep, image_threshold, ecdf_rank, presence_category, outcome_recompute,
        paired_difference, paired_contrast, sensitivity_delta, bootstrap_stratified, bootstrap_group, image_score, calibration_quantile,
        bootstrap_ci, bootstrap_cluster, bootstrap_paired, locked_eval, logo_eval,
    )
}

_STEPS = """steps AS (
    SELECT *, sum(n) OVER d AS cn, sum(p) OVER d AS cp FROM (SELECT {by}, score, count(*) AS n, count(*) FILTER (target) AS p FROM {rows} GROUP BY {by}, score)
    WINDOW d AS (PARTITION BY {by} ORDER BY score DESC))"""
_SWEEP = """cells AS (
    SELECT {by}, score AS threshold, cp AS tp, cn - cp AS fp, sum(p) OVER w - cp AS fn, sum(n) OVER w - cn - (sum(p) OVER w - cp) AS tn
    FROM steps WINDOW w AS (PARTITION BY {by}))"""

SQL = {
    "operational_eval": f"""
        WITH {RECORDS}, counts AS (
            SELECT source, count(*) AS n, count(*) FILTER (severe) AS n_severe, count(*) FILTER (severe AND decision <> 'PASS') AS severe_flagged,
                   count(*) FILTER (decision = 'PASS') AS n_pass, count(*) FILTER (decision = 'PASS' AND NOT actionable) AS true_pass,
                   avg((decision = 'REVIEW')::INT::DOUBLE) AS referral_rate, avg((decision = 'FAIL')::INT::DOUBLE) AS fail_rate
            FROM records GROUP BY source
        ), bounds AS (
            SELECT *, {_wilson_sql("severe_flagged", "n_severe", "-")} AS severe_lower, {_wilson_sql("true_pass", "n_pass", "-")} AS npv_lower,
                   CASE WHEN n_pass > 0 THEN true_pass::DOUBLE / n_pass END AS npv FROM counts
        ), gates AS (
            SELECT *, CASE WHEN n_severe < 2 OR severe_lower IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN severe_lower >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS severe_gate,
                   CASE WHEN n_pass < 5 OR npv IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN npv >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS npv_gate,
                   CASE WHEN n < 5 THEN 'INSUFFICIENT_EVIDENCE' WHEN referral_rate <= 0.25 THEN 'PASS' ELSE 'FAIL' END AS referral_gate FROM bounds)
        SELECT source, n, n_severe, severe_flagged, n_pass, true_pass, round(referral_rate, 6) AS referral_rate, round(fail_rate, 6) AS fail_rate,
               round(severe_lower, 6) AS severe_lower, round(npv, 6) AS npv, round(npv_lower, 6) AS npv_lower, severe_gate, npv_gate, referral_gate,
               CASE WHEN 'FAIL' IN (severe_gate, npv_gate, referral_gate) THEN 'FAIL'
                    WHEN 'INSUFFICIENT_EVIDENCE' IN (severe_gate, npv_gate, referral_gate) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS status
        FROM gates ORDER BY source""",
    "wilson_interval": f"""
        WITH {RECORDS}, c AS (SELECT lang, count(*) FILTER (actionable) AS hits, count(*) AS n FROM records GROUP BY lang)
        SELECT lang, hits, n, round(hits::DOUBLE / n, 6) AS estimate, round({_wilson_sql("hits", "n", "-")}, 6) AS lower, round({_wilson_sql("hits", "n", "+")}, 6) AS upper FROM c""",
    "confusion_counts": f"WITH {OBS} SELECT stratum, {COUNTS}, count(*) FILTER (valid) AS n_valid FROM obs GROUP BY stratum",
    "pixel_metrics": f"""
        WITH {OBS}, c AS (SELECT slide, {COUNTS}, count(*) FILTER (valid) AS n_valid FROM obs GROUP BY slide)
        SELECT *, {METRICS},
            round(CASE WHEN sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) = 0 THEN CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END
                  ELSE (tp::DOUBLE*tn - fp::DOUBLE*fn) / sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)) END, 6) AS mcc,
            round((CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 1.0 ELSE tn::DOUBLE / (tn + fp) END) / 2, 6) AS balanced_accuracy,
            round(CASE WHEN tn + fp = 0 THEN 0.0 ELSE fp::DOUBLE / (tn + fp) END, 6) AS false_positive_rate
        FROM c""",
    "pooled_micro": f"WITH {FIELDS}, c AS (SELECT stratum, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM fields WHERE n_valid > 0 GROUP BY stratum) SELECT *, {METRICS} FROM c",
    "field_macro": f"WITH {FIELDS}, x AS (SELECT stratum, {_DICE} AS d FROM fields WHERE n_valid > 0 AND label = 1) SELECT stratum, {_DISTRIBUTION} FROM x GROUP BY stratum",
    "slide_macro": f"""WITH {FIELDS}, s AS (SELECT stratum, slide, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM fields WHERE n_valid > 0 GROUP BY ALL),
        x AS (SELECT stratum, {_DICE} AS d FROM s) SELECT stratum, {_DISTRIBUTION} FROM x GROUP BY stratum""",
    "clean_burden": f"""WITH {FIELDS} SELECT stratum, count(*) AS n_clean, round(sum(fp)::DOUBLE / nullif(sum(n_valid), 0), 6) AS fp_fraction,
        round(sum(fp)::DOUBLE * 1000000 / nullif(sum(n_valid), 0), 6) AS fp_per_megapixel, round(avg(image_prediction::DOUBLE), 6) AS alert_rate,
        round(avg(fp::DOUBLE / nullif(n_valid, 0)), 6) AS mean_area_fraction, round(avg((fp::DOUBLE / nullif(n_valid, 0) >= 0.01)::INT::DOUBLE), 6) AS share_over_1_percent,
        round(avg((fp::DOUBLE / nullif(n_valid, 0) >= 0.05)::INT::DOUBLE), 6) AS share_over_5_percent, round(1 - sum(fp)::DOUBLE / nullif(sum(n_valid), 0), 6) AS pixel_specificity
        FROM fields WHERE label = 0 GROUP BY stratum""",
    "binary_rates": f"""WITH {FIELDS}, c AS (SELECT stratum, count(*) FILTER (label = 1 AND image_prediction = 1) AS tp, count(*) FILTER (label = 0 AND image_prediction = 1) AS fp,
        count(*) FILTER (label = 1 AND image_prediction = 0) AS fn, count(*) FILTER (label = 0 AND image_prediction = 0) AS tn FROM fields GROUP BY stratum),
        r AS (SELECT *, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END AS a, CASE WHEN tn + fp = 0 THEN 1.0 ELSE tn::DOUBLE / (tn + fp) END AS b FROM c)
        SELECT stratum, tp, fp, fn, tn, round(a, 6) AS recall, round(b, 6) AS specificity, round((a + b) / 2, 6) AS balanced_accuracy FROM r""",
    "aggregate_results": f"""WITH {FIELDS}, x AS (SELECT *, CASE WHEN n_valid > 0 THEN CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp + fn) END END AS iou FROM fields)
        SELECT slide, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, round(avg(iou), 6) AS mean_iou, count(iou) AS n_samples FROM x GROUP BY slide""",
    "burden_metrics": f"""WITH {FIELDS}, s AS (SELECT slide, sum(tp + fn)::DOUBLE / nullif(sum(n_valid), 0) AS t, sum(tp + fp)::DOUBLE / nullif(sum(n_valid), 0) AS p FROM fields GROUP BY slide)
        SELECT slide, round(t, 6) AS true_fraction, round(p, 6) AS predicted_fraction, round(p - t, 6) AS signed_error, round(abs(p - t), 6) AS absolute_error,
               round(CASE WHEN t <> 0 THEN (p - t) / t WHEN p = 0 THEN 0.0 END, 6) AS relative_error FROM s""",
    "grouping_sets": f"""WITH {OBS}, c AS (SELECT stratum, slide, {COUNTS} FROM obs GROUP BY ALL)
        SELECT coalesce(stratum, 'all') AS stratum, coalesce(slide, -1) AS slide, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn
        FROM c GROUP BY GROUPING SETS ((), (stratum), (slide))""",
    "comparison_rows": f"""WITH {RECORDS}, c AS (SELECT source, lang, decision, count(*) AS n FROM records GROUP BY ALL)
        SELECT source, lang, sum(n)::BIGINT AS n, '{{' || string_agg('"' || decision || '":' || n, ',' ORDER BY decision) || '}}' AS decisions FROM c GROUP BY source, lang""",
    "runtime_summary": """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
        round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max, round(sum(value), 3) AS total FROM events GROUP BY event_type""",
    "finite_mean": """WITH x AS (SELECT s_nationkey, s_acctbal / nullif(s_suppkey % 3, 0) AS v FROM supplier)
        SELECT s_nationkey, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, count(v) AS n FROM x GROUP BY s_nationkey""",
    "rollup_support": f"""WITH {OBS} SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, count(*) FILTER (target) AS positives,
        count(DISTINCT sample) AS samples, count(DISTINCT slide) AS slides FROM obs GROUP BY ROLLUP (stratum)""",
    "group_macro": f"WITH {FIELDS}, m AS (SELECT stratum, slide, avg(image_score) AS v FROM fields GROUP BY ALL) SELECT stratum, round(avg(v), 6) AS macro, count(*) AS n_groups FROM m GROUP BY stratum",
    "aggregate_rows": f"""WITH {FIELDS} SELECT stratum, label, count(image_score) AS n, round(avg(image_score), 6) AS mean, round(quantile_cont(image_score, 0.5), 6) AS median,
        round(min(image_score), 6) AS low, round(max(image_score), 6) AS high FROM fields GROUP BY stratum, label""",
    "average_precision": f"""WITH {OBS}, {_STEPS.format(by="stratum", rows="obs")}
        SELECT stratum, round(sum(p * cp::DOUBLE / cn) / nullif(sum(p), 0), 6) AS average_precision, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives FROM steps GROUP BY stratum""",
    "ap_diagnostics": f"""WITH {OBS}, {_STEPS.format(by="slide", rows="obs")}, a AS (
            SELECT slide, sum(p * cp::DOUBLE / cn) / nullif(sum(p), 0) AS ap, sum(p)::DOUBLE / sum(n) AS prevalence FROM steps GROUP BY slide
        ), c AS (SELECT slide, avg((score >= 0.6)::INT::DOUBLE) AS clean_fpr FROM obs WHERE NOT target GROUP BY slide)
        SELECT a.slide, round(ap, 6) AS average_precision, round(prevalence, 6) AS prevalence, round(clean_fpr, 6) AS clean_fpr,
               ap > greatest(0.3, prevalence) AND clean_fpr <= 0.75 AS ok FROM a LEFT JOIN c ON a.slide = c.slide""",
    "auroc_rank": f"""WITH {OBS}, s AS (SELECT slide, score, count(*) AS n, count(*) FILTER (target) AS p FROM obs GROUP BY ALL),
        r AS (SELECT *, sum(n - p) OVER (PARTITION BY slide ORDER BY score) - (n - p) AS below FROM s)
        SELECT slide, round(sum(p * (below + (n - p) / 2.0)) / nullif(sum(p) * sum(n - p), 0), 6) AS auroc, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives FROM r GROUP BY slide""",
    "spearman": """WITH x AS (SELECT l_suppkey AS slide, l_quantity AS a, l_discount + 0.0 AS b FROM lineitem),
        r AS (SELECT slide, rank() OVER (PARTITION BY slide ORDER BY a) + (count(*) OVER (PARTITION BY slide, a) - 1) / 2.0 AS ra,
                     rank() OVER (PARTITION BY slide ORDER BY b) + (count(*) OVER (PARTITION BY slide, b) - 1) / 2.0 AS rb FROM x)
        SELECT slide, round(CASE WHEN count(*) < 2 OR stddev_pop(ra) = 0 OR stddev_pop(rb) = 0 THEN NULL ELSE corr(ra, rb) END, 6) AS rho FROM r GROUP BY slide""",
    "threshold_sweep": f"""WITH {OBS}, v AS (SELECT * FROM obs WHERE valid), {_STEPS.format(by="stratum", rows="v")}, {_SWEEP.format(by="stratum")},
        m AS (SELECT stratum, threshold, round(2.0 * tp / (2 * tp + fp + fn), 12) AS dice, round(tp::DOUBLE / (tp + fp), 12) AS precision FROM cells)
        SELECT stratum, round(dice, 6) AS dice, round(precision, 6) AS precision, round(threshold, 6) AS threshold FROM m
        QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY m.dice DESC, m.precision DESC, m.threshold DESC) = 1""",
    "image_threshold": f"""WITH {FIELDS}, v AS (SELECT stratum, label = 1 AS target, image_score AS score FROM fields), {_STEPS.format(by="stratum", rows="v")}, {_SWEEP.format(by="stratum")},
        m AS (SELECT stratum, threshold, round((CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fn) END + CASE WHEN tn + fp = 0 THEN 1.0 ELSE tn::DOUBLE / (tn + fp) END) / 2, 12) AS ba,
                     round(CASE WHEN tn + fp = 0 THEN 1.0 ELSE tn::DOUBLE / (tn + fp) END, 12) AS sp FROM cells)
        SELECT stratum, round(ba, 6) AS balanced_accuracy, round(sp, 6) AS specificity, round(threshold, 6) AS threshold FROM m
        QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY ba DESC, sp DESC, m.threshold DESC) = 1""",
    "ecdf_rank": f"""WITH {OBS}, f AS (SELECT score, count(*) AS n FROM obs WHERE stratum = 'F' GROUP BY score), q AS (SELECT DISTINCT score FROM obs WHERE stratum = 'O'),
        b AS (SELECT score, sum(n) AS n, max(asked) AS asked FROM (SELECT score, n, 0 AS asked FROM f UNION ALL SELECT score, 0, 1 FROM q) GROUP BY score),
        c AS (SELECT *, sum(n) OVER (ORDER BY score)::DOUBLE / sum(n) OVER () AS share FROM b)
        SELECT score, round(share, 9) AS percentile FROM c WHERE asked = 1""",
    "presence_category": f"""WITH {FIELDS} SELECT stratum, CASE WHEN label = 1 THEN CASE WHEN image_prediction = 1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN image_prediction = 1 THEN 'FP' ELSE 'TN' END END AS category,
        count(*) AS n FROM fields GROUP BY ALL""",
    "outcome_recompute": f"WITH {FIELDS} SELECT sample, tp, fp, fn FROM fields WHERE sample % 97 = 0",
    "paired_difference": f"""WITH {FIELDS}, p AS (SELECT slide, avg(image_score) FILTER (stratum = 'F') AS f, avg(image_score) FILTER (stratum = 'O') AS o FROM fields GROUP BY slide)
        SELECT slide, round(f - o, 9) AS difference FROM p WHERE f IS NOT NULL AND o IS NOT NULL""",
    "paired_contrast": """WITH u AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)
        SELECT a.event_type AS a, b.event_type AS b, count(*) AS n, round(avg(a.v - b.v), 6) AS difference FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""",
    "sensitivity_delta": f"""WITH {RECORDS}, h AS (SELECT source, lang, n_chars % 2 AS half, avg((decision = 'FAIL')::INT::DOUBLE) AS rate FROM records GROUP BY ALL),
        d AS (SELECT a.source, a.lang, round(b.rate - a.rate, 6) AS delta FROM h a JOIN h b ON a.source = b.source AND a.lang = b.lang AND a.half = 0 AND b.half = 1)
        SELECT source, lang, delta FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(delta) DESC, lang DESC) = 1""",
    "bootstrap_stratified": f"""{_DRAWS}, v AS (SELECT stratum, replicate, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 1.0::DOUBLE ELSE (2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)))::DOUBLE END AS value FROM replicates GROUP BY ALL)
        SELECT stratum, {_INTERVAL} FROM v GROUP BY stratum""",
    "bootstrap_group": f"{_DRAWS}, v AS (SELECT stratum, replicate, avg(v) AS value FROM replicates GROUP BY ALL) SELECT stratum, {_INTERVAL} FROM v GROUP BY stratum",
    "image_score": f"WITH {OBS} SELECT slide, round(quantile_cont(score, 0.995), 6) AS image_score FROM obs WHERE valid GROUP BY slide",
    "calibration_quantile": f"""WITH {OBS}, t AS (SELECT stratum, quantile_cont(score, 0.99) AS threshold FROM obs WHERE slide % 4 = 0 GROUP BY stratum)
        SELECT stratum, round(any_value(threshold), 6) AS threshold, round(avg((score > threshold)::INT::DOUBLE), 6) AS alert_rate FROM obs JOIN t USING (stratum) WHERE slide % 4 <> 0 GROUP BY stratum""",
    "bootstrap_ci": f"""WITH {FIELDS}, d AS (SELECT sample, {_DICE} AS v FROM fields WHERE n_valid > 0),
        numbered AS (SELECT v, row_number() OVER (ORDER BY sample) - 1 AS place, count(*) OVER () AS n FROM d),
        drawn AS (SELECT replicate, (('0x' || substr(sha256('7|' || replicate || '|' || place), 1, 12))::BIGINT % n) AS place FROM numbered, range(40) AS r(replicate)),
        m AS (SELECT replicate, avg(v) AS value FROM drawn JOIN numbered USING (place) GROUP BY replicate) SELECT {_INTERVAL}, (SELECT round(avg(v), 6) FROM d) AS estimate FROM m""",
    "bootstrap_cluster": f"""WITH {FIELDS}, clusters AS (SELECT slide, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(image_score) AS v FROM fields WHERE n_valid > 0 GROUP BY slide),
        numbered AS (SELECT *, row_number() OVER (ORDER BY slide) - 1 AS place, count(*) OVER () AS n FROM clusters),
        drawn AS (SELECT replicate, (('0x' || substr(sha256('7|' || replicate || '|' || place), 1, 12))::BIGINT % n) AS place FROM numbered, range(100) AS r(replicate)),
        v AS (SELECT replicate, 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS pooled_dice, avg(v) AS mean_score FROM drawn JOIN numbered USING (place) GROUP BY replicate),
        l AS (SELECT 'pooled_dice' AS metric, pooled_dice AS value FROM v UNION ALL SELECT 'mean_score', mean_score FROM v) SELECT metric, {_INTERVAL} FROM l GROUP BY metric""",
    "bootstrap_paired": f"""WITH {OBS}, m AS (SELECT * FROM (VALUES ('low', 0.4::DOUBLE), ('middle', 0.6::DOUBLE), ('high', 0.8::DOUBLE)) AS t(method, cut)),
        c AS (SELECT slide, method, count(*) FILTER (valid AND target AND score >= cut) AS tp, count(*) FILTER (valid AND NOT target AND score >= cut) AS fp, count(*) FILTER (valid AND target AND NOT score >= cut) AS fn,
                     count(*) FILTER (valid) AS n_valid FROM obs, m GROUP BY ALL), d AS (SELECT slide, method, {_DICE} AS v FROM c WHERE n_valid > 0),
        numbered AS (SELECT slide, row_number() OVER (ORDER BY slide) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT slide FROM d)),
        drawn AS (SELECT replicate, (('0x' || substr(sha256('7|' || replicate || '|' || place), 1, 12))::BIGINT % n) AS place FROM numbered, range(100) AS r(replicate)),
        v AS (SELECT x.method AS a, y.method AS b, replicate, avg(x.v - y.v) AS value FROM drawn JOIN numbered USING (place) JOIN d x USING (slide) JOIN d y USING (slide) WHERE x.method < y.method GROUP BY ALL)
        SELECT a, b, {_INTERVAL} FROM v GROUP BY a, b""",
    "locked_eval": f"""WITH {OBS}, r AS (SELECT *, CASE WHEN substr(sha256(slide::VARCHAR), 1, 1) < '8' THEN 'calibration' ELSE 'test' END AS role FROM obs),
        v AS (SELECT * FROM r WHERE role = 'calibration' AND valid), {_STEPS.format(by="stratum", rows="v")}, {_SWEEP.format(by="stratum")},
        m AS (SELECT stratum, threshold, round(2.0 * tp / (2 * tp + fp + fn), 12) AS dice, round(tp::DOUBLE / (tp + fp), 12) AS precision FROM cells),
        l AS (SELECT stratum, threshold FROM m QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY m.dice DESC, m.precision DESC, m.threshold DESC) = 1),
        t AS (SELECT r.*, threshold FROM r JOIN l USING (stratum) WHERE role = 'test'),
        c AS (SELECT stratum, threshold, {COUNTS.replace("score >= 0.6", "score >= threshold")}, count(*) FILTER (valid) AS n_valid FROM t GROUP BY ALL),
        s AS (SELECT stratum, sample, count(*) FILTER (target) > 2 AS label, max(score) >= any_value(threshold) AS called FROM t GROUP BY ALL),
        k AS (SELECT stratum, count(*) FILTER (label AND called) AS samples_tp, count(*) FILTER (NOT label AND called) AS samples_fp, count(*) FILTER (label AND NOT called) AS samples_fn, count(*) FILTER (NOT label AND NOT called) AS samples_tn FROM s GROUP BY stratum)
        SELECT x.* EXCLUDE (specificity, iou, threshold), round(threshold, 6) AS threshold, samples_tp, samples_fp, samples_fn, samples_tn FROM (SELECT *, {METRICS} FROM c) x JOIN k USING (stratum)""",
    "logo_eval": f"""WITH {OBS}, r AS (SELECT *, slide % 7 AS own FROM obs WHERE valid), v AS (SELECT r.*, fold FROM r, range(7) AS f(fold) WHERE fold <> own), {_STEPS.format(by="fold", rows="v")}, {_SWEEP.format(by="fold")},
        m AS (SELECT fold, threshold, round(2.0 * tp / (2 * tp + fp + fn), 12) AS dice, round(tp::DOUBLE / (tp + fp), 12) AS precision FROM cells),
        l AS (SELECT fold, threshold FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY m.dice DESC, m.precision DESC, m.threshold DESC) = 1),
        c AS (SELECT own AS fold, threshold, {COUNTS.replace("score >= 0.6", "score >= threshold")}, count(*) AS n_valid FROM r JOIN l ON own = fold GROUP BY ALL)
        SELECT x.* EXCLUDE (specificity, iou, precision, threshold), round(threshold, 6) AS threshold FROM (SELECT *, {METRICS} FROM c) x""",
}
