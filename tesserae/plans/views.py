"""Views of the given tables that play the parts of the data model, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with a target, a score and a valid region, of samples, slides and strata."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"),
        F.col("l_suppkey").alias("slide"),
        F.col("l_linestatus").alias("stratum"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") >= 26).alias("target"),
        (F.col("l_extendedprice") / (F.col("l_quantity") * 2000.0)).alias("score"),
        (F.col("l_returnflag") != "N").alias("valid"),
    )


OBS = """obs AS (
    SELECT l_orderkey AS sample, l_suppkey AS slide, l_linestatus AS stratum, l_linenumber AS line, l_quantity >= 26 AS target,
           l_extendedprice / (l_quantity * 2000.0::DOUBLE) AS score, l_returnflag <> 'N' AS valid
    FROM lineitem)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and label of each sample at a threshold of 0.6; slide and stratum are its smallest."""
    called = F.col("score") >= 0.6
    cell = lambda x: F.count_if(x & F.col("valid"))
    t = F.col("target")
    return (
        obs(spark, sf_dir)
        .groupBy("sample")
        .agg(
            F.min("slide").alias("slide"),
            F.min("stratum").alias("stratum"),
            cell(t & called).alias("tp"),
            cell(~t & called).alias("fp"),
            cell(t & ~called).alias("fn"),
            cell(~t & ~called).alias("tn"),
            F.count_if("valid").alias("n_valid"),
            F.max("score").alias("image_score"),
            F.count_if(t).alias("positives"),
        )
        .withColumns({"label": (F.col("positives") > 2).cast("int"), "image_prediction": (F.col("image_score") >= 0.7).cast("int")})
    )


FIELDS = f"""{OBS}, fields AS (
    SELECT *, (positives > 2)::INT AS label, (image_score >= 0.7)::INT AS image_prediction FROM (
        SELECT sample, min(slide) AS slide, min(stratum) AS stratum,
               count(*) FILTER (valid AND target AND score >= 0.6) AS tp, count(*) FILTER (valid AND NOT target AND score >= 0.6) AS fp,
               count(*) FILTER (valid AND target AND NOT score >= 0.6) AS fn, count(*) FILTER (valid AND NOT target AND NOT score >= 0.6) AS tn,
               count(*) FILTER (valid) AS n_valid, max(score) AS image_score, count(*) FILTER (target) AS positives
        FROM obs GROUP BY sample))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational records: labelled documents by source; severe means toxic and of low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id")
    decision = F.when(F.col("n_chars") % 10 == 0, "REVIEW").when(F.col("n_chars") > 1500, "PASS").otherwise("FAIL")
    return rows.select(
        "doc_id", "source", "lang", "n_chars", decision.alias("decision"),
        (F.col("quality") == 0).alias("actionable"),
        ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("severe"),
    )


RECORDS = """records AS (
    SELECT d.doc_id, source, lang, n_chars, CASE WHEN n_chars % 10 = 0 THEN 'REVIEW' WHEN n_chars > 1500 THEN 'PASS' ELSE 'FAIL' END AS decision,
           quality = 0 AS actionable, toxic = 1 AND quality = 0 AS severe
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images of 100 by 100 cells, the last one as high as its events reach: a value, a kind, three channels."""
    rows, at = table(spark, sf_dir, "events"), F.col("event_id") % 10_000
    return rows.select(
        F.floor(F.col("event_id") / 10_000).alias("image"), F.floor(at / 100).cast("int").alias("y"), (at % 100).cast("int").alias("x"),
        F.round("value", 3).alias("v"), "event_type", (50.0 / (50.0 + F.round("value", 3))).alias("r"),
        ((F.col("user_id") % 50 + 1) / 50.0).alias("g"), ((F.col("event_id") % 23) / 22.0).alias("b"),
    )


PLANE = """plane AS (
    SELECT event_id // 10000 AS image, (event_id % 10000 // 100)::INT AS y, (event_id % 100)::INT AS x, round(value, 3) AS v, event_type,
           50.0::DOUBLE / (50.0::DOUBLE + round(value, 3)) AS r, (user_id % 50 + 1) / 50.0::DOUBLE AS g, (event_id % 23) / 22.0::DOUBLE AS b
    FROM events)"""
SIZED = f"{PLANE}, sized AS (SELECT *, max(y) OVER (PARTITION BY image) + 1 AS height, max(x) OVER (PARTITION BY image) + 1 AS width FROM plane)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifest records; the split is a function of the record's hash."""
    key = F.sha2(F.col("o_orderkey").cast("string"), 256)
    split = F.when(F.substring(key, 1, 1) < "8", "train").when(F.substring(key, 1, 1) < "c", "validation").otherwise("test")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("patient"),
        F.concat_ws("-", "o_orderpriority", "o_custkey").alias("block"), key.alias("digest"), split.alias("split"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


MANIFEST = """manifest AS (
    SELECT o_orderkey AS record, o_custkey AS patient, o_orderpriority || '-' || o_custkey AS block, sha256(o_orderkey::VARCHAR) AS digest,
           CASE WHEN substr(sha256(o_orderkey::VARCHAR), 1, 1) < '8' THEN 'train' WHEN substr(sha256(o_orderkey::VARCHAR), 1, 1) < 'c' THEN 'validation' ELSE 'test' END AS split,
           o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority
    FROM orders)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors; the role is a function of the vector's hash."""
    first = F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 1)
    role = F.when(first < "8", "fit").when(first < "c", "calibration").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", role.alias("role"))


VECTORS = """vectors AS (
    SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label,
           CASE WHEN substr(sha256(vec_id::VARCHAR), 1, 1) < '8' THEN 'fit' WHEN substr(sha256(vec_id::VARCHAR), 1, 1) < 'c' THEN 'calibration' ELSE 'test' END AS role
    FROM embeddings)"""
