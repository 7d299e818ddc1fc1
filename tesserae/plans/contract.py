"""Queries of contracts and their records; parts, suppliers and orders play resources, methods and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import contracts
from .views import MANIFEST, manifest, table


def contract_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in JSON, one an order, whose policies and approvals depend on the order."""
    k, digest = F.col("record"), F.col("digest")
    policy = F.struct(
        (k % 5 != 0).alias("require_real_data"), F.lit(True).alias("require_artifact_annotations"), F.when(k % 7 != 0, F.lit(True)).alias("require_ignore_masks"),
        (k % 11 == 0).alias("allow_synthetic_for_scientific_acceptance"), F.lit(True).alias("require_regime_stratification"),
        F.when(k % 3 == 0, F.array(F.lit("adjudicated"), F.lit("draft"))).otherwise(F.array(F.lit(" Adjudicated "))).alias("accepted_annotation_statuses"),
    )
    approvals = F.array(F.struct(F.lit("a").alias("role"), (k % 2 == 0).alias("approved"), digest.alias("evidence_sha256")), F.struct(F.lit("b").alias("role"), F.lit(True).alias("approved"), F.when(k % 13 != 0, digest).alias("evidence_sha256")))
    rows = manifest(spark, sf_dir).select("record", F.to_json(F.struct(policy.alias("scientific_acceptance"), approvals.alias("approvals"))).alias("document"))
    return contracts.acceptance(rows, "record", "document").groupBy("code", "severity", "field").agg(F.count("*").alias("n"), F.min("record").alias("first"))


def named_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of collections in JSON: lists for some regions, objects for others, text for one."""
    name = F.when(F.col("n_nationkey") % 6 == 0, F.lit(" ")).when(F.col("n_nationkey") % 4 == 0, F.lit("same")).otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").withColumn("name", name)
    held = F.array_sort(F.collect_list(F.struct("n_nationkey", "name")))
    rows = rows.groupBy("n_regionkey").agg(held.alias("h"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("h", lambda x: F.when(x["n_nationkey"] % 5 == 0, F.lit("3")).otherwise(F.concat(F.lit('{"id":"'), x["name"], F.lit('"}')))), ","), F.lit("]"))
    by_id = F.concat(F.lit("{"), F.array_join(F.transform("h", lambda x: F.concat(F.lit('"k'), x["n_nationkey"].cast("string"), F.lit('":{}'))), ","), F.lit("}"))
    text = F.when(F.col("n_regionkey") % 3 == 0, listed).when(F.col("n_regionkey") % 3 == 1, by_id).otherwise("none")
    return contracts.named_members(rows.select("n_regionkey", text.alias("t")), "n_regionkey", "t", "id")


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 9 == 0, "restricted").when(F.col("p_size") % 2 == 0, "open").otherwise("granted")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource"), kind.alias("license"), F.when(F.col("p_partkey") % 19 != 0, F.sha2("p_name", 256)).alias("sha256"), (F.col("p_retailprice") > 905).alias("available"))
    return contracts.resources(rows)


_RESOURCES = """resources AS (SELECT p_partkey AS resource, CASE WHEN p_size % 9 = 0 THEN 'license' WHEN p_partkey % 19 = 0 THEN 'digest' WHEN NOT p_retailprice > 905 THEN 'unavailable' ELSE 'eligible' END AS status FROM part)"""


def contract_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(spark, sf_dir)


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as methods; they use the parts that they supplied in large numbers."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("method"), (F.col("s_acctbal") > 0).alias("enabled"), (F.col("s_suppkey") % 10 != 3).alias("ready"))
    uses = table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("method"), F.col("l_partkey").alias("resource"))
    return contracts.methods(rows, uses, _resources(spark, sf_dir))


_METHODS = f"""{_RESOURCES}, used AS (SELECT l_suppkey AS method, bool_and(coalesce(status, 'unlisted') = 'eligible') AS every_ FROM lineitem LEFT JOIN resources ON resource = l_partkey WHERE l_quantity = 50 AND l_discount = 0.1 GROUP BY ALL),
    reasons AS (SELECT s_suppkey AS method, CASE WHEN NOT s_acctbal > 0 THEN 'disabled' WHEN s_suppkey % 10 = 3 THEN 'not ready' WHEN NOT coalesce(every_, true) THEN 'resource' END AS reason FROM supplier LEFT JOIN used ON method = s_suppkey),
    methods AS (SELECT method, reason IS NULL AS eligible, reason FROM reasons)"""


def contract_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir)


def contract_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as comparisons of a method in a regime and a status; what a supplier sold in small numbers it is capable of."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("method"), F.col("l_returnflag").alias("regime"), F.col("l_linestatus").alias("output"), F.col("l_quantity").alias("q"))
    cells = lines.select("regime", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("output"))
    return contracts.comparisons(lines.where("q >= 40"), lines.where("q < 3"), _methods(spark, sf_dir), cells, ["regime", "output"])


def contract_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events, as metrics, that each user's report lacks or has beyond the required ones."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return contracts.required_values(rows, ["user_id"], "event_type", ["click", "purchase", "refund", "view"])


def contract_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority, as a cohort: attestations, checksums, support of both classes, shared identities."""
    rows = manifest(spark, sf_dir)
    return contracts.cohorts(rows, "priority", F.col("status") == "F", F.col("record") % 101 != 0, checks.is_digest(F.when(F.col("record") % 97 != 0, F.col("digest"))), ["patient", "digest"], 400)


def run_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs."""
    k = F.col("record")
    rows = manifest(spark, sf_dir).select(
        "record", F.when(k % 4 == 0, F.substring("digest", 1, 39)).otherwise(F.substring("digest", 1, 40)).alias("commit"), F.when(k % 5 != 0, k % 3 == 0).alias("dirty"), F.upper("digest").alias("lock_sha256"),
        (k - 500).alias("seed"), F.col("price").alias("started"), F.lit(100_000.0).alias("ended"), F.when(k % 2 == 0, F.lit(" ")).otherwise("3.13").alias("python"),
    )
    return contracts.provenance(rows, "record").groupBy("code", "field").agg(F.count("*").alias("n"), F.min("record").alias("first"))


def sample_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as samples."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 9 == 0, "comet").when(k % 8 == 0, None).otherwise("he").alias("modality"), F.when(k % 5 == 0, 4).otherwise(3).alias("channels"), F.col("p_name").alias("patient"), F.when(k % 6 != 0, F.col("p_brand")).alias("block"),
        F.col("p_type").alias("slide"), F.when(k % 3 == 0, "test").otherwise("fit").alias("role"), (size % 4).alias("positive_cells"), F.lit(24).alias("patch"), size.alias("stride"), (size * 2).alias("height"), F.lit(60).alias("width"),
    )
    return contracts.sample_contract(rows, "p_partkey")


QUERIES = {
    f.__name__: f
    for f in (contract_acceptance, named_collection, contract_resources, contract_methods, contract_comparisons, contract_metrics, contract_cohorts, run_provenance, sample_contract)
}

_UP = "UNION ALL SELECT"
SQL = {
    "contract_acceptance": f"""WITH {MANIFEST}, i AS (
            SELECT 'unsafe_acceptance_policy' AS code, 'error' AS severity, 'require_real_data' AS field, record FROM manifest WHERE record % 5 = 0
            {_UP} 'unsafe_acceptance_policy', 'error', 'require_ignore_masks', record FROM manifest WHERE record % 7 = 0
            {_UP} 'synthetic_acceptance_forbidden', 'error', 'allow_synthetic_for_scientific_acceptance', record FROM manifest WHERE record % 11 = 0
            {_UP} 'adjudication_requirement_cannot_be_relaxed', 'error', 'accepted_annotation_statuses', record FROM manifest WHERE record % 3 = 0
            {_UP} 'approval_missing', 'blocker', 'approved', record FROM manifest WHERE record % 2 <> 0 {_UP} 'evidence_missing', 'blocker', 'evidence_sha256', record FROM manifest WHERE record % 13 = 0)
        SELECT code, severity, field, count(*) AS n, min(record) AS first FROM i GROUP BY ALL""",
    "named_collection": """WITH m AS (SELECT n_regionkey, n_nationkey AS k, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS place, trim(CASE WHEN n_nationkey % 6 = 0 THEN ' ' WHEN n_nationkey % 4 = 0 THEN 'same' ELSE n_name END) AS name FROM nation),
        l AS (SELECT n_regionkey, place, CASE WHEN n_regionkey % 3 = 1 THEN 'k' || k WHEN k % 5 = 0 OR name = '' THEN NULL ELSE name END AS id, n_regionkey % 3 = 0 AND k % 5 = 0 AS bare FROM m WHERE n_regionkey % 3 < 2)
        SELECT n_regionkey, place, id, CASE WHEN bare THEN 'expected_object' WHEN id IS NULL THEN 'missing_id' WHEN place > min(place) OVER (PARTITION BY n_regionkey, id) THEN 'duplicate_id' END AS code FROM l
        UNION ALL SELECT DISTINCT n_regionkey, NULL, NULL, 'expected_collection' FROM m WHERE n_regionkey % 3 = 2""",
    "contract_resources": f"WITH {_RESOURCES} SELECT * FROM resources",
    "contract_methods": f"WITH {_METHODS} SELECT * FROM methods",
    "contract_comparisons": f"""WITH {_METHODS}, r AS (SELECT DISTINCT l_suppkey AS method, l_returnflag AS regime, l_linestatus AS output FROM lineitem WHERE l_quantity >= 40), c AS (SELECT DISTINCT l_suppkey AS method, l_returnflag AS regime, l_linestatus AS output FROM lineitem WHERE l_quantity < 3),
        k AS (SELECT r.*, c.method IS NOT NULL AS able, coalesce(m.eligible, false) AS good FROM r LEFT JOIN c USING (method, regime, output) LEFT JOIN methods m USING (method))
        SELECT 'capability_mismatch' AS code, method, regime, output FROM k WHERE NOT able UNION ALL SELECT 'method_not_eligible', method, regime, output FROM k WHERE able AND NOT good
        UNION ALL SELECT 'missing_cell', NULL, regime, output FROM (SELECT DISTINCT l_returnflag AS regime FROM lineitem), (VALUES ('F'), ('O'), ('P')) AS t(output) WHERE (regime, output) NOT IN (SELECT (regime, output) FROM k WHERE able AND good)""",
    "contract_metrics": """WITH h AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS have FROM events GROUP BY user_id)
        SELECT user_id, array_to_string(list_filter(['click', 'purchase', 'refund', 'view'], lambda x: NOT list_contains(have, x)), ',') AS missing, array_to_string(list_filter(have, lambda x: NOT list_contains(['click', 'purchase', 'refund', 'view'], x)), ',') AS surplus FROM h""",
    "contract_cohorts": f"""WITH {MANIFEST}, c AS (SELECT priority AS cohort, count(*) FILTER (record % 101 = 0) AS a, count(*) FILTER (record % 97 = 0) AS b, count(*) FILTER (status = 'F') AS p, count(*) FILTER (status <> 'F') AS q FROM manifest GROUP BY ALL),
        v AS (SELECT DISTINCT priority AS cohort, patient FROM manifest), s AS (SELECT patient FROM v GROUP BY patient HAVING count(*) > 1), d AS (SELECT DISTINCT priority AS cohort, digest FROM manifest), e AS (SELECT digest FROM d GROUP BY digest HAVING count(*) > 1)
        SELECT cohort, '' AS field, 'attestation_missing' AS code, a AS n FROM c WHERE a > 0 UNION ALL SELECT cohort, '', 'checksum_missing', b FROM c WHERE b > 0 UNION ALL SELECT cohort, '', 'positive_support', p FROM c WHERE p < 400
        UNION ALL SELECT cohort, '', 'negative_support', q FROM c WHERE q < 400 UNION ALL SELECT cohort, 'patient', 'identity_shared', count(*) FROM v JOIN s USING (patient) GROUP BY cohort UNION ALL SELECT cohort, 'digest', 'identity_shared', count(*) FROM d JOIN e USING (digest) GROUP BY cohort""",
    "run_provenance": f"""WITH {MANIFEST}, i AS (SELECT 'commit_malformed' AS code, 'commit' AS field, record FROM manifest WHERE record % 4 = 0 {_UP} 'tree_dirty', 'dirty', record FROM manifest WHERE record % 5 = 0 OR record % 3 = 0
            {_UP} 'lock_malformed', 'lock_sha256', record FROM manifest WHERE regexp_matches(digest, '[a-f]') {_UP} 'seed_negative', 'seed', record FROM manifest WHERE record < 500 {_UP} 'times_reversed', 'ended', record FROM manifest WHERE price > 100000
            {_UP} 'version_missing', 'python', record FROM manifest WHERE record % 2 = 0) SELECT code, field, count(*) AS n, min(record) AS first FROM i GROUP BY ALL""",
    "sample_contract": """SELECT p_partkey, 'modality' AS code, 'error' AS severity, 'modality' AS field FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 8 = 0 UNION ALL SELECT p_partkey, 'channels', 'error', 'channels' FROM part WHERE p_partkey % 5 = 0
        UNION ALL SELECT p_partkey, 'origin', 'error', 'slide' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'not_clean', 'error', 'positive_cells' FROM part WHERE p_partkey % 3 <> 0 AND p_size % 4 > 0
        UNION ALL SELECT p_partkey, 'stride', 'error', 'stride' FROM part WHERE p_size >= 24 UNION ALL SELECT p_partkey, 'too_small', 'error', 'patch' FROM part WHERE p_size * 2 < 24""",
}
