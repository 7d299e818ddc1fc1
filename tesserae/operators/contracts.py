"""Rules over benchmark contracts: documents in JSON, and the tables of what they name. All give rows of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from .audits import Rule, issues

# What a contract must say.
POLICY = {
    "require_real_data": True,
    "require_artifact_annotations": True,
    "require_ignore_masks": True,
    "allow_synthetic_for_scientific_acceptance": False,
    "require_regime_stratification": True,
}


def acceptance(contracts: DataFrame, key: str, document: str) -> DataFrame:
    """``key, code, severity, field``: policies that do not hold literally, statuses other than adjudicated, approvals that
    lack a true flag or a digest of their evidence."""
    text = F.col(document)
    literal = lambda name: F.coalesce(F.get_json_object(text, f"$.scientific_acceptance.{name}"), F.lit(""))
    rules = []
    for name, value in POLICY.items():
        code = "unsafe_acceptance_policy" if value else "synthetic_acceptance_forbidden"
        rules.append(Rule(code, "error", name, literal(name) != ("true" if value else "false")))
    statuses = F.transform(F.from_json(literal("accepted_annotation_statuses"), "array<string>"), lambda x: F.lower(F.trim(x)))
    adjudicated = F.coalesce(F.array_distinct(statuses) == F.array(F.lit("adjudicated")), F.lit(False))
    rules.append(Rule("adjudication_requirement_cannot_be_relaxed", "error", "accepted_annotation_statuses", ~adjudicated))
    found = issues(contracts, key, rules)
    approvals = F.from_json(F.get_json_object(text, "$.approvals"), "array<struct<role:string,approved:string,evidence_sha256:string>>")
    rows = contracts.select(key, F.explode(approvals).alias("a"))
    own = [
        Rule("approval_missing", "blocker", "approved", F.coalesce(F.col("a.approved"), F.lit("")) != "true"),
        Rule("evidence_missing", "blocker", "evidence_sha256", (F.col("a.approved") == "true") & ~checks.is_digest(F.lower(F.trim("a.evidence_sha256")))),
    ]
    return found.unionByName(issues(rows, key, own))


def named_members(documents: DataFrame, key: str, document: str, name: str) -> DataFrame:
    """``key, place, id, code``: the entries of a JSON collection, an object by id or a list of objects that hold theirs.

    ``code`` tells what is wrong: no object, no identifier, one that came before; null for good entries. What is neither
    gives one row, ``expected_collection``.
    """
    text = F.ltrim(document)
    by_id = F.transform(F.map_entries(F.from_json(document, "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    listed = F.transform(F.from_json(document, "array<string>"), lambda v: F.struct(F.lit(None).cast("string").alias("k"), v.alias("v")))
    entries = F.when(text.startswith("{"), by_id).when(text.startswith("["), listed)
    rows = documents.select(key, F.posexplode_outer(entries).alias("place", "e"))
    own = F.get_json_object("e.v", f"$.{name}")
    rows = rows.select(key, "place", F.coalesce(F.col("e.v"), F.lit("")).startswith("{").alias("whole"), F.trim(F.coalesce(own, F.col("e.k"))).alias("id"))
    rows = rows.withColumn("id", F.when(F.col("whole") & (F.col("id") != ""), F.col("id")))
    first = rows.where("id is not null").groupBy(key, "id").agg(F.min("place").alias("first"))
    rows = rows.join(first, [key, "id"], "left")
    code = F.when(F.col("place").isNull(), "expected_collection").when(~F.col("whole"), "expected_object").when(F.col("id").isNull(), "missing_id").when(F.col("place") > F.col("first"), "duplicate_id")
    return rows.select(key, "place", "id", code.alias("code"))


def resources(rows: DataFrame) -> DataFrame:
    """``resource, status``: eligible, or blocked by its licence, its digest or its state. ``rows``: resource, license, sha256,
    available."""
    status = F.when(~F.col("license").isin("open", "granted"), "license").when(~checks.is_digest(F.col("sha256")), "digest").when(~F.col("available"), "unavailable").otherwise("eligible")
    return rows.select("resource", F.coalesce(status, F.lit("license")).alias("status"))


def methods(rows: DataFrame, uses: DataFrame, states: DataFrame) -> DataFrame:
    """``method, eligible, reason``: enabled, ready, and every resource that it uses is eligible (one that is not listed is
    not). ``rows``: method, enabled, ready; ``uses``: method, resource; ``states``: of ``resources``."""
    used = uses.distinct().join(states, "resource", "left").groupBy("method").agg(F.bool_and(F.coalesce("status", F.lit("unlisted")) == "eligible").alias("all"))
    rows = rows.join(used, "method", "left")
    reason = F.when(~F.col("enabled"), "disabled").when(~F.col("ready"), "not ready").when(~F.coalesce("all", F.lit(True)), "resource")
    return rows.select("method", reason.isNull().alias("eligible"), reason.alias("reason"))


def comparisons(rows: DataFrame, capabilities: DataFrame, eligible: DataFrame, cells: DataFrame, parts: list[str]) -> DataFrame:
    """``code, method, <parts>``: comparisons of a method without that capability, or that is not eligible (a blocker), and the
    required ``cells`` (parts) that no good comparison fills."""
    rows = rows.select("method", *parts).distinct()
    able = rows.join(capabilities.select("method", *parts).distinct(), ["method", *parts], "left_semi")
    unable = rows.join(capabilities.select("method", *parts).distinct(), ["method", *parts], "left_anti").withColumn("code", F.lit("capability_mismatch"))
    good = able.join(eligible.where("eligible"), "method", "left_semi")
    blocked = able.join(eligible.where("eligible"), "method", "left_anti").withColumn("code", F.lit("method_not_eligible"))
    missing = cells.select(*parts).distinct().join(good, parts, "left_anti").withColumns({"code": F.lit("missing_cell"), "method": F.lit(None).cast(dict(rows.dtypes)["method"])})
    columns = ["code", "method", *parts]
    return unable.select(columns).unionByName(blocked.select(columns)).unionByName(missing.select(columns))


def required_values(rows: DataFrame, by: list[str], column: str, required: list[str]) -> DataFrame:
    """``by, missing, surplus``: of each group, required values that it lacks and values beyond them, in order."""
    have = F.array_sort(F.collect_set(column))
    need = F.array(*[F.lit(x) for x in sorted(required)])
    found = rows.groupBy(*by).agg(have.alias("have"))
    return found.select(*by, F.array_join(F.array_except(need, "have"), ",").alias("missing"), F.array_join(F.array_except("have", need), ",").alias("surplus"))


def provenance(runs: DataFrame, key: str) -> DataFrame:
    """Issues of ``key, commit, dirty, lock_sha256, seed, started, ended, python`` rows."""
    c = F.col
    return issues(runs, key, [
        Rule("commit_malformed", "error", "commit", ~checks.is_digest(c("commit"), 40)),
        Rule("tree_dirty", "error", "dirty", F.coalesce(c("dirty"), F.lit(True))),
        Rule("lock_malformed", "error", "lock_sha256", ~checks.is_digest(c("lock_sha256"))),
        Rule("seed_negative", "error", "seed", c("seed").isNull() | (c("seed") < 0)),
        Rule("times_reversed", "error", "ended", c("ended") < c("started")),
        Rule("version_missing", "error", "python", ~checks.is_present(c("python"))),
    ])


def sample_contract(rows: DataFrame, key: str) -> DataFrame:
    """Issues of ``key, modality, channels, patient, block, slide, role, positive_cells, patch, stride, height, width`` rows: a
    clean sample is bright-field with three channels, knows its whole origin, has empty masks and is larger than a patch."""
    c = F.col
    return issues(rows, key, [
        Rule("modality", "error", "modality", F.coalesce(c("modality") != "he", F.lit(True))),
        Rule("channels", "error", "channels", c("channels") != 3),
        Rule("origin", "error", "slide", ~(checks.is_present(c("patient")) & checks.is_present(c("block")) & checks.is_present(c("slide")))),
        Rule("not_clean", "error", "positive_cells", c("role").isin("fit", "calibration") & (c("positive_cells") > 0)),
        Rule("stride", "error", "stride", c("stride") >= c("patch")),
        Rule("too_small", "error", "patch", F.least("height", "width") < c("patch")),
    ])


def cohorts(records: DataFrame, cohort: str, label: Column, attested: Column, checksum: Column, identities: list[str], least: int) -> DataFrame:
    """``cohort, field, code, n``: records without attestation or checksum, classes with fewer than ``least`` records, and
    identities that other cohorts share."""
    by = records.groupBy(F.col(cohort).alias("cohort"))
    counts = by.agg(F.count_if(~F.coalesce(attested, F.lit(False))).alias("attestation_missing"), F.count_if(~F.coalesce(checksum, F.lit(False))).alias("checksum_missing"), F.count_if(label).alias("positive_support"), F.count_if(~label).alias("negative_support"))
    long = counts.unpivot(["cohort"], ["attestation_missing", "checksum_missing", "positive_support", "negative_support"], "code", "n")
    bad = long.where((F.col("code").endswith("missing") & (F.col("n") > 0)) | (F.col("code").endswith("support") & (F.col("n") < least))).withColumn("field", F.lit(""))
    one = records.select(F.col(cohort).alias("cohort"), F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in identities])).alias("i")).select("cohort", "i.*").where("value is not null").distinct()
    shared = one.groupBy("field", "value").agg(F.count("*").alias("k")).where("k > 1")
    overlap = one.join(shared, ["field", "value"]).groupBy("cohort", "field").agg(F.count("*").alias("n")).withColumn("code", F.lit("identity_shared"))
    return bad.select("cohort", "field", "code", "n").unionByName(overlap.select("cohort", "field", "code", "n"))
