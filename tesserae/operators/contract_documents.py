"""Rules over benchmark contracts as VARIANT: ontology, governance, modalities, regimes and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .audits import Rule, issues
from .manifests import kind

# What a contract must hold.
MODALITIES = ("he", "comet", "cosmx")
REGIMES = {
    "native_zero_shot": ("test",),
    "calibrated": ("calibration", "test"),
    "clean_reference_anomaly": ("calibration", "fit", "test"),
    "shallow_adaptation": ("calibration", "fit", "test"),
    "lora": ("calibration", "fit", "test"),
    "full_finetune": ("calibration", "fit", "test"),
}
APPROVALS = ("data_use", "privacy", "method_assets", "scientific_owner")
ONTOLOGY = ("version", "crack_definition", "approval_reference")
STRATA = ("modality", "artifact", "task", "regime", "input_variant", "site", "scanner_or_instrument", "tissue_type", "severity")
REPORTING = ("forbid_pooled_primary_score_across_modalities", "forbid_ranking_patch_classifiers_by_pixel_metrics", "require_runtime_memory_failure_and_abstention_reporting")
INTERVALS = "cluster_bootstrap_at_highest_available_patient_or_block_unit"


def at(value: str | Column, path: str) -> Column:
    """A member by its path; null where it is missing or null."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def _text(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _present(value: Column) -> Column:
    """Neither missing nor false, blank or empty."""
    said = F.when(kind(value) == "STRING", F.trim(_text(value)) != "").when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    return value.isNotNull() & F.coalesce(said, ~F.to_json(value).isin("{}", "[]"))


def _true(value: Column) -> Column:
    return F.coalesce((kind(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False))


def _object(value: Column) -> Column:
    return F.coalesce(kind(value) == "OBJECT", F.lit(False))


def _strings(value: Column) -> Column:
    """Members of a list that are texts, others as JSON."""
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_text(x), F.to_json(x)))


_SECTIONS = ("ontology", "governance_approvals", "reporting")
_PATHS = (
    *_SECTIONS, *(f"ontology.{x}" for x in (*ONTOLOGY, "stakeholder_approved")), *(f"governance_approvals.{x}{y}" for x in APPROVALS for y in ("", ".status", ".reference", ".evidence_sha256")),
    *(f"reporting.{x}" for x in ("stratify_by", *REPORTING, "confidence_intervals")),
)


def _name(path: str) -> str:
    return path.replace(".", "_")


def _looked_up(docs: DataFrame) -> DataFrame:
    """Each member that the rules ask for as a column, looked up once and not once for each mention."""
    return docs.withColumns({_name(x): at("doc", f"$.{x}") for x in _PATHS})


def _document_rules() -> list[Rule]:
    rules, own_at = [], lambda path: F.col(_name(path))
    ontology, governance, reporting = map(own_at, _SECTIONS)
    rules.append(Rule("missing_ontology_contract", "error", "$.ontology", ~_object(ontology)))
    rules += [Rule("ontology_approval_incomplete", "blocker", f"$.ontology.{x}", _object(ontology) & ~_present(own_at(f"ontology.{x}"))) for x in ONTOLOGY]
    rules.append(Rule("ontology_not_approved", "blocker", "$.ontology.stakeholder_approved", _object(ontology) & ~_true(own_at("ontology.stakeholder_approved"))))
    rules.append(Rule("missing_governance_approvals", "blocker", "$.governance_approvals", ~_object(governance)))
    for area in APPROVALS:
        section = f"governance_approvals.{area}"
        own, path = own_at(section), f"$.{section}"
        evidence = F.lower(F.trim(_text(own_at(f"{section}.evidence_sha256"))))
        digest = F.coalesce(evidence.rlike("^[0-9a-f]{64}$") & (evidence != "0" * 64), F.lit(False))
        rules.append(Rule("governance_approval_missing", "blocker", path, _object(governance) & ~_object(own)))
        rules.append(Rule("governance_approval_pending", "blocker", f"{path}.status", _object(own) & (F.coalesce(_text(own_at(f"{section}.status")), F.lit("")) != "approved")))
        rules.append(Rule("governance_evidence_unverified", "blocker", path, _object(own) & (~_present(own_at(f"{section}.reference")) | ~digest)))
    rules.append(Rule("missing_reporting_contract", "error", "$.reporting", ~_object(reporting)))
    strata = F.coalesce(_strings(own_at("reporting.stratify_by")), F.array().cast("array<string>"))
    rules.append(Rule("incomplete_reporting_strata", "error", "$.reporting.stratify_by", _object(reporting) & (F.size(F.array_except(F.array(*map(F.lit, STRATA)), strata)) > 0)))
    rules += [Rule("unsafe_reporting_policy", "error", f"$.reporting.{x}", _object(reporting) & ~_true(own_at(f"reporting.{x}"))) for x in REPORTING]
    rules.append(Rule("invalid_confidence_interval_contract", "error", "$.reporting.confidence_intervals", _object(reporting) & (F.coalesce(_text(own_at("reporting.confidence_intervals")), F.lit("")) != INTERVALS)))
    return rules


def members(docs: DataFrame, section: str) -> DataFrame:
    """``contract, id, value`` of a collection of objects by id, or of a list of objects that hold theirs; the first of an id."""
    held = docs.select("contract", at("doc", f"$.{section}").alias("held")).where(kind(F.col("held")).isin("OBJECT", "ARRAY"))
    rows = docs.sparkSession.sql("SELECT contract, pos, key, value FROM {held}, LATERAL variant_explode(held)", held=held)
    rows = rows.select("contract", "pos", F.coalesce("key", _text(at("value", "$.id"))).alias("id"), "value").where(_object(F.col("value")) & (F.trim("id") != ""))
    return rows.groupBy("contract", "id").agg(F.min_by("value", "pos").alias("value"))


def _modalities(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Required ones that are missing; input variants without names, twice named, or chosen by place."""
    own = keep(own, "modalities")
    names = own.groupBy("contract").agg(F.collect_set("id").alias("ids"))
    lacks = F.explode(F.array_except(F.array(*map(F.lit, MODALITIES)), F.coalesce("ids", F.array().cast("array<string>"))))
    missing = docs.select("contract").join(names.hint("merge"), "contract", "left").select("contract", lacks.alias("id"))
    missing = missing.select("contract", F.lit("missing_required_modality").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("$.modalities."), "id").alias("field"))
    variants = F.try_variant_get(at("value", "$.input_variants"), "$", "array<variant>")
    rows = own.select("contract", F.concat(F.lit("$.modalities."), "id").alias("path"), "id", F.when(kind(at("value", "$.input_variants")) == "ARRAY", variants).alias("variants"))
    none = rows.where("variants is null OR size(variants) = 0").select("contract", F.lit("missing_input_variants").alias("code"), F.lit("error").alias("severity"), F.concat("path", F.lit(".input_variants")).alias("field"))
    each = rows.select("contract", "id", "path", F.posexplode("variants").alias("place", "v"))
    each = each.select("contract", "id", "place", "v", F.concat("path", F.lit(".input_variants["), F.col("place").cast("string"), F.lit("]")).alias("path"), _text(at("v", "$.id")).alias("name"))
    named = _object(F.col("v")) & F.coalesce(F.trim("name") != "", F.lit(False))
    first = each.where(named).groupBy("contract", "name").agg(F.min(F.struct("id", "place")).alias("first"))
    each = keep(each.join(first.hint("merge"), ["contract", "name"], "left"), "variants")
    roles = at("v", "$.semantic_channels")
    bad_roles = F.coalesce(kind(roles) != "ARRAY", F.lit(True)) | (F.size(F.try_variant_get(roles, "$", "array<variant>")) == 0)
    bad_roles = bad_roles | F.exists(F.try_variant_get(roles, "$", "array<variant>"), lambda x: F.coalesce((kind(x) != "STRING") | (F.trim(F.try_variant_get(x, "$", "string")) == ""), F.lit(True)))
    rules = [
        Rule("expected_object", "error", "", ~_object(F.col("v"))),
        Rule("missing_id", "error", "", _object(F.col("v")) & ~named),
        Rule("duplicate_id", "error", "", named & ((F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")))),
        Rule("positional_channel_selection_forbidden", "error", ".channel_selection", named & (F.coalesce(_text(at("v", "$.channel_selection")), F.lit("")) != "semantic_role")),
        Rule("missing_semantic_channels", "error", ".semantic_channels", named & bad_roles),
        Rule("positional_channel_selection_forbidden", "error", ".channel_indices", named & F.try_variant_get("v", "$.channel_indices", "variant").isNotNull()),
    ]
    found = issues(each.withColumn("where", F.struct("contract", "path")), "where", rules)
    found = found.select("where.contract", "code", "severity", F.concat("where.path", "field").alias("field"))
    return missing.unionByName(none).unionByName(found)


def _regimes(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Required ones that are missing, or that use other cohorts than theirs."""
    asked = docs.select("contract", F.explode(F.map_from_arrays(F.array(*map(F.lit, REGIMES)), F.array(*[F.array(*map(F.lit, x)) for x in REGIMES.values()]))).alias("id", "cohorts"))
    rows = asked.join(own.hint("merge"), ["contract", "id"], "left")
    listed = F.coalesce(F.array_sort(F.array_distinct(_strings(at("value", "$.required_cohorts")))), F.array().cast("array<string>"))
    rules = [
        Rule("missing_required_regime", "error", "", F.col("value").isNull()),
        Rule("invalid_regime_cohorts", "error", ".required_cohorts", F.col("value").isNotNull() & (listed != F.col("cohorts"))),
    ]
    found = issues(rows.withColumn("where", F.struct("contract", "id")), "where", rules)
    return found.select("where.contract", "code", "severity", F.concat(F.lit("$.regimes."), "where.id", "field").alias("field"))


def audit(contracts: DataFrame) -> DataFrame:
    """``contract, code, severity, field`` of documents ``contract, document`` (JSON text). A document that is no JSON object
    is one issue, and no other rule looks at it.

    The files of documents are far smaller than their rows: so documents are dealt out to all tasks, and what is joined to them
    is sorted and merged, not broadcast by the size of its files."""
    parsed = F.try_parse_json("document")
    tasks = int(contracts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = keep(contracts.repartition(tasks, "contract").select("contract", parsed.alias("doc")), "contracts")
    broken = docs.where(~_object(F.col("doc"))).select("contract", F.lit("contract_not_an_object").alias("code"), F.lit("error").alias("severity"), F.lit("$").alias("field"))
    docs = docs.where(_object(F.col("doc")))
    found = broken.unionByName(issues(_looked_up(docs), "contract", _document_rules()))
    return found.unionByName(_modalities(docs, members(docs, "modalities"))).unionByName(_regimes(docs, members(docs, "regimes")))
