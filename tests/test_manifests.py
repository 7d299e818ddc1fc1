"""Manifests as VARIANT: no line is lost."""

from __future__ import annotations

import json

from tesserae.operators import contract_documents, manifests
from tesserae.sources.files import manifest_lines, manifest_records

GOOD = {
    "sample_id": "a", "modality": "H&E", "image_path": "a.npy", "split": "Train", "patient_id": 4, "cohort": "prevalence", "pixel_size_um": 0.5, "image_sha256": "0f" * 32,
    "valid_mask_path": "v.npy", "valid_mask_sha256": "sha256:" + "AB" * 32, "unknown": {"deep": [1, {"x": None}]},
}


def found(rows):
    return {(r.line, r.code, r.severity, r.field) for r in rows.collect()}


def test_every_line_is_a_record_or_an_issue(spark, tmp_path):
    lines = [json.dumps(GOOD), "", "{broken", "[1]", json.dumps(GOOD | {"split": "test"}), json.dumps(GOOD | {"sample_id": "b", "split": "test"}), json.dumps({}), "null"]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    rows = manifest_lines(spark, f"file://{tmp_path}/m.jsonl")
    assert {r.line: r.text for r in rows.collect()} == dict(enumerate(lines, 1))
    got = found(manifests.audit(rows))
    assert {x for x in got if x[0] < 7} == {
        (3, "json_decode_error", "error", None), (4, "record_not_object", "error", None),
        (5, "duplicate_sample_id", "error", "sample_id"), *[(k, c, "error", f) for k in (5, 6) for f, c in (("patient_id", "patient_split_leakage"), ("image_path", "source_path_split_leakage"), ("image_sha256", "file_checksum_split_leakage"))],
    }
    assert {x[1:] for x in got if x[0] == 7} == {
        *[("missing_required_field", "error", x) for x in manifests.REQUIRED], ("missing_group_id", "error", "patient_id/block_id/slide_id/run_id"), ("missing_cohort", "warning", "cohort"),
        ("missing_pixel_size", "warning", "pixel_size_um"), ("missing_valid_region", "warning", "valid_mask_path/ignore_mask_path"),
    }
    assert (8, "record_not_object", "error", None) in got
    strict = found(manifests.audit(rows, strict=True))
    assert {x[:2] for x in strict} == {x[:2] for x in got} and {x[2] for x in strict} == {"error"}
    kept = manifests.read(rows).where("line = 1").selectExpr("to_json(record) AS r").first().r
    assert json.loads(kept) == GOOD


def test_values_of_the_wrong_kind(spark):
    odd = [
        ("sample_id", True, "invalid_sample_id"), ("run_id", [1], "invalid_group_id"), ("split", {}, "invalid_split"), ("split", "mine", "uncontrolled_split"), ("cohort", False, "invalid_cohort"), ("cohort", "mine", "uncontrolled_cohort"),
        ("modality", "xray", "unsupported_modality"), ("image_path", 5, "invalid_path_field"), ("ignore_mask_path", " ", "invalid_path_field"), ("channel_names", [], "invalid_channel_names"), ("channel_names", ["a", 1], "invalid_channel_names"),
        ("channel_names", ["a", " A"], "duplicate_channel_name"), ("modality", "COMET", "missing_fluorescence_channel_names"), ("channel_axis", 0.5, "invalid_channel_axis"), ("channel_axis", True, "invalid_channel_axis"),
        ("pixel_size_um", None, "invalid_pixel_size"), ("pixel_size_um", [0.5, -1], "invalid_pixel_size"), ("pixel_size_um", [1], "invalid_pixel_size"), ("pixel_size_um", True, "invalid_pixel_size"), ("pixel_size_um", "0.5", "invalid_pixel_size"),
        ("color_order", None, "invalid_color_order"), ("source_id", {}, "invalid_source_id"), ("image_sha256", None, "missing_checksum"), ("image_sha256", "0f", "invalid_checksum"), ("fold_mask_path", "f.npy", "missing_checksum"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(GOOD | {k: v})) for i, (k, v, _) in enumerate(odd)], "line long, text string")
    got = found(manifests.audit(rows))
    own = {i: {c for line, c, _, f in got if line == i and not c.startswith("duplicate_sample") and not c.endswith("leakage")} for i in range(len(odd))}
    for i, (name, _, code) in enumerate(odd):
        extra = {"modality": {"missing_required_field"}, "sample_id": set(), "image_path": {"missing_checksum"}}.get(name, set())
        assert code in own[i] and own[i] <= {code} | extra, (odd[i], own[i])
    fine = [GOOD | {"pixel_size_um": [0.5, 2]}, GOOD | {"channel_axis": 0, "sample_id": "b"}, GOOD | {"cohort_role": "Missing Degraded-Input", "sample_id": 7}]
    del fine[2]["cohort"]
    assert found(manifests.audit(spark.createDataFrame(list(enumerate(map(json.dumps, fine))), "line long, text string"))) == set()


def test_documents_and_empty_manifests(spark, tmp_path):
    for name, text in {"list": json.dumps([GOOD, 5]), "held": json.dumps({"version": 1, "samples": [GOOD]}), "none": "{}", "broken": "[{", "text": '"x"'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = manifest_records(spark, f"file://{tmp_path}").collect()
    got = {(r.path.rsplit("/", 1)[1], r.line): r.issue or json.loads(r.text) for r in rows}
    assert got == {("list.json", 1): GOOD, ("list.json", 2): 5, ("held.json", 1): GOOD, ("none.json", 1): "invalid_manifest_root", ("text.json", 1): "invalid_manifest_root", ("broken.json", 1): "json_decode_error"}
    assert found(manifests.audit(manifest_records(spark, f"file://{tmp_path}/none.json"))) == {(1, "invalid_manifest_root", "error", None)}
    assert found(manifests.audit(spark.createDataFrame([(1, " ")], "line long, text string"))) == {(0, "empty_manifest", "error", None)}


def test_a_whole_contract_has_no_issues(spark):
    variant = {"id": "v", "channel_selection": "semantic_role", "semantic_channels": ["nuclear"]}
    approval = {"status": "approved", "reference": "r", "evidence_sha256": " " + "0A" * 32}
    good = {
        "ontology": {"version": 1, "crack_definition": "c", "approval_reference": "r", "stakeholder_approved": True},
        "governance_approvals": {x: approval for x in contract_documents.APPROVALS},
        "modalities": {m: {"input_variants": [variant | {"id": m}]} for m in contract_documents.MODALITIES},
        "regimes": [{"id": k, "required_cohorts": [*v, v[0]]} for k, v in contract_documents.REGIMES.items()],
        "reporting": {"stratify_by": [*contract_documents.STRATA, "more"], "confidence_intervals": contract_documents.INTERVALS} | {x: True for x in contract_documents.REPORTING},
    }
    bad = good | {"ontology": good["ontology"] | {"version": False}, "modalities": good["modalities"] | {"he": {"input_variants": [variant, variant | {"channel_indices": None}, "x"]}}, "regimes": good["regimes"][1:]}
    rows = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "[]"), (4, None)], "contract long, document string")
    place = "$.modalities.he.input_variants"
    assert {(r.contract, r.code, r.severity, r.field) for r in contract_documents.audit(rows).collect()} == {
        (2, "ontology_approval_incomplete", "blocker", "$.ontology.version"), (2, "duplicate_id", "error", f"{place}[1]"), (2, "positional_channel_selection_forbidden", "error", f"{place}[1].channel_indices"),
        (2, "expected_object", "error", f"{place}[2]"), (2, "missing_required_regime", "error", "$.regimes.native_zero_shot"), (3, "contract_not_an_object", "error", "$"), (4, "contract_not_an_object", "error", "$"),
    }
    assert contract_documents.audit(rows.limit(0)).count() == 0
