"""Manifests of JSON lines, made from orders, with what breaks each rule now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifests
from .views import table

_K = "o_orderkey"


def _when(*cases: tuple[str, str], otherwise: str = "''") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def _every(n: int, member: str) -> tuple[str, str]:
    return f"{_K} % {n} = 0", f"'{member}'"


_MEMBERS = (
    _when(_every(53, ""), _every(59, ', "sample_id": "  "'), _every(61, ', "sample_id": true'), (f"{_K} % 71 = 0", "', \"sample_id\": \"s7\"'"), otherwise=f"', \"sample_id\": \"s' || {_K} || '\"'"),
    _when(_every(67, ', "patient_id": [1]'), _every(7, ""), otherwise="', \"patient_id\": ' || o_custkey"),
    _when((f"{_K} % 5 = 0", "', \"block_id\": \"b' || (o_custkey % 900) || '\"'")),
    _when(_every(73, ""), _every(79, ', "split": {}'), _every(83, ', "split": "Other"'), ("o_custkey % 3 = 0", "', \"split\": \"Train\"'"), (f"{_K} % 9 = 1", "', \"split\": \"locked-test\"'"), otherwise="', \"split\": \"validation\"'"),
    _when(_every(11, ""), _every(13, ', "cohort": null, "cohort_role": "prevalence"'), _every(17, ', "cohort_role": "Enriched Challenge"'), _every(19, ', "cohort": false'), _every(23, ', "cohort": "mine"'), otherwise="', \"cohort\": \"prevalence\"'"),
    _when(_every(29, ', "modality": "xray"'), _every(3, ', "modality": "H&E"'), (f"{_K} % 3 = 1", "', \"modality\": \"COMET\"'"), otherwise="', \"modality\": \"CosMx\"'"),
    _when(_every(31, ', "image_path": 5'), otherwise=f"', \"image_path\": \"i' || ({_K} - {_K} % 2) || '.npy\"'"),
    _when(_every(37, ""), _every(41, ', "image_sha256": "zz"'), otherwise=f"', \"image_sha256\": \"' || lpad(CAST({_K} - {_K} % 5 AS STRING), 64, '0') || '\"'"),
    _when(_every(4, ""), _every(43, ', "valid_mask_path": ""'), (f"{_K} % 4 = 1", "', \"valid_mask_path\": \"v.npy\"'"), otherwise="', \"valid_mask_path\": \"v.npy\", \"valid_mask_sha256\": \"sha256:' || repeat('0f', 32) || '\"'"),
    _when(_every(3, ""), _every(89, ', "channel_names": []'), _every(97, ', "channel_names": ["DAPI", "dapi "]'), (f"{_K} % 10 = 1", "''"), otherwise="', \"channel_names\": [\"DAPI\", \"CD3\"]'"),
    _when(_every(107, ', "channel_axis": "0"'), _every(2, ', "channel_axis": 0')),
    _when(_every(6, ""), _every(109, ', "pixel_size_um": null'), _every(113, ', "pixel_size_um": [0.5, 0]'), _every(5, ', "pixel_size_um": [0.5, 0.25]'), otherwise="', \"pixel_size_um\": 0.5'"),
    _when(_every(127, ', "color_order": 3')),
    _when(_every(131, ', "source_id": {}'), (f"{_K} % 8 = 0", "', \"source_id\": ' || (o_custkey % 1200)")),
)
#: A line of the manifest, in the SQL of both engines.
LINE = _when(_every(101, '{"sample_id": '), _every(103, "[1]"), otherwise="'{\"extra\": {\"kept\": 1}' || " + " || ".join(_MEMBERS) + " || '}'")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col(_K).alias("line"), F.expr(LINE).alias("text"))


def manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a manifest of JSON lines."""
    return manifests.audit(_lines(spark, sf_dir))


def manifest_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many issues of each code and severity a strict audit finds."""
    return manifests.audit(_lines(spark, sf_dir), strict=True).groupBy("code", "severity", "field").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (manifest_audit, manifest_strict)}


def _type(name: str) -> str:
    return f"nullif(json_type(j, '$.{name}'), 'NULL')"


def _string(name: str) -> str:
    return f"trim(json_extract_string(j, '$.{name}'))"


def _text(name: str) -> str:
    return f"CASE WHEN {_type(name)} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') AND {_string(name)} <> '' THEN {_string(name)} END"


def _term(value: str) -> str:
    return f"translate(lower({value}), '- ', '__')"


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


def _sql(policy: str) -> str:
    """CTE ``issues``."""
    blank = lambda x: f"({_type(x)} = 'VARCHAR' AND {_string(x)} = '')"
    path = lambda x: f"({_type(x)} = 'VARCHAR' AND {_string(x)} <> '')"
    own = "json_exists(j, '$.cohort')"
    either = lambda f: f"CASE WHEN {own} THEN {f('cohort')} ELSE {f('cohort_role')} END"
    fluorescent = f"lower({_text('modality')}) IN ('comet', 'cosmx')"
    listed = "j -> '$.channel_names'"
    bad_names = f"({_type('channel_names')} IS NOT NULL AND ({_type('channel_names')} <> 'ARRAY' OR json_array_length({listed}) = 0))"
    names = f"list_transform(json_extract_string(j, '$.channel_names[*]'), lambda x: lower(trim(x)))"
    pair = "CAST(json_extract_string(j, '$.pixel_size_um[*]') AS DOUBLE[])"
    pixel = f"CASE json_type(j, '$.pixel_size_um') WHEN 'ARRAY' THEN len({pair}) = 2 AND list_min({pair}) > 0 WHEN 'NULL' THEN false ELSE json_type(j, '$.pixel_size_um') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST({_string('pixel_size_um')} AS DOUBLE) > 0 END"
    digest = lambda x: f"coalesce({_type(x)} = 'VARCHAR' AND regexp_full_match(lower({_string(x)}), '(sha256:)?[0-9a-f]{{64}}'), false)"
    m = manifests
    rules = [
        *[("missing_required_field", "error", x, f"{_type(x)} IS NULL OR {blank(x)}") for x in m.REQUIRED],
        ("invalid_sample_id", "error", "sample_id", f"json_exists(j, '$.sample_id') AND {_text('sample_id')} IS NULL"),
        *[("invalid_group_id", "error", x, f"{_type(x)} IS NOT NULL AND {_text(x)} IS NULL") for x in m.GROUPS],
        ("missing_group_id", "error", "/".join(m.GROUPS), f"coalesce({', '.join(map(_text, m.GROUPS))}) IS NULL"),
        ("invalid_split", "error", "split", f"{_type('split')} IS NOT NULL AND {_text('split')} IS NULL AND NOT {blank('split')}"),
        ("uncontrolled_split", policy, "split", f"{_term(_text('split'))} NOT IN {_listed(m.SPLITS)}"),
        ("invalid_cohort", "error", "cohort", f"({either(_type)}) IS NOT NULL AND ({either(_text)}) IS NULL AND NOT ({either(blank)})"),
        ("missing_cohort", policy, "cohort", f"({either(_type)}) IS NULL OR ({either(blank)})"),
        ("uncontrolled_cohort", policy, "cohort", f"{_term(either(_text))} NOT IN {_listed(m.COHORTS)}"),
        ("unsupported_modality", "error", "modality", f"lower({_text('modality')}) NOT IN ('h&e', 'comet', 'cosmx')"),
        *[("invalid_path_field", "error", x, f"{_type(x)} IS NOT NULL AND NOT {path(x)}") for x in m.PATHS],
        ("invalid_channel_names", "error", "channel_names", bad_names),
        ("duplicate_channel_name", "error", "channel_names", f"NOT {bad_names} AND len(list_distinct({names})) < len({names})"),
        ("missing_fluorescence_channel_names", policy, "channel_names", f"{fluorescent} AND ({_type('channel_names')} IS NULL OR {bad_names})"),
        ("invalid_channel_axis", "error", "channel_axis", f"{_type('channel_axis')} NOT IN ('UBIGINT', 'BIGINT')"),
        ("missing_pixel_size", policy, "pixel_size_um", "NOT json_exists(j, '$.pixel_size_um')"),
        ("invalid_pixel_size", "error", "pixel_size_um", f"json_exists(j, '$.pixel_size_um') AND NOT ({pixel})"),
        ("invalid_color_order", "error", "color_order", "json_type(j, '$.color_order') <> 'VARCHAR'"),
        ("missing_valid_region", policy, "valid_mask_path/ignore_mask_path", f"NOT (coalesce({path('valid_mask_path')}, false) OR coalesce({path('ignore_mask_path')}, false))"),
        ("invalid_source_id", "error", "source_id", f"{_type('source_id')} IS NOT NULL AND {_text('source_id')} IS NULL"),
        *[("missing_checksum", policy, m.checksum_of(x), f"{path(x)} AND {_type(m.checksum_of(x))} IS NULL") for x in m.PATHS],
        *[("invalid_checksum", "error", m.checksum_of(x), f"{path(x)} AND {_type(m.checksum_of(x))} IS NOT NULL AND NOT {digest(m.checksum_of(x))}") for x in m.PATHS],
    ]
    single = " UNION ALL ".join(f"SELECT line, '{c}' AS code, '{s}' AS severity, '{f}' AS field FROM r WHERE {b}" for c, s, f, b in rules)
    fields = ("sample_id", *m.SHARED)
    code = "CASE field WHEN 'sample_id' THEN 'duplicate_sample_id' " + " ".join(f"WHEN '{x}' THEN '{c}'" for x, c in m.SHARED.items()) + " END"
    return f"""l AS (SELECT {_K} AS line, {LINE} AS text FROM orders), v AS (SELECT line, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM l),
        r AS MATERIALIZED (SELECT * FROM v WHERE json_type(j) = 'OBJECT'), single AS MATERIALIZED ({single}),
        good AS (SELECT * FROM r WHERE line NOT IN (SELECT line FROM single WHERE severity = 'error')),
        held AS ({" UNION ALL ".join(f"SELECT line, {_term(_text('split'))} AS split, '{x}' AS field, {_text(x)} AS value FROM good" for x in fields)}),
        w AS (SELECT *, min_by(split, line) OVER s AS first_split, min(line) OVER s AS first_line FROM held WHERE value IS NOT NULL WINDOW s AS (PARTITION BY field, value)),
        issues AS (
            SELECT line, CASE WHEN j IS NULL THEN 'json_decode_error' ELSE 'record_not_object' END AS code, 'error' AS severity, NULL AS field FROM v WHERE j IS NULL OR json_type(j) <> 'OBJECT'
            UNION ALL SELECT * FROM single
            UNION ALL SELECT line, {code} AS code, 'error' AS severity, field FROM w WHERE line <> first_line AND (field = 'sample_id' OR split <> first_split))"""


SQL = {
    "manifest_audit": f"WITH {_sql('warning')} SELECT * FROM issues",
    "manifest_strict": f"WITH {_sql('error')} SELECT code, severity, field, count(*) AS n FROM issues GROUP BY ALL",
}
