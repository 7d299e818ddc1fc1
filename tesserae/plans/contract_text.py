"""Whole contracts in JSON, made from customers, with what breaks each rule now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract_documents as documents
from .views import table

_K = "c_custkey"
_GOOD = "'{\"status\": \"approved\", \"reference\": \"r\", \"evidence_sha256\": \"' || repeat('0A', 32) || '\"}'"
_VARIANT = '{"id": "%s", "channel_selection": "semantic_role", "semantic_channels": ["nuclear"]}'


def _case(*cases: tuple[str, str], otherwise: str) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END)"


def _every(n: int, text: str) -> tuple[str, str]:
    return f"{_K} % {n} = 0", f"'{text}'"


def _regime(name: str) -> str:
    return f'{{"id": "{name}", "required_cohorts": [{", ".join(chr(34) + x + chr(34) for x in documents.REGIMES[name])}]}}'


_ONTOLOGY = _case(_every(7, "null"), _every(11, '{"version": [], "crack_definition": " ", "stakeholder_approved": "true"}'), otherwise=f"'{{\"version\": 2, \"crack_definition\": \"c\", \"approval_reference\": \"r\", \"stakeholder_approved\": true}}'")
_GOVERNANCE = _case(
    _every(13, "[]"),
    otherwise=f"'{{\"data_use\": ' || {_GOOD} || ', \"privacy\": ' || "
    + _case(_every(3, "5"), _every(5, '{"status": "pending", "reference": "", "evidence_sha256": "x"}'), otherwise=_GOOD)
    + f" || ', \"method_assets\": ' || {_GOOD} || "
    + _case(_every(17, ""), otherwise=f"', \"scientific_owner\": ' || {_GOOD}")
    + " || '}'",
)
_MODALITIES = _case(
    _every(19, '{"he": {"input_variants": []}, "xray": {}}'),
    _every(2, f'{{"he": {{"input_variants": [{_VARIANT % "a"}]}}, "comet": {{"input_variants": [{_VARIANT % "b"}, {_VARIANT % "b"}, 5, {{"id": " "}}]}}, "cosmx": {{"input_variants": [{{"id": "c", "channel_selection": "index", "semantic_channels": ["x", 1], "channel_indices": [0]}}]}}}}'),
    otherwise="'[" + ", ".join(f'{{"id": "{m}", "input_variants": [{_VARIANT % m}]}}' for m in documents.MODALITIES) + ", 3]'",
)
_REGIMES = _case(
    _every(23, "\"none\""),
    _every(4, '{"calibrated": {"required_cohorts": ["test"]}, "lora": {"required_cohorts": ["fit", "test", "calibration", "fit"]}, "native_zero_shot": {}}'),
    otherwise="'[" + ", ".join(map(_regime, documents.REGIMES)) + "]'",
)
_REPORTING = _case(
    _every(29, "{}"), _every(31, "true"),
    otherwise="'{\"stratify_by\": [" + ", ".join(f'"{x}"' for x in documents.STRATA) + "], " + ", ".join(f'"{x}": true' for x in documents.REPORTING) + f', "confidence_intervals": "{documents.INTERVALS}"}}\'',
)
#: A contract, in the SQL of both engines.
DOCUMENT = _case(
    _every(101, "{broken"), _every(103, "[1]"),
    otherwise=f"'{{\"ontology\": ' || {_ONTOLOGY} || ', \"governance_approvals\": ' || {_GOVERNANCE} || ', \"modalities\": ' || {_MODALITIES} || ', \"regimes\": ' || {_REGIMES} || ', \"reporting\": ' || {_REPORTING} || '}}'",
)


def contract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the contracts, by code and place: how many, and the first contract."""
    found = documents.audit(table(spark, sf_dir, "customer").select(F.col(_K).alias("contract"), F.expr(DOCUMENT).alias("document")))
    return found.groupBy("code", "severity", "field").agg(F.count("*").alias("n"), F.min("contract").alias("first"))


QUERIES = {f.__name__: f for f in (contract_documents,)}


def _type(path: str) -> str:
    return f"nullif(json_type(j, '{path}'), 'NULL')"


def _is(path: str, kind: str) -> str:
    return f"coalesce(json_type(j, '{path}') = '{kind}', false)"


def _text(path: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN json_extract_string(j, '{path}') END"


def _present(path: str) -> str:
    return f"coalesce(CASE json_type(j, '{path}') WHEN 'VARCHAR' THEN trim(json_extract_string(j, '{path}')) <> '' WHEN 'BOOLEAN' THEN json_extract_string(j, '{path}') = 'true' WHEN 'NULL' THEN false ELSE (j -> '{path}')::VARCHAR NOT IN ('{{}}', '[]') END, false)"


def _true(path: str) -> str:
    return f"({_is(path, 'BOOLEAN')} AND json_extract_string(j, '{path}') = 'true')"


def _sql() -> str:
    d, rules = documents, []
    o, g, r = ("$.ontology", "$.governance_approvals", "$.reporting")
    rules.append(("missing_ontology_contract", "error", o, f"NOT {_is(o, 'OBJECT')}"))
    rules += [("ontology_approval_incomplete", "blocker", f"{o}.{x}", f"{_is(o, 'OBJECT')} AND NOT {_present(f'{o}.{x}')}") for x in d.ONTOLOGY]
    rules.append(("ontology_not_approved", "blocker", f"{o}.stakeholder_approved", f"{_is(o, 'OBJECT')} AND NOT {_true(f'{o}.stakeholder_approved')}"))
    rules.append(("missing_governance_approvals", "blocker", g, f"NOT {_is(g, 'OBJECT')}"))
    for area in d.APPROVALS:
        p = f"{g}.{area}"
        digest = f"lower(trim({_text(f'{p}.evidence_sha256')}))"
        rules.append(("governance_approval_missing", "blocker", p, f"{_is(g, 'OBJECT')} AND NOT {_is(p, 'OBJECT')}"))
        rules.append(("governance_approval_pending", "blocker", f"{p}.status", f"{_is(p, 'OBJECT')} AND coalesce({_text(f'{p}.status')}, '') <> 'approved'"))
        rules.append(("governance_evidence_unverified", "blocker", p, f"{_is(p, 'OBJECT')} AND NOT ({_present(f'{p}.reference')} AND coalesce(regexp_full_match({digest}, '[0-9a-f]{{64}}') AND {digest} <> repeat('0', 64), false))"))
    rules.append(("missing_reporting_contract", "error", r, f"NOT {_is(r, 'OBJECT')}"))
    strata = ", ".join(f"'{x}'" for x in d.STRATA)
    rules.append(("incomplete_reporting_strata", "error", f"{r}.stratify_by", f"{_is(r, 'OBJECT')} AND NOT list_has_all(coalesce(json_extract_string(j, '{r}.stratify_by[*]'), []), [{strata}])"))
    rules += [("unsafe_reporting_policy", "error", f"{r}.{x}", f"{_is(r, 'OBJECT')} AND NOT {_true(f'{r}.{x}')}") for x in d.REPORTING]
    rules.append(("invalid_confidence_interval_contract", "error", f"{r}.confidence_intervals", f"{_is(r, 'OBJECT')} AND coalesce({_text(f'{r}.confidence_intervals')}, '') <> '{d.INTERVALS}'"))
    single = " UNION ALL ".join(f"SELECT contract, '{c}' AS code, '{s}' AS severity, '{f}' AS field FROM d WHERE {b}" for c, s, f, b in rules)

    def listed(section: str) -> str:
        """Members of a section as (contract, id, v), the first of an id."""
        p = f"$.{section}"
        return f"""(SELECT contract, id, min_by(v, place) AS v FROM (
            SELECT contract, k AS id, json_extract(j, '{p}.' || k) AS v, 0 AS place FROM (SELECT contract, j, unnest(json_keys(j, '{p}')) AS k FROM d WHERE json_type(j, '{p}') = 'OBJECT')
            UNION ALL SELECT contract, CASE WHEN json_type(v, '$.id') = 'VARCHAR' THEN json_extract_string(v, '$.id') END, v, place FROM (SELECT contract, unnest(json_extract(j, '{p}[*]')) AS v, unnest(range(json_array_length(j, '{p}')::BIGINT)) AS place FROM d WHERE json_type(j, '{p}') = 'ARRAY'))
            WHERE json_type(v) = 'OBJECT' AND trim(id) <> '' GROUP BY ALL)"""

    regimes = ", ".join(f"('{k}', [{', '.join(repr(x) for x in v)}])" for k, v in d.REGIMES.items())
    return f"""WITH c AS (SELECT {_K} AS contract, {DOCUMENT} AS t FROM customer), p AS (SELECT contract, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM c),
        d AS MATERIALIZED (SELECT * FROM p WHERE json_type(j) = 'OBJECT'), single AS ({single}),
        m AS (SELECT * FROM {listed("modalities")}), lacks AS (SELECT contract, id FROM d, (VALUES {", ".join(f"('{x}')" for x in d.MODALITIES)}) AS t(id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.contract = d.contract AND m.id = t.id)),
        none AS (SELECT contract, id FROM m WHERE json_type(v, '$.input_variants') IS DISTINCT FROM 'ARRAY' OR json_array_length(v, '$.input_variants') = 0),
        e AS (SELECT contract, id, unnest(json_extract(v, '$.input_variants[*]')) AS j, unnest(range(json_array_length(v, '$.input_variants')::BIGINT)) AS place FROM m WHERE json_type(v, '$.input_variants') = 'ARRAY'),
        n AS (SELECT *, json_type(j) = 'OBJECT' AS held, {_text("$.id")} AS name, coalesce(json_type(j) = 'OBJECT' AND trim({_text("$.id")}) <> '', false) AS named FROM e),
        f AS (SELECT *, first_value(id || '/' || place) OVER (PARTITION BY contract, CASE WHEN named THEN name ELSE id || '?' || place END ORDER BY id, place) AS owner, '$.modalities.' || id || '.input_variants[' || place || ']' AS path FROM n),
        variants AS (
            SELECT contract, 'expected_object' AS code, path AS field FROM f WHERE NOT held
            UNION ALL SELECT contract, 'missing_id', path FROM f WHERE held AND NOT named
            UNION ALL SELECT contract, 'duplicate_id', path FROM f WHERE named AND owner <> id || '/' || place
            UNION ALL SELECT contract, 'positional_channel_selection_forbidden', path || '.channel_selection' FROM f WHERE named AND coalesce({_text("$.channel_selection")}, '') <> 'semantic_role'
            UNION ALL SELECT contract, 'missing_semantic_channels', path || '.semantic_channels' FROM f WHERE named AND (json_type(j, '$.semantic_channels') IS DISTINCT FROM 'ARRAY' OR json_array_length(j, '$.semantic_channels') = 0
                OR len(list_filter(json_extract(j, '$.semantic_channels[*]'), lambda x: json_type(x) <> 'VARCHAR' OR trim(json_extract_string(x, '$')) = '')) > 0)
            UNION ALL SELECT contract, 'positional_channel_selection_forbidden', path || '.channel_indices' FROM f WHERE named AND json_exists(j, '$.channel_indices')),
        r AS (SELECT * FROM {listed("regimes")}), asked AS (SELECT contract, t.id, t.cohorts, r.v FROM d CROSS JOIN (VALUES {regimes}) AS t(id, cohorts) LEFT JOIN r USING (contract, id)),
        issues AS (
            SELECT contract, 'contract_not_an_object' AS code, 'error' AS severity, '$' AS field FROM p WHERE json_type(j) IS DISTINCT FROM 'OBJECT'
            UNION ALL SELECT * FROM single UNION ALL SELECT contract, 'missing_required_modality', 'error', '$.modalities.' || id FROM lacks UNION ALL SELECT contract, 'missing_input_variants', 'error', '$.modalities.' || id || '.input_variants' FROM none
            UNION ALL SELECT contract, code, 'error', field FROM variants
            UNION ALL SELECT contract, 'missing_required_regime', 'error', '$.regimes.' || id FROM asked WHERE v IS NULL
            UNION ALL SELECT contract, 'invalid_regime_cohorts', 'error', '$.regimes.' || id || '.required_cohorts' FROM asked
                WHERE v IS NOT NULL AND list_sort(list_distinct(coalesce(json_extract_string(v, '$.required_cohorts[*]'), []))) <> cohorts)
        SELECT code, severity, field, count(*) AS n, min(contract) AS first FROM issues GROUP BY ALL"""


SQL = {"contract_documents": _sql()}
