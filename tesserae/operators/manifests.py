"""Manifests of samples, one JSON record a line, as VARIANT: every line is a record or an issue, and members that no rule
knows are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..storage import keep
from .audits import Rule, issues

# Fixed values of the manifest format.
REQUIRED = ("sample_id", "modality", "image_path", "split")
GROUPS = ("patient_id", "block_id", "slide_id", "run_id")
PATHS = ("image_path", "fold_mask_path", "crack_mask_path", "tissue_mask_path", "valid_mask_path", "ignore_mask_path", "fold_instance_mask_path", "crack_instance_mask_path")
SPLITS = ("development", "train", "validation", "test", "locked_test")
COHORTS = ("development", "prevalence", "enriched_challenge", "external_generalization", "missing_degraded_input", "downstream_impact")
#: A rule of policy: a warning, or an error in strict mode.
POLICY = "policy"
NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
SCALARS = ("STRING", *NUMBERS)


def kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def spread(source: str, paths: dict[str, str], values: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    """Adds, for each name and path, ``kind_<name>`` (null where the member is missing, VOID where it is null) and
    ``text_<name>`` of strings and numbers; and ``value_<name>`` of ``values``.

    A record has many rules that ask for the same members: each is looked up once, and not once for each mention.
    """

    def add(rows: DataFrame) -> DataFrame:
        found = rows.withColumns({f"value_{x}": F.try_variant_get(source, path, "variant") for x, path in paths.items()})
        found = found.withColumns({f"kind_{x}": kind(F.col(f"value_{x}")) for x in paths})
        said = {f"text_{x}": F.when(F.col(f"kind_{x}").isin(*SCALARS), F.try_variant_get(f"value_{x}", "$", "string")) for x in paths}
        return found.withColumns(said).drop(*[f"value_{x}" for x in paths if x not in values])

    return add


def held(name: str) -> Column:
    """Whether the record has the member, and it is not null."""
    return F.coalesce(F.col(f"kind_{name}") != "VOID", F.lit(False))


def is_kind(name: str, *kinds: str) -> Column:
    return F.coalesce(F.col(f"kind_{name}").isin(*kinds), F.lit(False))


def text(name: str) -> Column:
    """A member as trimmed text, if it is a string or number that is not blank."""
    found = F.trim(f"text_{name}")
    return F.when(found != "", found)


def _blank(name: str) -> Column:
    return is_kind(name, "STRING") & (F.trim(f"text_{name}") == "")


def checksum_of(path: str) -> str:
    return f"{path.removesuffix('_path')}_sha256"


def _rules() -> list[Rule]:
    """Of single records, each over ``record`` alone."""
    is_string = lambda name: is_kind(name, "STRING") & ~_blank(name)
    missing = lambda name: ~held(name) | _blank(name)
    # a record that has the member, null or not, does not fall back
    has_cohort = F.col("kind_cohort").isNotNull()
    own = lambda f: F.when(has_cohort, f("cohort")).otherwise(f("cohort_role"))
    cohort, raw_cohort, blank_cohort = own(text), own(held), own(_blank)
    names = F.try_variant_get("value_channel_names", "$", "array<variant>")
    bad_name = lambda x: F.coalesce((kind(x) != "STRING") | (F.trim(F.try_variant_get(x, "$", "string")) == ""), F.lit(True))
    bad_names = held("channel_names") & (~is_kind("channel_names", "ARRAY") | (F.size(names) == 0) | F.exists(names, bad_name))
    lowered = F.transform(names, lambda x: F.lower(F.trim(F.try_variant_get(x, "$", "string"))))
    modality = schema.modality(text("modality"))
    number = lambda x: F.try_variant_get(x, "$", "double")
    positive = lambda x: F.coalesce((number(x) > 0) & (number(x) < float("inf")), F.lit(False))
    pixel, pair = F.col("value_pixel_size_um"), F.try_variant_get("value_pixel_size_um", "$", "array<variant>")
    good_pixel = F.when(is_kind("pixel_size_um", *NUMBERS), positive(pixel)).when(is_kind("pixel_size_um", "ARRAY"), (F.size(pair) == 2) & F.forall(pair, positive)).otherwise(F.lit(False))
    has_pixel, has_color = F.col("kind_pixel_size_um").isNotNull(), F.col("kind_color_order").isNotNull()
    return [
        *[Rule("missing_required_field", "error", x, missing(x)) for x in REQUIRED],
        Rule("invalid_sample_id", "error", "sample_id", F.col("kind_sample_id").isNotNull() & text("sample_id").isNull()),
        *[Rule("invalid_group_id", "error", x, held(x) & text(x).isNull()) for x in GROUPS],
        Rule("missing_group_id", "error", "/".join(GROUPS), F.coalesce(*map(text, GROUPS)).isNull()),
        Rule("invalid_split", "error", "split", held("split") & text("split").isNull() & ~_blank("split")),
        Rule("uncontrolled_split", POLICY, "split", ~schema.normal_term(text("split")).isin(*SPLITS)),
        Rule("invalid_cohort", "error", "cohort", raw_cohort & cohort.isNull() & ~blank_cohort),
        Rule("missing_cohort", POLICY, "cohort", cohort.isNull() & (~raw_cohort | blank_cohort)),
        Rule("uncontrolled_cohort", POLICY, "cohort", ~schema.normal_term(cohort).isin(*COHORTS)),
        Rule("unsupported_modality", "error", "modality", held("modality") & modality.isNull()),
        *[Rule("invalid_path_field", "error", x, held(x) & ~is_string(x)) for x in PATHS],
        Rule("invalid_channel_names", "error", "channel_names", bad_names),
        Rule("duplicate_channel_name", "error", "channel_names", ~bad_names & (F.size(F.array_distinct(lowered)) < F.size(lowered))),
        Rule("missing_fluorescence_channel_names", POLICY, "channel_names", modality.isin("comet", "cosmx") & (~held("channel_names") | bad_names)),
        Rule("invalid_channel_axis", "error", "channel_axis", held("channel_axis") & ~is_kind("channel_axis", "BIGINT")),
        Rule("missing_pixel_size", POLICY, "pixel_size_um", ~has_pixel),
        Rule("invalid_pixel_size", "error", "pixel_size_um", has_pixel & ~good_pixel),
        Rule("invalid_color_order", "error", "color_order", has_color & ~is_kind("color_order", "STRING")),
        Rule("missing_valid_region", POLICY, "valid_mask_path/ignore_mask_path", ~(is_string("valid_mask_path") | is_string("ignore_mask_path"))),
        Rule("invalid_source_id", "error", "source_id", held("source_id") & text("source_id").isNull()),
        *[Rule("missing_checksum", POLICY, checksum_of(x), is_string(x) & ~held(checksum_of(x))) for x in PATHS],
        *[Rule("invalid_checksum", "error", checksum_of(x), is_string(x) & held(checksum_of(x)) & ~_digest(checksum_of(x))) for x in PATHS],
    ]


def _digest(name: str) -> Column:
    value = F.lower(F.trim(f"text_{name}"))
    return F.coalesce(is_kind(name, "STRING") & value.rlike("^(sha256:)?[0-9a-f]{64}$"), F.lit(False))


#: Members that records of two splits may not share, and the issue; the sample's id may not occur twice at all.
SHARED = {x: f"{x.removesuffix('_id')}_split_leakage" for x in GROUPS} | {"source_id": "source_split_leakage", "image_path": "source_path_split_leakage", "image_sha256": "file_checksum_split_leakage"}

#: Members that the rules ask for.
MEMBERS = tuple(dict.fromkeys((*REQUIRED, *GROUPS, *PATHS, *map(checksum_of, PATHS), *SHARED, "cohort", "cohort_role", "channel_names", "channel_axis", "pixel_size_um", "color_order")))


def read(lines: DataFrame) -> DataFrame:
    """``line, record, state``: ``record`` is the line's VARIANT; ``state`` is null, or the issue of a line that is no record.
    Blank lines are passed over. ``lines``: ``line`` (its number), ``text``, and perhaps an ``issue`` in its place."""
    found = F.try_parse_json("text")
    state = F.when(found.isNull(), "json_decode_error").when(kind(found) != "OBJECT", "record_not_object")
    if "issue" not in lines.columns:
        return lines.where(F.trim("text") != "").select("line", found.alias("record"), state.alias("state"))
    return lines.where((F.trim("text") != "") | F.col("issue").isNotNull()).select("line", found.alias("record"), F.coalesce("issue", state).alias("state"))


def audit(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``line, code, severity, field``: the issues of a manifest, by line.

    A line that is no JSON, or no object, is an issue. Records without errors of their own are held against each other: the
    first with an id, or with a member of ``SHARED``, owns it; a later one with the same id, or of another split, is an
    issue. ``strict`` makes errors of the rules of policy. A manifest without records has one issue, of line 0.
    """
    policy = "error" if strict else "warning"
    paths = {x: f"$.{x}" for x in MEMBERS}
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = read(lines.repartition(tasks)).transform(spread("record", paths, ("channel_names", "pixel_size_um")))
    rows = keep(rows.drop("record"), "manifest")
    unread = rows.where("state is not null").select("line", F.col("state").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("field"))
    rules = [Rule(r.code, policy if r.severity == POLICY else r.severity, r.field, r.breached) for r in _rules()]
    single = keep(issues(rows.where("state is null"), "line", rules), "manifest-issues")
    bad = single.where("severity = 'error'").select("line").distinct()
    good = rows.where("state is null").join(bad.hint("merge"), "line", "left_anti")
    shared = [F.struct(F.lit(x).alias("field"), text(x).alias("value")) for x in ("sample_id", *SHARED)]
    values = keep(good.select("line", schema.normal_term(text("split")).alias("split"), F.explode(F.array(*shared)).alias("h")).select("line", "split", "h.*").where("value is not null"), "manifest-values")
    owner = values.groupBy("field", "value").agg(F.min(F.struct("line", "split")).alias("owner"))
    later = values.join(owner, ["field", "value"]).where("line <> owner.line AND (field = 'sample_id' OR split <> owner.split)")
    code = F.coalesce(*[F.when(F.col("field") == x, F.lit(c)) for x, c in {"sample_id": "duplicate_sample_id", **SHARED}.items()])
    shared = later.select("line", code.alias("code"), F.lit("error").alias("severity"), "field")
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("line"), F.lit("empty_manifest").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("field"))
    return unread.unionByName(single).unionByName(shared).unionByName(none)
