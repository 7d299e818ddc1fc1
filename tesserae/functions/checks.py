"""Predicates on single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_digest(value: Column, digits: int = 64) -> Column:
    """Lower-case hexadecimal of so many digits, not all zero."""
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{digits}}}$") & ~value.rlike("^0+$"), F.lit(False))


def is_safe_path(value: Column) -> Column:
    """Relative, and never leaves its folder."""
    return F.coalesce((value != "") & ~value.startswith("/") & ~value.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def is_present(value: Column) -> Column:
    """Not null and not blank text."""
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def in_domain(values: Column, *domain: int) -> Column:
    """Whether all elements of an array are in the domain."""
    return F.forall(values, lambda x: x.isin(*domain))


def is_fraction(value: Column) -> Column:
    """Null, or finite and between 0 and 1."""
    return value.isNull() | (~F.isnan(value) & value.between(0.0, 1.0))


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(value) | F.abs(value).eqNullSafe(float("inf")), None).otherwise(value)


def spacing(values: Column) -> Column:
    """A struct of y and x from one or two finite positive numbers; null otherwise."""
    good = F.size(values).between(1, 2) & F.forall(values, lambda x: x.isNotNull() & (x > 0) & (x < float("inf")))
    return F.when(good, F.struct(values[0].alias("y"), F.element_at(values, -1).alias("x")))


def truth(path: str, json: Column) -> Column:
    """A JSON member that is literally true; absence is not approval."""
    return F.coalesce(F.get_json_object(json, path) == "true", F.lit(False))


def canonical_json(members: dict[str, Column]) -> Column:
    """Compact JSON text with the members in the order of their names; nulls are written, strings escaped."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"})


def canonical_sha(members: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(members), 256)
