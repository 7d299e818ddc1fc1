"""Rule engines: many predicates over records to one row for each issue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``breached`` is true where a record breaks the rule."""

    code: str
    severity: str
    field: str
    breached: Column


def issues(records: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``key, code, severity, field`` of each broken rule, all rules in one pass."""
    found = [F.when(F.coalesce(r.breached, F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"))) for r in rules]
    rows = records.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("issue"))
    return rows.select(key, "issue.code", "issue.severity", "issue.field")


def status(found: DataFrame) -> DataFrame:
    """``errors, blockers, warnings, status``, of one row; errors come before blockers before warnings."""
    count = lambda x: F.count_if(F.col("severity") == x)
    word = F.when(count("error") > 0, "INVALID").when(count("blocker") > 0, "BLOCKED").when(count("warning") > 0, "READY_WITH_WARNINGS").otherwise("READY")
    return found.agg(count("error").alias("errors"), count("blocker").alias("blockers"), count("warning").alias("warnings"), word.alias("status"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values, without regard to case, that more than one row of a key has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.lower(F.col(k).cast("string")).alias("value")) for k in keys]))
    found = rows.select(pairs.alias("x")).where("x.value is not null").groupBy("x.family", "x.value").agg(F.count("*").alias("n"))
    return found.where("n > 1")
