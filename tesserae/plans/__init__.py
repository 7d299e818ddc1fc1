"""Registered queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from . import contract, contract_text, fields, image, manifest, quality, structure

_PARTS = (quality, structure, image, fields, contract, contract_text, manifest)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
