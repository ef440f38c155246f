"""All queries of the library, and their DuckDB statements."""

from __future__ import annotations

from . import catalogue, catalogue_engines, catalogue_more, catalogue_roads, catalogue_sources, catalogue_vector


def queries() -> dict[str, catalogue.Query]:
    return catalogue.QUERIES | catalogue_vector.QUERIES | catalogue_sources.QUERIES | catalogue_roads.QUERIES | catalogue_engines.QUERIES | catalogue_more.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalogue.ORACLE | catalogue_vector.ORACLE | catalogue_sources.ORACLE | catalogue_engines.ORACLE | catalogue_more.ORACLE
