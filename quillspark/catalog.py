"""All queries of the library outside ``llm``, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import advice, derived, kept, layout, records, retrieval, search, services, sheets, store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return search.QUERIES | store.QUERIES | sheets.QUERIES | advice.BOOK.queries | kept.BOOK.queries | layout.BOOK.queries | records.BOOK.queries | retrieval.BOOK.queries | services.BOOK.queries | derived.BOOK.queries


def oracle_sql() -> dict[str, str]:
    return search.ORACLES | store.ORACLES | sheets.ORACLES | advice.BOOK.sql | kept.BOOK.sql | layout.BOOK.sql | records.BOOK.sql | retrieval.BOOK.sql | services.BOOK.sql | derived.BOOK.sql
