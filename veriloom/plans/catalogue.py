"""Named queries over the test tables, with the SQL that gives the same rows.

The tables hold no statutes, so each operator runs on the nearest one: documents are texts, sources economies, benchmark items
indicators, labels review decisions, events logs, and the order tables mappings (nation as economy, brand as indicator).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, folder) under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from veriloom.plans import events, evidence, funnel, provisions, publishing, reports, retrieval, spans, texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The composite shortlist: cosine, lexical and phrase tiers, joined and ranked."""
    _load()
    return QUERIES["shortlist_composite"](spark, folder)
