"""Registry of named queries: a Spark builder plus, where SQL can express the
operator, the equivalent DuckDB SQL over the driver tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.fixtures import view_ctes

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "run_pipeline"


def compose_sql(body: str) -> str:
    """Prefix the fixture views; a body starting with WITH continues the list."""
    text = body.strip()
    if text[:4].upper() == "WITH":
        return view_ctes().rstrip() + ",\n" + text[4:].lstrip()
    return view_ctes() + text


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose_sql(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    from tidemark.plans import q_core, q_curation, q_dedupe, q_extract, q_history, q_io, q_layouts, q_listings, q_pages, q_quality, q_query, q_run  # noqa: F401
