"""Registered queries over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.plans import analytics, extraction, facts, spans, text, vectors
from kairograph.plans.facts import flagship

MODULES = (facts, analytics, spans, vectors, text, extraction)


def _dates_as_text(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Dates leave a registered query as ISO text, the same in every client."""

    def run(spark, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {k: _dates_as_text(v) for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DATES lists the date columns of a module's results, by query."""
    out = {}
    for m in MODULES:
        for k, sql in m.SQL.items():
            dates = getattr(m, "DATES", {}).get(k)
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates or ())
            out[k] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if dates else sql
    return out
