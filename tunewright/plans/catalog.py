"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunewright.plans import corpus, duplicates, generating, library, melodies, model, preparing, sources, texts, timelines

PARTS = (corpus, melodies, duplicates, model, timelines, sources, texts, generating, library, preparing)
FLAGSHIP = "nearest_reference"

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in PARTS:
        out |= part.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in PARTS:
        out |= part.oracle_sql()
    return out
