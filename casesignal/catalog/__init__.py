"""Registered queries over the test tables, each with its SQL twin if any."""

from casesignal.catalog import (  # noqa: F401
    aggregates,
    evaluation,
    features,
    ingest,
    modeling,
    naming,
    preparation,
    ranking,
    safety,
    scalar,
)
from casesignal.catalog.registry import oracle_sql, queries  # noqa: F401
