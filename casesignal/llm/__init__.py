"""Operators for building training corpora, and their registered queries."""

from casesignal.llm.registry import oracle_sql, queries  # noqa: F401
