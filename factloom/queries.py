"""The library's queries: name -> function(spark, sf_dir), with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from factloom.catalog import aggregates, dedup, evaluation, generate, joins, memory, more, nested, retrieval, text, tokenizing, windows  # noqa: F401
from factloom.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
