"""All queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.panel import one_pass

from . import book, extras, factors, portfolios, research, studies


def _entries() -> dict[str, tuple]:
    return factors.entries() | research.entries() | portfolios.entries() | book.entries() | extras.entries() | studies.entries()


def queries() -> dict:
    return {name: one_pass(q) for name, (q, _) in _entries().items()}


def oracles() -> dict:
    return {name: sql for name, (_, sql) in _entries().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rank_ic_summary"](spark, sf_dir)
