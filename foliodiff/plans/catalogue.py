"""Registered queries of the report-comparison engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliodiff.plans import canonical_queries, compare_queries, element_queries, layout_queries, naming_queries, report_queries, run_queries, text_queries

_ALL = {**text_queries.QUERIES, **naming_queries.QUERIES, **compare_queries.QUERIES, **canonical_queries.QUERIES, **layout_queries.QUERIES, **report_queries.QUERIES, **run_queries.QUERIES, **element_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From named values of two versions to issues per account, package and report, rules applied."""
    return compare_queries.issue_rollup(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
