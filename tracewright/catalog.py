"""The registered queries and their SQL twins, gathered from the modules of tracewright.plans."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("delegations", "diagnoses", "evidence", "findings", "measures", "reports", "sequences", "spending", "structures", "tails", "windows", "work")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"tracewright.plans.{m}"), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["session_metrics"](spark, sf_dir)
