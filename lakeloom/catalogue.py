"""All named queries outside the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import asked, legacy, metadata, operations, oracle, platform, scale
from lakeloom.plans.toolkit import TOOLS, opened
from lakeloom.plans.warehouse import MODELS, Warehouse


assert platform.NODES and operations.HEALTH and metadata.MODEL and scale.database and asked.ASKED  # their queries join TOOLS when they are imported


def _model(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: oracle.shaped(Warehouse(spark, sf_dir)(name), oracle.COLUMNS[name])


def _tool(name: str) -> Callable[[SparkSession, str], DataFrame]:
    plan, spec, _ = TOOLS[name]
    return lambda spark, sf_dir: oracle.shaped(opened(plan)(spark, sf_dir), spec)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: _model(name) for name in MODELS}, **{name: _tool(name) for name in TOOLS}, **legacy.queries()}


def oracle_sql() -> dict[str, str]:
    models = {name: oracle.statement(f"SELECT * FROM {name}", oracle.COLUMNS[name]) for name in MODELS}
    tools = {name: oracle.plain(sql, spec) for name, (_, spec, sql) in TOOLS.items() if sql}
    return {**models, **tools, **legacy.oracle_sql()}
