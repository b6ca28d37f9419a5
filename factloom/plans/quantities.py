"""Queries on quantities in common units (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import units
from factloom.plans.registry import query
from factloom.sources.tables import checkpoint, table


@query()
def p2_values(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "slot_values"), table(spark, d, "currency_rates"))


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.near_pairs(checkpoint(p2_values(spark, d)))
