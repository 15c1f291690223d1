"""Totals, project summaries and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry


def _project_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def totals(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("status") == "IN", 1).otherwise(0)), F.lit(0)).alias("matched"),
    )


def _summary_columns() -> list[Column]:
    return [
        F.count("*").alias("total_listings"),
        F.countDistinct("dealer").alias("unique_dealers"),
        F.max("ts").alias("latest_timestamp"),
    ]


def project_summaries(inventory: DataFrame) -> DataFrame:
    """Listings, dealers and newest time per society and status; IN first, then by size."""
    return inventory.groupBy("society", "status").agg(*_summary_columns()).orderBy(
        (F.col("status") == "IN").desc(), F.col("total_listings").desc(), "society", "status"
    )


def curated_summaries(inventory: DataFrame, registry: Registry) -> DataFrame:
    """One row per target project in registry order, with zeros where it has no stock."""
    stock = inventory.filter("status = 'IN'").groupBy(_project_key(F.col("society")).alias("society")).agg(
        *_summary_columns()
    )
    return (
        registry.names_df(inventory.sparkSession).join(stock, "society", "left")
        .fillna(0, ["total_listings", "unique_dealers", "latest_timestamp"])
        .orderBy("ord")
        .select("ord", "society", F.lit("IN").alias("status"), "total_listings", "unique_dealers", "latest_timestamp")
    )


def out_summaries(inventory: DataFrame, registry: Registry) -> DataFrame:
    """Societies outside the registry, largest first."""
    names = registry.names_df(inventory.sparkSession).select(F.upper("society").alias("_key"))
    grouped = inventory.filter("status = 'OUT'").groupBy("society").agg(*_summary_columns())
    return (
        grouped.withColumn("society", F.trim("society"))
        .filter(F.col("society") != "")
        .withColumn("_key", _project_key(F.col("society")))
        .join(names, "_key", "left_anti")
        .select("society", F.lit("OUT").alias("status"), "total_listings", "unique_dealers", "latest_timestamp")
        .orderBy(F.col("total_listings").desc(), "society")
    )


def filter_projects(
    summaries: DataFrame, search: str | None = None, status: str = "ALL", stock: str = "ALL", trim: bool = True
) -> DataFrame:
    """Filter a summary by name, by status (ALL, IN, OUT) and by stock (ALL, ACTIVE, EMPTY)."""
    if search is not None and search.strip():
        wanted = (search.strip() if trim else search).lower()
        summaries = summaries.filter(F.lower("society").contains(wanted))
    if status != "ALL":
        is_in = F.col("status") == "IN"
        summaries = summaries.filter(is_in if status == "IN" else ~is_in)
    if stock != "ALL":
        has_stock = F.col("total_listings") > 0
        summaries = summaries.filter(has_stock if stock == "ACTIVE" else ~has_stock)
    return summaries


def filter_out_projects(summaries: DataFrame, search: str | None = None) -> DataFrame:
    """Name filter of the OUT list, where the search text is taken as typed."""
    return filter_projects(summaries, search, trim=False)


def inventory_kpis(summaries: DataFrame) -> DataFrame:
    """Listings in all, IN projects, and projects with stock."""
    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    return summaries.agg(
        F.coalesce(F.sum("total_listings"), F.lit(0)).alias("total_listings"),
        counted(F.col("status") == "IN").alias("in_projects"),
        counted(F.col("total_listings") > 0).alias("projects_with_stock"),
    )
