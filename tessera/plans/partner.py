"""Merging a model with a partner's: rows by field, a full outer join, and a row policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Table

ROWS = "field_key string, section string, name string, expr string, data_type string, description string, default_aggregation string"
DETAILS = ("name", "expr", "description", "default_aggregation")


def dbt_rows(spark: SparkSession, models: list[dict]) -> DataFrame:
    """Entities and categorical dimensions -> dimensions, time dimensions, measures."""
    rows = []
    for m in models:
        for section, items in (("dimensions", m.get("entities") or []), ("dimensions", m.get("dimensions") or []), ("measures", m.get("measures") or [])):
            for d in items:
                expr, kind = str(d.get("expr") or d["name"]), "TEXT"
                at = section
                if section == "measures":
                    kind = "NUMBER"
                elif d.get("type") == "time":
                    at, kind = "time_dimensions", "DATETIME"
                rows.append((expr.upper(), at, str(d["name"]), expr, kind, str(d.get("description") or ""), str(d.get("agg") or "")))
    return spark.createDataFrame(rows, ROWS)


def model_rows(spark: SparkSession, table: Table) -> DataFrame:
    rows = [
        (c.expr.upper(), section, c.name, c.expr, c.data_type, c.description, c.default_aggregation)
        for section, cols in (("dimensions", table.dimensions), ("time_dimensions", table.time_dimensions), ("measures", [*table.measures, *table.facts]))
        for c in cols
    ]
    return spark.createDataFrame(rows, ROWS)


def merge(ours: DataFrame, partner: DataFrame, prefer: str = "ours", keep_ours: bool = True, keep_partner: bool = True) -> DataFrame:
    """(field_key, section, data_type, name, expr, description, default_aggregation, origin).

    Section and type are ours, else the partner's (type: else TEXT); of the details, the preferred side's
    non-empty ones win.
    """
    if prefer not in ("ours", "partner"):
        raise ValueError("prefer ours or partner")
    a = ours.select(*[F.col(c).alias(f"a_{c}") for c in ours.columns])
    b = partner.select(*[F.col(c).alias(f"b_{c}") for c in partner.columns])
    both = a.join(b, F.col("a_field_key") == F.col("b_field_key"), "full_outer")
    first, second = ("a", "b") if prefer == "ours" else ("b", "a")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    origin = F.when(F.col("a_field_key").isNull(), "partner").when(F.col("b_field_key").isNull(), "ours").otherwise("merged")
    out = both.select(
        F.coalesce("a_field_key", "b_field_key").alias("field_key"),
        F.coalesce("a_section", "b_section").alias("section"),
        F.coalesce(filled("a_data_type"), filled("b_data_type"), F.lit("TEXT")).alias("data_type"),
        *[F.coalesce(filled(f"{first}_{d}"), filled(f"{second}_{d}"), F.lit("")).alias(d) for d in DETAILS],
        origin.alias("origin"),
    )
    drop = ([] if keep_ours else ["ours"]) + ([] if keep_partner else ["partner"])
    return out.filter(~F.col("origin").isin(drop)) if drop else out
