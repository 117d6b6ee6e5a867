"""Filed series: fields by period, their nodes, and the identities that tie periods together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_form(wide: DataFrame, fields: list[str], model: str = "model", period: str = "period", index: str = "period_idx") -> DataFrame:
    """(model, field, period_idx, period, value) of filled cells: an empty one is no row."""
    return wide.unpivot([model, index, period], fields, "field", "value").where("value is not null").select(F.col(model).alias("model"), "field", F.col(index).alias("period_idx"), F.col(period).alias("period"), "value")


def balance_breaks(series: DataFrame, left: str, right: list[str], tolerance: float = 0.01) -> DataFrame:
    """(model, period_idx, lhs, rhs) where left differs from the sum of right; only where all are there."""
    p = series.groupBy("model", "period_idx").pivot("field", [left, *right]).agg(F.first("value"))
    total = sum((F.col(f"`{r}`") for r in right[1:]), F.col(f"`{right[0]}`"))
    return p.select("model", "period_idx", F.col(f"`{left}`").alias("lhs"), total.alias("rhs")).where(F.abs(F.col("lhs") - F.col("rhs")) > tolerance)


def rollforward_breaks(series: DataFrame, stock: str, flows: dict[str, float], tolerance: float = 0.01) -> DataFrame:
    """(model, period_idx, lhs, rhs) where the stock is not the one before plus signed flows; the first period is not judged."""
    p = series.groupBy("model", "period_idx").pivot("field", [stock, *flows]).agg(F.first("value"))
    before = F.lag(f"`{stock}`").over(Window.partitionBy("model").orderBy("period_idx"))
    change = sum((F.col(f"`{k}`") * s for k, s in flows.items()), F.lit(0.0))
    p = p.select("model", "period_idx", F.col(f"`{stock}`").alias("lhs"), (before + change).alias("rhs"))
    return p.where(F.abs(F.col("lhs") - F.col("rhs")) > tolerance)
