"""Model spend: A05, A06, W04 and the priced usage table they start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackquarry.functions.money import (
    DEFAULT_LIMIT_MICRO,
    MICRO,
    cost_micro,
    estimate_micro,
    with_prices,
)
from stackquarry.operators.ordered import running_total

# ---- fixed values -----------------------------------------------------------
WARN_PERCENT = 80
EXCEEDED_BELOW_MICRO = 10_000
# -----------------------------------------------------------------------------


def priced_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with day, cost_micro and est_micro; prices are joined, not kept."""
    priced = with_prices(usage, prices)
    return priced.select(
        "user_id",
        "req_id",
        "ts",
        F.to_date("ts").alias("day"),
        "model_id",
        "input_tokens",
        "output_tokens",
        cost_micro(F.col("input_tokens"), F.col("output_tokens")).alias("cost_micro"),
        estimate_micro(F.col("input_tokens")).alias("est_micro"),
    )


def daily_usage(priced: DataFrame) -> DataFrame:
    """Cost, requests and tokens per user and day. Whole numbers, so partial sums
    on the map side give the same result in any order."""
    return priced.groupBy("user_id", "day").agg(
        F.sum("cost_micro").alias("cost_micro"),
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )


def usage_report(daily: DataFrame, limit_micro: str | None = None) -> DataFrame:
    """Budget figures per row; ``limit_micro`` names a limit column, 0 or NULL
    there means the default of 5 USD."""
    limit = F.lit(DEFAULT_LIMIT_MICRO).cast("bigint")
    if limit_micro:
        limit = F.coalesce(F.nullif(F.col(limit_micro), F.lit(0)), limit)
    report = daily.withColumn("limit_micro", limit)
    remaining = F.col("limit_micro") - F.col("cost_micro")
    percent = F.col("cost_micro").cast("double") / F.col("limit_micro").cast("double") * F.lit(100.0)
    average = F.col("cost_micro").cast("double") / F.lit(float(MICRO)) / F.col("requests")
    return report.withColumns(
        {
            "remaining_micro": remaining,
            "percent_used": percent,
            "avg_cost": F.when(F.col("requests") > 0, average),
            "warn": percent > WARN_PERCENT,
            "exceeded": remaining < EXCEEDED_BELOW_MICRO,
        }
    )


def running_spend(priced: DataFrame, chunks: int | None = None) -> DataFrame:
    """Spend of the day so far, after each request."""
    rows = priced.select("user_id", "day", "ts", "req_id", "cost_micro")
    return running_total(rows, ["user_id", "day"], ["ts", "req_id"], "cost_micro", "spent_micro", chunks)
