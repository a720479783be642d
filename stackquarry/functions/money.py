"""Tokens, prices and cost in whole micro-USD: F06-F08, F12, F13, F15.

A price of p USD per 1000 tokens is p * 1,000,000 nano-USD per token, a whole number for
every price of up to six decimals; a finer one is an error. A request's cost is summed in
nano-USD and rounded once, half up, to micro-USD, so costs are exact BIGINTs and add up the
same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
NANO_PER_MICRO = 1000
# ---- fixed values -----------------------------------------------------------
ESTIMATED_OUTPUT_TOKENS = 500
UNKNOWN_ESTIMATE_MICRO = 10_000
DEFAULT_LIMIT_MICRO = 5_000_000
DEFAULT_PRICE = ("0.25", "1.25", 9, 7)
BYTES_PER_TOKEN = 4
# -----------------------------------------------------------------------------


def token_estimate(text: Column) -> Column:
    """bytes, not characters, divided by four and rounded down."""
    return F.floor(F.octet_length(text) / F.lit(BYTES_PER_TOKEN))


def nano_per_token(usd_per_1000: Column) -> Column:
    """An error for a price that nano-USD per token cannot hold."""
    nano = usd_per_1000 * 1_000_000
    problem = F.format_string("price %s is too fine for whole nano-USD per token", usd_per_1000.cast("string"))
    return F.when(nano.isNull() | (nano == F.floor(nano)), nano.cast("bigint")).otherwise(F.raise_error(problem))


def micro(nano: Column) -> Column:
    """Nano-USD in micro-USD, rounded half up."""
    up = nano + F.lit(NANO_PER_MICRO // 2)
    return F.floor(up.cast("decimal(20,0)") / F.lit(NANO_PER_MICRO).cast("decimal(4,0)")).cast("bigint")


def with_prices(df: DataFrame, prices: DataFrame, model: str = "model_id") -> DataFrame:
    """Add the price columns of each row's model, NULL when it is unknown."""
    side = prices.select(
        F.col("model_id").alias("_price_model"), "input_cost", "output_cost", "speed", "quality"
    )
    return df.join(side, F.col(model) == F.col("_price_model"), "left").drop("_price_model")


def cost_nano(input_tokens: Column, output_tokens: Column) -> Column:
    """On rows from ``with_prices``: an unknown model costs nothing."""
    return F.coalesce(
        input_tokens * nano_per_token(F.col("input_cost"))
        + output_tokens * nano_per_token(F.col("output_cost")),
        F.lit(0).cast("bigint"),
    )


def cost_micro(input_tokens: Column, output_tokens: Column) -> Column:
    """F07 on rows from ``with_prices``."""
    return micro(cost_nano(input_tokens, output_tokens))


def estimate_micro(input_tokens: Column, hosted: Column | bool = True) -> Column:
    """F08 on rows from ``with_prices``: unknown model 0.01 USD, no hosted client 0."""
    known = input_tokens * nano_per_token(F.col("input_cost")) + nano_per_token(
        F.col("output_cost")
    ) * F.lit(ESTIMATED_OUTPUT_TOKENS)
    hosted = F.lit(hosted) if isinstance(hosted, bool) else hosted
    return F.when(
        hosted, F.coalesce(micro(known), F.lit(UNKNOWN_ESTIMATE_MICRO).cast("bigint"))
    ).otherwise(F.lit(0).cast("bigint"))


def price_or_default(df: DataFrame, prices: DataFrame, model: str = "model_id") -> DataFrame:
    """unknown models take the default price row."""
    input_cost, output_cost, speed, quality = DEFAULT_PRICE
    return with_prices(df, prices, model).withColumns(
        {
            "input_cost": F.coalesce("input_cost", F.lit(input_cost).cast("decimal(18,6)")),
            "output_cost": F.coalesce("output_cost", F.lit(output_cost).cast("decimal(18,6)")),
            "speed": F.coalesce("speed", F.lit(speed)),
            "quality": F.coalesce("quality", F.lit(quality)),
        }
    )


def date_key(ts: Column) -> Column:
    """yyyy-MM-dd."""
    return F.date_format(ts, "yyyy-MM-dd")


def batch_key(ts: Column) -> Column:
    """yyyyMMddTHHmmssZ."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
