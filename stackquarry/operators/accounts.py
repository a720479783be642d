"""Account quotas, stack outputs, retention: P12-P16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry import wording
from stackquarry.functions.text import label_of_kind

# ---- fixed values -----------------------------------------------------------
RETENTION_DAYS = 30
GPU_REQUEST_VCPUS = 4
STANDARD_REQUEST_VCPUS = 8
# -----------------------------------------------------------------------------


def classify_quota(quotas: DataFrame) -> DataFrame:
    """Status and message per quota row; a NULL value could not be checked."""
    name = F.coalesce(label_of_kind(F.col("quota_code"), wording.QUOTA_NAMES), F.col("quota_code"))
    return quotas.withColumns(
        {
            "quota_name": name,
            "status": F.when(F.col("value").isNull(), F.lit("could not check"))
            .when(F.col("value") == 0, F.lit("BLOCKED"))
            .otherwise(F.lit("OK")),
        }
    )


def pending_quota_requests(requests: DataFrame) -> DataFrame:
    """P13."""
    return requests.filter(F.col("status") == "PENDING").select(
        "quota_name", "desired_value", "status", "created"
    )


def quota_recommendation(quotas: DataFrame) -> DataFrame:
    """Per account what to request or deploy. A quota that could not be read
    counts as zero, like the fallback of the check itself."""

    def quota(code: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("quota_code") == code, F.col("value"))), F.lit(0.0))

    per_account = quotas.groupBy("account").agg(
        quota(wording.GPU_QUOTA).alias("gpu"), quota(wording.STANDARD_QUOTA).alias("standard")
    )
    gpu_open, standard_open = F.col("gpu") != 0, F.col("standard") != 0
    return per_account.select(
        "account",
        F.when(gpu_open, F.lit("deploy g4dn.xlarge"))
        .otherwise(F.lit(f"request {wording.GPU_QUOTA} to {GPU_REQUEST_VCPUS} vCPU"))
        .alias("gpu_advice"),
        F.when(standard_open, F.lit("deploy t3.medium"))
        .otherwise(F.lit(f"request {wording.STANDARD_QUOTA} to {STANDARD_REQUEST_VCPUS} vCPU"))
        .alias("standard_advice"),
        F.when(gpu_open, F.lit("gpu instance"))
        .when(standard_open, F.lit("cpu instance, managed model or wait"))
        .otherwise(F.lit("managed model or request quota"))
        .alias("options"),
    )


def stack_output_values(stacks: DataFrame, keys: list[str] = wording.STACK_OUTPUT_KEYS) -> DataFrame:
    """The first value of each wanted key, read inside the row: no explode, no pivot."""

    def value(key: str) -> Column:
        hits = F.filter("outputs", lambda o: o["OutputKey"] == key)
        return F.get(hits, F.lit(0))["OutputValue"].alias(key)

    return stacks.select("stack", *[value(k) for k in keys])


def retention_filter(artefacts: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Artefacts not older than 30 days at ``as_of``. The bound is on the bare
    column, so it reaches the parquet scan."""
    return artefacts.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(RETENTION_DAYS)))
