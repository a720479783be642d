"""Usage and budget as events arrive: ST01, ST02."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackquarry.operators.budget import budget_gate
from stackquarry.operators.usage import daily_usage
from stackquarry.sources.checkpoints import dropped, written
from stackquarry.streaming.state_log import StateLog

SPENT = "user_id BIGINT, day DATE, spent_micro BIGINT"
SUMS = "user_id BIGINT, day DATE, cost_micro BIGINT, requests BIGINT, tokens BIGINT"


def usage_log(spark: SparkSession, folder: str) -> StateLog:
    added = {name: F.sum(name).cast("bigint") for name in ("cost_micro", "requests", "tokens")}
    return StateLog(spark, f"{folder}/sums", ["user_id", "day"], added, SUMS)


def spend_log(spark: SparkSession, folder: str) -> StateLog:
    """Spend only grows, so the greatest figure is the last."""
    return StateLog(spark, f"{folder}/spent", ["user_id", "day"], {"spent_micro": F.max("spent_micro")}, SPENT)


def add_daily_usage(priced: DataFrame, folder: str) -> None:
    """ST01: add up usage as it arrives; run it on a schedule, it stops when caught up.

    A sum needs no order: each micro-batch adds its own sums per user and day to a log that
    merges them in levels, so nothing is ever too late, and a repeated batch replaces itself.
    ``summed_daily_usage`` reads the log.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        usage_log(batch.sparkSession, folder).append(batch_id, daily_usage(batch))

    _catch_up(priced, step, folder)


def summed_daily_usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage_log(spark, folder).merged_rows()


def run_budget_gate(requests: DataFrame, folder: str) -> None:
    """ST02: gate a stream of requests; run it on a schedule, it stops when caught up.

    Writes a decision for every request to ``folder/decisions``, and the spend of each
    (user, day) of a micro-batch after it to the log ``folder/spent``. A micro-batch goes through the batch gate with the spend so far of its own days as
    the opening, so a user who sends a third of all requests is cut into chunks here
    too instead of being one task's state. Days are never let go: a late request is
    gated against its own day, and a future one touches no other day. Running a batch
    again after a failure overwrites its folders with the same result.

    Requests are gated in order within a micro-batch, and when they arrive across
    micro-batches.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = written(batch, "gate_batch")
        # one value for each calendar day that the micro-batch holds
        days = [row["day"] for row in stored.select("day").distinct().collect()]
        log = spend_log(spark, folder)
        before = _spent_before(log, batch_id, days)
        budget_gate(stored, opening=before).drop("error").write.mode("overwrite").parquet(
            f"{folder}/decisions/batch_id={batch_id}"
        )
        dropped(stored)
        decisions = spark.read.parquet(f"{folder}/decisions/batch_id={batch_id}")
        after = decisions.groupBy("user_id", "day").agg(
            F.max(
                F.col("spent_before_micro") + F.when(F.col("admitted"), F.col("cost_micro")).otherwise(0)
            ).alias("spent_micro")
        )
        log.append(batch_id, after)

    _catch_up(requests, step, folder)


def _catch_up(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str) -> None:
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _spent_before(log: StateLog, batch_id: int, days: list) -> DataFrame:
    """The spend of these days so far; files without them are passed over."""
    own = F.col("day").isin([day for day in days if day is not None])
    if None in days:
        own = own | F.col("day").isNull()
    return log.rows(before=batch_id).where(own).groupBy("user_id", "day").agg(F.max("spent_micro").alias("spent_micro"))


def budget_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/decisions").parquet(f"{folder}/decisions")
