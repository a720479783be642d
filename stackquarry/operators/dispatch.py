"""Sending parsed questions to their lookups: P06."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.operators.answers import not_implemented
from stackquarry.operators.costs import period_days, top_cost
from stackquarry.operators.routes import ROUTE_INTENT, api_route_lookup
from stackquarry.operators.triggers import trigger_counts

TRIGGER_INTENT = "lambda_triggers"
COST_INTENT = "cost_top"


def _param(name: str) -> Column:
    return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(""))


def dispatch_intents(
    parsed: DataFrame,
    apis: DataFrame,
    methods: DataFrame,
    integrations: DataFrame,
    triggers: DataFrame,
    costs: DataFrame,
    as_of: Column,
) -> DataFrame:
    """parsed: question_id, project, text, intent, params. One row per question:
    question_id, intent, text, data (JSON text), error.

    The lookup rows behind a count (the triggers of a function, the ranked services)
    stay in the tables of ``triggers_of_asked`` and ``top_cost``.
    """
    routes = api_route_lookup(
        parsed.filter(F.col("intent") == ROUTE_INTENT), apis, methods, integrations
    )
    route_data = (
        F.when(
            F.col("outcome") == "found",
            F.to_json(F.struct("api_id", "api_name", "lambda_name", "method", "path")),
        )
        .when(F.col("outcome") == "route_missing", F.to_json(F.struct("api_id", "api_name", "message")))
        .otherwise(F.to_json(F.struct("message")))
    )
    route_rows = routes.select("question_id", "intent", "text", route_data.alias("data"))

    asked = parsed.filter(F.col("intent") == TRIGGER_INTENT).select(
        "question_id", "text", _param("lambda").alias("function_name")
    )
    trigger_rows = trigger_counts(asked, triggers).select(
        "question_id",
        F.lit(TRIGGER_INTENT).alias("intent"),
        "text",
        F.to_json(F.struct(F.col("function_name").alias("lambda"), "trigger_count")).alias("data"),
    )

    cost_questions = parsed.filter(F.col("intent") == COST_INTENT).select(
        "question_id",
        "text",
        as_of.alias("as_of"),
        period_days(_param("period")).alias("days"),
        _param("limit").try_cast("int").alias("top"),
        _param("limit").alias("limit"),
        _param("period").alias("period"),
    )
    # Each wish (as_of, days, top) is worked out once, however many questions have it.
    wish = F.struct("as_of", "days", "top")
    wishes = cost_questions.select(wish.alias("question_id"), "as_of", "days", "top").distinct()
    sums = top_cost(wishes, costs).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("services"), F.sum("amount_cents").alias("amount_cents")
    )
    sums = sums.select("question_id.*", "services", "amount_cents")
    cost_rows = cost_questions.join(sums, ["as_of", "days", "top"], "left").select(
        "question_id",
        F.lit(COST_INTENT).alias("intent"),
        "text",
        F.to_json(
            F.struct(
                F.coalesce("amount_cents", F.lit(0).cast("bigint")).alias("amount_cents"),
                "limit",
                "period",
                F.coalesce("services", F.lit(0).cast("bigint")).alias("services"),
            )
        ).alias("data"),
        F.when(
            F.col("days").isNull() & (F.col("period") != ""),
            F.format_string("could not read period '%s'", "period"),
        ).alias("error"),
    )

    others = parsed.filter(
        ~F.coalesce(F.col("intent").isin(ROUTE_INTENT, TRIGGER_INTENT, COST_INTENT), F.lit(False))
    ).select("question_id", "intent", "text", not_implemented(F.col("intent")).alias("data"))
    without_error = route_rows.unionByName(trigger_rows).unionByName(others)
    return without_error.withColumn("error", F.lit(None).cast("string")).unionByName(cost_rows)
