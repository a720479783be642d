"""Which function handles a route: J01 with W01, F05, A07.

The three lookups are equi-joins from the question table to tables that have
been made unique per join key first: "first match in list order" is a min over
(position, id), which Spark aggregates partially on the map side. A question
therefore meets at most one row per join, however many APIs share its name, and
a name or route asked for by a third of all questions is an ordinary skewed join
key that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.functions.questions import is_route_question, route_words
from stackquarry.wording import API_MISSING, ROUTE_MISSING

ROUTE_INTENT = "api_gateway_lambda"


def function_from_uri(uri: Column) -> Column:
    """the text between the first and second ':function:', up to a slash."""
    tail = F.split_part(uri, F.lit(":function:"), F.lit(2))
    return F.when(
        F.contains(uri, F.lit(":lambda:path")), F.split_part(tail, F.lit("/"), F.lit(1))
    ).otherwise(F.lit(""))


def first_apis(apis: DataFrame) -> DataFrame:
    """Per project and name the API listed first, plus under the empty name the
    project's very first API, which is what a question without a name gets."""
    named = apis.select(
        "project", F.explode(F.array("name", F.lit(""))).alias("wanted"), "pos", "api_id", "name"
    )
    return (
        named.groupBy("project", "wanted")
        .agg(F.min(F.struct("pos", "api_id", "name")).alias("api"))
        .select("project", "wanted", "api.api_id", F.col("api.name").alias("api_name"))
    )


def first_resources(methods: DataFrame) -> DataFrame:
    """Per API, path and method the resource listed first."""
    return (
        methods.groupBy("api_id", "path", "method")
        .agg(F.min(F.struct("pos", "resource_id")).alias("r"))
        .select("api_id", "path", "method", "r.resource_id")
    )


def first_integrations(integrations: DataFrame) -> DataFrame:
    """One URI per API, resource and method: the least of several."""
    return integrations.groupBy("api_id", "resource_id", "method").agg(F.min("uri").alias("uri"))


def api_route_lookup(
    questions: DataFrame, apis: DataFrame, methods: DataFrame, integrations: DataFrame
) -> DataFrame:
    """J01 over a table of parsed route questions.

    questions: question_id, project, text, params. Adds outcome (found, api_missing,
    route_missing), api_name, api_id, path, method, lambda_name, message. The names
    to offer for a missing API are a table of their own, ``available_apis``.
    """

    def param(name: str) -> Column:
        return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(""))

    asked = questions.select(
        "question_id",
        "project",
        "text",
        F.lit(ROUTE_INTENT).alias("intent"),
        param("api").alias("wanted"),
        param("method").alias("method"),
        param("path").alias("path"),
    )
    return _lookup(asked, apis, methods, integrations)


def _lookup(
    asked: DataFrame, apis: DataFrame, methods: DataFrame, integrations: DataFrame
) -> DataFrame:
    """asked: question_id, project, text, intent, wanted, method, path. Rows of another
    intent pass through: their ``wanted`` is NULL and meets nothing."""
    routes = first_resources(methods).join(
        first_integrations(integrations),
        ["api_id", "resource_id", "method"],
        "left",
    )
    is_route = F.col("intent") == ROUTE_INTENT
    hit = (
        asked.join(first_apis(apis), ["project", "wanted"], "left")
        .join(routes, ["api_id", "path", "method"], "left")
        .withColumn(
            "outcome",
            F.when(~is_route, F.lit(None))
            .when(F.col("api_id").isNull(), F.lit("api_missing"))
            .when(F.col("resource_id").isNull(), F.lit("route_missing"))
            .otherwise(F.lit("found")),
        )
    )
    found = F.col("outcome") == "found"
    return hit.select(
        "question_id",
        "project",
        "text",
        "intent",
        "outcome",
        "api_name",
        "api_id",
        F.when(found, F.col("path")).alias("path"),
        F.when(found, F.col("method")).alias("method"),
        F.when(found, F.coalesce(function_from_uri(F.col("uri")), F.lit(""))).alias("lambda_name"),
        F.when(
            F.col("outcome") == "api_missing", F.format_string(API_MISSING, "wanted")
        )
        .when(
            F.col("outcome") == "route_missing",
            F.format_string(ROUTE_MISSING, "path", "method", "api_name"),
        )
        .alias("message"),
    )


def available_apis(lookups: DataFrame, apis: DataFrame) -> DataFrame:
    """The API names, in list order, of every project with a missed API.

    One row per project and API, not a list copied into each missed question. Only
    the API look-up is needed to know what was missed, and the distinct lets Spark
    drop the route joins from the plan.
    """
    missing = (F.col("intent") == ROUTE_INTENT) & F.col("api_id").isNull()
    missed = lookups.filter(missing).select("project").distinct()
    return apis.join(missed, "project", "left_semi").select("project", "pos", "name")


def route_answers(
    questions: DataFrame, apis: DataFrame, methods: DataFrame, integrations: DataFrame
) -> DataFrame:
    """Questions as text to answers: F01, F02, J01. Other questions come back 'unknown'.

    One pass over the questions: the texts are parsed once, and rows of other
    intents go through the same joins. Their path is made unique, so that they
    spread over the shuffle instead of meeting in one partition under NULL keys.
    """
    known = questions.withColumns(
        {"_route": is_route_question(F.col("text")), "_words": route_words(F.col("text"))}
    )

    def word(at: int) -> Column:
        return F.when(F.size("_words") == 4, F.get("_words", F.lit(at))).otherwise(F.lit(""))

    route = F.col("_route")
    asked = known.select(
        "question_id",
        "project",
        "text",
        F.when(route, F.lit(ROUTE_INTENT)).otherwise(F.lit("unknown")).alias("intent"),
        F.when(route, word(3)).alias("wanted"),
        F.when(route, F.upper(word(0))).otherwise(F.lit("")).alias("method"),
        F.when(route, word(1)).otherwise(F.col("question_id").cast("string")).alias("path"),
    )
    return _lookup(asked, apis, methods, integrations)
