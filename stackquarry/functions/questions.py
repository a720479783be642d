"""Reading questions: F01-F03, F10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackquarry import wording
from stackquarry.functions import variants
from stackquarry.functions.text import contains_any

PARSED = "STRUCT<intent: STRING, service: STRING, action: STRING, params: MAP<STRING, STRING>, raw_query: STRING>"


def is_route_question(question: Column) -> Column:
    lowered = F.lower(question)
    return F.contains(lowered, F.lit("lambda")) & contains_any(lowered, ["api", "gateway"])


def route_words(question: Column) -> Column:
    """[method, path, on or in, api] of the first route in the text; [''] without one.

    The pattern runs once; its parts hold no white space, so they are split again.
    """
    return F.split(F.regexp_extract(question, wording.ROUTE_PATTERN, 0), r"[\t\n\f\r ]+", -1)


def route_params(question: Column) -> Column:
    """map with method, path and api; empty when the text does not match."""
    words = route_words(question)
    return F.when(
        F.size(words) == 4,
        F.create_map(
            F.lit("method"), F.upper(F.get(words, F.lit(0))),
            F.lit("path"), F.get(words, F.lit(1)),
            F.lit("api"), F.get(words, F.lit(3)),
        ),
    ).otherwise(no_params())


def no_params() -> Column:
    return F.from_json(F.lit("{}"), "MAP<STRING, STRING>")


def parsed_struct(intent: Column, service: Column, action: Column, params: Column, raw: Column) -> Column:
    return F.struct(
        intent.alias("intent"),
        service.alias("service"),
        action.alias("action"),
        params.alias("params"),
        raw.alias("raw_query"),
    )


def unknown_question(question: Column) -> Column:
    return parsed_struct(F.lit("unknown"), F.lit(""), F.lit(""), no_params(), question)


def keyword_intent(question: Column) -> Column:
    """F01 with F02: the parsed-question struct found by keywords alone."""
    return F.when(
        is_route_question(question),
        parsed_struct(
            F.lit("api_gateway_lambda"),
            F.lit("apigateway"),
            F.lit("get_integration"),
            route_params(question),
            question,
        ),
    ).otherwise(unknown_question(question))


def route_backend(question: Column, has_architecture_backend: bool | Column = True) -> Column:
    """'arch' or 'general', decided on the question before redaction."""
    available = (
        F.lit(has_architecture_backend)
        if isinstance(has_architecture_backend, bool)
        else has_architecture_backend
    )
    matches = contains_any(F.lower(question), wording.ARCHITECTURE_WORDS)
    return F.when(available & matches, F.lit("arch")).otherwise(F.lit("general"))


def parse_query_json(text: Column, question: Column) -> Column:
    """decode a model reply into a parsed question; any fault gives 'unknown'.

    Field types are checked, not coerced: a numeric intent is a fault.
    """
    return F.coalesce(decoded_query(text, question), unknown_question(question))


def decoded_query(text: Column, question: Column) -> Column:
    """Parsed question, or NULL when the text is not a valid reply."""
    reply = F.try_parse_json(text)
    params = F.try_variant_get(reply, "$.params", "map<string, variant>")
    params_fit = F.coalesce(
        F.forall(
            F.map_values(params),
            lambda v: F.coalesce(variants.kind(v).isin("STRING", "VOID"), F.lit(True)),
        ),
        variants.absent(reply, "$.params"),
    )
    fits = (
        variants.decodes_as_object(reply)
        & variants.text_fits(reply, "$.intent")
        & variants.text_fits(reply, "$.service")
        & variants.text_fits(reply, "$.action")
        & variants.text_fits(reply, "$.raw_query")
        & params_fit
    )
    texts = F.transform_values(
        params, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    )
    return F.when(
        fits,
        parsed_struct(
            *[
                F.coalesce(variants.text_or_null(reply, f"$.{name}"), F.lit(""))
                for name in ("intent", "service", "action")
            ],
            F.coalesce(texts, no_params()),
            question,
        ),
    )
