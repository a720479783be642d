import pytest
from pyspark.sql import functions as F

from stackquarry.functions.questions import keyword_intent, parse_query_json, route_backend
from stackquarry.operators import answers, routes


@pytest.mark.parametrize(
    "text,intent,params",
    [
        ("Which Lambda handles GET /users on prod-api?", "api_gateway_lambda", ("GET", "/users", "prod-api")),
        ("lambda for post  /a-b/c IN my_api gateway", "api_gateway_lambda", ("POST", "/a-b/c", "my_api")),
        ("Which Lambda handles GET /users/{id} on prod-api?", "api_gateway_lambda", None),
        ("Lambda in the capital", "api_gateway_lambda", None),
        ("Which Lambda handles GET /x on orders?", "unknown", None),
        ("Top 3 services by cost last 7 days", "unknown", None),
    ],
)
def test_keyword_intent(spark, text, intent, params):
    row = spark.createDataFrame([(text,)], "t STRING").select(keyword_intent(F.col("t")).alias("p")).first().p
    assert row.intent == intent and row.raw_query == text
    wanted = dict(zip(("method", "path", "api"), params)) if params else {}
    assert row.params == wanted


def test_route_backend(spark):
    rows = spark.createDataFrame([("Explain my VPC",), ("S3 cost?",), ("Reduce spend?",), (None,)], "t STRING")
    out = rows.select(route_backend(F.col("t")).alias("a"), route_backend(F.col("t"), False).alias("b")).collect()
    assert [r.a for r in out] == ["arch", "arch", "general", "general"]
    assert {r.b for r in out} == {"general"}


HEAD = "arn:aws:apigateway:us-east-1:lambda:path/2015-03-31/functions/arn:aws:lambda:us-east-1:123456789012"


@pytest.mark.parametrize(
    "uri,name",
    [
        (f"{HEAD}:function:f/invocations", "f"),
        (f"{HEAD}:function:f:live/invocations", "f:live"),
        (f"{HEAD}/invocations", ""),
        ("http://example.com/:function:f/", ""),
    ],
)
def test_function_from_uri(spark, uri, name):
    row = spark.createDataFrame([(uri,)], "u STRING").select(routes.function_from_uri(F.col("u")).alias("n"))
    assert row.first().n == name


def inventory(spark):
    apis = spark.createDataFrame(
        [("p", 1, "a1", "first"), ("p", 2, "a2", "demo-api"), ("p", 3, "a3", "demo-api"), ("q", 1, "b1", "other")],
        "project STRING, pos BIGINT, api_id STRING, name STRING",
    )
    methods = spark.createDataFrame(
        [("a2", "r2", 2, "/hello", "GET"), ("a2", "r1", 1, "/hello", "GET"), ("a3", "r3", 1, "/only", "GET"),
         ("a2", "r4", 3, "/none", "POST")],
        "api_id STRING, resource_id STRING, pos BIGINT, path STRING, method STRING",
    )
    integrations = spark.createDataFrame(
        [("a2", "r1", "GET", f"{HEAD}:function:demo-hello/invocations"), ("a2", "r2", "GET", f"{HEAD}:function:no/x"),
         ("a2", "r4", "POST", None)],
        "api_id STRING, resource_id STRING, method STRING, uri STRING",
    )
    return apis, methods, integrations


def test_route_answers(spark):
    questions = spark.createDataFrame(
        [
            (1, "p", "Which Lambda handles GET /hello on demo-api?"),
            (2, "p", "Which Lambda handles GET /only on demo-api?"),
            (3, "p", "Which API Lambda handles GET /hello on ghost?"),
            (4, "p", "Which Lambda handles GET /users/{id} on prod-api?"),
            (5, "p", "What is this?"),
            (6, "p", "Which Lambda handles POST /none on demo-api?"),
            (7, "q", "Which Lambda handles GET /hello on demo-api?"),
        ],
        "question_id BIGINT, project STRING, text STRING",
    )
    apis, methods, integrations = inventory(spark)
    found = routes.route_answers(questions, apis, methods, integrations)
    rows = {r.question_id: r for r in found.collect()}
    assert len(rows) == 7
    assert (rows[1].outcome, rows[1].lambda_name, rows[1].api_id) == ("found", "demo-hello", "a2")
    assert rows[2].outcome == "route_missing"
    assert rows[2].message == "Path '/only' with method 'GET' not found in API 'demo-api'"
    assert rows[3].message == "API Gateway 'ghost' not found"
    assert (rows[4].outcome, rows[4].api_name) == ("route_missing", "first")
    assert (rows[5].intent, rows[5].outcome, rows[5].message) == ("unknown", None, None)
    assert (rows[6].outcome, rows[6].lambda_name) == ("found", "")
    assert rows[7].outcome == "api_missing"
    offered = routes.available_apis(found, apis).orderBy("project", "pos").collect()
    assert [(r.project, r.name) for r in offered] == [
        ("p", "first"), ("p", "demo-api"), ("p", "demo-api"), ("q", "other")
    ]


def test_two_uris_give_one_answer(spark):
    apis, methods, integrations = inventory(spark)
    more = spark.createDataFrame([("a2", "r1", "GET", f"{HEAD}:function:another/invocations")], integrations.schema)
    asked = spark.createDataFrame([(1, "p", "Which Lambda handles GET /hello on demo-api?")], "question_id BIGINT, project STRING, text STRING")
    rows = routes.route_answers(asked, apis, methods, integrations.unionByName(more)).collect()
    assert [r.lambda_name for r in rows] == ["another"]


@pytest.mark.parametrize(
    "reply,intent,params",
    [
        ('{"intent":"cost_top","params":{"limit":"3"}}', "cost_top", {"limit": "3"}),
        ('{"intent":5}', "unknown", {}),
        ('{"intent":"x","params":{"limit":3}}', "unknown", {}),
        ('{"intent":"x","params":[1]}', "unknown", {}),
        ('{"intent":"x","params":{"a":null}}', "x", {"a": ""}),
        ("not json", "unknown", {}),
        ('["intent"]', "unknown", {}),
        (None, "unknown", {}),
        ("{}", "", {}),
    ],
)
def test_parse_query_json(spark, reply, intent, params):
    df = spark.createDataFrame([(reply,)], "r STRING").select(
        parse_query_json(F.col("r"), F.lit("asked")).alias("p")
    )
    row = df.first().p
    assert (row.intent, row.params, row.raw_query) == (intent, params, "asked")


def test_first_valid_chunk(spark):
    chunks = spark.createDataFrame(
        [("a", 2, '{"intent":"late"}'), ("a", 1, '{"intent":"early"}'), ("a", 0, "intent?"), ("b", 0, '{"service":"x"}')],
        "req_id STRING, chunk_idx BIGINT, response STRING",
    )
    requests = spark.createDataFrame([("a", "qa"), ("b", "qb"), ("c", "qc")], "req_id STRING, text STRING")
    rows = {r.req_id: r.parsed for r in answers.first_valid_chunk(requests, chunks).collect()}
    assert rows["a"].intent == "early" and rows["a"].raw_query == "qa"
    assert rows["b"].intent == rows["c"].intent == "unknown" and rows["c"].raw_query == "qc"
