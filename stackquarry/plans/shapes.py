"""The library's input tables, derived from the driver tables by column expressions.

The driver tables carry no cloud identifiers, so names, routes and templates are
spelled out of their keys. Nothing is sampled or cut: every row of the driver
table becomes a row (or an array element) of the shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- routes -----------------------------------------------------------------

API_NAME = "'api-' || CASE WHEN {k} % 10 = 8 THEN {k} - 5 ELSE {k} END"
METHOD = (
    "CASE {n} % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' "
    "WHEN 3 THEN 'DELETE' ELSE 'PATCH' END"
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem; its four keys together name it, but for repeated rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey AS part",
        "l_suppkey AS supp",
        "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line_key",
    )


def apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "'p' || (s_suppkey div 10) AS project",
        "s_suppkey AS pos",
        "'a' || s_suppkey AS api_id",
        API_NAME.format(k="s_suppkey") + " AS name",
    )


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey",
        "l_partkey",
        "'a' || l_suppkey AS api_id",
        "'r' || l_partkey || '-' || (l_orderkey % 3) AS resource_id",
        "l_partkey * 3 + l_orderkey % 3 AS pos",
        "'/parts/' || l_partkey AS path",
        METHOD.format(n="l_linenumber") + " AS method",
    )


def api_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("api_id", "resource_id", "pos", "path", "method")


def integrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "'arn:aws:apigateway:us-east-1:lambda:path/2015-03-31/functions/arn:aws:lambda:us-east-1:123456789012"
    return _routes(spark, sf_dir).selectExpr(
        "api_id",
        "resource_id",
        "method",
        "CASE (l_partkey + l_suppkey) % 10 WHEN 0 THEN 'http://example.com/:function:x/' "
        "WHEN 1 THEN NULL "
        f"WHEN 2 THEN {head}:function:fn-' || l_partkey || ':live/invocations' "
        f"WHEN 3 THEN {head}/invocations' "
        f"ELSE {head}:function:fn-' || resource_id || '-' || method || '/invocations' END AS uri",
    )


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lines(spark, sf_dir).selectExpr(
        "l_orderkey",
        "line_key AS question_id",
        "part",
        "supp",
        API_NAME.format(k="supp") + " AS api",
        METHOD.format(n="l_linenumber") + " AS m",
    )
    return named.selectExpr(
        "question_id",
        "'p' || (supp div 10) AS project",
        """CASE l_orderkey % 10
            WHEN 0 THEN 'Which API Lambda handles ' || m || ' /parts/' || part || ' on ghost-' || supp || '?'
            WHEN 1 THEN 'Which Lambda handles ' || m || ' /none/' || part || ' on ' || api || '?'
            WHEN 2 THEN 'Which Lambda handles ' || m || ' /parts/{id} on ' || api || '?'
            WHEN 3 THEN 'Which Lambda handles ' || m || ' /parts/' || part || ' on orders-' || supp || '?'
            WHEN 4 THEN 'lambda for ' || lower(m) || '  /parts/' || part || ' IN ' || api || ' gateway'
            ELSE 'Which Lambda handles ' || m || ' /parts/' || part || ' on ' || api || '?' END AS text""",
    )


# ---- templates --------------------------------------------------------------

RESOURCE = """CASE (part + l_linenumber) % 7
    WHEN 0 THEN '{"Type":"AWS::Lambda::Function","Properties":{"FunctionName":"fn-' || part || '"}}'
    WHEN 1 THEN '{"Type":"AWS::ApiGateway::RestApi","Properties":{"Name":{"Ref":"P' || part || '"}}}'
    WHEN 2 THEN '{"Type":"AWS::S3::Bucket"}'
    WHEN 3 THEN '{"Properties":{"TableName":"table-' || part || '"},"Type":"AWS::DynamoDB::Table"}'
    WHEN 4 THEN '{"Type":5}'
    WHEN 5 THEN '{"Type":"AWS::IAM::Role","Properties":{}}'
    ELSE '"just text"' END"""


def stack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template per order; its resources are the order's lines, none for some."""
    resources = (
        lines(spark, sf_dir)
        .selectExpr("l_orderkey", "line_key", f"{RESOURCE} AS body")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("line_key", "body"))).alias("found"))
        .selectExpr(
            "l_orderkey",
            # the place tells repeated lines apart
            """array_join(transform(found, (f, i) -> '"R' || f.line_key || '.' || i || '":' || f.body), ',') AS entries""",
        )
    )
    return (
        table(spark, sf_dir, "orders")
        .join(resources, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .selectExpr(
            "'c' || o_custkey AS project",
            "'s' || o_orderkey AS stack",
            """'{"Resources":{' || coalesce(entries, '') || '}' || CASE o_orderkey % 3
                WHEN 0 THEN ',"Outputs":{}'
                WHEN 1 THEN ',"Outputs":{"Url":{"Value":"u' || o_orderkey || '"},"Name":{"Value":"n"}}'
                ELSE '' END || '}' AS doc""",
        )
    )


def scan_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Projects with every kind of scan fault, by customer key."""
    customers = table(spark, sf_dir, "customer").selectExpr(
        "'c' || c_custkey AS project", "c_custkey % 8 AS kind", "c_custkey AS k"
    )
    stack = '{{"type":"aws:cloudformation:stack","properties":{{"templateFile":"{0}.json"}}}}'
    both = '{"artifacts":{"A":' + stack.format("A") + ',"B":' + stack.format("B") + ',"T":{"type":"cdk:tree"}}}'
    one = '{"artifacts":{"A":' + stack.format("A") + "}}"
    return {
        "projects": customers.select("project"),
        "files": customers.filter("kind <> 0").selectExpr("project", "'tree.json' AS file"),
        "manifests": customers.filter("kind > 1").select(
            "project",
            F.when(F.col("kind") == 2, F.lit('{"artifacts":'))
            .when(F.col("kind") == 3, F.lit('{"artifacts":{"T":{"type":"cdk:tree"}}}'))
            .when(F.col("kind") == 6, F.lit(both))
            .otherwise(F.lit(one))
            .alias("text"),
        ),
        "templates": customers.filter("kind > 4").select(
            "project",
            F.lit("A.json").alias("template_file"),
            F.when(F.col("kind") == 5, F.lit("[1, 2"))
            .otherwise(F.concat(F.lit('{"Resources":{"k'), F.col("k"), F.lit('":{}}}')))
            .alias("text"),
        ),
    }


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'c' || o_custkey AS project", "o_orderdate AS scan_ts", "'s' || o_orderkey AS logical_id"
    )


def two_scans(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """Two scans: resources found, and the list of scanned projects. The second skips
    every fifth project and finds nothing in some."""
    orders = table(spark, sf_dir, "orders")
    projects = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'c' || c_custkey AS project")
    scans = []
    for n, day, kept in ((0, "2024-01-01", "true"), (1, "2024-01-02", "{k} % 5 <> 0")):
        at = f"TIMESTAMP'{day} 10:00:00' AS scan_ts"
        rows = orders.where(f"o_orderkey % 2 = {n} AND " + kept.format(k="o_custkey"))
        scans.append(
            (
                rows.selectExpr("'c' || o_custkey AS project", at, "'s' || o_orderkey AS logical_id"),
                projects.where(kept.format(k="c_custkey")).selectExpr("project", at),
            )
        )
    return scans


# ---- texts ------------------------------------------------------------------

SECRET_QUESTION = (
    "'Who calls arn:aws:lambda:us-east-1:' || (100000000000 + doc_id) || ':function:f' || doc_id "
    "|| ' from 10.0.' || (doc_id % 256) || '.7?'"
)
SECRET_CONTEXT = (
    "CASE WHEN doc_id % 3 = 0 THEN text || ' {\"a\":\"s3://logs-' || (100000000000 + doc_id) "
    "|| '/x\",\"b\":\"10.0.0.1\",\"c\":\"' || (100000000000 + doc_id) || '\"}' ELSE text END"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_texts(table(spark, sf_dir, "documents"))


def secret_texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", f"{SECRET_QUESTION} AS question", f"{SECRET_CONTEXT} AS context")


def turns(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    if role:
        talk = talk.filter(F.col("role") == role)
    return talk.selectExpr("conv_id", "turn", "conv_id * 100 + turn AS req_id", "text")


ROUTE_HINT = (
    "CASE (conv_id + turn) % 6 WHEN 0 THEN ' on Lambda' WHEN 1 THEN ' in my VPC' "
    "WHEN 2 THEN ' as a Step  Function' WHEN 3 THEN ' as a Step Function' ELSE '' END"
)


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir, "user").selectExpr("req_id", f"text || {ROUTE_HINT} AS question")


def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state document per nation; keys out of order and with blanks on purpose."""
    return table(spark, sf_dir, "nation").selectExpr(
        "'n' || n_nationkey AS project",
        """'{"Resources": {"F": {"Type": "AWS::Lambda::Function", "Properties": {"FunctionName": "'
           || n_name || '"}}}, "Outputs": {}}' AS doc""",
    )


def project_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns asked of a nation's project; one nation in 27 does not exist."""
    return turns(spark, sf_dir, "user").selectExpr(
        "req_id",
        "'n' || (conv_id % 27) AS project",
        "text || ' from arn:aws:lambda:us-east-1:1:function:f' || conv_id || ' at 10.0.0.' || turn AS question",
        "conv_id % 10 AS user_id",
        "date_add(DATE'2024-01-01', cast(conv_id % 3 AS INT)) AS day",
        "timestamp_micros(1704067200000000 + conv_id * 1000000 + turn) AS ts",
    )


# ---- usage ------------------------------------------------------------------

MODEL_OF_EVENT = """CASE event_id % 5
    WHEN 0 THEN 'anthropic.claude-3-haiku-20240307-v1:0'
    WHEN 1 THEN 'anthropic.claude-3-sonnet-20240229-v1:0'
    WHEN 2 THEN 'amazon.titan-text-express-v1'
    WHEN 3 THEN 'meta.llama3.2-70b-instruct-v1:0'
    ELSE 'some-other-model' END"""
LIMIT_OF_USER = "CASE user_id % 3 WHEN 0 THEN 500000 WHEN 1 THEN 2000000 ELSE 5000000 END"


def usage_of_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id",
        "event_id AS req_id",
        "ts",
        f"{MODEL_OF_EVENT} AS model_id",
        "cast(floor(value * 10) AS BIGINT) AS input_tokens",
        "cast(get_json_object(props, '$.k') AS BIGINT) * 5 AS output_tokens",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_of_events(table(spark, sf_dir, "events"))


def fine_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices per 1000 tokens of a few millionths of a dollar, one for each part."""
    return table(spark, sf_dir, "part").selectExpr(
        "'m' || p_partkey AS model_id",
        "cast((p_partkey % 1000 + 1) / cast(1000000 AS DECIMAL(7,0)) AS DECIMAL(18,6)) AS input_cost",
        "cast((p_partkey % 777 + 1) * 5 / cast(1000000 AS DECIMAL(7,0)) AS DECIMAL(18,6)) AS output_cost",
        "1 AS speed",
        "1 AS quality",
    )


def offer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).withColumn("model_id", F.expr("'m' || (req_id % 300)"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "to_date(ts) AS usage_date",
        "event_type || '-' || (user_id % 20) AS service",
        "cast(floor(value * 100) AS BIGINT) AS amount_cents",
    )


def cost_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS question_id",
        "date_add(DATE'2024-01-05', cast(c_custkey % 25 AS INT)) AS as_of",
        "cast(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS INT) AS days",
        "cast(1 + c_custkey % 5 AS INT) AS top",
    )


# ---- models and hosts -------------------------------------------------------


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS host_id",
        "2 + (c_custkey % 4) * 2 AS cpu_cores",
        "CASE (c_custkey div 4) % 4 WHEN 0 THEN 3 WHEN 1 THEN 7 WHEN 2 THEN 16 ELSE 32 END AS ram_gb",
        "c_custkey % 3 = 0 AS has_gpu",
        "CASE WHEN c_custkey % 3 = 0 THEN 'NVIDIA' ELSE '' END AS gpu_type",
    )


def host_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            "c_custkey AS host_id",
            "posexplode(array('llama3.2:3b', 'llama3.2:1b', 'phi3:mini', 'llama3.2:8b', 'other:7b')) AS (i, name)",
        )
        .filter("(host_id + i) % 3 <> 0")
        .select("host_id", "name")
    )


def memory_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS host_id",
        r"""CASE c_custkey % 10 WHEN 0 THEN 'MemFree: 12 kB\nCached: 5 kB'
            WHEN 1 THEN 'MemTotal: lots kB\nMemTotal: 8000000 kB'
            WHEN 2 THEN 'MemTotal:\nMemTotal: 8000000 kB'
            ELSE 'MemFree: 1 kB\nMemTotal:    ' || ((c_custkey * 37 + 3) * 100000) || ' kB\nCached: 5 kB' END AS dump""",
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS budget_id",
        "cast(cast(floor(c_acctbal * 100) AS DECIMAL(18,0)) / 5000 AS DECIMAL(18,6)) AS daily_budget",
        "c_custkey % 2 = 0 AS prioritize_speed",
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS brand",
        "p_partkey AS pos",
        "'m' || p_partkey AS model_id",
        "cast(p_size AS DECIMAL(18,6)) AS input_cost",
        "cast(floor(p_retailprice / 100) AS DECIMAL(18,6)) AS output_cost",
    )


def priced_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price table: a model per part, dearer with its retail price."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos",
        "'m' || p_partkey AS model_id",
        "cast(floor(p_retailprice) / 1000 AS DECIMAL(18,6)) AS input_cost",
        "cast(p_size / 100 AS DECIMAL(18,6)) AS output_cost",
        "cast(p_partkey % 97 AS INT) AS speed",
        "cast(p_size AS INT) AS quality",
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey",
        "'a' || s_suppkey AS account",
        """posexplode(array('anthropic.claude-3-haiku-20240307-v1:0', 'anthropic.claude-3-sonnet-20240229-v1:0',
            'amazon.titan-text-express-v1', 'meta.llama3.2-70b-instruct-v1:0', 'some-other-model')) AS (i, model_id)""",
    ).selectExpr("account", "model_id", "(s_suppkey + i * 2) % 9 > 5 AS ok")


def provider_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS provider",
        "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS model_name",
        "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'm' || p_partkey END AS model_id",
    )


# ---- triggers, accounts, pairs ----------------------------------------------


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "'fn-' || l_partkey AS function_name",
        "CASE l_linenumber % 3 WHEN 0 THEN 'apigateway' WHEN 1 THEN 'sqs' ELSE 's3' END AS source_type",
        "'arn:aws:events:::src-' || l_suppkey AS source_arn",
    )


def trigger_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS question_id", "'fn-' || (p_partkey * 3) AS function_name"
    )


def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed questions of all kinds, one per (order, line)."""
    return lines(spark, sf_dir).selectExpr(
        "line_key AS question_id",
        "'p' || (supp div 10) AS project",
        "'question ' || line_key AS text",
        """CASE l_orderkey % 4 WHEN 0 THEN 'api_gateway_lambda' WHEN 1 THEN 'lambda_triggers'
           WHEN 2 THEN 'cost_top' ELSE 'list_buckets' END AS intent""",
        f"""CASE l_orderkey % 4
            WHEN 0 THEN map('api', {API_NAME.format(k='supp')}, 'method', {METHOD.format(n='l_linenumber')}, 'path', '/parts/' || part)
            WHEN 1 THEN map('lambda', 'fn-' || part)
            WHEN 2 THEN map('limit', cast(1 + part % 3 AS STRING), 'period', CASE part % 50
                WHEN 0 THEN '9999999 years' WHEN 1 THEN '1000000 days' ELSE (1 + part % 2) || ' weeks' END)
            ELSE map('x', 'y') END AS params""",
    )


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .selectExpr(
            "c_custkey AS k",
            "'c' || c_custkey AS account",
            "posexplode(array('L-DB2E81BA', 'L-1216C47A', 'L-34B43A08')) AS (i, quota_code)",
        )
        .selectExpr(
            "account",
            "quota_code",
            "CASE (k + i * 3) % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0D ELSE cast((k + i) % 7 AS DOUBLE) END AS value",
        )
    )


def quota_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "'quota ' || o_orderpriority AS quota_name",
        "o_totalprice AS desired_value",
        "CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'CASE_CLOSED' END AS status",
        "o_orderdate AS created",
    )


def stacks_with_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "'c' || c_custkey AS stack",
        """filter(array(
            named_struct('OutputKey', 'PublicIP', 'OutputValue', '10.0.0.' || (c_custkey % 256)),
            named_struct('OutputKey', 'Other', 'OutputValue', 'x'),
            named_struct('OutputKey', CASE WHEN c_custkey % 2 = 0 THEN 'OllamaURL' ELSE 'Unused' END,
                         'OutputValue', 'http://host-' || c_custkey),
            named_struct('OutputKey', 'PublicIP', 'OutputValue', 'second')),
            o -> c_custkey % 5 <> 0 OR o.OutputKey = 'Other') AS outputs""",
    )


def listed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_name || '-' || p_partkey AS FunctionName", "'arn:aws:lambda:::' || p_partkey AS FunctionArn"
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 4 = 0 THEN 'Table' ELSE 'Lambda' END AS Type",
        "p_name || '-' || p_partkey AS FunctionName",
        "'arn:aws:lambda:::' || p_partkey AS Arn",
    )


def loose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).selectExpr(
        "CASE WHEN req_id % 7 = 0 THEN '' WHEN req_id % 11 = 0 THEN NULL ELSE 'Turn ' || req_id END AS prompt",
        "CASE WHEN req_id % 5 = 0 THEN '' ELSE text END AS completion",
    )


# ---- model replies ----------------------------------------------------------

REPLY_KIND = """CASE (conv_id + turn) % 9
    WHEN 0 THEN 'anthropic' WHEN 1 THEN 'titan' WHEN 2 THEN 'llama' WHEN 3 THEN 'sagemaker'
    WHEN 4 THEN 'openai' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'broken' WHEN 7 THEN 'wrong' ELSE 'empty' END"""
TYPE_OF_KIND = "CASE WHEN kind = 'sagemaker' THEN 'sagemaker' WHEN kind IN ('openai', 'empty') THEN 'openai' ELSE 'bedrock' END"
MODEL_OF_KIND = """CASE kind WHEN 'titan' THEN 'amazon.titan-text-express-v1'
    WHEN 'llama' THEN 'meta.llama3.2-70b-instruct-v1:0' WHEN 'unsupported' THEN 'openai.gpt-4o'
    ELSE 'anthropic.claude-3-haiku-20240307-v1:0' END"""


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).selectExpr("req_id", "text", f"{REPLY_KIND} AS kind").selectExpr(
        "req_id", "text", "kind", f"{TYPE_OF_KIND} AS type", f"{MODEL_OF_KIND} AS model_id"
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = "' \\n' || text || '  \\t'"
    return model_calls(spark, sf_dir).selectExpr(
        "req_id",
        "type",
        "model_id",
        f"""CASE kind
            WHEN 'anthropic' THEN to_json(named_struct('completion', {padded}, 'stop', 1))
            WHEN 'titan' THEN to_json(named_struct('results', array(named_struct('outputText', {padded}))))
            WHEN 'llama' THEN to_json(named_struct('generation', {padded}))
            WHEN 'sagemaker' THEN to_json(named_struct('response', '', 'output', {padded}, 'text', 'no'))
            WHEN 'openai' THEN to_json(named_struct('choices', array(named_struct('message', named_struct('content', {padded})))))
            WHEN 'broken' THEN '{{"completion": '
            WHEN 'wrong' THEN '{{"completion": 5}}'
            WHEN 'empty' THEN '{{"choices": []}}'
            ELSE '{{}}' END AS body""",
    )


NOISE = (
    "CASE (conv_id + turn) % 4 WHEN 0 THEN 'Based on the provided infrastructure context, ' "
    "WHEN 1 THEN 'So, in summary: ' ELSE '' END"
)
NOISE_TAIL = (
    r"CASE (conv_id + turn) % 3 WHEN 0 THEN '\n\n\n SourceArn: z\n end. ' "
    r"WHEN 1 THEN '\n Action: lambda:InvokeFunction\n  DemoApi Permission\n' ELSE '' END"
)


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir, "assistant").selectExpr(
        "req_id", f"'\\n ' || {NOISE} || text || {NOISE_TAIL} AS reply"
    )


QUERY_REPLY = """CASE req_id % 8
    WHEN 0 THEN '{"intent":"lambda_triggers","service":"lambda","action":"list_triggers","params":{"lambda":"f' || req_id || '"},"raw_query":"old"}'
    WHEN 1 THEN '{"intent":5,"service":"lambda"}'
    WHEN 2 THEN 'The intent is unclear'
    WHEN 3 THEN '{"intent":"cost_top","params":{"limit":3}}'
    WHEN 4 THEN '{"intent":"cost_top","params":{"limit":"3","period":null}}'
    WHEN 5 THEN '["intent"]'
    WHEN 6 THEN '{"service":"s3"}'
    ELSE '{"intent":null,"extra":[1,2]}' END"""


def query_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).selectExpr("conv_id", "turn", "req_id", f"{QUERY_REPLY} AS response")
