"""Fixed model dimensions.

The tables are literal VALUES relations: Spark knows their exact size, so joins
against them turn into broadcast hash joins by the ordinary size threshold, with
no hint. A caller's own catalog takes the same path and is only broadcast when
its statistics allow it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -----------------------------------------------------------
# (model id, USD per 1000 input tokens, USD per 1000 output tokens, speed, quality)
PRICES = [
    ("anthropic.claude-3-haiku-20240307-v1:0", "0.25", "1.25", 9, 7),
    ("anthropic.claude-3-sonnet-20240229-v1:0", "3.00", "15.00", 7, 9),
    ("amazon.titan-text-express-v1", "0.13", "0.17", 8, 6),
    ("meta.llama3.2-70b-instruct-v1:0", "0.99", "0.99", 6, 8),
]
DEFAULT_MODEL = "anthropic.claude-3-haiku-20240307-v1:0"

# (name, minimum RAM in GB, minimum CPUs, needs a GPU, size label, priority)
REQUIREMENTS = [
    ("llama3.2:3b", 8, 4, False, "3B", 100),
    ("llama3.2:1b", 4, 2, False, "1B", 80),
    ("phi3:mini", 4, 2, False, "Mini", 70),
    ("llama3.2:8b", 16, 8, False, "8B", 120),
]

# (type, model id, region, max tokens, temperature)
HOSTED_MODELS = [
    ("bedrock", "anthropic.claude-3-sonnet-20240229-v1:0", "us-east-1", 4096, 0.1),
    ("bedrock", "anthropic.claude-3-haiku-20240307-v1:0", "us-east-1", 4096, 0.1),
    ("bedrock", "amazon.titan-text-express-v1", "us-east-1", 4096, 0.1),
    ("bedrock", "meta.llama3.2-70b-instruct-v1:0", "us-east-1", 4096, 0.1),
    ("bedrock", "openai.gpt-4o", "us-east-1", 4096, 0.1),
]

# order in which a working hosted model is looked for
MODEL_PREFERENCE = [
    "anthropic.claude-3-haiku-20240307-v1:0",
    "anthropic.claude-3-sonnet-20240229-v1:0",
    "amazon.titan-text-express-v1",
    "meta.llama3.2-70b-instruct-v1:0",
]
# -----------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(spark: SparkSession, rows: list[str], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def prices(spark: SparkSession, rows: list[tuple] = PRICES) -> DataFrame:
    """pos, model_id, input_cost, output_cost (USD per 1000 tokens), speed, quality. A
    price of more than six decimals is an error."""
    for model, *costs, _, _ in rows:
        for cost in costs:
            if Decimal(cost).normalize().as_tuple().exponent < -6:
                raise ValueError(f"price {cost} of {model} has more than six decimals")
    literals = [
        f"({pos}, {_quoted(m)}, CAST('{i}' AS DECIMAL(18,6)), CAST('{o}' AS DECIMAL(18,6)), {s}, {q})"
        for pos, (m, i, o, s, q) in enumerate(rows)
    ]
    return _values(spark, literals, "pos, model_id, input_cost, output_cost, speed, quality")


def requirements(spark: SparkSession, rows: list[tuple] = REQUIREMENTS) -> DataFrame:
    """pos, name, min_ram_gb, min_cpus, needs_gpu, size, priority."""
    literals = [
        f"({pos}, {_quoted(n)}, {ram}, {cpu}, {str(gpu).lower()}, {_quoted(size)}, {prio})"
        for pos, (n, ram, cpu, gpu, size, prio) in enumerate(rows)
    ]
    return _values(spark, literals, "pos, name, min_ram_gb, min_cpus, needs_gpu, size, priority")


def hosted_models(spark: SparkSession, rows: list[tuple] = HOSTED_MODELS) -> DataFrame:
    """type, model_id, endpoint_name, region, max_tokens, temperature."""
    literals = [
        f"({_quoted(t)}, {_quoted(m)}, CAST(NULL AS STRING), {_quoted(r)}, {mx}, CAST({temp} AS DOUBLE))"
        for t, m, r, mx, temp in rows
    ]
    return _values(
        spark, literals, "type, model_id, endpoint_name, region, max_tokens, temperature"
    )
