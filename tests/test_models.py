import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stackquarry import catalog
from stackquarry.operators import models

HAIKU, SONNET, TITAN, LLAMA = catalog.MODEL_PREFERENCE
WITHOUT_HAIKU = [p for p in catalog.PRICES if p[0] != HAIKU]


@pytest.mark.parametrize(
    "rows,budget,speed,model",
    [
        (catalog.PRICES, "1", True, HAIKU),
        (catalog.PRICES, "5", True, TITAN),
        (catalog.PRICES, "5", False, TITAN),
        (catalog.PRICES, "8.75", False, HAIKU),
        (catalog.PRICES, "105", False, HAIKU),
        (WITHOUT_HAIKU, "15", True, TITAN),
        (WITHOUT_HAIKU, "15", False, LLAMA),
        (WITHOUT_HAIKU, "105", False, SONNET),
        (WITHOUT_HAIKU, "1", False, TITAN),
    ],
)
def test_select_model(spark, rows, budget, speed, model):
    df = spark.createDataFrame(
        [(1, Decimal(budget), speed)], "budget_id BIGINT, daily_budget DECIMAL(18,6), prioritize_speed BOOLEAN"
    )
    assert models.select_model(df, rows).first().model_id == model


def test_place_models(spark):
    specs = [(1, 8, 16), (2, 4, 16), (3, 8, 7), (4, 8, 3), (5, 8, 16)]
    hosts = spark.createDataFrame(
        [(h, c, r, False, "") for h, c, r in specs],
        "host_id BIGINT, cpu_cores INT, ram_gb INT, has_gpu BOOLEAN, gpu_type STRING",
    )
    installed = spark.createDataFrame(
        [(h, n[0]) for h in range(1, 5) for n in catalog.REQUIREMENTS] + [(5, "other")], "host_id BIGINT, name STRING"
    )
    rows = models.place_models(hosts, catalog.requirements(spark), installed).collect()
    assert {r.host_id: r.model for r in rows} == {
        1: "llama3.2:8b", 2: "llama3.2:3b", 3: "llama3.2:1b", 4: "", 5: ""
    }


def test_gpu_need(spark):
    hosts = spark.createDataFrame(
        [(1, 8, 16, True, "NVIDIA"), (2, 8, 16, False, "")],
        "host_id BIGINT, cpu_cores INT, ram_gb INT, has_gpu BOOLEAN, gpu_type STRING",
    )
    needs = catalog.requirements(spark, [("big", 1, 1, True, "B", 9), ("small", 1, 1, False, "S", 1)])
    installed = spark.createDataFrame(
        [(1, "big"), (1, "small"), (2, "big"), (2, "small")], "host_id BIGINT, name STRING"
    )
    placed = models.place_models(hosts, needs, installed)
    assert {r.host_id: r.model for r in placed.collect()} == {1: "big", 2: "small"}
    text = models.host_summary(F.col("cpu_cores"), F.col("ram_gb"), F.col("has_gpu"), F.col("gpu_type"))
    assert [r[0] for r in hosts.orderBy("host_id").select(text).collect()] == [
        "CPU: 8 cores, RAM: 16 GB, NVIDIA GPU", "CPU: 8 cores, RAM: 16 GB, No GPU"
    ]


def test_names_and_marks(spark):
    df = spark.createDataFrame([("phi3:mini", "phi3:mini"), ("x", None)], "name STRING, current STRING")
    rows = {r.name: r for r in models.mark_current(df, catalog.requirements(spark)).collect()}
    assert (rows["phi3:mini"].label, rows["phi3:mini"].is_current, rows["phi3:mini"].gpu) == ("phi3:mini (Mini)", True, "No")
    assert (rows["x"].label, rows["x"].is_current, rows["x"].gpu) == ("x", False, None)


def test_first_working_model(spark):
    probes = spark.createDataFrame(
        [("a", LLAMA, True), ("a", SONNET, True), ("a", HAIKU, False), ("b", HAIKU, False), ("c", "unlisted", True)],
        "account STRING, model_id STRING, ok BOOLEAN",
    )
    got = {r.account: r.model_id for r in models.first_working_model(probes).collect()}
    assert got == {"a": SONNET, "b": "", "c": ""}


def test_models_by_provider_and_cheapest(spark):
    listed = spark.createDataFrame(
        [(0, "A", "m", "1"), (1, None, None, None), (2, "A", "n", None)],
        "pos BIGINT, provider STRING, model_name STRING, model_id STRING",
    )
    rows = models.models_by_provider(listed).orderBy("pos").collect()
    assert [(r.provider, r.label, r.provider_total, r.grand_total) for r in rows] == [
        ("A", "m (1)", 2, 3), ("Unknown", "Unknown (Unknown)", 1, 3), ("A", "n (Unknown)", 2, 3)
    ]
    assert models.cheapest_model(catalog.prices(spark)).first().model_id == TITAN


def test_catalog_tables(spark):
    assert catalog.hosted_models(spark).count() == 5
    assert [f.dataType.simpleString() for f in catalog.prices(spark).schema][:4] == [
        "int", "string", "decimal(18,6)", "decimal(18,6)"
    ]


def test_equal_priorities_follow_the_list(spark):
    needs = catalog.requirements(spark, [("z", 1, 1, False, "Z", 5), ("a", 1, 1, False, "A", 5)])
    hosts = spark.createDataFrame([(1, 4, 8, False)], "host_id INT, cpu_cores INT, ram_gb INT, has_gpu BOOLEAN")
    installed = spark.createDataFrame([(1, "a"), (1, "z")], "host_id INT, name STRING")
    assert models.place_models(hosts, needs, installed).first().model == "z"


def test_prices_are_held_or_refused(spark):
    assert str(catalog.prices(spark, [("m", "0.000250", "1.25", 1, 1)]).first().input_cost) == "0.000250"
    with pytest.raises(ValueError, match="six decimals"):
        catalog.prices(spark, [("m", "0.0000005", "1", 1, 1)])


@pytest.mark.parametrize("chunks", [None, 9])
def test_select_model_from_a_table(spark, chunks):
    draw = random.Random(4)
    rows = [(f"m{k}", Decimal(draw.randint(0, 300)) / 100, Decimal(draw.randint(0, 300)) / 100, draw.randint(1, 5), draw.randint(1, 5)) for k in range(60)]
    budgets = spark.createDataFrame(
        [(k, None if k % 40 == 7 else Decimal(draw.choice([0, 500, 777, 1234, draw.randint(0, 5000)])) / 100, k % 2 == 0) for k in range(200)],
        "budget_id BIGINT, daily_budget DECIMAL(18,6), prioritize_speed BOOLEAN",
    )
    prices = spark.createDataFrame(
        [(k, *row) for k, row in enumerate(rows)],
        "pos INT, model_id STRING, input_cost DECIMAL(18,6), output_cost DECIMAL(18,6), speed INT, quality INT",
    )
    for default in ("m7", "none"):
        wanted = models.select_model(budgets, rows, default)
        got = models.select_model_from(budgets, prices, default, chunks)
        assert got.columns == wanted.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    none = models.select_model_from(budgets, prices.where("false"), "m7").collect()
    assert len(none) == 200 and {r.model_id for r in none} == {None}
