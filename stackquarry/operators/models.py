"""Placing and choosing models: J03-J05, J08, K01-K03, W03, A04, P11, P21, F14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry import catalog
from stackquarry.functions.money import ESTIMATED_OUTPUT_TOKENS
from stackquarry.operators.ordered import running_best

# ---- fixed values: the request assumed when a model is chosen by budget -----
ASSUMED_INPUT_TOKENS = 1000
REQUESTS_PER_BUDGET = 10
# -----------------------------------------------------------------------------


def available_only(host_models: DataFrame, requirements: DataFrame) -> DataFrame:
    """Installed models that have a requirement row."""
    return host_models.join(requirements.select("name"), "name", "left_semi")


def place_models(hosts: DataFrame, requirements: DataFrame, host_models: DataFrame) -> DataFrame:
    """J03 with K01 and W03: the best installed model that fits each host, '' when none.

    Installed models meet the requirements by name, then their host by id, so the
    fit test is a filter on an equi-join and not a host x model product. The best
    of a host is a min over (priority, place in the list), aggregated partially.
    """
    wanted = requirements.select("pos", "name", "min_ram_gb", "min_cpus", "needs_gpu", "priority")
    installed = host_models.select("host_id", "name").join(wanted, "name")
    fitting = installed.join(hosts, "host_id").filter(
        (F.col("ram_gb") >= F.col("min_ram_gb"))
        & (F.col("cpu_cores") >= F.col("min_cpus"))
        & (~F.col("needs_gpu") | F.col("has_gpu"))
    )
    best = fitting.groupBy("host_id").agg(
        F.min_by("name", F.struct(-F.col("priority"), F.col("pos"))).alias("model")
    )
    return hosts.join(best, "host_id", "left").withColumn("model", F.coalesce("model", F.lit("")))


def display_names(df: DataFrame, requirements: DataFrame, name: str = "name") -> DataFrame:
    """Add ``label``: 'name (size)' for a known model, else the name."""
    sizes = requirements.select(F.col("name").alias("_known"), F.col("size").alias("_size"))
    return (
        df.join(sizes, F.col(name) == F.col("_known"), "left")
        .withColumn(
            "label",
            F.when(F.col("_size").isNull(), F.col(name)).otherwise(
                F.format_string("%s (%s)", name, "_size")
            ),
        )
        .drop("_known", "_size")
    )


def mark_current(df: DataFrame, requirements: DataFrame, name: str = "name", current: str = "current") -> DataFrame:
    """Label, is_current, and the requirement columns with the GPU need as Yes or No."""
    needs = requirements.select(
        F.col("name").alias("_need"), "min_ram_gb", "min_cpus",
        F.when(F.col("needs_gpu"), F.lit("Yes")).otherwise(F.lit("No")).alias("gpu"),
    )
    return (
        display_names(df, requirements, name)
        .withColumn("is_current", F.coalesce(F.col(name) == F.col(current), F.lit(False)))
        .join(needs, F.col(name) == F.col("_need"), "left")
        .drop("_need")
    )


def host_summary(cpu_cores: Column, ram_gb: Column, has_gpu: Column, gpu_type: Column) -> Column:
    """F14."""
    gpu = F.when(has_gpu, F.concat(gpu_type, F.lit(" GPU"))).otherwise(F.lit("No GPU"))
    return F.concat(
        F.lit("CPU: "), cpu_cores.cast("string"), F.lit(" cores, RAM: "), ram_gb.cast("string"),
        F.lit(" GB, "), gpu,
    )


def _catalog_array(rows: list[tuple]) -> Column:
    """The price catalog as one array literal; a catalog handed over as a Python list
    is bounded by what the caller typed."""
    return F.array(
        *[
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(model).alias("model_id"),
                F.lit(i).cast("decimal(18,6)").alias("input_cost"),
                F.lit(o).cast("decimal(18,6)").alias("output_cost"),
                F.lit(speed).alias("speed"),
                F.lit(quality).alias("quality"),
            )
            for pos, (model, i, o, speed, quality) in enumerate(rows)
        ]
    )


def _needed(input_cost: Column, output_cost: Column) -> Column:
    """The least daily budget for which a model is affordable."""
    tokens_in, tokens_out = (F.lit(n / 1000).cast("decimal(4,1)") for n in (ASSUMED_INPUT_TOKENS, ESTIMATED_OUTPUT_TOKENS))
    return (input_cost * tokens_in + output_cost * tokens_out) * REQUESTS_PER_BUDGET


def select_model(
    budgets: DataFrame,
    models: list[tuple] = catalog.PRICES,
    default: str = catalog.DEFAULT_MODEL,
) -> DataFrame:
    """Budgets (budget_id, daily_budget, prioritize_speed) gain ``model_id``.

    The choice is worked out inside each row against the catalog literal: no join
    and no shuffle. A model is affordable when its assumed request costs at most a
    tenth of the budget; the default model wins when affordable or when nothing is;
    without it the best by speed or quality, or the cheapest.
    """
    rows = _catalog_array(models)

    affordable = F.filter(rows, lambda m: _needed(m["input_cost"], m["output_cost"]) <= F.col("daily_budget"))

    def best(first: str, second: str) -> Column:
        ranked = F.transform(
            affordable, lambda m: F.struct(m[first], m[second], (-m["pos"]).alias("earlier"), m["model_id"])
        )
        return F.array_max(ranked)["model_id"]

    cheapest = F.array_min(
        F.transform(
            rows,
            lambda m: F.struct((m["input_cost"] + m["output_cost"]).alias("price"), m["pos"], m["model_id"]),
        )
    )["model_id"]
    has_default = default in [m[0] for m in models]
    default_affordable = F.exists(affordable, lambda m: m["model_id"] == default)
    chosen = (
        F.when(F.size(affordable) == 0, F.lit(default) if has_default else cheapest)
        .when(default_affordable, F.lit(default))
        .when(F.col("prioritize_speed"), best("speed", "quality"))
        .otherwise(best("quality", "speed"))
    )
    return budgets.withColumn("model_id", chosen)


def select_model_from(
    budgets: DataFrame, prices: DataFrame, default: str = catalog.DEFAULT_MODEL, chunks: int | None = None
) -> DataFrame:
    """J08 over a table of prices (pos, model_id, input_cost, output_cost, speed, quality) of
    any size: ``budgets`` gain ``model_id`` by the rules of ``select_model``.

    The best model within a budget only changes where a price is crossed, so it is the best
    so far along the prices in the order of their cost. Prices and budgets are range-sorted
    together by that cost; each budget takes what is best up to its own place. No budget
    meets a list of models, and equal budgets spread over chunks.
    """
    rank = {name: (name, other) for name, other in (("speed", "quality"), ("quality", "speed"))}
    steps = prices.select(
        _needed(F.col("input_cost"), F.col("output_cost")).cast("decimal(38,8)").alias("_at"),
        *[
            F.struct(F.col(a), F.col(b), (-F.col("pos")).alias("earlier"), "model_id").alias(f"_{name}")
            for name, (a, b) in rank.items()
        ],
    ).filter(F.col("_at").isNotNull())
    own = F.struct(*budgets.columns)
    asked = budgets.select(F.col("daily_budget").cast("decimal(38,8)").alias("_at"), own.alias("_own"))
    # A price comes before the budgets that just reach it.
    both = steps.withColumn("_kind", F.lit(0)).unionByName(asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_nth", F.monotonically_increasing_id())
    found = running_best(both, [], ["_at", "_kind", "_nth"], {f"_best_{name}": f"_{name}" for name in rank}, chunks).filter("_kind = 1")
    own_price = F.col("model_id") == default
    known = prices.agg(
        F.min_by("model_id", F.struct((F.col("input_cost") + F.col("output_cost")).alias("price"), "pos")).alias("cheapest"),
        F.max(own_price).alias("has_default"),
        F.min(F.when(own_price, _needed(F.col("input_cost"), F.col("output_cost")))).alias("default_at"),
    )
    cheapest, has_default, default_at = (known.select(name).scalar() for name in ("cheapest", "has_default", "default_at"))
    chosen = (
        F.when(F.col("_best_speed").isNull(), F.when(has_default, F.lit(default)).otherwise(cheapest))
        .when(default_at <= F.col("_at"), F.lit(default))
        .when(F.col("_own.prioritize_speed"), F.col("_best_speed.model_id"))
        .otherwise(F.col("_best_quality.model_id"))
    )
    return found.select("_own.*", chosen.alias("model_id"))


def cheapest_model(prices: DataFrame, *by: str) -> DataFrame:
    """Smallest input + output price, first in list order on ties."""
    return prices.groupBy(*by).agg(
        F.min_by(
            "model_id", F.struct((F.col("input_cost") + F.col("output_cost")).alias("price"), "pos")
        ).alias("model_id")
    )


def first_working_model(probes: DataFrame, preference: list[str] = catalog.MODEL_PREFERENCE) -> DataFrame:
    """Per account the first preferred model whose probe succeeded, '' when none."""
    rank = F.array_position(F.array(*[F.lit(m) for m in preference]), F.col("model_id"))
    usable = F.col("ok") & (rank > 0)
    return probes.groupBy("account").agg(
        F.coalesce(F.min_by("model_id", F.when(usable, rank)), F.lit("")).alias("model_id")
    )


def provider_rows(models: DataFrame) -> DataFrame:
    """Missing texts become Unknown; label is 'name (id)'."""
    known = {c: F.coalesce(c, F.lit("Unknown")) for c in ("provider", "model_name", "model_id")}
    return models.withColumns(known).withColumn(
        "label", F.format_string("%s (%s)", "model_name", "model_id")
    )


def models_by_provider(models: DataFrame) -> DataFrame:
    """The listing as rows (provider, pos, label) with the size of its provider
    group and the grand total.

    The group stays a set of rows in input order (pos) instead of one list value,
    so a provider with a third of all models is never gathered in one task. The
    grand total is a scalar subquery.
    """
    rows = provider_rows(models).select("provider", "pos", "label")
    sizes = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("provider_total"))
    grand_total = models.agg(F.count(F.lit(1)).alias("grand_total")).scalar()
    return rows.join(sizes, "provider").withColumn("grand_total", grand_total)


def best_per_group(df: DataFrame, keys: list[str], ranking: list[Column], value: str) -> DataFrame:
    """W03 in general form: per key the ``value`` of the row that sorts first by
    ``ranking`` (ascending expressions), as a partial aggregate instead of a window."""
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(ranking)])
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))
