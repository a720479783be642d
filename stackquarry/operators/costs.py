"""Top services by cost over a period: A09.

Costs are summed per day and service, and then along the days of each service, range-sorted
over the cluster. A period costs two look-ups into these running sums, one at its end and one
before its begin, however many days lie between: each running sum holds from its day up to
the service's next one, so it is handed to the borders of periods that fall between, found by
number in the sorted borders. Each distinct (as_of, days) period is worked out once and joined
to its questions at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.operators.ordered import join_same, running_total, running_totals
from stackquarry.operators.selection import top_rows
from stackquarry.sources.checkpoints import written

#: Days beyond which dates could no longer be computed.
LONGEST = 1_000_000
SUMMED = ("cents", "rows", "known")
# ---- fixed values: days per unit of a period --------------------------------
PERIOD_UNITS = [("day", 1), ("week", 7), ("month", 30), ("year", 365)]
# -----------------------------------------------------------------------------


def period_days(period: Column) -> Column:
    """'7 days' -> 7, '2 weeks' -> 14; NULL when it cannot be read."""
    number = F.regexp_extract(period, r"(?i)(\d+)\s*(day|week|month|year)", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(period, r"(?i)(\d+)\s*(day|week|month|year)", 2))
    factor = F.coalesce(*[F.when(unit == name, F.lit(days)) for name, days in PERIOD_UNITS])
    return F.try_multiply(number, factor)


def top_cost(questions: DataFrame, costs: DataFrame) -> DataFrame:
    """questions: question_id, as_of, days, top. costs: usage_date, service, amount_cents.

    Rows (question_id, rank, service, amount_cents): sums over (as_of - days, as_of],
    the ``top`` largest, ties by service name.
    """
    periods = questions.filter(F.col("days") > 0).groupBy("as_of", "days").agg(F.max("top").alias("most"))
    # The begin excludes its own day: what had been spent by then does not count.
    begin = F.date_sub("as_of", F.least(F.col("days"), F.lit(LONGEST)))
    periods = periods.withColumns({"begin": begin, "end": F.col("as_of")}).filter(F.col("end").isNotNull())
    paid = spent_by(costs, periods.select("begin").union(periods.select("end")).toDF("border"))
    ends = periods.join(paid.withColumnRenamed("border", "end"), "end")
    begins = paid.withColumnsRenamed({"border": "begin", **{c: f"{c}_before" for c in SUMMED}})

    def within(column: str) -> Column:
        return F.col(column) - F.coalesce(f"{column}_before", F.lit(0))

    sums = (
        join_same(ends, begins, ["begin", "service"], "left")
        # a service without a row within the period has no place in it
        .filter(within("rows") > 0)
        .select("as_of", "days", "most", "service", F.when(within("known") > 0, within("cents")).alias("amount_cents"))
    )
    ranked = top_rows(sums, ["as_of", "days"], "amount_cents", ["service"], "most")
    return questions.join(
        ranked.select("as_of", "days", "rank", "service", "amount_cents"), ["as_of", "days"]
    ).filter(F.col("rank") <= F.col("top")).select("question_id", "rank", "service", "amount_cents")


def spent_by(costs: DataFrame, borders: DataFrame) -> DataFrame:
    """border, service, cents, rows and known (rows with an amount): sums of a service's costs
    up to and including each distinct border; none for services that had no row by then.

    Rows: borders x services that have costs by then, which the answer needs; the days
    between borders cost nothing.
    """
    daily = costs.filter(F.col("usage_date").isNotNull()).groupBy("usage_date", "service").agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("cents"),
        F.count(F.lit(1)).alias("rows"),
        F.count("amount_cents").alias("known"),
    )
    sums = running_totals(daily, ["service"], ["usage_date"], {f"{c}_through": c for c in SUMMED})
    # Borders and days in one order: how many borders lie before each day.
    marks = borders.distinct().select(F.col("border").alias("date"), F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("one"))
    days = daily.select(F.col("usage_date").alias("date"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("one")).distinct()
    placed = written(running_total(marks.union(days), [], ["date", "kind"], "one", "through"), "border_places")
    numbers = placed.filter("kind = 1").select(F.col("date").alias("border"), F.col("through").alias("number"))
    before = placed.filter("kind = 0").select("date", "through")
    count = numbers.agg(F.max("number").alias("n")).scalar()
    later = Window.partitionBy("service").orderBy("usage_date")
    spans = sums.join(before, sums["usage_date"] == before["date"]).select(
        "service", *[F.col(f"{c}_through").alias(c) for c in SUMMED], (F.col("through") + 1).alias("low"),
        F.coalesce(F.lead("through").over(later), count).alias("high"),
    )
    held = spans.filter(F.col("low") <= F.col("high")).withColumn("number", F.explode(F.sequence("low", "high")))
    return held.join(numbers, "number").select("border", "service", *SUMMED)
