import random
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackquarry import catalog
from stackquarry.functions import money
from stackquarry.operators import answers, budget, usage
from stackquarry.operators.budget import border_groups, budget_gate, starting_spend
from stackquarry.operators.ordered import ordered_chunks, running_total
from stackquarry.streaming.usage import budget_decisions, run_budget_gate

DAY = date(2024, 1, 1)
START = datetime(2024, 1, 1)
GATE = "user_id BIGINT, day DATE, ts TIMESTAMP, req_id BIGINT, est_micro BIGINT, cost_micro BIGINT, limit_micro BIGINT"


def test_cost_vectors(spark):
    models = [p[0] for p in catalog.PRICES] + ["unknown"]
    df = spark.createDataFrame([(m, 1000, 500) for m in models], "model_id STRING, i BIGINT, o BIGINT")
    rows = money.with_prices(df, catalog.prices(spark)).select(
        "model_id",
        money.cost_micro(F.col("i"), F.col("o")).alias("cost"),
        money.estimate_micro(F.col("i")).alias("est"),
        money.estimate_micro(F.col("i"), hosted=False).alias("local"),
    )
    got = {r.model_id: (r.cost, r.est, r.local) for r in rows.collect()}
    costs = [875000, 10500000, 215000, 1485000]
    assert got == {m: (c, c, 0) for m, c in zip(models, costs)} | {"unknown": (0, 10000, 0)}


def test_token_estimate_counts_bytes(spark):
    df = spark.createDataFrame([("éééé",), ("abc",), ("",)], "t STRING")
    assert [r[0] for r in df.select(money.token_estimate(F.col("t"))).collect()] == [2, 0, 0]


def test_usage_report_edges(spark):
    daily = spark.createDataFrame(
        [(1, DAY, 4_100_000, 2, 10, 0), (2, DAY, 4_995_000, 3, 1, None), (3, DAY, 0, 0, 0, 1_000_000)],
        "user_id BIGINT, day DATE, cost_micro BIGINT, requests BIGINT, tokens BIGINT, own BIGINT",
    )
    rows = {r.user_id: r for r in usage.usage_report(daily, "own").collect()}
    assert rows[1].limit_micro == 5_000_000 and rows[1].warn and not rows[1].exceeded
    assert rows[2].exceeded and rows[2].remaining_micro == 5000
    assert rows[3].avg_cost is None and rows[3].percent_used == 0.0


def gate_by_hand(rows, opening=None):
    spent, out = dict(opening or {}), {}
    for user, day, ts, req, est, cost, limit in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        before = spent.get((user, day), 0)
        ok = before + est <= limit
        out[req] = (ok, before)
        spent[user, day] = before + (cost if ok else 0)
    return out, spent


def decisions(df):
    return {r.req_id: (r.admitted, r.spent_before_micro) for r in df.collect()}


def test_gate_vector(spark):
    pairs = [(3, 2), (4, 4), (1, 1), (2, 9), (0, 0)]
    rows = [(1, DAY, START, i, e, c, 5) for i, (e, c) in enumerate(pairs)]
    got = decisions(budget_gate(spark.createDataFrame(rows, GATE)))
    assert [got[i][0] for i in range(5)] == [True, False, True, True, False]
    assert [got[i][1] for i in range(5)] == [0, 2, 2, 3, 12]


def random_requests(seed, n=600, cheap=False):
    """One user-day holds more than half of all rows; many share a time stamp."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user, day = (7, DAY) if rng.random() < 0.6 else (rng.randrange(12), DAY + timedelta(days=rng.randrange(3)))
        cost = 0 if cheap else rng.choice([0, 0, 1, 2, 5])
        rows.append((user, day, START + timedelta(seconds=rng.randrange(40)), i, rng.randrange(12), cost, 40))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_gate_with_a_hot_user_day(spark, seed):
    rows = random_requests(seed, cheap=seed == 3)
    df = spark.createDataFrame(rows, GATE)
    pieces = ordered_chunks(df.withColumn("opening", F.lit(0).cast("bigint")), ["user_id", "day"], ["ts", "req_id"], 9)
    assert len(border_groups(pieces)[(7, DAY)]) >= 4
    got = budget_gate(df, chunks=9)
    assert decisions(got) == gate_by_hand(rows)[0]
    for row in got.collect():
        assert (row.error is None) if row.admitted else row.error.startswith("daily budget exceeded. Remaining: $")


def test_free_requests_do_not_cost_a_round_per_chunk(spark, monkeypatch):
    """A nearly used-up budget with cheap free requests in every chunk."""
    rows = [(7, DAY, START, i, 10 if i % 2 else 30, 0 if i % 2 else 25, 50) for i in range(400)]
    df = spark.createDataFrame(rows, GATE)
    pieces = ordered_chunks(df.withColumn("opening", F.lit(0).cast("bigint")), ["user_id", "day"], ["ts", "req_id"], 12)
    folds = []
    original = budget._spend_after
    monkeypatch.setattr(budget, "_spend_after", lambda p, s: folds.append(len(s)) or original(p, s))
    starts = starting_spend(pieces)
    assert len(starts) == len(border_groups(pieces)[(7, DAY)]) and len(folds) == 1
    assert decisions(budget_gate(df, chunks=12)) == gate_by_hand(rows)[0]


def test_gate_with_opening_spend(spark):
    rows = random_requests(9)
    opening = {(7, DAY): 30, (1, DAY): 100}
    opened = spark.createDataFrame(
        [(u, d, s) for (u, d), s in opening.items()], "user_id BIGINT, day DATE, spent_micro BIGINT"
    )
    got = budget_gate(spark.createDataFrame(rows, GATE), chunks=9, opening=opened)
    assert decisions(got) == gate_by_hand(rows, opening)[0]


def test_running_total_with_a_hot_group(spark):
    rows = random_requests(5)
    df = spark.createDataFrame(rows, GATE)
    got = running_total(df, ["user_id", "day"], ["ts", "req_id"], "est_micro", "total", chunks=7)
    total, wanted = {}, {}
    for user, day, _, req, est, _, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        total[user, day] = total.get((user, day), 0) + est
        wanted[req] = total[user, day]
    assert {r.req_id: r.total for r in got.collect()} == wanted


def test_streamed_gate_equals_batch_on_ordered_input(spark, tmp_path):
    rows = sorted(random_requests(11), key=lambda r: (r[2], r[3]))
    source = tmp_path / "source"
    for i in range(3):
        part = spark.createDataFrame(rows[i * 200 : (i + 1) * 200], GATE)
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(GATE).option("maxFilesPerTrigger", 1).parquet(str(source))
    run_budget_gate(stream, str(tmp_path / "gate"))
    out = budget_decisions(spark, str(tmp_path / "gate"))
    assert out.select("batch_id").distinct().count() == 3
    # the micro-batches cut the rows by arrival, so the fold follows that order
    assert decisions(out) == gate_by_hand(rows)[0]


@pytest.mark.parametrize("chunks", [1, 4, 50])
def test_decisions_do_not_depend_on_the_chunks(spark, chunks):
    """Limits that differ by row, and requests without a user."""
    rng = random.Random(3)
    rows = [
        (None if i % 3 == 0 else 2**60 + i % 2, DAY, START + timedelta(seconds=i), i, rng.randrange(4), 5, (1000, 5)[i % 2])
        for i in range(120)
    ]
    got = budget_gate(spark.createDataFrame(rows, GATE), chunks=chunks)
    wanted = gate_by_hand([(-1 if r[0] is None else r[0], *r[1:]) for r in rows])[0]
    assert decisions(got) == wanted
    assert {r.user_id for r in got.collect()} == {None, 2**60, 2**60 + 1}


@pytest.mark.parametrize("chunks", [1, 4])
def test_running_spend_without_a_user(spark, chunks):
    rows = [(None, DAY, START + timedelta(seconds=i), i, 0, 1, 10) for i in range(40)]
    got = usage.running_spend(spark.createDataFrame(rows, GATE), chunks)
    assert sorted(r.spent_micro for r in got.collect()) == list(range(1, 41))


def test_streamed_gate_keeps_late_and_future_requests(spark, tmp_path):
    late = [(1, date(2024, 1, 10), START, 0, 1, 3, 5), (1, date(2099, 1, 1), START, 1, 1, 1, 5)]
    early = [(1, date(2024, 1, 1), START, 2, 1, 4, 5), (None, date(2024, 1, 10), START, 3, 1, 2, 5)]
    again = [(1, date(2024, 1, 10), START, 4, 3, 1, 5), (1, date(2024, 1, 1), START, 5, 1, 1, 5), (None, date(2024, 1, 10), START, 6, 4, 1, 5)]
    source = str(tmp_path / "source")
    for part in (late, early, again):
        spark.createDataFrame(part, GATE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(GATE).option("maxFilesPerTrigger", 1).parquet(source)
    run_budget_gate(stream, str(tmp_path / "gate"))
    got = decisions(budget_decisions(spark, str(tmp_path / "gate")))
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, 3), 5: (True, 4), 6: (False, 2)}


def test_fine_prices_cost_something(spark):
    prices = spark.createDataFrame([("m", "0.00025", "0.00125"), ("n", "0.0000005", "1")], "model_id STRING, i STRING, o STRING")
    prices = prices.selectExpr("model_id", "cast(i AS DECIMAL(18,7)) input_cost", "cast(o AS DECIMAL(18,7)) output_cost", "1 speed", "1 quality")
    asked = spark.createDataFrame([("m",)], "model_id STRING")
    million = F.lit(1_000_000)
    row = money.with_prices(asked, prices).select(money.cost_micro(million, million), money.estimate_micro(million)).first()
    assert tuple(row) == (1_500_000, 250_625)
    with pytest.raises(Exception, match="too fine"):
        money.with_prices(asked.select(F.lit("n").alias("model_id")), prices).select(money.cost_micro(million, million)).collect()


@pytest.fixture
def tiny_batches(spark):
    """Arrow batches of seven rows, so that groups go on from one batch to the next."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def test_gate_across_arrow_batches(spark, tiny_batches):
    rows = random_requests(21)
    assert decisions(budget_gate(spark.createDataFrame(rows, GATE), chunks=2)) == gate_by_hand(rows)[0]


@pytest.mark.parametrize("chunks", [1, 6])
@pytest.mark.parametrize("most", [None, 24])
def test_answers_within_budget(spark, tiny_batches, chunks, most):
    rng = random.Random(chunks)
    rows = [
        (7 if rng.random() < 0.6 else rng.randrange(4), DAY, START + timedelta(seconds=rng.randrange(20)), i,
         "why " * rng.randrange(1, 60), "{}", catalog.DEFAULT_MODEL, 6_000_000)
        for i in range(120)
    ]
    schema = "user_id BIGINT, day DATE, ts TIMESTAMP, req_id BIGINT, question STRING, context STRING, model_id STRING, limit_micro BIGINT"
    lost = (7, DAY, START, 999, "no context", None, catalog.DEFAULT_MODEL, 6_000_000)
    df = spark.createDataFrame([*rows, lost], schema)

    def echo(names, prompts):
        return pd.Series(["r" * (len(p) % 97) for p in prompts])

    got = {
        r.req_id: r
        for r in answers.answer_within_budget(df, echo, catalog.prices(spark), chunks=chunks, most_reply_tokens=most).collect()
    }
    prompts = {r.req_id: r.prompt for r in answers.prepare_prompts(df).collect()}
    spent = {}
    for user, _, _, req, *_, limit in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        before, tokens = spent.get(user, 0), len(prompts[req].encode()) // 4
        ok = before + tokens * 250 + 625_000 <= limit
        cost = tokens * 250 + (len(prompts[req]) % 97) // 4 * 1250 if ok else 0
        spent[user] = before + cost
        assert (got[req].admitted, got[req].spent_before_micro, got[req].cost_micro) == (ok, before, cost)
        assert (got[req].answer is None) == (not ok)
    assert any(not r.admitted for r in got.values()) and len(got) == 121
    assert not got[999].admitted and "run a scan first" in got[999].error


def test_reserved_prompts_go_out_together(spark):
    schema = "user_id BIGINT, day DATE, ts TIMESTAMP, req_id BIGINT, question STRING, context STRING, model_id STRING, limit_micro BIGINT"
    rows = [(1, DAY, START + timedelta(seconds=i), i, "why", "{}", catalog.DEFAULT_MODEL, 40_000_000) for i in range(60)]
    df = spark.createDataFrame(rows, schema)

    def decided(most):
        calls = spark.sparkContext.accumulator(0)

        def echo(names, prompts):
            calls.add(1)
            return pd.Series(["r" * 90] * len(prompts))

        kept = answers.answer_within_budget(df, echo, catalog.prices(spark), chunks=1, most_reply_tokens=most)
        found = sorted((r.req_id, r.admitted, r.spent_before_micro, r.cost_micro) for r in kept.collect())
        return found, calls.value

    one_by_one, many = decided(None)
    together, few = decided(30)
    assert one_by_one == together and any(row[1] for row in together)
    assert many == sum(row[1] for row in together) and few <= 1 + many // 10
    with pytest.raises(Exception, match="beyond the stated bound"):
        decided(3)
