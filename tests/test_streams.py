from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stackquarry import catalog
from stackquarry.functions.redact import scrub
from stackquarry.operators import usage
from stackquarry.operators.budget import budget_gate
from stackquarry.operators.pairs import make_pairs
from stackquarry.streaming import runs, texts
from stackquarry.streaming.state_log import StateLog
from stackquarry.streaming.usage import add_daily_usage, budget_decisions, run_budget_gate, spend_log, summed_daily_usage, usage_log

USAGE = "user_id BIGINT, req_id BIGINT, ts TIMESTAMP, model_id STRING, input_tokens BIGINT, output_tokens BIGINT"


def in_files(spark, rows, schema, path, n):
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_daily_usage_over_batches(spark, tmp_path):
    rows = [
        (i % 3 or None, i, datetime(2024, 1, 1) + timedelta(hours=37 * i % 100), catalog.PRICES[i % 4][0], i, 2 * i)
        for i in range(100)
    ]
    rows[5] = (1, 5, datetime(2099, 1, 1), "unknown", 1, 1)
    path = str(tmp_path / "usage")
    in_files(spark, rows, USAGE, path, 4)
    stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", 1).parquet(path)
    folder = str(tmp_path / "sums")
    add_daily_usage(usage.priced_usage(stream, catalog.prices(spark)), folder)
    got = summed_daily_usage(spark, folder)
    wanted = usage.daily_usage(usage.priced_usage(spark.read.schema(USAGE).parquet(path), catalog.prices(spark)))
    assert usage_log(spark, folder)._manifests()[-1] >= 3
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.select(*got.columns).collect()))


def test_scrub_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"lambda at 10.0.0.{i}", "s3://b/x " * (i % 3)) for i in range(30)]
    schema = "id BIGINT, question STRING, context STRING"
    path = str(tmp_path / "questions")
    in_files(spark, rows, schema, path, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = runs.to_table(texts.stream_scrub_route(stream), "scrub")
    wanted = scrub(spark.read.schema(schema).parquet(path).withColumn("backend", F.lit("arch")), ["question", "context"])
    assert sorted(map(str, got.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_pairs_stream_reads_each_file_once(spark, tmp_path):
    raw, out, progress = (str(tmp_path / n) for n in ("raw", "train", "progress"))
    schema = "Type STRING, FunctionName STRING, Arn STRING"
    for day in range(2):
        rows = [("Lambda", f"f{day}", "a"), ("Table", "t", "b")]
        spark.createDataFrame(rows, schema).write.option("compression", "gzip").json(f"{raw}/2024010{day + 1}")
        counts: dict[int, int] = {}
        texts.stream_pairs(spark, raw, out, progress, counts=counts)
        assert sum(counts.values()) == 1
    got = spark.read.schema("prompt STRING, completion STRING").json(out)
    assert sorted(r.prompt for r in got.collect()) == ["What triggers the f0 Lambda?", "What triggers the f1 Lambda?"]
    assert got.columns == make_pairs(spark.createDataFrame([], schema)).columns


def test_a_log_stays_small_and_survives_retries(spark, tmp_path):
    def log():
        return StateLog(spark, str(tmp_path / "log"), ["k"], {"n": F.sum("n").cast("bigint")}, "k BIGINT, n BIGINT", limit=3)

    def add(batch, rows):
        log().append(batch, spark.createDataFrame(rows, "k BIGINT, n BIGINT").coalesce(1))

    assert log().rows().count() == 0
    total = {}
    for batch in range(30):
        rows = [(batch % 4 or None, batch), (7, 1)]
        for k, n in rows:
            total[k] = total.get(k, 0) + n
        if batch % 6 == 5:  # a run that failed after its work, and one that failed before it published
            add(batch, [(1, 10_000)])
            log()._written(spark.createDataFrame([(1, 1)], "k BIGINT, n BIGINT"))
        add(batch, rows)
        assert len(list((tmp_path / "log" / "tables").iterdir())) <= 2 * 3 * 4
    assert {r.k: r.n for r in log().merged_rows().collect()} == total
    before = {r.k: r.n for r in log().merged_rows(before=29).collect()}
    assert before[7] == 29 and len(log()._manifests()) == 2
    assert len(log()._state(None)[1]) <= 2 * 4


def test_the_streamed_gate_over_batches_that_share_days(spark, tmp_path):
    schema = "user_id BIGINT, req_id BIGINT, ts TIMESTAMP, day DATE, est_micro BIGINT, cost_micro BIGINT, limit_micro BIGINT"
    start = datetime(2024, 1, 1)
    rows = [
        ((i // 3) % 3 or None, i, start + timedelta(minutes=7 * i), (start + timedelta(minutes=7 * i)).date(), 5, i % 11, 150)
        for i in range(600)
    ]
    folder, path = str(tmp_path / "gate"), str(tmp_path / "requests")
    for low in range(0, 600, 150):
        spark.createDataFrame(rows[low : low + 150], schema).coalesce(2).write.mode("append").parquet(path)
        run_budget_gate(spark.readStream.schema(schema).parquet(path), folder)
    got = budget_decisions(spark, folder).select("req_id", "admitted", "spent_before_micro")
    wanted = budget_gate(spark.createDataFrame(rows, schema)).select("req_id", "admitted", "spent_before_micro")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert not all(r.admitted for r in got.collect())
    assert {batch for batch in spend_log(spark, folder)._manifests()} == {2, 3}


def test_pairs_are_counted_per_batch(spark, tmp_path):
    raw, out, progress = (str(tmp_path / n) for n in ("raw", "train", "progress"))
    for n in range(5):
        rows = [("Lambda", f"f{n}-{k}", "a") for k in range(n)] + [("Table", "t", "b")]
        spark.createDataFrame(rows, "Type STRING, FunctionName STRING, Arn STRING").coalesce(1).write.json(f"{raw}/{n}")
    counts: dict[int, int] = {}
    texts.stream_pairs(spark, raw, out, progress, max_files=1, counts=counts)
    assert len(counts) == 5 and sorted(counts.values()) == [0, 1, 2, 3, 4]
    assert sum(counts.values()) == spark.read.schema("prompt STRING, completion STRING").json(out).count()
