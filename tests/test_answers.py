import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackquarry import wording
from stackquarry.functions.answers import (
    answer_prompt,
    clean_response,
    extract_response,
    intent_prompt,
    request_body,
)
from stackquarry.functions.redact import numbered_entries, numbered_text, scrub, text_pieces
from stackquarry.operators import accounts, answers, costs, selection, triggers

LONG = "Based on x. " + "S2 " * 180 + ". S3. S4."


@pytest.mark.parametrize(
    "text,clean",
    [
        ("\n a \n\n\n SourceArn: z\n b ", "a\nb"),
        ("S1. Based on x. S3. " + "S4 " * 200, "S1. S3."),
        ("Based on a. From the context b. Based on c. " + "x" * 500, None),
        ("é" * 251 + ". b. c. d", "é" * 251 + ". b. c."),
        ("é" * 240 + ". b. c. d", None),
        ("So, in summary:  yes ", "yes"),
        ("DemoApi Permission\nDemoApi\nAction: lambda:InvokeFunction\nAction:", "DemoApi\nAction:"),
        ("", ""),
    ],
)
def test_clean_response(spark, text, clean):
    row = spark.createDataFrame([(text,)], "t STRING").select(clean_response(F.col("t")).alias("c")).first()
    assert row.c == (text.strip() if clean is None else clean)


def test_prompts_keep_odd_characters(spark):
    df = spark.createDataFrame([("{question} %s $1 \\1", "{context}")], "c STRING, q STRING")
    row = df.select(answer_prompt(F.col("c"), F.col("q")).alias("p"), intent_prompt(F.col("q")).alias("i")).first()
    head, rest = wording.ANSWER_PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    assert row.p == head + "{question} %s $1 \\1" + middle + "{context}" + tail
    assert row.i == wording.INTENT_PROMPT + "{context}"


@pytest.mark.parametrize(
    "kind,model,body",
    [
        ("bedrock", "anthropic.x", {"prompt": "p", "max_tokens": 10, "temperature": 0.5, "top_p": 1, "anthropic_version": "bedrock-2023-05-31"}),
        ("bedrock", "amazon.titan-x", {"inputText": "p", "textGenerationConfig": {"maxTokenCount": 10, "temperature": 0.5, "topP": 1}}),
        ("bedrock", "meta.llama3", {"prompt": "p", "max_gen_len": 10, "temperature": 0.5, "top_p": 1}),
        ("sagemaker", "any", {"prompt": "p", "max_tokens": 10, "temperature": 0.5}),
        ("openai", "any", {"messages": [{"role": "user", "content": "p"}], "max_tokens": 10, "temperature": 0.5}),
        ("bedrock", "openai.gpt-4o", None),
        ("other", "anthropic.x", None),
    ],
)
def test_request_body(spark, kind, model, body):
    df = spark.createDataFrame([(kind, model)], "k STRING, m STRING")
    got = df.select(request_body(F.col("k"), F.col("m"), F.lit("p"), F.lit(10), F.lit(0.5)).alias("b")).first().b
    assert (json.loads(got) if got else None) == body


@pytest.mark.parametrize(
    "kind,model,body,text,error",
    [
        ("bedrock", "anthropic.x", '{"completion":" a\\n"}', "a", None),
        ("bedrock", "anthropic.x", "{}", "", None),
        ("bedrock", "anthropic.x", '{"completion":5}', None, "failed to parse anthropic response"),
        ("bedrock", "amazon.titan-x", '{"results":[{"outputText":"t"},{"outputText":"u"}]}', "t", None),
        ("bedrock", "amazon.titan-x", '{"results":[]}', "", None),
        ("bedrock", "meta.llama3", '{"generation":"g"}', "g", None),
        ("sagemaker", "", '{"response":"","output":"o","text":"t"}', "o", None),
        ("sagemaker", "", '{"text":"t"}', "t", None),
        ("openai", "", '{"choices":[{"message":{"content":"c"}}]}', "c", None),
        ("openai", "", '{"choices":[]}', None, "no response from model"),
        ("openai", "", "oops", None, "failed to parse openai response"),
        ("bedrock", "openai.gpt-4o", "{}", None, "unsupported Bedrock model: openai.gpt-4o"),
    ],
)
def test_extract_response(spark, kind, model, body, text, error):
    df = spark.createDataFrame([(kind, model, body)], "k STRING, m STRING, b STRING")
    row = df.select(extract_response(F.col("k"), F.col("m"), F.col("b")).alias("r")).first().r
    assert (row.text, row.error) == (text, error)


def test_answer_batch_order_of_steps(spark):
    questions = spark.createDataFrame(
        [(1, "p", "Which lambda uses 10.0.0.1?"), (2, "p", "Costs?"), (3, "gone", "x")],
        "req_id BIGINT, project STRING, question STRING",
    )
    documents = spark.createDataFrame([("p", '{"b": "s3://bkt/x", "a": 1}')], "project STRING, doc STRING")
    asked = answers.question_context(questions, documents)

    def backend(names, prompts):
        assert not prompts.str.contains(r"10\.0\.0\.1|s3://").any()
        context = prompts.str.extract(r"CONTEXT ---\n(.*)\n--- END", expand=False)
        return "However, since " + names + " saw " + context + ". [[IP_1]] [[S3_1]] SourceArn"[:-10]

    rows = {r.req_id: r for r in answers.answer_batch(asked, backend).collect()}
    assert rows[1].answer == 'arch saw {"a":1,"b":"s3://bkt/x"}. 10.0.0.1 [[S3_1]]'
    assert rows[2].backend == "general" and rows[2].answer == 'general saw {"a":1,"b":"s3://bkt/x"}. [[IP_1]] s3://bkt/x'
    assert rows[3].answer is None and rows[3].error == wording.NO_SNAPSHOT

    @F.pandas_udf("string")
    def classify(q: pd.Series) -> pd.Series:
        return q.str.len().map(lambda n: "arch" if n < 10 else "general")

    routed = answers.answer_batch(asked, backend, classifier=classify).collect()
    assert {r.req_id: r.backend for r in routed} == {1: "general", 2: "arch", 3: "arch"}


def test_a_shared_context_is_redacted_once(spark):
    odd = "x\u0001[[IP_70]]\u0001\u0002 [[ARN_90]] 10.1.2.3 arn:aws:x:y:1:z s3://b/c 123456789012 10.1.2.3"
    documents = spark.createDataFrame([("p", json.dumps({"k": odd})), ("q", "{}"), ("r", None)], "project STRING, doc STRING")
    asked = [(k, p, q) for k, (p, q) in enumerate((p, q) for p in ("p", "q", "r", "none") for q in ("Hi", "s3://z 10.0.0.9 and 10.0.0.8", None))]
    questions = spark.createDataFrame(asked, "req_id BIGINT, project STRING, question STRING")
    whole = answers.prepare_prompts(answers.question_context(questions, documents))
    pieces = answers.prepare_prompts(answers.redacted_context(questions, documents))
    columns = ["req_id", "prompt", "backend", F.to_json(F.struct("redactions"))]
    wanted = {r[0]: tuple(r) for r in whole.select(*columns).collect()}
    got = {r[0]: tuple(r) for r in pieces.select(*columns).collect()}
    assert got == wanted

    def backend(names, prompts):
        return prompts.str.extract(r"CONTEXT ---\n(.*)\n--- END", expand=False)

    rows = {r.req_id: r for r in answers.answer_batch(answers.redacted_context(questions, documents), backend).collect()}
    assert json.loads(rows[1].answer) == {"k": odd}
    assert rows[3].answer == "{}" and rows[9].error == wording.NO_SNAPSHOT


def test_pieces_of_raw_texts(spark):
    texts = ["", "\u0001", "\u0001[[IP_1]]10.0.0.1\u0001\u0002[[IP_1]]", "10.0.0.110.0.0.1", "arn:a s3://b 123456789012,1.2.3.4", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k INT, t STRING")
    direct = scrub(frame.withColumn("q", F.lit("1.1.1.1 and arn:x")), ["q", "t"])
    parts = frame.select("k", text_pieces(F.col("t")).alias("p"))
    got = {r.k: (r.t, r.e) for r in parts.select("k", numbered_text(F.col("p"), F.lit(2)).alias("t"), numbered_entries(F.col("p"), F.lit(2)).alias("e")).collect()}
    for row in direct.collect():
        assert got[row.k] == (row.scrubbed_t, None if row.t is None else row.redactions[2:])


def test_patterns_run_below_the_join(spark):
    documents = spark.createDataFrame([("p", "{}")], "project STRING, doc STRING")
    questions = spark.createDataFrame([(1, "p", "x")], "req_id BIGINT, project STRING, question STRING")
    ready = answers.prepare_prompts(answers.redacted_context(questions, documents))
    above, below = ready._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)
    # above the join the patterns read questions only, below it one context per project
    assert below.count("regexp_extract_all") >= 4
    whole = answers.prepare_prompts(answers.question_context(questions, documents))
    whole_above, _ = whole._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter", 1)
    assert above.count("regexp_extract_all") < whole_above.count("regexp_extract_all")


def test_top_cost(spark):
    paid = [("2024-01-10", "a", 5), ("2024-01-10", "b", 5), ("2024-01-03", "c", 100), ("2024-01-04", "c", 3), ("2024-01-09", "a", 1), ("2024-01-11", "z", 999)]
    spend = spark.createDataFrame(paid, "d STRING, service STRING, amount_cents BIGINT").selectExpr(
        "to_date(d) AS usage_date", "service", "amount_cents"
    )
    asked = spark.createDataFrame(
        [(1, "7 days", 2), (2, "1 day", 5), (3, "2 weeks", 1), (4, "soon", 1), (5, "7 days", 3)],
        "question_id BIGINT, period STRING, top INT",
    ).selectExpr("question_id", "period", "top", "DATE'2024-01-10' AS as_of")
    asked = asked.withColumn("days", costs.period_days(F.col("period")))
    rows = costs.top_cost(asked, spend).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r["rank"], r.service, r.amount_cents) for r in rows] == [
        (1, 1, "a", 6), (1, 2, "b", 5), (2, 1, "a", 5), (2, 2, "b", 5), (3, 1, "c", 103),
        (5, 1, "a", 6), (5, 2, "b", 5), (5, 3, "c", 3),
    ]


def test_top_cost_of_any_periods(spark):
    draw = random.Random(5)
    first = datetime.date(2024, 1, 1)
    paid = [(first + datetime.timedelta(draw.randint(0, 60)), draw.choice(["a", "b", "c", "d", None]), draw.choice([None, -3, 0, 5, 5, 9])) for _ in range(300)]
    paid += [(None, "a", 7)] + [(first, f"s{k}", 1) for k in range(40)]
    asked = [(k, first + datetime.timedelta(draw.randint(-5, 80)), draw.choice([0, 1, 3, 30, 10**9, None]), draw.randint(0, 50)) for k in range(60)]
    asked.append((99, None, 7, 3))
    got = costs.top_cost(
        spark.createDataFrame(asked, "question_id BIGINT, as_of DATE, days INT, top INT"),
        spark.createDataFrame(paid, "usage_date DATE, service STRING, amount_cents BIGINT"),
    ).collect()
    wanted = []
    for k, as_of, days, top in asked:
        sums = {}
        for day, service, cents in paid if as_of and days else ():
            if day and day <= as_of and (as_of - day).days < days:
                sums.setdefault(service, []).append(cents)
        sums = {s: sum(c for c in cents if c is not None) if any(c is not None for c in cents) else None for s, cents in sums.items()}
        order = sorted(sums.items(), key=lambda p: (p[1] is None, -(p[1] or 0), p[0] is not None, p[0] or ""))
        wanted += [(k, n, service, cents) for n, (service, cents) in enumerate(order[:top], 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


@pytest.mark.parametrize("chunks", [None, 7])
def test_top_rows(spark, chunks):
    draw = random.Random(6)
    edge = [0, 1, -1, 63, 64, -(2**63), 2**63 - 1, 2**53, 2**53 + 1, None]
    rows = [("hot", draw.choice(edge), k) for k in range(2000)] + [("ties", 5, k) for k in range(500)]
    rows += [(g, draw.randint(-(10**6), 10**6), k) for g in ("x", "y", None) for k in range(100)] + [("few", 1, 0)]
    most = {"hot": 777, "ties": 100, "x": 10, "y": 1, None: 100, "few": 50}
    df = spark.createDataFrame([(g, v, n, most[g]) for g, v, n in rows], "g STRING, v BIGINT, n INT, k INT")
    got = selection.top_rows(df, ["g"], "v", ["n"], "k", chunks=chunks).select("g", "v", "n", "rank").collect()
    wanted = []
    for g, k in most.items():
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        wanted += [(*r, place) for place, r in enumerate(own[:k], 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    bins = [r.b for r in spark.createDataFrame([(v,) for v in sorted(v for v in edge if v is not None)], "v BIGINT").select(selection.value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and len(set(bins)) >= 7


def test_triggers(spark):
    rows = spark.createDataFrame(
        [("f", "sqs", "1"), ("f", "s3", "2"), ("g", "s3", "3")], "function_name STRING, source_type STRING, source_arn STRING"
    )
    asked = spark.createDataFrame([(1, "f"), (2, "f"), (3, "none")], "question_id BIGINT, function_name STRING")
    counts = {r.question_id: r.trigger_count for r in triggers.trigger_counts(asked, rows).collect()}
    assert counts == {1: 2, 2: 2, 3: 0}
    assert triggers.triggers_of_asked(asked, rows).count() == 2


def test_accounts(spark):
    quotas = spark.createDataFrame(
        [("a", "L-DB2E81BA", 0.0), ("a", "L-1216C47A", 8.0), ("b", "L-DB2E81BA", 4.0), ("c", "L-1216C47A", None)],
        "account STRING, quota_code STRING, value DOUBLE",
    )
    status = {(r.account, r.quota_code): r.status for r in accounts.classify_quota(quotas).collect()}
    assert status["a", "L-DB2E81BA"] == "BLOCKED" and status["c", "L-1216C47A"] == "could not check"
    advice = {r.account: r for r in accounts.quota_recommendation(quotas).collect()}
    assert advice["a"].gpu_advice == "request L-DB2E81BA to 4 vCPU" and advice["a"].standard_advice == "deploy t3.medium"
    assert advice["b"].gpu_advice == "deploy g4dn.xlarge" and advice["b"].standard_advice.startswith("request")
    assert advice["c"].options == "managed model or request quota"


@pytest.mark.parametrize(
    "model,body,text,error",
    [
        ("amazon.titan-text-express-v1", '{"results":{"outputText":"x"}}', None, "failed to parse titan response"),
        ("amazon.titan-text-express-v1", '{"results":["x"]}', None, "failed to parse titan response"),
        ("amazon.titan-text-express-v1", '{"results":null}', "", None),
        ("amazon.titan-text-express-v1", '{"results":[{"outputText":" x "}]}', "x", None),
    ],
)
def test_containers_of_replies(spark, model, body, text, error):
    df = spark.createDataFrame([(model, body)], "m STRING, b STRING")
    row = df.select(extract_response(F.lit("bedrock"), F.col("m"), F.col("b")).alias("r")).first().r
    assert (row.text, row.error) == (text, error)
