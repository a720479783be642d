import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackquarry.functions.redact import redaction_rows, scrub, unscrub, unscrub_with_rows

VECTORS = [
    (
        "Who calls arn:aws:lambda:us-east-1:123456789012:function:f from 10.0.0.1?",
        '{"a":"s3://logs-123456789012/x","b":"10.0.0.1","c":"123456789012"}',
        "Who calls [[ARN_1]] from [[IP_2]]?",
        '{"a":"[[S3_6]][[ACCOUNT_ID_3]]/x","b":"[[IP_5]]","c":"[[ACCOUNT_ID_4]]"}',
    ),
    (
        "see arn:aws:s3:::b.",
        "v 999.999.999.999 1.2.3.4.5 x12345678901234",
        "see [[ARN_1]]",
        "v [[IP_2]] [[IP_3]].5 x12345678901234",
    ),
    ("é123456789012", "", "é[[ACCOUNT_ID_1]]", ""),
    ("nothing here", None, "nothing here", None),
]


def both(df):
    out = scrub(df, ["question", "context"])
    return out.withColumns(
        {
            "q": unscrub(F.col("scrubbed_question"), F.col("redactions")),
            "c": unscrub(F.col("scrubbed_context"), F.col("redactions")),
        }
    )


@pytest.mark.parametrize("question,context,hidden_question,hidden_context", VECTORS)
def test_vectors(spark, question, context, hidden_question, hidden_context):
    df = spark.createDataFrame([(question, context)], "question STRING, context STRING")
    row = both(df).first()
    assert (row.scrubbed_question, row.scrubbed_context) == (hidden_question, hidden_context)
    assert (row.q, row.c) == (question, context)
    assert [e.idx for e in row.redactions] == list(range(1, len(row.redactions) + 1))


def test_side_table(spark):
    df = spark.createDataFrame(
        [(i, q, c) for i, (q, c, _, _) in enumerate(VECTORS)], "req BIGINT, question STRING, context STRING"
    )
    hidden = scrub(df, ["question", "context"])
    rows = redaction_rows(hidden, "req")
    assert rows.filter("req = 0").count() == 6 and rows.filter("req = 3").count() == 0
    back = unscrub_with_rows(hidden.select("req", "scrubbed_question"), rows, "req", "scrubbed_question", "question")
    assert {r.req: r.question for r in back.collect()} == {i: v[0] for i, v in enumerate(VECTORS)}


def test_unknown_and_odd_placeholders(spark):
    df = spark.createDataFrame(
        [("from 10.0.0.1", "[[[IP_1]]] [[IP_2]] [[ARN_1]] [[IP_99999999999999]] [[IP_0]]")],
        "question STRING, text STRING",
    )
    row = scrub(df, ["question"]).select(unscrub(F.col("text"), F.col("redactions")).alias("t")).first()
    assert row.t == "[10.0.0.1] [[IP_2]] [[ARN_1]] [[IP_99999999999999]] [[IP_0]]"


def brute(texts):
    patterns = [
        ("ARN", r"arn:[A-Za-z0-9\-_:/.]+"),
        ("ACCOUNT_ID", r"(?a:\b\d{12}\b)"),
        ("IP", r"(?a:\b\d{1,3}(?:\.\d{1,3}){3}\b)"),
        ("S3", r"s3://[A-Za-z0-9.\-_/]+"),
    ]
    n, out = 0, []
    for text in texts:
        for tag, pattern in patterns:

            def fill(m, tag=tag):
                nonlocal n
                n += 1
                return f"[[{tag}_{n}]]"

            text = re.sub(pattern, fill, text)
        out.append(text)
    return out


PIECE = st.sampled_from(
    ["arn:aws:s3:::b", "123456789012", "10.0.0.1", "s3://a-b/c", " ", "é", "_", ".", "x", "/", "1", "\n", ":", "999.1.2.3"]
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(PIECE, max_size=12), st.lists(PIECE, max_size=12)), min_size=60, max_size=60))
def test_against_brute_force(spark, cases):
    rows = [(i, "".join(q), "".join(c)) for i, (q, c) in enumerate(cases)]
    got = both(spark.createDataFrame(rows, "i INT, question STRING, context STRING")).collect()
    for r in got:
        assert [r.scrubbed_question, r.scrubbed_context] == brute([r.question, r.context])
        assert (r.q, r.c) == (r.question, r.context)
