"""Every registered query against its SQL counterpart, on the smallest driver tables."""

import os

import pandas as pd
import pytest

from stackquarry.plans import shapes
from stackquarry.plans.catalogue import QUERIES
from stackquarry.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(value):
        if value is None or value is pd.NaT or value is pd.NA or value != value:
            return None
        return str(value)[:10] if hasattr(value, "year") else value

    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in ORACLE:
        wanted = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(wanted.columns)
        assert rows_of(got) == rows_of(wanted)


def test_shapes_keep_every_row(spark):
    lines = shapes.table(spark, SF, "lineitem").count()
    assert shapes.lines(spark, SF).count() == lines
    assert shapes.route_questions(spark, SF).count() == lines == shapes.parsed_questions(spark, SF).count()
    assert shapes.stack_documents(spark, SF).count() == shapes.table(spark, SF, "orders").count()
