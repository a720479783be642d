"""Every registered text query on the smallest tables, against SQL where there is some."""

from __future__ import annotations

import os

import pandas as pd
import pytest

import __spark_entry__ as contract
from stackquarry.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def rows_of(frame: pd.DataFrame) -> list[str]:
    def plain(value):
        if pd.isna(value):
            return None
        # pandas reads whole numbers beside nulls as floats
        return int(value) if isinstance(value, float) and value.is_integer() else value

    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)
    return sorted(str(tuple(map(plain, row))) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert name in contract.queries()
    got = QUERIES[name](spark, SF)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    frame = got.toPandas()
    assert len(frame) > 0
    if name in ORACLE:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for table in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        wanted = con.execute(ORACLE[name]).df()
        assert rows_of(frame) == rows_of(wanted[frame.columns])


def test_no_other_module_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "stackquarry")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as source:
                    assert "stackquarry.llm" not in source.read()
