"""Every query with SQL gives what the other engine gives on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from codeloom.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame) -> list[str]:  # type: ignore[no-untyped-def]
    frame = frame[sorted(frame.columns)]

    def plain(v):  # type: ignore[no-untyped-def]
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
            return None
        return round(float(v), 9) if isinstance(v, float) or type(v).__name__.startswith(("float", "int", "uint")) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    without = {"q_token_batches", "q_line_chunks", "q_char_chunks", "q_label_propagation", "q_extracted", "q_imported", "q_called", "q_inherits", "q_uses"}
    assert without == set(QUERIES) - set(ORACLE)


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
