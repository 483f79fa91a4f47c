"""Every registered query with a SQL counterpart gives the same rows in a second engine."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, table

NAMES = sorted(oracle_sql())
#: Queries about training, whose users, classes and requests need more rows than the smallest tables have.
LARGER = "/root/testdata/sf0.01"
TRAINING = {"tournament_support", "cross_val_support", "train_global_registered", "explain_global_support", "run_report_rows", "fit_support", "train_personal_support", "compare_support",
            "stream_training_states"}


def connected(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck(sf):
    return {folder: connected(folder) for folder in (sf, LARGER)}


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    folder = LARGER if name in TRAINING else sf
    df = queries()[name](spark, folder)
    got, columns = table(df.collect(), df.columns)
    result = duck[folder].sql(oracle_sql()[name])
    want, wanted = table(result.fetchall(), result.columns)
    assert columns == wanted
    assert got == want and want


#: Queries without a SQL counterpart; their shape is checked here, their content in other tests. Those of ``llm`` are in tests/llm.
ROWS_ONLY = sorted(n for n in queries() if n not in NAMES and not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_gives_rows(spark, name):
    rows = queries()[name](spark, LARGER).collect()
    assert rows
    if "precision" in rows[0].asDict():
        accuracy = next(r["f1_score"] for r in rows if r["label"] == "accuracy")
        assert accuracy >= 0.9, f"{name}: {accuracy} on held-out rows of eight classes"
    if "macro_f1" in rows[0].asDict():
        assert all(r["macro_f1"] >= 0.9 for r in rows), rows


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names():
    assert set(oracle_sql()) <= set(queries())
