import os

import duckdb
import pytest

import __spark_entry__ as entry
from signalflow.plans import queries as plans

TABLES = ["documents", "pages", "events", "labels"]
NAMES = sorted(plans.queries())


@pytest.fixture(scope="module")
def twins(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, twins, name):
    frame = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = twins.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, rows) == rows_of(columns, found.fetchall())


def test_entry_and_missing_folder(spark):
    assert entry.entry(spark).count() > 0
    assert set(NAMES) <= set(entry.queries())
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(f"{root}/signalflow"):
        if "/llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm import" not in open(f"{folder}/{f}").read()
