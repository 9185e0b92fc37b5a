"""Every driver query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from lakeloom.queries_more import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(_plain(row[i]) for i in at) for row in r.fetchall()), key=str)


def test_plans_push_filters_and_columns_to_the_scan(spark):
    plan = QUERIES["scan_filter_project"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [" in plan and "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan and "props" not in plan


def test_the_entry_works_without_the_training_data_package():
    import importlib
    import sys

    import __spark_entry__ as entry

    held = {k: sys.modules.pop(k) for k in [*sys.modules] if k.startswith("lakeloom.llm") or k == "corpus_pipeline"}

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("lakeloom.llm"):
                raise ModuleNotFoundError(name)

    finder = Absent()
    sys.meta_path.insert(0, finder)
    import lakeloom

    attr = lakeloom.__dict__.pop("llm", None)
    try:
        importlib.reload(entry)
        assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    finally:
        sys.meta_path.remove(finder)
        sys.modules.update(held)
        if attr is not None:
            lakeloom.llm = attr
        importlib.reload(entry)


def test_a_day_of_an_interval_table_opens_one_directory(spark):
    df = QUERIES["pruned_interval_scan"](spark, SF)
    assert df.count() and len({f.rpartition("/")[0] for f in df.inputFiles()}) == 1
    whole = QUERIES["incremental_backfill"](spark, SF)
    assert len({f.rpartition("/")[0] for f in whole.inputFiles()}) > 20 and "__interval" not in whole.columns
