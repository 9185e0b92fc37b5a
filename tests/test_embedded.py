"""Exports to databases that run inside the driver."""

from __future__ import annotations

import datetime as dt
import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lakeloom.queries_more import ORACLES
from lakeloom.sources import embedded

SF = "/root/testdata/sf0.001"
ON_CLUSTER = """
from pyspark.sql import SparkSession
from lakeloom.queries_more import QUERIES
conf = {"spark.master": "local-cluster[2,1,512]", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "HOME/shared", "spark.sql.warehouse.dir": "HOME/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    QUERIES["export_over_jdbc"](spark, "SF").write.parquet("HOME/out")
finally:
    spark.stop()
"""


def test_executors_of_other_processes_do_not_hinder_an_export(tmp_path):
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    r = subprocess.run([sys.executable, "-c", ON_CLUSTER.replace("HOME", str(tmp_path)).replace("SF", SF)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert r.returncode == 0, r.stderr[-3000:]
    got = duckdb.sql(f"select c_custkey, c_name, c_acctbal from '{tmp_path}/out/*.parquet' order by all").fetchall()
    customer = duckdb.read_parquet(f"{SF}/customer.parquet")  # noqa: F841 - the SQL reads it
    assert got and got == duckdb.sql(f"select * from ({ORACLES['export_over_jdbc']}) order by all").fetchall()


def test_rows_of_every_chunk_arrive_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedded, "FETCHED", 7)
    monkeypatch.setattr(embedded, "HELD", 3)
    odd = ["", None, 'say "so", he\nsaid', "naïve 漢字", "x" * 40_000]
    rows = [(i, odd[i % 5], dt.datetime(2024, 1, 1, 0, 0, i), None if i % 3 else i / 7, dt.date(2024, 1, 1 + i), i % 2 == 0) for i in range(25)]
    df = spark.createDataFrame(rows, "id bigint, said string, at timestamp_ntz, share double, day date, even boolean")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    there = lambda: sorted(tuple(r) for r in spark.read.option("preferTimestampNTZ", "true").jdbc(url, "kept").collect())
    embedded.write(df, url, "kept", {"batchsize": "2"})
    assert there() == rows
    embedded.write(df.where("id > 20"), url, "kept", {})
    assert there() == rows[21:]
    embedded.write(df.where("id < 0"), url, "kept", {})
    assert there() == []


@pytest.mark.parametrize("url, inside", [("jdbc:derby:memory:x", True), ("jdbc:derby:/a/b;create=true", True), ("jdbc:derby://host:1527/b", False), ("jdbc:h2:mem:x", True), ("jdbc:h2:tcp://host/x", False), ("jdbc:sqlite:/a.db", True), ("jdbc:postgresql://host/x", False), ("jdbc:hsqldb:hsql://host/x", False)])
def test_only_databases_without_a_server_are_in_process(url, inside):
    assert embedded.in_process(url) is inside
