from __future__ import annotations

import json
import os
import time

import pytest

from lakeloom.cli import main
from lakeloom.errors import LoomError
from lakeloom.plans.config import Config, discover, models_of
from lakeloom.plans.model import Compaction, Embedded, Full, TimeRange, external, model, table
from lakeloom.plans.project import Project
from lakeloom.plans.state import StateStore
from lakeloom.testing import check_model

pytestmark = pytest.mark.usefixtures("fresh_catalog")


@pytest.fixture
def run(spark, tmp_path, capsys):
    assert main(["init", str(tmp_path)]) == 0
    capsys.readouterr()

    def go(*args):
        code = main([*args, "--config", str(tmp_path / "lakeloom_config.py"), *([] if "--text" in args else ["--json"])], spark)
        out = capsys.readouterr().out
        return code, json.loads(out) if out.strip() else None

    return go


def test_a_project_from_scaffold_to_prod(run, tmp_path):
    code, out = run("apply", "dev", "--now", "2026-01-03")
    assert code == 2 and out["applied"] is False and out["plan"]["hasChanges"]
    code, out = run("apply", "dev", "--now", "2026-01-03", "--yes", "--metrics", str(tmp_path / "m.prom"))
    assert code == 0 and out["promoted"] and out["built"] == ["raw.sales", "mart.shop_days", "mart.shops"]
    assert "lakeloom_intervals_done_total 2" in (tmp_path / "m.prom").read_text()
    code, out = run("plan", "dev", "--now", "2026-01-03")
    assert [a["change"] for a in out["actions"]] == ["unchanged"] * 3 and out["hasChanges"]  # lookback reads the last day again
    assert run("run", "dev", "--now", "2026-01-04") == (0, {"apiVersion": 1, "env": "dev", "outcome": "ok", "processed": ["mart.shop_days"]})
    code, out = run("status", "dev", "--now", "2026-01-05")
    assert code == 0 and out["lag"] == [{"model": "mart.shop_days", "doneUpTo": "2026-01-04T00:00:00.000Z", "missing": 1, "failed": 0}]
    assert out["ticks"][0]["outcome"] == "ok"
    assert run("audit", "dev")[1]["blockingViolations"] == 0
    code, out = run("lineage", "mart.shops", "total")
    assert out["lineage"][0]["sources"][0]["sources"][0]["column"] == "amount"
    assert run("passport", "dev")[1]["models"][-1]["effective"]["limitedBy"] == "mart.shop_days"
    assert "`dev__mart`.`shop_days`" in run("render", "mart.shops", "dev")[1]["sql"]
    assert [m["name"] for m in run("graph", "--html", str(tmp_path / "g.html"))[1]["models"]] == ["raw.sales", "mart.shop_days", "mart.shops"]
    code, out = run("restate", "dev", "mart.shop_days", "--from", "2026-01-01", "--to", "2026-01-02", "--dry-run")
    assert len(out["targets"][0]["intervals"]) == 1
    run("apply", "prod", "--now", "2026-01-04", "--yes")
    assert run("diff", "dev", "prod")[1]["different"] == []
    assert run("janitor")[1]["removed"] == []
    assert run("compact", "dev", "--dry-run")[1]["compacted"] == []
    assert run("migrate")[1] == {"apiVersion": 1, "from": 2, "to": 2}
    seed = tmp_path / "seeds" / "sales.csv"
    seed.write_text(seed.read_text() + "2026-01-02 12:00:00,east,1\n")
    code, out = run("run", "dev", "--now", "2026-01-04")
    assert code == 2 and out["outcome"] == "awaiting-human" and any("raw.sales" in b for b in out["blockedBy"])
    code, out = run("apply", "dev", "--now", "2026-01-04", "--yes")
    d = run("diff", "dev", "prod", "--data")[1]
    assert d["data"]["mart.shop_days"]["onlyInA"] == 1 and d["data"]["mart.shop_days"]["inBoth"] == 3
    code, out = run("schedule", "dev", "@daily", "--print-systemd")
    assert code == 0 and len(out["units"]) == 2


def test_errors_are_one_screen(run, tmp_path, capsys):
    code, _ = run("restate", "dev", "mart.nope", "--from", "2026-01-01", "--to", "2026-01-02")
    assert code == 1
    (tmp_path / "lakeloom_config.py").write_text("oops(")
    assert main(["plan", "dev", "--config", str(tmp_path / "lakeloom_config.py")]) == 1
    assert "can't be loaded" in capsys.readouterr().err


def test_discovery(tmp_path):
    (tmp_path / "a.py").write_text("from lakeloom.plans.model import *\nx = external('r.x', table('t'), 'id string')\n")
    (tmp_path / "b.py").write_text("from lakeloom.plans.model import *\ny = external('r.x', table('other'), 'id string')\n")
    assert [m.name for m in discover(("a.py",), tmp_path)] == ["r.x"]
    with pytest.raises(LoomError, match="a.py and in b.py"):
        discover(("*.py",), tmp_path)
    inner = external("r.y", table("t"), "id string")
    outer = model("m.z", Full(), "id string", lambda c: f"SELECT id FROM {c.ref(inner)}")
    assert [m.name for m in models_of(Config(models=(outer,)), tmp_path)] == ["m.z", "r.y"]


def test_models_can_be_tested_by_rows(spark):
    raw = external("raw.moves", table("t"), "id string, ts timestamp, n int, ok boolean")
    plain = model("stage.plain", Embedded(), "id string, ts timestamp, n int", lambda c: f"SELECT id, ts, n FROM {c.ref(raw)} WHERE ok")
    m = model("mart.sums", TimeRange("day", "2026-01-01"), "day timestamp, total bigint", lambda c: f"SELECT CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) AS day, sum(n) AS total FROM {c.ref(plain)} WHERE ts >= {c.start} AND ts < {c.end} GROUP BY 1")
    rows = [{"id": "a", "ts": "2026-01-01 05:00:00", "n": 2, "ok": True}, {"id": "b", "ts": "2026-01-01 06:00:00", "n": 3, "ok": True}, {"id": "c", "ts": "2026-01-02 06:00:00", "n": 9, "ok": True}, {"id": "d", "ts": "2026-01-01 06:00:00", "n": 50, "ok": False}]
    given = {"raw.moves": rows}
    check_model(spark, m, given, [{"day": "2026-01-01 00:00:00", "total": 5}], start="2026-01-01", end="2026-01-02")
    with pytest.raises(AssertionError, match="unexpected"):
        check_model(spark, m, given, [{"day": "2026-01-01 00:00:00", "total": 6}], start="2026-01-01", end="2026-01-02")
    with pytest.raises(LoomError, match="numeric"):
        check_model(spark, m, {"raw.moves": [{"n": "x"}]}, [], start="2026-01-01", end="2026-01-02")
    with pytest.raises(LoomError, match="unknown columns"):
        check_model(spark, m, {"raw.moves": [{"zz": 1}]}, [], start="2026-01-01", end="2026-01-02")
    with pytest.raises(LoomError, match="no rows for it"):
        check_model(spark, m, {}, [], start="2026-01-01", end="2026-01-02")


def test_compaction_order_of_reasons_and_merge(spark, tmp_path):
    place = tmp_path / "archive"
    for day in ("2026-03-01", "2026-03-09", "2026-03-10"):
        for k in range(3):
            spark.createDataFrame([("e1", k), (f"e{k}", None)], "id string, n int").coalesce(1).write.mode("append").parquet(f"{place}/day={day}")
    spark.createDataFrame([("z", 1)], "id string, n int").coalesce(1).write.parquet(f"{place}/day=2026-02-01")
    spark.createDataFrame([("z", 1)], "id string, n int").coalesce(1).write.parquet(f"{place}/day=soon")
    now = 1773144000000  # 2026-03-10T12:00Z
    for root, _, files in os.walk(place):
        for f in files:
            at = now / 1000 - (3600 if "03-09" in root else 90_000)
            os.utime(os.path.join(root, f), (at, at))
    raw = external("raw.a", table("unused"), "id string, n int")
    from lakeloom.plans.model import parquet

    raw = external("raw.a", parquet(f"{place}/*/*.parquet"), "id string, n int", compaction=Compaction(2, 24, ("id",), ("n",), "day"))
    p = Project(spark, [raw], str(tmp_path / "lake"))
    dry = p.compact("dev", dry_run=True, now=now)
    assert [c["partition"] for c in dry.compacted] == ["day=2026-03-01"] and dry.compacted[0]["rows"] is None
    r = p.compact("dev", now=now)
    assert {s["partition"]: s["reason"] for s in r.skipped} == {"day=2026-02-01": "already-compact", "day=2026-03-09": "grace-period", "day=2026-03-10": "current-day", "day=soon": "undated"}
    assert r.compacted[0]["rows"] == 3 and r.compacted[0]["files"] == 3
    got = sorted(map(tuple, spark.read.parquet(f"{place}/day=2026-03-01").collect()), key=str)
    assert got == [("e0", None), ("e1", 0), ("e2", None)]
    assert len([f for f in os.listdir(f"{place}/day=2026-03-01") if f.endswith(".parquet")]) == 1


def test_large_partitions_become_several_files(spark, tmp_path, monkeypatch):
    from lakeloom.operators import compact as module
    from lakeloom.plans.model import parquet

    place = tmp_path / "archive"
    for k in range(6):
        spark.range(k * 500, (k + 2) * 500).coalesce(1).write.mode("append").parquet(f"{place}/day=2026-03-01")
    monkeypatch.setattr(module, "FILE_BYTES", 8_000)
    raw = external("raw.a", parquet(f"{place}/*/*.parquet"), "id bigint", compaction=Compaction(2, 0, ("id",), (), "day"))
    p = Project(spark, [raw], str(tmp_path / "lake"))
    r = p.compact("dev", now=round(time.time() * 1000) + 10**10)
    left = [f for f in os.listdir(f"{place}/day=2026-03-01") if f.endswith(".parquet")]
    assert r.compacted[0]["rows"] == 3500 and 1 < len(left) < 6
    assert spark.read.parquet(str(place)).select("id").distinct().count() == spark.read.parquet(str(place)).count() == 3500


def test_own_lake_is_compacted_in_place(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.sql("CREATE TABLE src.e USING parquet AS SELECT /*+ REPARTITION(3) */ id, TIMESTAMP_NTZ'2026-03-01 08:00:00' AS ts FROM range(30)")
    raw = external("raw.e", table("src.e"), "id bigint, ts timestamp")
    m = model("stage.e", TimeRange("ts", "2026-03-01"), "id bigint, ts timestamp", lambda c: f"SELECT /*+ REPARTITION(3) */ id, ts FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}", target="parquet")
    p = Project(spark, [raw, m], str(tmp_path / "lake"))
    p.apply("dev", now="2026-03-02")
    r = p.compact("dev", now=round(time.time() * 1000) + 10**10)
    assert r.compacted[0]["published"] == "data.parquet" and r.compacted[0]["rows"] == 30
    assert p.table("dev", "stage.e").count() == 30
    p.restate("dev", "stage.e", "2026-03-01", "2026-03-02")
    p.apply("dev", now="2026-03-02")
    assert p.table("dev", "stage.e").count() == 30


def test_ticks_by_stream(spark, tmp_path):
    from lakeloom.streaming.daily import ticking

    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.sql("CREATE TABLE src.e USING parquet AS SELECT 1L AS id, TIMESTAMP_NTZ'2026-03-01 08:00:00' AS ts")
    raw = external("raw.e", table("src.e"), "id bigint, ts timestamp")
    m = model("stage.e", TimeRange("ts", "2026-03-01"), "id bigint, ts timestamp", lambda c: f"SELECT id, ts FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}")
    p = Project(spark, [raw, m], str(tmp_path / "lake"), StateStore())
    p.apply("dev", now="2026-03-01")
    arrivals = str(tmp_path / "arrivals")
    spark.range(2).write.parquet(arrivals)
    q = ticking(p, "dev", spark.readStream.schema("id bigint").parquet(arrivals), str(tmp_path / "cp"), now=lambda: 1772409600000)
    q.awaitTermination(60)
    assert p.table("dev", "stage.e").count() == 1 and p.store.last_runs("dev")[0]["outcome"] == "ok"
