from __future__ import annotations

import pytest

from lakeloom.errors import AuditError, BlockedError, ContractError
from lakeloom.operators.audits import accepted, assert_contiguous, assert_no_gaps, custom, not_null, unique
from lakeloom.plans.model import Embedded, Full, ScdType2, TimeRange, UniqueKey, View, external, model, parquet, seed, sql_model, table
from lakeloom.plans.project import Project
from lakeloom.plans.state import StateStore

pytestmark = pytest.mark.usefixtures("fresh_catalog")


@pytest.fixture
def events(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.sql("DROP TABLE IF EXISTS src.events")
    spark.sql("CREATE TABLE src.events USING parquet AS SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2026-03-01 08:00:00', 1.0D), ('b', TIMESTAMP_NTZ'2026-03-02 09:30:00', 2.0D), ('c', TIMESTAMP_NTZ'2026-03-03 23:59:59', 3.0D) t(id, ts, amount)")
    return external("raw.events", table("src.events"), "id string, ts timestamp, amount double")


def daily(events, **more):
    kind = more.pop("kind", None) or TimeRange("ts", "2026-03-01", batch_size=more.pop("batch_size", 2), lookback=more.pop("lookback", 0))
    return model("stage.events", kind, "id string, ts timestamp, amount double", lambda c: f"SELECT {c.cols(events, 'id', 'ts', 'amount')} FROM {c.ref(events)} WHERE ts >= {c.start} AND ts < {c.end}", **more)


def totals(stage, extra="", schema="day timestamp, n bigint", name="mart.daily"):
    return model(name, Full(), schema, lambda c: f"SELECT CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) AS day, count(*) AS n{extra} FROM {c.ref(stage)} GROUP BY 1")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_build_then_promotion_without_work(spark, events, tmp_path):
    stage = daily(events)
    p = Project(spark, [events, stage, totals(stage)], str(tmp_path / "lake"), tmp_path / "state.db")
    first = p.apply("dev", now="2026-03-04")
    assert first.built == ["stage.events", "mart.daily"] and first.promoted
    assert p.table("dev", "mart.daily").count() == 3
    assert not p.plan("dev", now="2026-03-04").has_changes
    prod = p.apply("prod", now="2026-03-04")
    assert prod.built == []
    assert rows(p.table("prod", "stage.events")) == rows(p.table("dev", "stage.events"))
    assert spark.table("mart.daily").count() == 3


def test_new_intervals_come_with_time_and_ticks_refuse_changes(spark, events, tmp_path):
    stage = daily(events)
    p = Project(spark, [events, stage], str(tmp_path / "lake"), tmp_path / "state.db")
    p.apply("dev", now="2026-03-02")
    assert [r[0] for r in rows(p.table("dev", "stage.events"))] == ["a"]
    assert p.run("dev", now="2026-03-04") == {"env": "dev", "outcome": "ok", "processed": ["stage.events"]}
    assert p.table("dev", "stage.events").count() == 3
    changed = model("stage.events", stage.kind, "id string, ts timestamp", lambda c: f"SELECT id, ts FROM {c.ref(events)} WHERE ts >= {c.start} AND ts < {c.end}")
    q = Project(spark, [events, changed], str(tmp_path / "lake"), p.store)
    with pytest.raises(BlockedError):
        q.run("dev", now="2026-03-04")
    assert [t["outcome"] for t in q.store.last_runs("dev")] == ["awaiting-human", "ok"]


def test_backfill_replaces_and_rows_that_vanish_vanish(spark, events, tmp_path):
    for target in ("table", "parquet"):
        stage = daily(events, target=target)
        p = Project(spark, [events, stage], str(tmp_path / target), tmp_path / f"{target}.db")
        p.apply("dev", now="2026-03-04")
        before = rows(p.table("dev", "stage.events"))
        p.restate("dev", "stage.events", "2026-03-01", "2026-03-03")
        p.apply("dev", now="2026-03-04")
        assert rows(p.table("dev", "stage.events")) == before
        spark.sql("INSERT OVERWRITE src.events SELECT * FROM VALUES ('c', TIMESTAMP_NTZ'2026-03-03 23:59:59', 3.0D), ('a2', TIMESTAMP_NTZ'2026-03-01 01:00:00', 9.0D) t(id, ts, amount)")
        p.restate("dev", "stage.events", "2026-03-01", "2026-03-03")
        p.apply("dev", now="2026-03-04")
        assert [r[0] for r in rows(p.table("dev", "stage.events"))] == ["a2", "c"]
        spark.sql("INSERT OVERWRITE src.events SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2026-03-01 08:00:00', 1.0D), ('b', TIMESTAMP_NTZ'2026-03-02 09:30:00', 2.0D), ('c', TIMESTAMP_NTZ'2026-03-03 23:59:59', 3.0D) t(id, ts, amount)")


def test_lookback_reads_the_last_intervals_again(spark, events, tmp_path):
    stage = daily(events, lookback=1)
    p = Project(spark, [events, stage], str(tmp_path / "lake"), tmp_path / "state.db")
    p.apply("dev", now="2026-03-04")
    spark.sql("INSERT INTO src.events VALUES ('late', TIMESTAMP_NTZ'2026-03-03 12:00:00', 5.0D)")
    plan = p.plan("dev", now="2026-03-04")
    assert plan.has_changes and not plan.structural
    p.apply("dev", now="2026-03-04")
    assert p.table("dev", "stage.events").count() == 4


def test_upsert_keeps_absent_rows_and_null_keys_accumulate(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.sql("CREATE TABLE src.people USING parquet AS SELECT * FROM VALUES ('p1', 'Ada'), ('p2', 'Bo'), (NULL, 'x') t(id, name)")
    raw = external("raw.people", table("src.people"), "id string, name string")
    m = model("stage.people", UniqueKey("id"), "id string, name string", lambda c: f"SELECT id, name FROM {c.ref(raw)}")
    p = Project(spark, [raw, m], str(tmp_path / "lake"))
    p.apply("dev")
    spark.sql("INSERT OVERWRITE src.people VALUES ('p2', 'Bo B.'), ('p3', 'Cy'), (NULL, 'x')")
    p.apply("dev")
    assert rows(p.table("dev", "stage.people")) == sorted([("p1", "Ada"), ("p2", "Bo B."), ("p3", "Cy"), (None, "x"), (None, "x")], key=str)


def test_scd2_closes_opens_and_reopens(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.sql("CREATE TABLE src.depts USING parquet AS SELECT * FROM VALUES ('icu', 'Ivanov'), ('lab', CAST(NULL AS STRING)) t(id, head)")
    raw = external("raw.depts", table("src.depts"), "id string, head string")
    m = model("dim.depts", ScdType2(("id",)), "id string, head string, valid_from timestamp, valid_to timestamp", lambda c: f"SELECT id, head FROM {c.ref(raw)}")
    p = Project(spark, [raw, m], str(tmp_path / "lake"))
    p.apply("dev", now="2026-02-01")
    spark.sql("INSERT OVERWRITE src.depts VALUES ('icu', 'Sidorov'), ('lab', NULL)")
    p.apply("dev", now="2026-02-02")
    spark.sql("INSERT OVERWRITE src.depts VALUES ('icu', 'Ivanov'), ('lab', NULL)")
    p.apply("dev", now="2026-02-03")
    got = [(r.id, r.head, str(r.valid_from)[:10], str(r.valid_to)[:10] if r.valid_to else None) for r in p.table("dev", "dim.depts").collect()]
    assert sorted(got, key=str) == sorted([("icu", "Ivanov", "2026-02-01", "2026-02-02"), ("icu", "Sidorov", "2026-02-02", "2026-02-03"), ("icu", "Ivanov", "2026-02-03", None), ("lab", None, "2026-02-01", None)], key=str)


def test_seed_embedded_view_and_sql_file(spark, tmp_path):
    (tmp_path / "regions.csv").write_text("code,title,note\nN,North,x\nS,\"So, uth\",\n")
    (tmp_path / "q.sql").write_text("SELECT code, upper(title) AS title FROM @ref(mart.named) WHERE code <> 'X';")
    s = seed("ref.regions", tmp_path / "regions.csv", "code string, title string")
    e = model("stage.plain", Embedded(), "code string, title string", lambda c: f"SELECT code, title FROM {c.ref(s)}")
    v = model("mart.named", View(), "code string, title string", lambda c: f"SELECT code, title FROM {c.ref(e)} AS e")
    f = sql_model("mart.loud", Full(), "code string, title string", tmp_path / "q.sql", [v])
    p = Project(spark, [s, e, v, f], str(tmp_path / "lake"))
    p.apply("dev")
    assert rows(p.table("dev", "mart.loud")) == [("N", "NORTH"), ("S", "SO, UTH")]
    assert not spark.catalog.tableExists("dev__stage.plain")
    (tmp_path / "regions.csv").write_text("code,title,note\nN,Nord,x\n")
    assert [(a.name, a.change) for a in p.plan("dev").actions if a.change != "unchanged"][0] == ("ref.regions", "breaking")
    p.apply("dev")
    assert rows(p.table("dev", "mart.loud")) == [("N", "NORD")]


def test_contract_reports_all_deviations_and_promotes_nothing(spark, events, tmp_path):
    bad = model("mart.bad", Full(), "id bigint, amount double, gone string", lambda c: f"SELECT id, amount, 1 AS extra FROM {c.ref(events)}")
    p = Project(spark, [events, bad], str(tmp_path / "lake"))
    with pytest.raises(ContractError) as e:
        p.apply("dev")
    assert len(e.value.problems) == 3
    assert p.store.pointers("dev") == {}


def test_audits_block_warn_and_respect_scope(spark, events, tmp_path):
    ok = [not_null("id"), unique("id").per_interval(), accepted("id", ["a", "b", "c"]), assert_no_gaps("ts").whole(), custom("few", lambda c: f"SELECT * FROM {c.self} WHERE amount > 2").warn()]
    p = Project(spark, [events, daily(events, audits=ok)], str(tmp_path / "lake"))
    p.apply("dev", now="2026-03-04")
    assert p.metrics.value("lakeloom_audits_passed_total") > 0
    bad = daily(events, audits=[custom("none", lambda c: f"SELECT * FROM {c.self} WHERE amount = 2")], batch_size=1)
    q = Project(spark, [events, bad], str(tmp_path / "lake2"))
    with pytest.raises(AuditError):
        q.apply("dev", now="2026-03-04")
    fp = q.versions()["stage.events"]
    assert len(q.store.intervals("stage.events", fp)) == 1 and len(q.store.intervals("stage.events", fp, "failed")) == 1
    spark.sql("INSERT INTO src.events VALUES ('d', TIMESTAMP_NTZ'2026-03-05 12:00:00', 5.0D)")
    gap = daily(events, audits=[assert_no_gaps("ts").whole()])
    with pytest.raises(AuditError, match="covered through 2026-03-03"):
        Project(spark, [events, gap], str(tmp_path / "lake3")).apply("dev", now="2026-03-06")


def test_contiguous(spark, tmp_path):
    spark.range(3).union(spark.range(5, 7)).createOrReplaceTempView("seqs")
    bad = spark.sql(assert_contiguous("id").sql("seqs")).collect()
    assert [tuple(r) for r in bad] == [(2, 5, 2)]


def test_versioning_categories_and_reuse(spark, events, tmp_path):
    stage = daily(events)
    store = StateStore()
    lake = str(tmp_path / "lake")
    Project(spark, [events, stage, totals(stage)], lake, store).apply("dev", now="2026-03-04")

    def change(*models):
        p = Project(spark, [events, *models], lake, store)
        return p, {a.name: a for a in p.plan("dev", now="2026-03-04").actions}

    kind, schema = stage.kind, "id string, ts timestamp, amount double, twice double"
    wider = model("stage.events", kind, schema, lambda c: f"SELECT {c.cols(events, 'id', 'ts', 'amount')}, amount * 2 AS twice FROM {c.ref(events)} WHERE ts >= {c.start} AND ts < {c.end}")
    p, a = change(wider, totals(wider))
    assert a["stage.events"].change == "non-breaking"
    assert a["mart.daily"].change == "indirect" and a["mart.daily"].reused_from
    result = p.apply("dev", now="2026-03-04")
    assert p.table("dev", "stage.events").columns[-1] == "twice" and p.table("dev", "mart.daily").count() == 3
    assert "mart.daily" in result.plan.by_name
    stricter = model("stage.events", kind, schema, lambda c: f"SELECT {c.cols(events, 'id', 'ts', 'amount')}, amount * 2 AS twice FROM {c.ref(events)} WHERE ts >= {c.start} AND ts < {c.end} AND amount > 1")
    _, a = change(stricter, totals(stricter))
    assert a["stage.events"].change == "breaking" and a["stage.events"].explain.diverged
    assert a["mart.daily"].change == "indirect" and a["mart.daily"].build


def test_forward_only_keeps_history(spark, events, tmp_path):
    stage, store, lake = daily(events), StateStore(), str(tmp_path / "lake")
    Project(spark, [events, stage], lake, store).apply("dev", now="2026-03-03")
    wider = model("stage.events", stage.kind, "id string, ts timestamp, amount double, twice double", lambda c: f"SELECT id, ts, amount, amount * 2 AS twice FROM {c.ref(events)} WHERE ts >= {c.start} AND ts < {c.end}")
    p = Project(spark, [events, wider], lake, store)
    p.apply("dev", now="2026-03-04", forward_only=["stage.events"])
    assert rows(p.table("dev", "stage.events").select("id", "twice")) == [("a", None), ("b", None), ("c", 6.0)]


def test_reopening_in_a_new_catalog_finds_everything(spark, events, tmp_path):
    stage = daily(events)
    models = [events, stage, totals(stage)]
    Project(spark, models, str(tmp_path / "lake"), tmp_path / "s.db").apply("dev", now="2026-03-04")
    for db in ("_phys", "dev__stage", "dev__mart"):
        spark.sql(f"DROP DATABASE {db} CASCADE")
    p = Project(spark, models, str(tmp_path / "lake"), tmp_path / "s.db")
    assert p.table("dev", "mart.daily").count() == 3
    assert not p.plan("dev", now="2026-03-04").has_changes


def test_janitor_spares_what_is_shared(spark, events, tmp_path):
    stage, store, lake = daily(events), StateStore(), str(tmp_path / "lake")
    p = Project(spark, [events, stage, totals(stage)], lake, store)
    p.apply("dev", now="2026-03-04")
    q = Project(spark, [events, stage], lake, store)
    q.apply("dev", now="2026-03-04")
    report = q.janitor(ttl=-1000)
    assert [r.partition("@")[0] for r in report["removed"]] == ["mart.daily"]
    assert q.table("dev", "stage.events").count() == 3
    assert not spark.catalog.tableExists("dev__mart.daily")


def test_redacted_environment(spark, events, tmp_path):
    m = model("mart.people", Full(), "id string, ts timestamp, amount double", lambda c: f"SELECT id, ts, amount FROM {c.ref(events)}", redact=["id"], audits=[not_null("id"), not_null("ts")], grain=["id"])
    p = Project(spark, [events, m], str(tmp_path / "lake"), redacted=["ext"])
    p.apply("dev")
    p.apply("ext")
    assert p.table("ext", "mart.people").columns == ["ts", "amount"] and p.table("dev", "mart.people").columns == ["id", "ts", "amount"]
    p.run("ext")


def test_external_files(spark, tmp_path):
    spark.sql("SELECT 1 AS a, 'x' AS b").coalesce(1).write.parquet(str(tmp_path / "p/k=1"))
    spark.sql("SELECT 2L AS a, 'y' AS b, 3.5D AS c").coalesce(1).write.parquet(str(tmp_path / "p/k=2"))
    union = external("raw.union", parquet(str(tmp_path / "p"), union_by_name=True), "a bigint, b string, c double")
    hive = external("raw.hive", parquet(str(tmp_path / "p"), hive_partitioning=True), "a bigint, b string, k int")
    m = model("mart.u", Full(), "a bigint, b string, c double", lambda c: f"SELECT a, b, c FROM {c.ref(union)}")
    n = model("mart.h", Full(), "a bigint, k int", lambda c: f"SELECT a, k FROM {c.ref(hive)}")
    p = Project(spark, [union, hive, m, n], str(tmp_path / "lake"))
    p.apply("dev")
    assert rows(p.table("dev", "mart.u")) == [(1, "x", None), (2, "y", 3.5)]
    assert rows(p.table("dev", "mart.h")) == [(1, 1), (2, 2)]
