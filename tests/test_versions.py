from __future__ import annotations

import json

import pytest

from lakeloom.errors import ReclassifyError
from lakeloom.operators.lineage import printed
from lakeloom.plans.engine import Engine
from lakeloom.plans.fingerprint import canonical_trees, fingerprint, versions
from lakeloom.plans.graph import build_graph
from lakeloom.plans.model import Full, TimeRange, external, model, table
from lakeloom.plans.planner import plan_changes, plan_json
from lakeloom.plans.state import StateStore
from lakeloom.plans.tree import diverged, drops_columns, has_window, is_suffix_change

pytestmark = pytest.mark.usefixtures("fresh_catalog")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("select a,b from t where x=1", "SELECT  a, b -- note\nFROM t\n  WHERE x = 1"),
        ("SELECT `a` FROM t", "select a from t"),
        ("SELECT a FROM t /* x */", "SELECT a FROM t"),
    ],
)
def test_layout_isnt_part_of_a_version(engine, a, b):
    assert engine.canonical(a) == engine.canonical(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("SELECT 1 AS x", "SELECT '1' AS x"),
        ("SELECT a FROM t", "SELECT b FROM t"),
        ("SELECT a FROM t WHERE a > 1", "SELECT a FROM t WHERE a >= 1"),
        (f"SELECT {', '.join(f'c{i}' for i in range(60))} FROM t", f"SELECT {', '.join(f'c{i}' for i in range(59))}, d FROM t"),
        ("SELECT a FROM t LIMIT 5", "SELECT a FROM t LIMIT 6"),
    ],
)
def test_meaning_is(engine, a, b):
    assert engine.canonical(a) != engine.canonical(b)


@pytest.mark.parametrize(
    ("old", "new", "fine"),
    [
        ("SELECT a FROM t", "SELECT a, b FROM t", True),
        ("SELECT a FROM t", "SELECT a, upper(b) AS c, b + 1 AS d FROM t", True),
        ("WITH q AS (SELECT 1) SELECT a FROM t ORDER BY a LIMIT 3", "WITH q AS (SELECT 1) SELECT a, b FROM t ORDER BY a LIMIT 3", True),
        ("SELECT a, count(*) AS n FROM t GROUP BY a", "SELECT a, count(*) AS n, sum(b) AS s FROM t GROUP BY a", True),
        ("SELECT a, count(*) AS n FROM t GROUP BY a HAVING count(*) > 1", "SELECT a, count(*) AS n, max(b) AS s FROM t GROUP BY a HAVING count(*) > 1", True),
        ("SELECT a FROM t", "SELECT b, a FROM t", False),
        ("SELECT a FROM t", "SELECT a FROM t WHERE a > 0", False),
        ("SELECT a, b FROM t", "SELECT a FROM t", False),
        ("SELECT DISTINCT a FROM t", "SELECT DISTINCT a, b FROM t", False),
        ("SELECT a FROM t GROUP BY ALL", "SELECT a, b FROM t GROUP BY ALL", False),
        ("SELECT a FROM t", "SELECT a, explode(xs) AS x FROM t", False),
        ("SELECT 1 AS one FROM t", "SELECT 1 AS one, count(*) AS n FROM t", False),
        ("SELECT a FROM t", "SELECT a, my_unknown(b) AS c FROM t", False),
        ("SELECT a FROM t", "SELECT a, * FROM t", False),
        ("SELECT a FROM t UNION ALL SELECT a FROM u", "SELECT a, b FROM t UNION ALL SELECT a, b FROM u", False),
        ("SELECT a, count(*) AS n FROM t GROUP BY a", "SELECT a, count(*) AS n, b FROM t GROUP BY a, b", False),
        ("SELECT a FROM t", "SELECT a, row_number() OVER (ORDER BY a) AS r FROM t", False),
    ],
)
def test_which_changes_leave_rows_alone(engine, old, new, fine):
    a, b = engine.canonical(old), engine.canonical(new)
    assert is_suffix_change(a, b) == fine
    assert diverged(a, b) and len(diverged(a, b)) <= 8 and diverged(a, a) == []
    assert drops_columns(a, b) == (old == "SELECT a, b FROM t")


def test_windows_are_found_in_queries_not_in_words(engine):
    assert has_window(engine.canonical("SELECT a FROM (SELECT sum(b) OVER (PARTITION BY c) AS a FROM t)"))
    assert has_window(engine.canonical("SELECT lag(a) OVER w AS x FROM t WINDOW w AS (ORDER BY a)"))
    assert not has_window(engine.canonical("SELECT over, 'lag() over ()' AS s FROM t"))


def chain(extra="", where=""):
    raw = external("raw.e", table("src.e"), "id string, ts timestamp, v double")
    s = model("s.e", TimeRange("ts", "2026-01-01"), "id string, ts timestamp" + (", w double" if extra else ""), lambda c: f"SELECT id, ts{extra} FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}{where}")
    m = model("m.f", Full(), "id string, n bigint", lambda c: f"SELECT id, count(*) AS n FROM {c.ref(s)} GROUP BY id")
    return build_graph([raw, s, m])


def pretend(store, engine, graph, env="dev"):
    """As if the graph had been applied."""
    from lakeloom.plans.fingerprint import FINGERPRINT_VERSION
    from lakeloom.plans.state import Snapshot

    v = versions(graph, engine)
    for n, (fp, ast) in v.items():
        store.save_snapshot(Snapshot(n, fp, "", ast, fp, graph.models[n].kind.tag, FINGERPRINT_VERSION, graph.models[n].schema.json(), ""))
    store.promote(env, {n: fp for n, (fp, _) in v.items()})
    return v


def test_what_makes_a_version(engine):
    a, b = versions(chain(), engine), versions(chain(where=" AND v > 0"), engine)
    assert a["raw.e"] == b["raw.e"] and a["s.e"][0] != b["s.e"][0] and a["m.f"][0] != b["m.f"][0] and a["m.f"][1] == b["m.f"][1]
    raw = external("raw.e", table("src.e"), "id string")
    body = lambda c: f"SELECT id FROM {c.ref(raw)}"
    m = model("m.a", Full(), "id string", body)
    assert fingerprint(m, "[]", []) == fingerprint(model("m.a", Full(), "id string", body, description="other", caveats=["x"]), "[]", [])
    assert fingerprint(m, "[]", []) != fingerprint(model("m.a", Full(), "id string", body, grain=["id"]), "[]", [])
    assert fingerprint(m, "[]", []) != fingerprint(model("m.a", Full(), "id string", body, target="parquet"), "[]", [])
    k = lambda **x: model("m.t", TimeRange("ts", **{"start": "2026-01-01", **x}), "ts timestamp", lambda c: f"SELECT ts FROM t WHERE ts >= {c.start} AND ts < {c.end}")
    assert len({fingerprint(k(**x), "[]", []) for x in ({}, {"start": "2025-01-01"}, {"batch_size": 3}, {"lookback": 2})}) == 1
    assert fingerprint(k(), "[]", []) != fingerprint(k(interval="hour"), "[]", [])


def test_parse_cache_is_used_and_optional(engine):
    store, g = StateStore(), chain()
    first = canonical_trees(g, engine, store)

    class Broken:
        def canonical(self, sql):
            raise AssertionError("parsed again")

        dialect = engine.dialect

    assert canonical_trees(g, Broken(), store) == first

    class Sick:
        def canon(self, keys):
            raise OSError

        save_canon = canon

    assert canonical_trees(g, engine, Sick()) == first


def test_operator_verdicts(engine):
    store = StateStore()
    pretend(store, engine, chain())
    harder = chain(where=" AND v > 0")
    plan = lambda g, **r: plan_changes("dev", g, engine, store, now="2026-01-02", **r)
    a = plan(harder, reclassify={"s.e": "non-breaking"}).by_name
    assert a["s.e"].change == "non-breaking" and a["s.e"].reclassified_from == "breaking" and "operator" in a["s.e"].explain.reason
    assert a["m.f"].reused_from and a["m.f"].physical != a["m.f"].fingerprint
    wider = chain(extra=", v AS w")
    assert plan(wider).by_name["s.e"].change == "non-breaking"
    assert plan(wider, reclassify={"s.e": "breaking"}).by_name["m.f"].reused_from is None
    store2 = StateStore()
    pretend(store2, engine, wider)
    with pytest.raises(ReclassifyError, match="loses columns"):
        plan_changes("dev", chain(), engine, store2, now="2026-01-02", reclassify={"s.e": "non-breaking"})
    for bad in ({"reclassify": {"x.y": "breaking"}}, {"reclassify": {"s.e": "fine"}}, {"forward_only": ["m.f"]}, {"forward_only": ["x.y"]}):
        with pytest.raises(ReclassifyError):
            plan(harder, **bad)
    f = plan(harder, forward_only=["s.e"]).by_name
    assert f["s.e"].change == "forward-only" and f["s.e"].reused_from and f["m.f"].reused_from
    shown = plan_json(plan(harder))
    assert list(shown) == ["env", "hasChanges", "warnings", "actions"] and json.dumps(shown)
    assert shown["actions"][1]["explain"]["diverged"] and shown["actions"][1]["backfill"] == [{"start": "2026-01-01T00:00:00.000Z", "end": "2026-01-02T00:00:00.000Z"}]


def test_versions_of_another_algorithm(engine):
    from dataclasses import replace

    from lakeloom.errors import StateError

    store, g = StateStore(), chain()
    v = pretend(store, engine, chain(where=" AND v > 0"))
    s = store.snapshot("s.e", v["s.e"][0])
    store.save_snapshot(replace(s, version=0))
    a = plan_changes("dev", g, engine, store, now="2026-01-02", forward_only=["s.e"]).by_name["s.e"]
    assert a.change == "breaking" and a.reused_from is None
    store.save_snapshot(replace(s, version=99))
    with pytest.raises(StateError, match="newer"):
        plan_changes("dev", g, engine, store, now="2026-01-02")


def test_lineage_through_subqueries_and_stars(spark, engine):
    raw = external("raw.moves", table("src.moves"), "case_id string, dept string, moved_at timestamp")
    stays = model("s.stays", Full(), "case_id string, dept string, duration double", lambda c: f"SELECT case_id, dept, (unix_micros(next_at) - unix_micros(moved_at)) / 1e6 AS duration FROM (SELECT *, lead(moved_at) OVER w AS next_at FROM {c.ref(raw)} WINDOW w AS (PARTITION BY case_id ORDER BY moved_at))")
    every = model("m.every", Full(), "case_id string, dept string, duration double", lambda c: f"SELECT * FROM {c.ref(stays)}")
    total = model("m.total", Full(), "dept string, hours double", lambda c: f"SELECT dept, sum(duration) / 3600 AS hours FROM {c.ref(every)} GROUP BY dept")
    g = build_graph([raw, stays, every, total])
    from lakeloom.operators.lineage import column_lineage

    o = column_lineage(g, canonical_trees(g, engine, None), "m.total", "hours")
    assert printed(o).split() == ["m.total.hours", "m.every.duration", "s.stays.duration", "raw.moves.moved_at"]
    assert column_lineage(g, canonical_trees(g, engine, None), "raw.moves", "dept").sources == ()


def test_archive_recipe(spark, tmp_path):
    """An archive with redeliveries: copies within the horizon collapse, a later one survives as it must."""
    from lakeloom.plans.model import parquet
    from lakeloom.plans.project import Project

    rows = [(f"ev-{i:03d}", f"2026-03-{1 + i % 4:02d} 10:00:00", f"2026-03-{1 + i % 4 + d:02d} 1{k}:00:00", k) for i in range(8) for k, d in enumerate([0, 0, 1] if i % 2 else [0])] + [("ev-003", "2026-03-04 10:00:00", "2026-03-20 10:00:00", 9)]
    spark.createDataFrame(rows, "event_id string, occurred string, arrived string, archiver_offset int").selectExpr("event_id", "CAST(occurred AS TIMESTAMP_NTZ) AS occurred_at", "CAST(arrived AS TIMESTAMP_NTZ) AS arrived_at", "archiver_offset").write.parquet(str(tmp_path / "archive"))
    raw = external("raw.archive", parquet(str(tmp_path / "archive")), "event_id string, occurred_at timestamp, arrived_at timestamp, archiver_offset int")
    m = model("stage.canonical", TimeRange("arrived_at", "2026-03-01", batch_size=1), "event_id string, occurred_at timestamp, arrived_at timestamp",
              lambda c: f"SELECT event_id, occurred_at, arrived_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, archiver_offset) AS n FROM {c.ref(raw)} WHERE arrived_at >= {c.start} - INTERVAL 7 DAY AND arrived_at < {c.end}) WHERE n = 1 AND arrived_at >= {c.start}")
    p = Project(spark, [raw, m], str(tmp_path / "lake"))
    p.apply("dev", now="2026-03-25")
    got = [r.event_id for r in p.table("dev", "stage.canonical").collect()]
    assert len(got) == 9 and len(set(got)) == 8 and got.count("ev-003") == 2
