from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import types as T

from lakeloom.errors import GraphError, LockError, LoomError, ModelError, StateError, mask
from lakeloom.functions.types import family, literal, struct
from lakeloom.operators.audits import accepted, custom, gap_sentence, not_null, unique
from lakeloom.operators.compact import glob_root, partition_day
from lakeloom.plans import graph_view, schedule
from lakeloom.plans.fragment import parse_file
from lakeloom.plans.graph import build_graph
from lakeloom.plans.interval import Interval, enumerate_intervals, floor_to, intervals_within, merge_intervals, millis, missing_intervals, partition_key, split_into_batches
from lakeloom.plans.lock import held
from lakeloom.plans.metrics import Metrics
from lakeloom.plans.model import Compaction, Embedded, External, Full, ScdType2, Seed, Source, TimeRange, UniqueKey, View, external, model, parquet, seed, table
from lakeloom.plans.passport import NOTHING, passports
from lakeloom.plans.state import Snapshot, StateStore, migrate
from lakeloom.sources.lake import freshness, view_name

DAY, HOUR = 86_400_000, 3_600_000
ONE = "id string, ts timestamp"
src = external("raw.x", table("src.x"), ONE)


def full(name, *deps, **more):
    return model(name, Full(), ONE, lambda c: "SELECT id, ts FROM " + (" CROSS JOIN ".join(c.ref(d) for d in deps) or "src.x"), **more)


def test_intervals():
    a = millis("2026-01-01T05:30:00")
    assert floor_to("day", a) == millis("2026-01-01") and floor_to("hour", -1) == -HOUR
    assert enumerate_intervals("day", a, millis("2026-01-03T23:59:59")) == [Interval(millis("2026-01-01"), millis("2026-01-02")), Interval(millis("2026-01-02"), millis("2026-01-03"))]
    assert enumerate_intervals("hour", a, a) == []
    parts = [Interval(k * DAY, (k + 1) * DAY) for k in (0, 1, 3)]
    assert merge_intervals(parts) == [Interval(0, 2 * DAY), Interval(3 * DAY, 4 * DAY)]
    assert missing_intervals(parts, parts[1:]) == parts[:1]
    assert split_into_batches("day", Interval(0, 5 * DAY), 2) == [Interval(0, 2 * DAY), Interval(2 * DAY, 4 * DAY), Interval(4 * DAY, 5 * DAY)]
    assert intervals_within("day", Interval(0, 2 * DAY)) == parts[:2]
    assert partition_key("hour", millis("2026-01-02T05:00:00")) == "2026-01-02T05"
    with pytest.raises(ValueError):
        split_into_batches("day", Interval(0, DAY), 0)


def test_graph_is_ordered_and_checked():
    a = full("s.a", src)
    b, c = full("s.b", a), full("s.c", a)
    d = full("s.d", b, c)
    g = build_graph([d, c, b, a, src])
    assert g.order == ("raw.x", "s.a", "s.b", "s.c", "s.d") == build_graph([src, a, b, c, d]).order
    assert g.descendants("s.a") == ["s.b", "s.c", "s.d"] and set(g.ancestors("s.d")) == {"s.b", "s.c", "s.a", "raw.x"}
    with pytest.raises(GraphError, match="unknown"):
        build_graph([d, c, b])
    with pytest.raises(GraphError, match="twice"):
        build_graph([src, a, full("s.a", src)])
    with pytest.raises(GraphError, match="circle"):
        build_graph([model("s.p", Full(), ONE, lambda c: f"SELECT * FROM {c.ref('s.q')}"), model("s.q", Full(), ONE, lambda c: f"SELECT * FROM {c.ref('s.p')}")])
    assert graph_view.layers(g) == [["raw.x"], ["s.a"], ["s.b", "s.c"], ["s.d"]]
    assert "<svg" in graph_view.page(g) and "s.d [full] <- s.b, s.c" in graph_view.text(g)
    assert graph_view.to_json(g)["models"][-1] == {"name": "s.d", "kind": "full", "deps": ["s.b", "s.c"]}


@pytest.mark.parametrize(
    ("build", "said"),
    [
        (lambda: full("nodot"), "schema.table"),
        (lambda: model("s.a", Full(), "", lambda c: "SELECT 1"), "empty"),
        (lambda: full("s.a", grain=["zz"]), "grain"),
        (lambda: full("s.a", redact=["zz"]), "redact"),
        (lambda: full("s.a", redact=["id", "ts"]), "every column"),
        (lambda: full("s.a", answerable="maybe"), "answerable"),
        (lambda: full("s.a", target="csv"), "target"),
        (lambda: model("s.a", View(), ONE, lambda c: "SELECT 1", target="parquet"), "view"),
        (lambda: model("s.a", Embedded(), ONE, lambda c: "SELECT 1", target="parquet"), "embedded"),
        (lambda: model("s.a", UniqueKey(), ONE, lambda c: "SELECT 1"), "key is empty"),
        (lambda: model("s.a", UniqueKey("zz"), ONE, lambda c: "SELECT 1"), "key columns"),
        (lambda: model("s.a", UniqueKey("id"), ONE, lambda c: "SELECT 1", target="parquet"), "plain parquet"),
        (lambda: model("s.a", ScdType2(("id",), "ts", "ts"), ONE, lambda c: "SELECT 1"), "two columns"),
        (lambda: model("s.a", TimeRange("zz", "2026-01-01"), ONE, lambda c: "SELECT 1"), "time column"),
        (lambda: model("s.a", TimeRange("ts", "soon"), ONE, lambda c: "SELECT 1"), "isn't a time"),
        (lambda: model("s.a", TimeRange("ts", "2026-01-01", batch_size=0), ONE, lambda c: "SELECT 1"), "batch_size"),
        (lambda: model("s.a", TimeRange("ts", "2026-01-01", interval="week"), ONE, lambda c: "SELECT 1"), "day or hour"),
        (lambda: model("s.a", Full(), ONE, lambda c: f"SELECT * FROM x WHERE ts < {c.end}"), "bounds"),
        (lambda: model("s.a", Full(), ONE, lambda c: f"SELECT * FROM {c.ref('s.a')}"), "itself"),
        (lambda: model("s.a", Full(), ONE, lambda c: f"SELECT {c.cols(src, 'zz')} FROM {c.ref(src)}"), "no column zz"),
        (lambda: model("s.a", Seed("x.csv"), ONE, lambda c: "SELECT 1"), "external() or seed()"),
        (lambda: model("s.a", External(Source("table", "t")), ONE, lambda c: "SELECT 1"), "external() or seed()"),
        (lambda: external("s.a", Source("csv", "p", True), ONE), "for parquet"),
        (lambda: external("s.a", Source("orc", "p"), ONE), "source"),
        (lambda: external("s.a", parquet("p"), ONE, compaction=Compaction(min_files=1)), "at least 2"),
        (lambda: external("s.a", parquet("p"), ONE, compaction=Compaction(order=("id",))), "only what a key"),
        (lambda: external("s.a", parquet("p"), ONE, compaction=Compaction()), "partition column"),
        (lambda: seed("s.a", "gone.csv", ONE), "isn't there"),
        (lambda: seed("s.a", "x.parquet", ONE), ".csv or .json"),
        (lambda: unique(), "needs a column"),
        (lambda: accepted("id", []), "needs a value"),
        (lambda: custom("c", lambda c: "SELECT 1"), "doesn't read"),
    ],
)
def test_definitions_that_are_wrong(build, said):
    with pytest.raises(ModelError, match=said.replace("(", r"\(").replace(")", r"\)")):
        build()


def test_raw_sql_tokens():
    f = parse_file("SELECT * FROM @ref(a.b) x JOIN @ref( c.d ) y WHERE t >= @start AND t < @end AND mail = 'x@startup.io'")
    assert f.refs == ["a.b", "c.d"] and f.bounded
    assert f.render(lambda n: n.upper(), "1", "2") == "SELECT * FROM A.B x JOIN C.D y WHERE t >= 1 AND t < 2 AND mail = 'x@startup.io'"


def test_types_and_literals():
    assert [family(t) for t in (T.StringType(), T.DecimalType(5, 2), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.ArrayType(T.LongType()), T.BinaryType(), T.NullType())] == ["text", "numeric", "boolean", "temporal", "temporal", "any", "any", "any"]
    assert literal("it's") == r"'it\'s'" and literal(None) == "NULL" and literal(True) == "TRUE" and literal(1.5) == "1.5D"
    with pytest.raises(ValueError):
        literal(float("nan"))
    assert "hunter2" not in mask("password = 'hunter2' and key abc", ("abc",)) and "abc" not in mask("key abc", ("abc",))


def test_schemas_without_a_session():
    s = struct("id bigint, `odd, name` string, d decimal(5,2), a array<struct<x: int, y: map<string, double>>>, t timestamp")
    assert s.names == ["id", "odd, name", "d", "a", "t"] and s["a"].dataType.simpleString() == "array<struct<x:int,y:map<string,double>>>"
    assert s["t"].dataType == T.TimestampNTZType() and s["d"].dataType == T.DecimalType(5, 2) and struct({"a": "int"}).names == ["a"]
    for bad in ("id", "id whatever", "a array<int"):
        with pytest.raises(ValueError):
            struct(bad)


def test_gap_sentences():
    rows = [{"covered_through": 5, "resumes_at": 9}, {"covered_through": 1, "resumes_at": 3}, {"covered_through": 9, "resumes_at": 20}]
    assert gap_sentence(rows) == "covered through 1, resumes at 3 (and 2 further gaps)" and gap_sentence([]) == ""
    assert not_null("a").warn().blocking is False and not_null("a").per_interval().scope == "interval"


def snap(fp, name="s.a", physical=None):
    return Snapshot(name, fp, "", "{}", physical or fp, "full", 1, "{}", "")


def test_store_pointers_orphans_and_claims(tmp_path):
    s = StateStore(tmp_path / "s.db")
    s.save_snapshot(snap("f1"))
    s.save_snapshot(snap("f1"))
    s.save_snapshot(snap("f2"))
    s.promote("dev", {"s.a": "f1"})
    s.promote("dev", {"s.a": "f2"})
    assert s.pointers("dev") == {"s.a": "f2"} and [x.fingerprint for x in s.snapshots() if x.orphaned] == ["f1"]
    claimed = s.claim_orphans(round(time.time() * 1000) + 5)
    assert [c.fingerprint for c in claimed] == ["f1"] and s.snapshot("s.a", "f1") is None
    with pytest.raises(StateError, match="removed meanwhile"):
        s.promote("prod", {"s.a": "f1"})
    assert s.pointers("prod") == {}
    assert [c.fingerprint for c in s.claim_orphans(0)] == ["f1"]  # a claim that wasn't finished comes again
    s.forget(claimed[0])
    assert s.claim_orphans(0) == []
    s.mark("s.a", "f2", [Interval(0, DAY), Interval(DAY, 2 * DAY)], "done")
    s.mark("s.a", "f2", [Interval(DAY, 2 * DAY)], "failed")
    assert s.intervals("s.a", "f2") == [Interval(0, DAY)] and s.intervals("s.a", "f2", "failed") == [Interval(DAY, 2 * DAY)]
    assert s.clear("s.a", "f2", Interval(0, DAY)) == [Interval(0, DAY)]


def test_store_migration(tmp_path):
    p = tmp_path / "s.db"
    s = StateStore(p)
    with s.change() as db:
        db.execute("update meta set value = '1'")
        db.execute("alter table snapshots drop column claimed")
    s.close()
    with pytest.raises(StateError, match="migrate"):
        StateStore(p)
    r = migrate(p)
    assert (r["from"], r["to"]) == (1, 2) and (tmp_path / "s.db.backup-v1").exists()
    assert migrate(p) == {"from": 2, "to": 2}
    StateStore(p).save_snapshot(snap("f"))


def test_locks_exclude_expire_and_fence(tmp_path):
    a, b = StateStore(tmp_path / "s.db"), StateStore(tmp_path / "s.db")
    with held(a, "env:dev", 5), pytest.raises(LockError), held(b, "env:dev", 5):
        pass
    token = a.acquire("k", 0.05)
    time.sleep(0.1)
    other = b.acquire("k", 5)
    assert other and not a.renew("k", token, 5)
    a.release("k", token)
    assert a.acquire("k", 5) is None
    with pytest.raises(LockError, match="lost"), held(a, "z", 0.3):
        with b.change() as db:
            db.execute("update locks set owner = 'thief' where key = 'z'")
        time.sleep(0.4)
    wins: list[bool] = []
    threads = [threading.Thread(target=lambda: wins.append(StateStore(tmp_path / "s.db").acquire("race", 60) is not None)) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(wins) == 1


def test_a_killed_holder_frees_its_lock(tmp_path):
    import os
    import signal
    import subprocess
    import sys

    code = f"from lakeloom.plans.state import StateStore; import time; s = StateStore({str(tmp_path / 's.db')!r}); print(bool(s.acquire('env:dev', 1.0)), flush=True); time.sleep(60)"
    p = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert p.stdout.readline().strip() == "True"
    os.kill(p.pid, signal.SIGKILL)
    p.wait()
    s = StateStore(tmp_path / "s.db")
    assert s.acquire("env:dev", 1) is None
    time.sleep(1.1)
    assert s.acquire("env:dev", 1)


def test_passports_fold_limits():
    inc = lambda n, d, **m: model(n, TimeRange("ts", "2026-01-01"), ONE, lambda c: f"SELECT id, ts FROM {c.ref(d)} WHERE ts >= {c.start} AND ts < {c.end}", **m)
    at = lambda d: {"contiguousThrough": f"2026-01-0{d}", "latestInterval": None, "failedIntervals": 0}
    noted = external("raw.n", table("t"), ONE, answerable="sampled", caveats=["partial"])
    stage = inc("s.stage", noted)
    mart = inc("s.mart", stage, caveats=["rounded"])
    left, right = full("s.left", stage), full("s.right", stage)
    joined = full("s.joined", left, right)
    g = build_graph([noted, stage, mart, left, right, joined])
    r = passports(g, {"s.stage": at(2), "s.mart": at(5)})
    e = r["s.mart"]["effective"]
    assert (e["completeThrough"], e["limitedBy"], e["answerable"]) == ("2026-01-02", "s.stage", "sampled")
    assert e["caveats"] == [{"model": "s.mart", "text": "rounded"}, {"model": "raw.n", "text": "partial"}]
    assert r["s.mart"]["freshness"]["contiguousThrough"] == "2026-01-05" and r["s.mart"]["declared"]["answerable"] == "full"
    assert len(r["s.joined"]["effective"]["caveats"]) == 1 and r["s.joined"]["effective"]["limitedBy"] == "s.stage"
    r = passports(g, {"s.stage": NOTHING, "s.mart": at(5)})
    assert (r["s.mart"]["effective"]["completeThrough"], r["s.mart"]["effective"]["limitedBy"]) == (None, "s.stage")
    assert passports(build_graph([noted]), {})["raw.n"]["effective"]["limitedBy"] is None
    f = freshness([Interval(0, DAY), Interval(DAY, 2 * DAY), Interval(4 * DAY, 5 * DAY)], 2)
    assert f == {"contiguousThrough": "1970-01-03T00:00:00.000Z", "latestInterval": "1970-01-06T00:00:00.000Z", "failedIntervals": 2}
    assert freshness([], 0)["latestInterval"] is None
    assert view_name("prod", "a.b") == "`a`.`b`" and view_name("dev", "a.b") == "`dev__a`.`b`"


def test_metrics_text():
    m = Metrics()
    m.add("lakeloom_intervals_done_total", 3)
    m.set("lakeloom_model_build_duration_seconds", 1.5, model='a"b')
    assert m.text() == '# HELP lakeloom_intervals_done intervals computed and marked done\n# TYPE lakeloom_intervals_done counter\nlakeloom_intervals_done_total 3\n# HELP lakeloom_model_build_duration_seconds seconds that a model\'s last build took\n# TYPE lakeloom_model_build_duration_seconds gauge\nlakeloom_model_build_duration_seconds{model="a\\"b"} 1.5\n# EOF\n'


def test_schedules(tmp_path):
    assert schedule.calendar("@daily") == "*-*-* 00:00:00" and schedule.calendar("*/30 6 * * mon-wed") == "Mon,Tue,Wed *-*-* 06:00,30:00"
    for bad in ("* * *", "61 * * * *", "0 0 30 2 *", "x * * * *"):
        with pytest.raises(LoomError):
            schedule.fields(bad)
    c = tmp_path / "lakeloom_config.py"
    once = schedule.with_entry("5 4 * * * other\n", "dev", "@hourly", c)
    assert schedule.with_entry(once, "dev", "@daily", c).count("lakeloom run dev") == 1
    assert schedule.with_entry(once, "dev", None, c) == "5 4 * * * other\n"
    assert "OnCalendar=*-*-* *:00:00" in "".join(schedule.units("dev", "@hourly", c).values())


def test_paths_of_partitions():
    assert glob_root("/a/b/day=*/x.parquet") == "/a/b" and glob_root("/a/b/") == "/a/b"
    assert partition_day("day=2026-01-02T05", "day") == millis("2026-01-02") and partition_day("day=soon", "day") is None


def test_json_is_an_object(capsys):
    from lakeloom.cli import decide, pairs, show

    show({"x": 1})
    assert json.loads(capsys.readouterr().out) == {"apiVersion": 1, "x": 1}
    assert [decide(*x) for x in ((False, False, False), (True, True, False), (True, False, True), (True, False, False))] == ["apply", "apply", "ask", "refuse"]
    assert pairs("a.b=breaking, c.d=non-breaking") == {"a.b": "breaking", "c.d": "non-breaking"}
    with pytest.raises(LoomError):
        pairs("a.b=maybe")


def test_public_names():
    import lakeloom

    assert all(hasattr(lakeloom, n) for n in lakeloom.__all__) and sorted(lakeloom.__all__) == lakeloom.__all__
    assert {"Project", "model", "external", "seed", "sql_model", "check_model", "read_manifest"} <= set(lakeloom.__all__)


def test_nothing_in_the_library_needs_the_training_data_package():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lakeloom"
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module or ''}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n.startswith("corpus_pipeline") for n in names), path
