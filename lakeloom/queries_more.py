"""More driver queries: sources and sinks, the executor, versions, analyses and the operational surface, each with the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io
import json
import logging
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .cli import main as command_line
from .errors import AuditError, ContractError, EngineError, LockError, LoomError
from .operators.audits import accepted, assert_contiguous, assert_no_gaps, custom, gap_sentence, not_null, unique
from .operators.compact import compact
from .operators.diff import schema_drift
from .operators.lineage import printed
from .plans import graph_view, ops, schedule
from .plans.config import discover, open_project
from .plans.engine import shared_dir
from .plans.executor import Executor, contract_problems
from .plans.fingerprint import canonical_trees, versions
from .plans.graph import build_graph
from .plans.lock import held
from .plans.model import Compaction, Embedded, Full, TimeRange, UniqueKey, View, csv, external, model, parquet, seed, table
from .plans.model import json as json_files
from .plans.planner import plan_json
from .plans.state import StateStore, migrate
from .queries import _DDL, NEXT, NOW, ORACLES, QUERIES, _events, _frame, _one, _project, _raw, _with, query

__all__ = ["ORACLES", "QUERIES"]


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _values(names: str, *rows: tuple) -> str:
    """SQL of constant rows."""
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


def _said(error: type[Exception], act: Callable[[], object]) -> str:
    try:
        act()
    except error as e:
        return str(e)
    return "nothing"


# sources and sinks
@query("select n_regionkey, count(*) as n from nation group by 1")
def external_table_source(spark, sf_dir):
    """A table that something else keeps, read under its own name."""
    own = f"src_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {own}")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.saveAsTable(f"{own}.nation")
    raw = external("raw.nation", table(f"{own}.nation"), _DDL["nation"])
    return _one(spark, "mart.by_region", "n_regionkey int, n bigint", lambda c: f"SELECT n_regionkey, count(*) AS n FROM {c.ref(raw)} GROUP BY 1", raw)


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal < 0")
def external_csv_source(spark, sf_dir):
    """Files with a header, columns by name with their declared types, in whatever order the files have them."""
    place = _place(spark, "csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", "c_acctbal", "c_custkey").write.option("header", "true").csv(place)
    raw = external("raw.customer", csv(place), "c_custkey bigint, c_name string, c_acctbal double")
    return _one(spark, "mart.debtors", "c_custkey bigint, c_name string, c_acctbal double", lambda c: f"SELECT * FROM {c.ref(raw)} WHERE c_acctbal < 0", raw)


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 = 0")
def external_json_source(spark, sf_dir):
    """A record a line."""
    place = _place(spark, "json")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(place)
    raw = external("raw.orders", json_files(place), "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return _one(spark, "mart.third", "o_orderkey bigint, o_orderstatus string, o_totalprice double", lambda c: f"SELECT * FROM {c.ref(raw)} WHERE o_orderkey % 3 = 0", raw)


@query("select n_nationkey, n_name from nation")
def external_json_array_source(spark, sf_dir):
    """One file that is a list of records."""
    place = _place(spark, "array")
    whole = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    whole.write.text(place)
    raw = external("raw.nation", json_files(place), "n_nationkey int, n_name string")
    return _one(spark, "mart.nations", "n_nationkey int, n_name string", lambda c: f"SELECT * FROM {c.ref(raw)}", raw)


@query("select date_trunc('day', ts)::date as day, count(*) as n from events where ts < timestamp '2024-01-08' group by 1")
def hive_new_partition(spark, sf_dir):
    """Directories of days are a column; those that arrive after the first apply are seen by the next."""
    place = _place(spark, "landing")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    raw = external("raw.landing", parquet(place, hive_partitioning=True), "event_id bigint, day date")
    m = model("mart.days", View(), "day date, n bigint", lambda c: f"SELECT day, count(*) AS n FROM {c.ref(raw)} GROUP BY day")
    for a, b in ((1, 4), (4, 8)):
        e.where((F.dayofmonth("ts") >= a) & (F.dayofmonth("ts") < b) & (F.col("ts") < F.lit("2024-02-01"))).select("event_id", "day").write.mode("append").partitionBy("day").parquet(place)
        p = _project(spark, raw, m)
        p.apply("dev", now=NOW)
    return p.table("dev", "mart.days")


@query("select event_id, ts, user_id, event_type, value from events where ts >= timestamp '2024-01-07' and ts < timestamp '2024-01-08'")
def pruned_interval_scan(spark, sf_dir):
    """A day of a table filled by day: of its intervals' directories only that day's is opened."""
    p = _project(spark, *_events(sf_dir))
    p.apply("dev", now=NEXT)
    return p.table("dev", "stage.events", "2024-01-07", "2024-01-08")


@query("select date_trunc('day', ts)::timestamp as day, count(distinct user_id) as users from events where ts < timestamp '2024-01-29' group by 1")
def windowed_parent(spark, sf_dir):
    """A daily sum over a daily table that reads, in each batch, only the batch's directories of it."""
    raw, stage = _events(sf_dir)
    m = model("mart.users", TimeRange("day", "2024-01-01", batch_size=7), "day timestamp, users bigint", lambda c: f"SELECT CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) AS day, count(DISTINCT user_id) AS users FROM {c.window(stage)} GROUP BY 1")
    p = _project(spark, raw, stage, m)
    p.apply("dev", now=NOW)
    return p.table("dev", "mart.users")


@query("select event_id, ts, user_id, event_type, value from events where ts < timestamp '2024-01-06'")
def lake_scan(spark, sf_dir):
    """A child reads a lake of directories whole: their names aren't columns, and ``*`` shows just the declared ones."""
    raw, m = _events(sf_dir, target="parquet")
    child = model("mart.copy", Full(), "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", lambda c: f"SELECT * FROM {c.ref(m)}")
    p = _project(spark, raw, m, child)
    p.apply("dev", now="2024-01-06")
    return p.table("dev", "mart.copy")


@query("select n_nationkey, n_name, 'nations' as place from nation")
def export_default_name(spark, sf_dir):
    """An export that names only a database takes the model's own table name there, and is written anew by each apply that works."""
    own = f"out_{uuid.uuid4().hex[:8]}"
    raw = _raw(sf_dir, "nation")
    m = model("mart.nations", Full(), "n_nationkey int, n_name string", lambda c: f"SELECT n_nationkey, n_name FROM {c.ref(raw)}", export=own)
    p = _project(spark, raw, m)
    p.apply("prod", now=NOW)
    return spark.table(f"{own}.nations").withColumn("place", F.lit("nations"))


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 0")
def export_over_jdbc(spark, sf_dir):
    """An export to another database over JDBC, written anew by a second apply; here one on disk that runs inside the driver, where no executor sees it."""
    home = tempfile.mkdtemp(prefix="derby-")
    url = f"jdbc:derby:{home}/db;create=true"
    raw = _raw(sf_dir, "customer")
    m = lambda least: model("mart.creditors", Full(), "c_custkey bigint, c_name string, c_acctbal double", lambda c: f"SELECT c_custkey, c_name, c_acctbal FROM {c.ref(raw)} WHERE c_acctbal > {least}", export=f"{url}#creditors")
    try:
        p = _project(spark, raw, m(1000), export_options={"batchsize": "500"})
        p.apply("prod", now=NOW)
        _with(p, raw, m(0)).apply("prod", now=NOW)
        there = spark._jvm.java.sql.DriverManager.getConnection(url)
        there.createStatement().execute(f"""CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY('SELECT "c_custkey", "c_name", "c_acctbal" FROM creditors', '{home}/rows.csv', null, null, 'UTF-8')""")
        there.close()
        fs, place = p.engine._fs(f"{_place(spark, 'creditors')}.csv")
        fs.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(f"file://{home}/rows.csv"), place)
    finally:
        _said(Exception, lambda: spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{home}/db;shutdown=true"))  # an exception is how Derby says done
        shutil.rmtree(home, ignore_errors=True)
    return spark.read.csv(place.toString(), "c_custkey bigint, c_name string, c_acctbal double", escape='"', nullValue="\0", multiLine=True, mode="FAILFAST")


@query("select n_name, n_regionkey, true as managed from nation where n_regionkey > 1")
def catalog_target(spark, sf_dir):
    """A model kept as a table of a catalog that the session names, under the versions' own names."""
    own, before = f"cat_{uuid.uuid4().hex[:8]}", spark.conf.get("spark.lakeloom.catalog", None)
    raw = _raw(sf_dir, "nation")
    m = model("mart.kept", Full(), "n_name string, n_regionkey int", lambda c: f"SELECT n_name, n_regionkey FROM {c.ref(raw)} WHERE n_regionkey > 1", target="catalog")
    p = _project(spark, raw, m)
    assert "needs spark.lakeloom.catalog" in _said(LoomError, lambda: p.apply("dev", now=NOW))
    spark.conf.set("spark.lakeloom.catalog", f"spark_catalog.{own}")
    try:
        p.apply("dev", now=NOW)
    finally:
        spark.conf.set("spark.lakeloom.catalog", before) if before else spark.conf.unset("spark.lakeloom.catalog")
    tables = [t.name for t in spark.catalog.listTables(own) if not t.isTemporary]
    kept = len(tables) == 1 and tables[0].startswith("mart__kept__") and spark.table(f"{own}.{tables[0]}").count() == p.table("dev", "mart.kept").count()
    return p.table("dev", "mart.kept").withColumn("managed", F.lit(kept))


@query("""with v as (select distinct event_id * 70000 as value from events where event_id % 7 <> 0 union select distinct event_id from events where event_id % 5 <> 0), l as (select value, lag(value) over (order by value) as before from v)
select before as covered_through, value as resumes_at, value - before - 1 as missing from l where value > before + 1""")
def audit_contiguous_ranges(spark, sf_dir):
    """Holes within and between ranges of values that are looked at side by side."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.where("event_id % 7 <> 0").selectExpr("event_id * 70000L AS event_id").union(e.where("event_id % 5 <> 0").selectExpr("CAST(event_id AS BIGINT)")).createOrReplaceTempView("audited_ranges")
    return spark.sql(assert_contiguous("event_id").sql("audited_ranges"))


@query(_values("died, rows, files", ("after the intent", 12, 1), ("before any file moved", 12, 2), ("between deletions", 12, 1)))
def compaction_after_a_crash(spark, sf_dir):
    """A compaction that dies loses and repeats no row: the next run finishes it, or takes back what wasn't decided."""
    rows = []
    for died in ("before any file moved", "after the intent", "between deletions"):
        place = _place(spark, "crash")
        spark.range(12).repartition(2).write.parquet(f"{place}/day=2024-01-02")
        raw = external("raw.days", parquet(f"{place}/*/*.parquet"), "id bigint", compaction=Compaction(2, 0, partition="day"))
        p = _project(spark, raw)
        write_text, delete, seen = p.engine.write_text, p.engine.delete, []

        def halt(*args, then=None) -> None:
            seen.append(args)
            if then and len(seen) < 2:
                then(*args)
                return
            raise OSError("killed")

        if died == "before any file moved":
            p.engine.write_text = halt
        elif died == "after the intent":
            p.engine.delete = lambda x: halt(x) if x.endswith(".parquet") else delete(x)
        else:
            p.engine.delete = lambda x: halt(x, then=delete) if x.endswith(".parquet") else delete(x)
        assert compact(p.engine, p.graph, lambda m: None, now=4_000_000_000_000).warnings
        p.engine.write_text, p.engine.delete = write_text, delete
        if died == "before any file moved":
            from .operators.compact import recover

            recover(p.engine, place)
        else:
            compact(p.engine, p.graph, lambda m: None, now=4_000_000_000_000)
        rows.append((died, spark.read.parquet(place).select("id").distinct().count() if spark.read.parquet(place).count() == 12 else -1, sum(f.endswith(".parquet") for f, _, _ in p.engine.files(place))))
    return _frame(spark, rows, "died string, rows int, files int")


@query(_values("step, files, there", ("written", 1, True), ("moved", 1, True), ("replaced", 2, True), ("deleted", 0, False)))
def file_store(spark, sf_dir):
    """Listing, moving, replacing and deleting through Hadoop's file systems; what scans skip isn't listed."""
    p = _project(spark, _raw(sf_dir, "nation"))
    e, place = p.engine, _place(spark, "files")
    rows = []
    one = spark.range(10).coalesce(1)
    one.write.parquet(f"{place}/a")
    one.write.parquet(f"{place}/_hidden")
    see = lambda step, d: rows.append((step, sum(f.endswith(".parquet") for f, _, _ in e.files(f"{place}/{d}")), e.exists(f"{place}/{d}")))
    see("written", "a")
    e.move(f"{place}/a", f"{place}/b")
    see("moved", "b")
    spark.range(10).repartition(2).write.parquet(f"{place}/c")
    e.move(f"{place}/c", f"{place}/b")
    see("replaced", "b")
    e.delete(f"{place}/b")
    see("deleted", "b")
    return _frame(spark, rows, "step string, files int, there boolean")


@query("select n_name, 'prepared' as mark, true as masked from nation where n_regionkey = 2")
def engine_preparation(spark, sf_dir):
    """Statements that run before anything is parsed, and errors that don't show secrets."""
    raw = _raw(sf_dir, "nation")
    v = model("mart.asia", Full(), "n_name string, mark string", lambda c: f"SELECT n_name, mark FROM {c.ref(raw)} CROSS JOIN prepared.marks WHERE n_regionkey = 2")
    p = _project(spark, raw, v, prepare=("CREATE DATABASE IF NOT EXISTS prepared", "CREATE OR REPLACE VIEW prepared.marks AS SELECT 'prepared' AS mark"), secrets=("hush-hush",))
    p.apply("dev", now=NOW)
    text = _said(EngineError, lambda: p.engine.execute("SELECT 'hush-hush' FROM nowhere.at_all"))
    return p.table("dev", "mart.asia").withColumn("masked", F.lit("hush" not in text and "***" in text))


@query("""select c_custkey, case when c_custkey in (7, 11) then c_acctbal + 1 else c_acctbal end as c_acctbal, 2 as rewritten from customer where c_custkey <= 500""")
def keyed_buckets(spark, sf_dir):
    """An upsert of two keys writes their buckets alone; the others' directories stay where they were."""
    from .plans import executor

    place = _place(spark, "keyed")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal").where("c_custkey <= 500")
    customer.write.parquet(f"{place}/load=1")
    raw = external("raw.customer", parquet(place, union_by_name=True), "c_custkey bigint, c_acctbal double")
    m = model("dim.balances", UniqueKey("c_custkey"), "c_custkey bigint, c_acctbal double", lambda c: f"SELECT * FROM {c.ref(raw)}", audits=[unique("c_custkey")])
    p = _project(spark, raw, m)
    size, executor.BUCKET_BYTES = executor.BUCKET_BYTES, 300  # else so few rows are one bucket
    try:
        p.apply("dev", now=NOW)
    finally:
        executor.BUCKET_BYTES = size
    fp = p.store.pointers("dev")["dim.balances"]
    before = p.store.places("dim.balances", fp)
    p.engine.delete(f"{place}/load=1")
    customer.where("c_custkey in (7, 11)").withColumn("c_acctbal", F.col("c_acctbal") + 1).write.parquet(f"{place}/load=2")
    p.run("dev", now=NOW)
    after = p.store.places("dim.balances", fp)
    moved = sum(after[b] != before[b] for b in before)
    assert len(before) > 4 and before.keys() == after.keys()
    return p.table("dev", "dim.balances").withColumn("rewritten", F.lit(moved))


# state and the executor
@query(_values("step, answer", ("pointers", "mart.a"), ("environments", "dev"), ("orphans", "mart.a@bb"), ("intervals", "2"), ("after clear", "1"), ("last plan", "me"), ("last run", "ok"), ("cached trees", "1")))
def state_api(spark, sf_dir):
    """The store's operations: versions, pointers, orphans, intervals, journals and parse trees."""
    from .plans.interval import Interval
    from .plans.state import Snapshot

    s, day = StateStore(), 86_400_000
    snap = lambda n, fp: Snapshot(n, fp, "", None, fp, "full", 1, "{}", "")
    for fp in ("aa", "bb"):
        s.save_snapshot(snap("mart.a", fp))
        s.promote("dev", {"mart.a": fp})
    s.promote("dev", {"mart.a": "aa"})
    rows = [("pointers", ",".join(s.pointers("dev"))), ("environments", ",".join(s.environments()))]
    rows.append(("orphans", ",".join(f"{x.name}@{x.fingerprint}" for x in s.claim_orphans(1 << 60))))
    s.mark("mart.a", "aa", [Interval(0, day), Interval(day, 2 * day)], "done")
    rows.append(("intervals", str(len(s.intervals("mart.a", "aa")))))
    s.clear("mart.a", "aa", Interval(0, day))
    rows.append(("after clear", str(len(s.intervals("mart.a", "aa")))))
    s.journal_plan("dev", "me", {})
    s.journal_run("dev", 0, "ok", {})
    s.save_canon({"k": "[]"})
    rows += [("last plan", s.last_plan("dev")["appliedBy"]), ("last run", s.last_runs("dev")[0]["outcome"]), ("cached trees", str(len(s.canon(["k", "other"]))))]
    return _frame(spark, rows, "step string, answer string")


@query("select event_type, count(*) as n from events where ts < timestamp '2024-01-29' group by 1")
def state_reopened(spark, sf_dir):
    """A store in a file: another project opens it after every table and view is gone from the catalog, and serves what was built."""
    raw, stage = _events(sf_dir)
    mart = model("mart.types", View(), "event_type string, n bigint", lambda c: f"SELECT event_type, count(*) AS n FROM {c.ref(stage)} GROUP BY 1")
    env = f"e{uuid.uuid4().hex[:8]}"
    home = tempfile.mkdtemp(prefix="state-")  # the driver's own
    p = _project(spark, raw, stage, mart, state=f"{home}/loom.sqlite")
    p.apply(env, now=NOW)
    for s in p.store.snapshots():
        if s.kind == "view":
            p.engine.execute(f"DROP VIEW `_phys`.`mart__types__{s.physical[:8]}`")
        elif s.kind != "external":
            p.engine.execute(f"DROP VIEW `_phys`.`stage__events__{s.physical[:8]}`")
            p.engine.execute(f"DROP TABLE `_phys`.`stage__events__{s.physical[:8]}__files`")
    spark.sql(f"DROP DATABASE `{env}__mart` CASCADE")
    p.store.close()
    from .plans.project import Project

    return Project(spark, [raw, stage, mart], p.lake, f"{home}/loom.sqlite").table(env, "mart.types")


@query("select n_name, 3 as tries, '0.5,1.0' as waits from nation")
def retry_of_writes(spark, sf_dir):
    """A write that fails twice is tried again after growing waits, and its rows are there once."""
    raw = _raw(sf_dir, "nation")
    m = model("mart.n", Full(), "n_name string", lambda c: f"SELECT n_name FROM {c.ref(raw)}")
    p = _project(spark, raw, m)
    tries, waits, move = [], [], p.engine.move

    def flaky(a: str, b: str) -> None:
        tries.append(a)
        if len(tries) < 3:
            raise OSError("the disk blinked")
        move(a, b)

    p.engine.move = flaky
    Executor(p.engine, p.store, p.lake, sleep=waits.append).apply(p.graph, p.plan("dev", now=NOW), 0)
    return p.table("dev", "mart.n").withColumn("tries", F.lit(len(tries))).withColumn("waits", F.lit(",".join(map(str, waits))))


@query(_values("tick, outcome", (1, "error: not yet"), (2, "2024-01-28"), (3, "2024-01-29"), (4, "2024-01-30")))
def daemon_ticks(spark, sf_dir):
    """Ticks until stopped; one that fails is told and the next comes."""
    p = _project(spark, *_events(sf_dir))
    p.apply("dev", now="2024-01-27")
    stop, rows = threading.Event(), []

    def one() -> None:
        k = len(rows) + 1
        if k == 1:
            raise LoomError("not yet")
        p.run("dev", now=f"2024-01-{26 + k}")
        rows.append((k, p.status("dev", now=NEXT)["lag"][0]["doneUpTo"][:10]))
        if k == 4:
            stop.set()

    ops.daemon(one, 0.001, stop, lambda e: rows.append((1, f"error: {e}")))
    return _frame(spark, rows, "tick int, outcome string")


@query(_values("problem", ("column extra isn't declared",), ("column gone is missing",), ("column n_name is text, declared numeric",)))
def contract_deviations(spark, sf_dir):
    """Missing, extra and otherwise typed columns, all at once and without running the query; nothing is promoted."""
    raw = _raw(sf_dir, "nation")
    m = model("mart.bad", Full(), "n_nationkey int, n_name double, gone string", lambda c: f"SELECT n_nationkey, n_name, 1 AS extra FROM {c.ref(raw)}")
    p = _project(spark, raw, m)
    try:
        p.apply("dev", now=NOW)
    except ContractError as e:
        problems = e.problems
    found = contract_problems(m.schema, p.engine.describe(f"SELECT n_nationkey, n_name, 1 AS extra FROM parquet.`{sf_dir}/nation.parquet`"))
    return _frame(spark, [(x,) for x in problems if x in found and not p.store.pointers("dev")], "problem string")


@query(_values("audit, runs", ("any", 5), ("interval", 4), ("whole", 1)))
def audit_scopes(spark, sf_dir):
    """Four batches and a last pass: each batch runs the audits of its scope, the pass over the whole those that ask about it, and with them those of any scope again."""
    seen: dict[str, int] = {}
    raw, stage = _events(sf_dir, batch_size=7, audits=[custom("any", lambda c: f"SELECT 'any' AS mark FROM {c.self} WHERE false"), custom("interval", lambda c: f"SELECT 'interval' AS mark FROM {c.self} WHERE false").per_interval(), custom("whole", lambda c: f"SELECT 'whole' AS mark FROM {c.self} WHERE false").whole()])
    p = _project(spark, raw, stage)
    ask = p.engine.query

    def watched(sql: str) -> DataFrame:
        if "AS mark" in sql:
            name = sql.split("'")[1]
            seen[name] = seen.get(name, 0) + 1
        return ask(sql)

    p.engine.query = watched
    p.apply("dev", now=NOW)
    return _frame(spark, sorted(seen.items()), "audit string, runs int")


@query("""with d as (select distinct date_trunc('day', ts)::timestamp as v from events where day(ts) not in (5, 6, 11)), g as (select v, lag(v) over (order by v) as b from d), h as (select * from g where v > b + interval 1 day)
select 'covered through ' || strftime(min_by(b, v), '%Y-%m-%d %H:%M:%S') || ', resumes at ' || strftime(min(v), '%Y-%m-%d %H:%M:%S') || case when count(*) > 1 then ' (and ' || (count(*) - 1) || ' further gap' || case when count(*) > 2 then 's' else '' end || ')' else '' end as sentence from h""")
def gap_report(spark, sf_dir):
    """What a gap audit says: the first gap, and how many more."""
    spark.read.parquet(f"{sf_dir}/events.parquet").where("day(ts) NOT IN (5, 6, 11)").createOrReplaceTempView("audited_days")
    bad = spark.sql(assert_no_gaps("ts", "day").sql("audited_days"))
    return _frame(spark, [(gap_sentence(bad.orderBy("resumes_at").limit(1).collect(), bad.count()),)], "sentence string")


@query(_values("step, answer", ("violations", "blocking audit"), ("promoted", "nothing"), ("warned", "promoted")))
def audit_blocks_promotion(spark, sf_dir):
    """A blocking audit of the whole ends the apply before promotion; as a warning it doesn't."""
    full = lambda audit: _events(sf_dir, audits=[audit.whole()])
    p = _project(spark, *full(accepted("event_type", ["nothing like it"])))
    text = _said(AuditError, lambda: p.apply("dev", now=NOW))
    rows = [("violations", "blocking audit" if "accepted(event_type)" in text else text), ("promoted", ",".join(p.store.pointers("dev")) or "nothing")]
    q = _project(spark, *full(accepted("event_type", ["nothing like it"]).warn()))
    rows.append(("warned", "promoted" if q.apply("dev", now=NOW).promoted else "not promoted"))
    return _frame(spark, rows, "step string, answer string")


@query("""select 'not_null(user_id)' as audit, (select count(*) from events where user_id is null and ts < timestamp '2024-01-29') as violations, false as skipped union all
select 'unique(event_type)', (select count(*) from (select event_type from events where ts < timestamp '2024-01-29' group by 1 having count(*) > 1)), false union all
select 'contiguous(event_id)', (select count(*) from (select event_id - lag(event_id) over (order by event_id) as d from events where ts < timestamp '2024-01-29') where d > 1), false union all select 'not_null(value)', null, true""")
def standalone_audit(spark, sf_dir):
    """Audits of what an environment serves, without building; those that ask about an interval are left out and named."""
    p = _project(spark, *_events(sf_dir, audits=[not_null("user_id"), unique("event_type").warn(), assert_contiguous("event_id").warn(), not_null("value").per_interval()]))
    p.apply("dev", now=NOW)
    r = p.audit("dev")
    rows = [(x["audit"], x["violations"], False) for x in r["results"]] + [(x["audit"], None, True) for x in r["skipped"]]
    return _frame(spark, rows, "audit string, violations bigint, skipped boolean")


# versions
_BODY = "SELECT user_id, count(*) AS n FROM {} WHERE value > 1 GROUP BY user_id"


@query(_values("other, same", ("another bound", False), ("another description", True), ("another grain", False), ("another layout of the text", True), ("another parent", False), ("another target", False), ("audits", True)))
def fingerprints(spark, sf_dir):
    """What makes another version of a model and what doesn't."""
    raw = _raw(sf_dir, "events")
    wider = external("raw.events", parquet(f"{sf_dir}/events.parquet"), _DDL["events"] + ", more int")
    m = lambda body=_BODY, parent=raw, **x: model("mart.u", Full(), "user_id bigint, n bigint", lambda c: body.format(c.ref(parent)), **x)
    p = _project(spark, raw, m())
    fp = lambda *models: versions(build_graph(models), p.engine)["mart.u"][0]
    base = fp(raw, m())
    others = {
        "another layout of the text": (raw, m("select user_id,  count(*) as n -- so many\nfrom {} where value > 1 group by user_id")), "another bound": (raw, m(_BODY.replace("> 1", "> 2"))),
        "another description": (raw, m(description="d", caveats=["c"])), "audits": (raw, m(audits=[not_null("n")])), "another grain": (raw, m(grain=["user_id"])),
        "another target": (raw, m(target="parquet")), "another parent": (wider, m(parent=wider)),
    }
    return _frame(spark, [(k, fp(*v) == base) for k, v in sorted(others.items())], "other string, same boolean")


@query(_values("changed, same", ("batch_size", True), ("interval", False), ("lookback", True), ("start", True), ("time_column", False)))
def kind_payloads(spark, sf_dir):
    """Of a time range its column and grain make a version; where filling starts, in what portions and what is read again don't."""
    raw = _raw(sf_dir, "events")
    m = lambda **x: model("stage.e", TimeRange(**{"time_column": "ts", "start": "2024-01-01"} | x), "ts timestamp, other timestamp", lambda c: f"SELECT ts, ts AS other FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}")
    p = _project(spark, raw, m())
    fp = lambda **x: versions(build_graph([raw, m(**x)]), p.engine)["stage.e"][0]
    return _frame(spark, [(k, fp(**{k: v}) == fp()) for k, v in sorted({"batch_size": 3, "lookback": 2, "start": "2025-01-01", "interval": "hour", "time_column": "other"}.items())], "changed string, same boolean")


@query(_values("pass, parsed, cached", (1, 2, 2), (2, 0, 2), (3, 1, 3)))
def parse_cache(spark, sf_dir):
    """A body is parsed once; the store keeps its tree by the text and the engine's version."""
    raw = _raw(sf_dir, "events")
    m = lambda n, x: model(f"mart.{n}", Full(), "user_id bigint", lambda c: f"SELECT user_id FROM {c.ref(raw)} WHERE value > {x}")
    p = _project(spark, raw, m("a", 1), m("b", 2))
    parsed, parse = [], p.engine.canonical
    p.engine.canonical = lambda sql: parsed.append(sql) or parse(sql)
    rows = []
    for k, models in enumerate(([m("a", 1), m("b", 2)], [m("a", 1), m("b", 2)], [m("a", 1), m("b", 3)]), 1):
        before = len(parsed)
        canonical_trees(build_graph([raw, *models]), p.engine, p.store)
        rows.append((k, len(parsed) - before, p.store._rows("select count(*) as n from canon")[0]["n"]))
    return _frame(spark, rows, "pass int, parsed int, cached int")


@query(_values("place, model, descendants", (0, "raw.events", "stage.events,mart.daily,mart.top"), (1, "stage.events", "mart.daily,mart.top"), (2, "mart.daily", "mart.top"), (3, "mart.top", "")))
def graph_order(spark, sf_dir):
    """Models in an order that doesn't depend on the input's, with all that read them; circles and unknown references are refused."""
    raw, stage = _events(sf_dir)
    daily = model("mart.daily", View(), "n bigint", lambda c: f"SELECT count(*) AS n FROM {c.ref(stage)}")
    top = model("mart.top", View(), "n bigint", lambda c: f"SELECT max(n) AS n FROM {c.ref(daily)}")
    g = build_graph([top, daily, raw, stage])
    assert g.order == build_graph([stage, raw, top, daily]).order
    return _frame(spark, [(k, n, ",".join(g.descendants(n))) for k, n in enumerate(g.order)], "place int, model string, descendants string")


@query(_values("model, change, diverged, cascade", ("mart.top", "indirect", 0, "stage.events"), ("stage.events", "breaking", 1, "")))
def plan_explained(spark, sf_dir):
    """Why a model has another version: where its tree diverges, or which parents changed."""
    raw, stage = _events(sf_dir)
    top = lambda s: model("mart.top", Full(), "user_id bigint, n bigint", lambda c: f"SELECT user_id, count(*) AS n FROM {c.ref(s)} GROUP BY user_id")
    p = _project(spark, raw, stage, top(stage))
    p.apply("dev", now="2024-01-03")
    other = model("stage.events", stage.kind, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", lambda c: f"SELECT event_id, ts, user_id, event_type, value + 1 AS value FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}")
    plan = plan_json(_with(p, raw, other, top(other)).plan("dev", now="2024-01-03"))
    rows = [(a["name"], a["change"], min(1, len(a["explain"]["diverged"])), ",".join(a["explain"].get("cascadeFrom", []))) for a in plan["actions"] if "explain" in a]
    return _frame(spark, rows, "model string, change string, diverged int, cascade string")


@query(_values("verdict, change, was", ("as planned", "breaking", None), ("forced", "non-breaking", "breaking"), ("refused", "loses columns", None)))
def reclassified(spark, sf_dir):
    """An operator's verdict over the planner's, refused where readers would lose columns."""
    raw = _raw(sf_dir, "nation")
    m = lambda body, schema="n_name string, n_regionkey int": model("mart.n", Full(), schema, lambda c: body.format(c.ref(raw)))
    p = _project(spark, raw, m("SELECT n_name, n_regionkey FROM {}"))
    p.apply("dev", now=NOW)
    q = _with(p, raw, m("SELECT upper(n_name) AS n_name, n_regionkey FROM {}"))
    rows = []
    for what, verdict in (("as planned", {}), ("forced", {"mart.n": "non-breaking"})):
        a = q.plan("dev", now=NOW, reclassify=verdict).by_name["mart.n"]
        rows.append((what, a.change, a.reclassified_from))
    text = _said(LoomError, lambda: _with(p, raw, m("SELECT n_name FROM {}", "n_name string")).plan("dev", now=NOW, reclassify={"mart.n": "non-breaking"}))
    rows.append(("refused", "loses columns" if "loses columns" in text else text, None))
    return _frame(spark, rows, "verdict string, change string, was string")


@query("select n_name, 'mart.gone' as removed, 2 as kept from nation where n_regionkey = 1")
def janitor_removes(spark, sf_dir):
    """Versions that nothing has served for long go with their tables and files; what is served stays."""
    raw = _raw(sf_dir, "nation")
    m = lambda n, k: model(f"mart.{n}", Full(), "n_name string", lambda c: f"SELECT n_name FROM {c.ref(raw)} WHERE n_regionkey = {k}")
    p = _project(spark, raw, m("here", 1), m("gone", 2), m("also", 3))
    p.apply("dev", now=NOW)
    q = _with(p, raw, m("here", 1), m("also", 3))
    q.apply("dev", now=NOW)
    report = q.janitor(ttl=-1000)
    gone = ",".join(x.partition("@")[0] for x in report["removed"])
    return q.table("dev", "mart.here").withColumn("removed", F.lit(gone)).withColumn("kept", F.lit(report["kept"]))


@query(_values("step, answer", ("first", "held"), ("second", "locked"), ("after", "held"), ("expired", "taken over"), ("fenced", "not renewed")))
def locks(spark, sf_dir):
    """One owner at a time; a lock that ran out is taken over, and its old owner can't renew it."""
    s, rows = StateStore(), []
    with held(s, "env:dev"):
        rows.append(("first", "held"))
        rows.append(("second", "locked" if "locked" in _said(LockError, lambda: held(s, "env:dev").__enter__()) else "held"))
    with held(s, "env:dev"):
        rows.append(("after", "held"))
    old = s.acquire("k", -1)
    rows.append(("expired", "taken over" if s.acquire("k", 60) else "locked"))
    rows.append(("fenced", "renewed" if s.renew("k", old, 60) else "not renewed"))
    return _frame(spark, rows, "step string, answer string")


@query(_values("step, answer", ("opening", "refused"), ("migrated", "1 -> 2"), ("copy", "kept"), ("again", "2 -> 2"), ("newer", "refused")))
def store_migration(spark, sf_dir):
    """An older store doesn't open before it is migrated, which keeps a copy; a newer one never opens."""
    import sqlite3

    path = f"{tempfile.mkdtemp(prefix='migrate-')}/s.sqlite"
    StateStore(path).close()

    def layout(version: str) -> None:
        db = sqlite3.connect(path)
        db.execute("update meta set value = ? where key = 'version'", (version,))
        db.commit()
        db.close()

    layout("1")
    opens = lambda: "refused" if _said(LoomError, lambda: StateStore(path).close()) != "nothing" else "open"
    rows = [("opening", opens())]
    r = migrate(path)
    rows += [("migrated", f"{r['from']} -> {r['to']}"), ("copy", "kept" if Path(r["backup"]).exists() else "lost")]
    r = migrate(path)
    rows.append(("again", f"{r['from']} -> {r['to']}"))
    layout("99")
    rows.append(("newer", opens()))
    return _frame(spark, rows, "step string, answer string")


@query(_values("form, text", ("logical", "SELECT n FROM stage.e WHERE n > 1"), ("dev", "SELECT n FROM (SELECT n_nationkey AS n FROM `dev__raw`.`seeded`) WHERE n > 1")))
def rendered(spark, sf_dir):
    """A model's query with logical names, and as an environment would run it with embedded models inlined."""
    home = Path(tempfile.mkdtemp(prefix="seed-"))
    (home / "s.csv").write_text("n_nationkey\n1\n2\n")
    s = seed("raw.seeded", home / "s.csv", "n_nationkey int")
    e = model("stage.e", Embedded(), "n int", lambda c: f"SELECT n_nationkey AS n FROM {c.ref(s)}")
    m = model("mart.m", View(), "n int", lambda c: f"SELECT n FROM {c.ref(e)} WHERE n > 1")
    p = _project(spark, s, e, m)
    return _frame(spark, [("logical", p.render("mart.m")), ("dev", p.render("mart.m", "dev"))], "form string, text string")


# analyses and maintenance
@query(_values("side, column_name", ("onlyInA", "o_clerk"), ("onlyInB", "o_extra"), ("onlyInB", "o_other")))
def schema_drifts(spark, sf_dir):
    """Columns that only one of two versions has."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    drift = schema_drift(o.withColumn("o_clerk", F.lit("x")), o.withColumns({"o_extra": F.lit(1), "o_other": F.lit(2)}))
    return _frame(spark, [(k, c) for k in sorted(drift) for c in drift[k]], "side string, column_name string")


@query(_values("line, text", (0, "mart.top.total"), (1, "  stage.events.value"), (2, "    raw.events.value")))
def lineage_printed(spark, sf_dir):
    """Where a column comes from, as an indented tree."""
    raw, stage = _events(sf_dir)
    top = model("mart.top", Full(), "user_id bigint, total double", lambda c: f"SELECT user_id, sum(value) AS total FROM {c.ref(stage)} GROUP BY user_id")
    lines = printed(_project(spark, raw, stage, top).lineage("mart.top", "total")).splitlines()
    return _frame(spark, list(enumerate(lines)), "line int, text string")


@query(_values("view, fact", ("html", "3 boxes, 2 curves"), ("json", "mart.v <- stage.events"), ("layers", "raw.events | stage.events | mart.v"), ("text", "mart.v [view] <- stage.events")))
def graph_views(spark, sf_dir):
    """The graph as text, JSON, layers by longest way and a page."""
    raw, stage = _events(sf_dir)
    v = model("mart.v", View(), "n bigint", lambda c: f"SELECT count(*) AS n FROM {c.ref(stage)}")
    g = build_graph([raw, stage, v])
    page, last = graph_view.page(g), graph_view.to_json(g)["models"][-1]
    rows = [("text", graph_view.text(g).splitlines()[-1]), ("json", f"{last['name']} <- {', '.join(last['deps'])}"), ("layers", " | ".join(",".join(x) for x in graph_view.layers(g))), ("html", f"{page.count('<rect')} boxes, {page.count('<path')} curves")]
    return _frame(spark, rows, "view string, fact string")


@query(_values("case_name, outcome", ("as expected", "passes"), ("in another order", "passes"), ("a row too many", "unexpected"), ("a wrong type", "refused"), ("an unknown column", "refused")))
def row_tests(spark, sf_dir):
    """Tests of a model by rows: what it reads, and what it should give."""
    from .testing import check_model

    raw = external("raw.moves", table("t"), "id string, n int")
    m = model("mart.m", Full(), "id string, n int", lambda c: f"SELECT id, n + 1 AS n FROM {c.ref(raw)} WHERE n > 0")
    given = [{"id": "a", "n": 1}, {"id": "b", "n": 2}, {"id": "c", "n": 0}]

    def outcome(rows: list[dict], expect: list[dict]) -> str:
        try:
            check_model(spark, m, {"raw.moves": rows}, expect)
        except AssertionError:
            return "unexpected"
        except LoomError:
            return "refused"
        return "passes"

    want = [{"id": "a", "n": 2}, {"id": "b", "n": 3}]
    rows = [("as expected", outcome(given, want)), ("in another order", outcome(given, want[::-1])), ("a row too many", outcome(given, [*want, {"id": "c", "n": 1}])), ("a wrong type", outcome([{"id": "a", "n": "x"}], want)), ("an unknown column", outcome([{"id": "a", "m": 1}], want))]
    return _frame(spark, rows, "case_name string, outcome string")


@query("select event_id, value, 'data.parquet' as file from events where ts < timestamp '2024-01-03'")
def compacted_lake(spark, sf_dir):
    """Intervals of an own lake merge into the one file name that its readers know, and the table goes on reading them."""
    raw, m = _events(sf_dir, target="parquet", compaction=Compaction(2, 0))
    p = _project(spark, raw, m)
    p.apply("dev", now="2024-01-03")
    root = f"{p.lake}/stage/events/fp={p.store.pointers('dev')['stage.events'][:8]}"
    for day in ("2024-01-01", "2024-01-02"):
        spark.read.parquet(f"{root}/interval={day}").repartition(3).write.parquet(f"{root}/_again/{day}")
        p.engine.move(f"{root}/_again/{day}", f"{root}/interval={day}")
    p.compact("dev", now=4_000_000_000_000)
    names = {f.rpartition("/")[2] for f, _, _ in p.engine.files(root) if f.endswith(".parquet")}
    return p.table("dev", "stage.events").select("event_id", "value").withColumn("file", F.lit(",".join(sorted(names))))


@query(_values("partition_name, reason", ("day=2024-01-09", "already-compact"), ("day=2024-01-10", "current-day"), ("day=someday", "undated"), ("day=2024-01-08", "merged")))
def compaction_reasons(spark, sf_dir):
    """Why partitions are left alone, in the order of the checks."""
    place = _place(spark, "days")
    for day, n in (("someday", 2), ("2024-01-08", 2), ("2024-01-09", 1), ("2024-01-10", 3)):
        spark.range(6).repartition(n).write.parquet(f"{place}/day={day}")
    raw = external("raw.days", parquet(f"{place}/*/*.parquet"), "id bigint", compaction=Compaction(2, 0, partition="day"))
    p = _project(spark, raw)
    from .plans.interval import millis

    r = compact(p.engine, p.graph, lambda m: None, now=millis("2024-01-10T12:00:00"), dry_run=True)
    # files are younger than "now" of the test, so grace doesn't tell here
    rows = [(x["partition"], x["reason"]) for x in r.skipped if x["reason"] != "grace-period"] + [(x["partition"], "merged") for x in r.compacted] + [(x["partition"], "merged") for x in r.skipped if x["reason"] == "grace-period"]
    return _frame(spark, rows, "partition_name string, reason string")


# the operational surface
def _scaffold(spark: SparkSession) -> Callable[..., tuple[int, dict, str]]:
    """A scaffolded project, and the command line over it: code, payload, what was said."""
    home = Path(tempfile.mkdtemp(prefix="cli-"))
    root = logging.getLogger()
    handlers, level = root.handlers[:], root.level

    def run(*args: str, plain: bool = False) -> tuple[int, dict, str]:
        out, err = io.StringIO(), io.StringIO()
        more = [] if args[0] == "init" else ["--config", str(home / "lakeloom_config.py")]
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            try:
                code = command_line([*args, *([str(home)] if args[0] == "init" else []), *more, *([] if plain else ["--json"])], spark)
            finally:
                root.handlers[:], root.level = handlers, level
        text = out.getvalue()
        return code, json.loads(text) if text.strip().startswith("{") else {}, err.getvalue() + (text if plain else "")

    run.home = home
    assert run("init")[0] == 0
    env = home / "lakeloom_config.py"
    env.write_text(env.read_text().replace('discovery=("models/*.py",)', f'discovery=("models/*.py",), lake="{shared_dir(spark)}/cli-{uuid.uuid4().hex}"'))
    return run


@query(_values("command, code", ("init", 0), ("plan", 0), ("apply", 2), ("apply --yes", 0), ("run", 0), ("status", 0), ("audit", 0), ("render", 0), ("graph", 0), ("lineage", 0), ("passport", 0), ("restate", 0), ("diff", 0), ("schedule", 0), ("janitor", 0), ("compact", 0), ("migrate", 0), ("unknown model", 1), ("run with changes", 2)))
def cli_commands(spark, sf_dir):
    """Every command over a scaffolded project, and the exit codes: 0 done, 1 an error, 2 a person has to look."""
    run = _scaffold(spark)
    calls = {
        "plan": ("plan", "dev", "--now", "2026-01-03"), "apply": ("apply", "dev", "--now", "2026-01-03"), "apply --yes": ("apply", "dev", "--now", "2026-01-03", "--yes"), "run": ("run", "dev", "--now", "2026-01-04"),
        "status": ("status", "dev"), "audit": ("audit", "dev"), "render": ("render", "mart.shops", "dev"), "graph": ("graph",), "lineage": ("lineage", "mart.shops", "total"), "passport": ("passport", "dev"),
        "restate": ("restate", "dev", "mart.shop_days", "--from", "2026-01-01", "--to", "2026-01-02", "--dry-run"), "diff": ("diff", "dev", "dev"), "schedule": ("schedule", "dev", "@daily", "--print-systemd"),
        "janitor": ("janitor",), "compact": ("compact", "dev", "--dry-run"), "migrate": ("migrate",), "unknown model": ("restate", "dev", "mart.nope", "--from", "2026-01-01", "--to", "2026-01-02"),
    }
    rows = [("init", 0)] + [(k, run(*v)[0]) for k, v in calls.items()]
    sales = run.home / "seeds" / "sales.csv"
    sales.write_text(sales.read_text() + "2026-01-02 12:00:00,east,1\n")
    rows.append(("run with changes", run("run", "dev", "--now", "2026-01-04")[0]))
    return _frame(spark, rows, "command string, code int")


@query(_values("command, fields", ("apply", "apiVersion,applied,built,env,plan,promoted"), ("graph", "apiVersion,models"), ("plan", "actions,apiVersion,env,hasChanges,warnings"), ("run", "apiVersion,env,outcome,processed"), ("status", "apiVersion,env,lag,lastPlan,models,promotedAt,storeVersion,ticks")))
def json_payloads(spark, sf_dir):
    """Payloads are objects with an ``apiVersion``."""
    run, rows = _scaffold(spark), []
    for name, args in {"plan": ("plan", "dev"), "apply": ("apply", "dev", "--yes", "--now", "2026-01-03"), "run": ("run", "dev", "--now", "2026-01-03"), "status": ("status", "dev"), "graph": ("graph",)}.items():
        rows.append((name, ",".join(sorted(run(*args)[1]))))
    return _frame(spark, rows, "command string, fields string")


@query(_values("series, value", ("lakeloom_intervals_done_total", 2.0), ("lakeloom_planned_models_total{category=\"added\"}", 3.0), ("lakeloom_snapshots_built_total", 3.0), ("lakeloom_audits_passed_total", 2.0)))
def metrics_text(spark, sf_dir):
    """Counters of an apply in Prometheus' text: each family with help and type, ``# EOF`` last."""
    run = _scaffold(spark)
    run("apply", "dev", "--yes", "--now", "2026-01-03", "--metrics", str(run.home / "m.prom"))
    lines = (run.home / "m.prom").read_text().splitlines()
    assert lines[-1] == "# EOF" and sum(x.startswith("# HELP") for x in lines) == sum(x.startswith("# TYPE") for x in lines)
    shown = ("lakeloom_intervals_done_total", "lakeloom_planned_models_total", "lakeloom_snapshots_built_total", "lakeloom_audits_passed_total")
    return _frame(spark, [(x.rpartition(" ")[0], float(x.rpartition(" ")[2])) for x in lines if x.startswith(shown)], "series string, value double")


@query(_values("failure, screen", ("a lock", "LockError and a hint"), ("a secret", "masked"), ("changes at a tick", "BlockedError and a hint")))
def failure_screens(spark, sf_dir):
    """An error is its kind, its message without credentials, and what to do next."""
    run, rows = _scaffold(spark), []
    run("apply", "dev", "--yes", "--now", "2026-01-03")
    store = StateStore(run.home / "lakeloom.state.sqlite")
    token = store.acquire("env:dev", 60)
    said = run("apply", "dev", "--yes")[2]
    rows.append(("a lock", "LockError and a hint" if "LockError" in said and "wait for the other" in said else said))
    store.release("env:dev", token)
    store.close()
    text = str(EngineError("ATTACH 'x' (password = 'p4ss')", ValueError("no"), ()))
    rows.append(("a secret", "masked" if "p4ss" not in text else text))
    sales = run.home / "seeds" / "sales.csv"
    sales.write_text(sales.read_text() + "2026-01-02 12:00:00,east,1\n")
    said = run("run", "dev")[2]
    rows.append(("changes at a tick", "BlockedError and a hint" if "BlockedError" in said and "lakeloom plan" in said else said))
    return _frame(spark, rows, "failure string, screen string")


@query(_values("step, answer", ("found", "mart.shop_days,mart.shops,raw.sales"), ("two of a name", "refused"), ("opened", "lake and state"), ("no configuration", "refused")))
def discovery_and_configuration(spark, sf_dir):
    """Models by glob, two of a name refused, and a project opened from its configuration."""
    run = _scaffold(spark)
    found = discover(("models/*.py",), run.home)
    rows = [("found", ",".join(sorted(m.name for m in found)))]
    (run.home / "models" / "twin.py").write_text("from lakeloom.plans.model import external, table\nx = external('raw.sales', table('t'), 'id string')\n")
    rows.append(("two of a name", "refused" if "is defined in" in _said(LoomError, lambda: discover(("models/*.py",), run.home)) else "taken"))
    (run.home / "models" / "twin.py").unlink()
    p = open_project(run.home / "lakeloom_config.py", spark)
    rows.append(("opened", "lake and state" if "/cli-" in p.lake and p.store.path == str(run.home.resolve() / "lakeloom.state.sqlite") else p.lake))
    rows.append(("no configuration", "refused" if _said(LoomError, lambda: open_project(run.home / "none.py", spark)) != "nothing" else "opened"))
    return _frame(spark, rows, "step string, answer string")


@query(_values("cron, calendar", ("*/15 * * * *", "*-*-* *:00,15,30,45:00"), ("0 6 * * mon-fri", "Mon,Tue,Wed,Thu,Fri *-*-* 06:00:00"), ("30 2 1 * *", "*-*-01 02:30:00"), ("@hourly", "*-*-* *:00:00"), ("0 0 30 2 *", "refused"), ("0 0 1 * mon", "refused")))
def schedules(spark, sf_dir):
    """Cron expressions as timers; those that never come, or that timers can't say, are refused."""

    def shown(cron: str) -> str:
        try:
            return schedule.calendar(cron)
        except LoomError:
            return "refused"

    return _frame(spark, [(c, shown(c)) for c in ("*/15 * * * *", "0 6 * * mon-fri", "30 2 1 * *", "@hourly", "0 0 30 2 *", "0 0 1 * mon")], "cron string, calendar string")


@query(_values("line, text", (1, "0 5 * * * other"), (2, "@daily ... # lakeloom-p-dev"), (3, "0 5 * * * other")))
def crontab_entries(spark, sf_dir):
    """A project's entry is set, replaced and taken away; other lines stay."""
    config = Path(tempfile.mkdtemp(prefix="cron-")) / "p" / "lakeloom_config.py"
    config.parent.mkdir()
    text = "0 5 * * * other\n"
    twice = schedule.with_entry(schedule.with_entry(text, "dev", "@hourly", config), "dev", "@daily", config)
    gone = schedule.with_entry(twice, "dev", None, config)
    short = lambda x: x if "lakeloom" not in x else f"{x.split()[0]} ... # {x.rpartition('# ')[2]}"
    return _frame(spark, list(enumerate([short(x) for x in (twice + gone).splitlines()], 1)), "line int, text string")


@query("select 'lakeloom_config.py' as file, true as there union all select 'models/sales.py', true union all select 'seeds/sales.csv', true union all select 'again', false")
def scaffolded(spark, sf_dir):
    """A small project that works; nothing that is there is overwritten."""
    run = _scaffold(spark)
    rows = [(n, (run.home / n).exists()) for n in ("lakeloom_config.py", "models/sales.py", "seeds/sales.csv")]
    return _frame(spark, [*rows, ("again", run("init")[0] == 0)], "file string, there boolean")


@query("select c_mktsegment, count(*) as n from customer group by 1")
def embedding_facade(spark, sf_dir):
    """The library's public names are enough for a project from definition to result."""
    import lakeloom

    raw = lakeloom.external("raw.customer", lakeloom.parquet(f"{sf_dir}/customer.parquet"), _DDL["customer"])
    m = lakeloom.model("mart.segments", lakeloom.Full(), "c_mktsegment string, n bigint", lambda c: f"SELECT c_mktsegment, count(*) AS n FROM {c.ref(raw)} GROUP BY 1")
    p = lakeloom.Project(spark, [raw, m], _place(spark, "lake"))
    p.apply("prod", now=NOW)
    return p.table("prod", "mart.segments")


@query(_values("part, shown", ("built", "mart.n"), ("change", "added"), ("form", "logfmt")))
def log_lines(spark, sf_dir):
    """One line a built model, as key=value pairs."""
    raw = _raw(sf_dir, "nation")
    p = _project(spark, raw, model("mart.n", Full(), "n_name string", lambda c: f"SELECT n_name FROM {c.ref(raw)}"))
    lines: list[str] = []

    class Keep(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            lines.append(record.getMessage())

    log, handler = logging.getLogger("lakeloom"), Keep()
    level = log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        p.apply("dev", now=NOW)
    finally:
        log.removeHandler(handler)
        log.setLevel(level)
    pairs = dict(x.split("=", 1) for x in next(x for x in lines if x.startswith("model=")).split())
    return _frame(spark, [("built", pairs["model"]), ("change", pairs["change"]), ("form", "logfmt" if "seconds" in pairs else "other")], "part string, shown string")


@query(_values("chapter, there", ("Applying a change", True), ("A tick failed", True), ("Computing history again", True), ("Keeping the lake tidy", True), ("Upgrading", True)))
def runbooks(spark, sf_dir):
    """What an operator does when something is wrong, chapter by chapter."""
    lines = (Path(__file__).resolve().parent.parent / "docs" / "runbooks.md").read_text().splitlines()
    return _frame(spark, [(c, f"## {c}" in lines) for c in ("A tick failed", "Applying a change", "Computing history again", "Keeping the lake tidy", "Upgrading")], "chapter string, there boolean")


# SQL that models' bodies may use
@query("select year(o_orderdate)::int as y, upper(o_orderstatus) as status, count(*) as n from orders group by y, status")
def group_by_alias(spark, sf_dir):
    raw = _raw(sf_dir, "orders")
    return _one(spark, "mart.a", "y int, status string, n bigint", lambda c: f"SELECT year(o_orderdate) AS y, upper(o_orderstatus) AS status, count(*) AS n FROM {c.ref(raw)} GROUP BY y, status", raw)


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25")
def ordered_body(spark, sf_dir):
    """An order with a limit decides which rows there are; the table itself has none."""
    raw = _raw(sf_dir, "customer")
    return _one(spark, "mart.top", "c_custkey bigint, c_acctbal double", lambda c: f"SELECT c_custkey, c_acctbal FROM {c.ref(raw)} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25", raw)


@query("select event_id, user_id, count(*) over (partition by user_id) as of_user, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as so_far from events")
def count_over_window(spark, sf_dir):
    raw = _raw(sf_dir, "events")
    return _one(spark, "mart.w", "event_id bigint, user_id bigint, of_user bigint, so_far bigint", lambda c: f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS of_user, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far FROM {c.ref(raw)}", raw)


@query("select event_id, round(extract(epoch from (ts - timestamp '2024-01-01')), 3) as seconds from events")
def epoch_difference(spark, sf_dir):
    raw = _raw(sf_dir, "events")
    return _one(spark, "mart.s", "event_id bigint, seconds double", lambda c: f"SELECT event_id, round((unix_micros(CAST(ts AS TIMESTAMP_LTZ)) - unix_micros(TIMESTAMP_LTZ'2024-01-01 00:00:00')) / 1e6D, 3) AS seconds FROM {c.ref(raw)}", raw)


@query("select n_name, i::int as i, lpad(i::varchar, 3, '0') as padded, (['a', 'b', 'c'])[i] as letter from nation, generate_series(1, 3) t(i)")
def series_lateral(spark, sf_dir):
    raw = _raw(sf_dir, "nation")
    return _one(spark, "mart.l", "n_name string, i int, padded string, letter string", lambda c: f"SELECT n_name, i, lpad(CAST(i AS STRING), 3, '0') AS padded, element_at(array('a', 'b', 'c'), i) AS letter FROM {c.ref(raw)}, LATERAL (SELECT explode(sequence(1, 3)) AS i)", raw)


@query("select event_id, floor(value)::bigint as whole, props is null as bare from events where try_cast(event_type as integer) is null")
def casts(spark, sf_dir):
    raw = _raw(sf_dir, "events")
    return _one(spark, "mart.c", "event_id bigint, whole bigint, bare boolean", lambda c: f"SELECT event_id, CAST(floor(value) AS BIGINT) AS whole, props IS NULL AS bare FROM {c.ref(raw)} WHERE try_cast(event_type AS INT) IS NULL", raw)
