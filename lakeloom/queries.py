"""Driver queries over the test tables: each takes its operator through models, plans and tables, and has the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.audits import Audit, accepted, assert_contiguous, assert_no_gaps, custom, not_null, unique
from .operators.compact import compact
from .operators.diff import compared, islands
from .operators.materialize import dedupe_latest
from .plans.engine import shared_dir
from .plans.model import Compaction, Embedded, Full, Model, ScdType2, TimeRange, UniqueKey, View, external, model, parquet, seed, sql_model
from .plans.planner import window_risk
from .plans.project import Project

NOW, NEXT = "2024-01-29", "2024-01-31"
_DDL = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _raw(sf_dir: str, name: str) -> Model:
    return external(f"raw.{name}", parquet(f"{sf_dir}/{name}.parquet"), _DDL[name])


def _project(spark: SparkSession, *models: Model, **more) -> Project:
    return Project(spark, models, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}", **more)


def _with(p: Project, *models: Model) -> Project:
    """The same lake and state with other models."""
    return Project(p.engine.spark, models, p.lake, p.store, redacted=p.redacted)


def _events(sf_dir: str, **more) -> tuple[Model, Model]:
    raw = _raw(sf_dir, "events")
    lookback, batch, target = more.pop("lookback", 0), more.pop("batch_size", 30), more.pop("target", "table")
    m = model("stage.events", TimeRange("ts", "2024-01-01", batch_size=batch, lookback=lookback), "event_id bigint, ts timestamp, user_id bigint, event_type string, value double",
              lambda c: f"SELECT event_id, ts, user_id, event_type, value FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}", target=target, **more)
    return raw, m


def _one(spark: SparkSession, name: str, schema: str, body, *deps: Model) -> DataFrame:
    m = model(name, Full(), schema, body)
    p = _project(spark, *deps, m)
    p.apply("dev", now=NEXT)
    return p.table("dev", name)


@query("select event_id, ts, user_id, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12' and event_type = 'click'")
def scan_filter_project(spark, sf_dir):
    raw = _raw(sf_dir, "events")
    v = model("mart.week", View(), "event_id bigint, ts timestamp, user_id bigint, value double", lambda c: f"SELECT event_id, ts, user_id, value FROM {c.ref(raw)} WHERE ts >= {c.lit(_day(5))} AND ts < {c.lit(_day(12))} AND event_type = 'click'")
    p = _project(spark, raw, v)
    p.apply("dev", now=NEXT)
    return p.table("dev", "mart.week")


def _day(n: int):
    import datetime as dt

    return dt.datetime(2024, 1, n)


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, min(l_shipdate) as first_day, max(l_shipdate) as last_day from lineitem group by 1, 2")
def full_group_by(spark, sf_dir):
    raw = _raw(sf_dir, "lineitem")
    return _one(spark, "mart.pricing", "l_returnflag string, l_linestatus string, n bigint, quantity bigint, revenue double, first_day timestamp, last_day timestamp",
                lambda c: f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM {c.ref(raw)} GROUP BY 1, 2", raw)


@query("select date_trunc('day', ts)::timestamp as day, count(*) as n, round(sum(value), 4) as total from events where ts < timestamp '2024-01-31' group by 1")
def daily_volume(spark, sf_dir):
    """The flagship: an external table, filled day by day, summed up in a view."""
    raw, stage = _events(sf_dir)
    mart = model("mart.daily_volume", View(), "day timestamp, n bigint, total double", lambda c: f"SELECT CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) AS day, count(*) AS n, round(sum(value), 4) AS total FROM {c.ref(stage)} GROUP BY 1")
    p = _project(spark, raw, stage, mart)
    p.apply("prod", now=NEXT)
    return p.table("prod", "mart.daily_volume")


_STAGED = "select event_id, ts, user_id, event_type, value from events where ts < timestamp '{}'"


@query(_STAGED.format("2024-01-31"))
def incremental_backfill(spark, sf_dir):
    """Filled up to one day, then by a tick to a later one."""
    p = _project(spark, *_events(sf_dir, batch_size=10))
    p.apply("dev", now=NOW)
    p.run("dev", now=NEXT)
    return p.table("dev", "stage.events")


@query(_STAGED.format("2024-01-31"))
def lookback_idempotent(spark, sf_dir):
    p = _project(spark, *_events(sf_dir, lookback=3))
    p.apply("dev", now=NEXT)
    p.apply("dev", now=NEXT)
    return p.table("dev", "stage.events")


@query(_STAGED.format("2024-01-31"))
def restate_range(spark, sf_dir):
    p = _project(spark, *_events(sf_dir))
    p.apply("dev", now=NEXT)
    p.restate("dev", "stage.events", "2024-01-05", "2024-01-08")
    p.apply("dev", now=NEXT)
    return p.table("dev", "stage.events")


@query(_STAGED.format("2024-01-08"))
def parquet_partition_replace(spark, sf_dir):
    """A lake of one directory a day, filled twice, and read as its manifest lists it."""
    from .sources.lake import read_manifest, version_root

    raw, m = _events(sf_dir, target="parquet")
    p = _project(spark, raw, m)
    p.apply("dev", now="2024-01-08")
    p.restate("dev", "stage.events", "2024-01-02", "2024-01-03")
    p.apply("dev", now="2024-01-08")
    fp = p.store.pointers("dev")["stage.events"]
    return read_manifest(spark, f"{version_root(p.lake, 'stage.events', fp)}/manifest.json")


@query("select c_custkey, c_name, c_nationkey, case when c_custkey % 7 = 0 then round(c_acctbal + 1, 2) else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 2 = 0 or c_custkey % 7 = 0")
def upsert_by_key(spark, sf_dir):
    """Even keys, then every seventh with another balance: two loads of one source."""
    place = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customer.where("c_custkey % 2 = 0").write.parquet(f"{place}/load=1")
    raw = external("raw.customer", parquet(place, union_by_name=True), _DDL["customer"])
    m = model("dim.customer", UniqueKey("c_custkey"), _DDL["customer"], lambda c: f"SELECT * FROM {c.ref(raw)}")
    p = _project(spark, raw, m)
    p.apply("dev", now=NOW)
    p.engine.delete(f"{place}/load=1")
    customer.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2)).write.parquet(f"{place}/load=2")
    p.run("dev", now=NOW)
    return p.table("dev", "dim.customer")


_SCD = """
with a as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 3 <> 0),
b as (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_orderpriority from orders where o_orderkey % 4 <> 0)
select a.*, timestamp '2024-02-01' as valid_from, case when b.o_orderkey is null then timestamp '2024-02-02' end as valid_to
from a left join b on a.o_orderkey = b.o_orderkey and a.o_orderstatus is not distinct from b.o_orderstatus and a.o_orderpriority is not distinct from b.o_orderpriority
union all
select b.*, timestamp '2024-02-02', null from b where not exists (select 1 from a where a.o_orderkey = b.o_orderkey and a.o_orderstatus is not distinct from b.o_orderstatus and a.o_orderpriority is not distinct from b.o_orderpriority)"""


@query(_SCD)
def scd2_two_loads(spark, sf_dir):
    """Two loads of a source that changes between them."""
    shared = f"{shared_dir(spark)}/scd-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders.where("o_orderkey % 3 <> 0").write.parquet(f"{shared}/load=1")
    raw = external("raw.orders", parquet(shared, union_by_name=True), "o_orderkey bigint, o_orderstatus string, o_orderpriority string")
    m = model("dim.orders", ScdType2(("o_orderkey",)), "o_orderkey bigint, o_orderstatus string, o_orderpriority string, valid_from timestamp, valid_to timestamp", lambda c: f"SELECT * FROM {c.ref(raw)}")
    p = _project(spark, raw, m)
    p.apply("dev", now="2024-02-01")
    p.engine.delete(f"{shared}/load=1")
    orders.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).write.parquet(f"{shared}/load=2")
    p.apply("dev", now="2024-02-02")
    return p.table("dev", "dim.orders")


@query("select n_name, r_name, upper(r_name) as loud from nation join region on n_regionkey = r_regionkey where r_regionkey < 3")
def seed_embedded_view_sql(spark, sf_dir):
    """A seed, an embedded model over it, a view over that, and a model of a .sql file."""
    import json
    import os

    home = tempfile.mkdtemp(prefix="project-")  # a project's own files are the driver's
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").limit(100).collect()
    with open(os.path.join(home, "regions.json"), "w") as f:
        f.write("\n".join(json.dumps({"r_regionkey": r["r_regionkey"], "r_name": r["r_name"]}) for r in regions))
    with open(os.path.join(home, "loud.sql"), "w") as f:
        f.write("SELECT n.n_name, r.r_name, upper(r.r_name) AS loud FROM @ref(raw.nation) n JOIN @ref(mart.some) r ON n.n_regionkey = r.r_regionkey")
    s = seed("ref.regions", os.path.join(home, "regions.json"), _DDL["region"])
    e = model("stage.regions", Embedded(), _DDL["region"], lambda c: f"SELECT r_regionkey, r_name FROM {c.ref(s)}")
    v = model("mart.some", View(), _DDL["region"], lambda c: f"SELECT r_regionkey, r_name FROM {c.ref(e)} WHERE r_regionkey < 3")
    raw = _raw(sf_dir, "nation")
    loud = sql_model("mart.loud", Full(), "n_name string, r_name string, loud string", os.path.join(home, "loud.sql"), [raw, v])
    p = _project(spark, s, e, v, raw, loud)
    p.apply("dev", now=NOW)
    return p.table("dev", "mart.loud")


_REDELIVERED = "select *, ts + interval 1 hour as arrived from events union all select *, ts + interval 30 hour from events where event_id % 4 = 0 union all select *, ts + interval 200 hour from events where event_id % 10 = 0"


@query(f"with r as ({_REDELIVERED}), w as (select *, row_number() over (partition by event_id, date_trunc('day', ts) order by arrived) as n from r where arrived < ts + interval 3 day) select event_id, ts, arrived, value from w where n = 1")
def dedup_horizon(spark, sf_dir):
    """Redeliveries within a horizon collapse to the first arrival; later ones aren't seen."""
    raw = _raw(sf_dir, "events")

    def body(c):
        r = c.ref(raw)
        union = f"SELECT *, ts + INTERVAL 1 HOUR AS arrived FROM {r} UNION ALL SELECT *, ts + INTERVAL 30 HOUR FROM {r} WHERE event_id % 4 = 0 UNION ALL SELECT *, ts + INTERVAL 200 HOUR FROM {r} WHERE event_id % 10 = 0"
        return f"SELECT event_id, ts, arrived, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id, CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ) ORDER BY arrived) AS n FROM ({union}) WHERE arrived < ts + INTERVAL 3 DAY) WHERE n = 1"

    return _one(spark, "mart.canonical", "event_id bigint, ts timestamp, arrived timestamp, value double", body, raw)


@query("select doc_id, text, lang from (select *, row_number() over (partition by lang, n_chars order by doc_id nulls last) as n from documents) where n = 1")
def dedup_row_number(spark, sf_dir):
    """The merge of compaction: one row of a key, by an order with nulls last."""
    return dedupe_latest(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang", "n_chars"], ["doc_id"]).select("doc_id", "text", "lang")


@query("select event_id, user_id, value from events where ts < timestamp '2024-01-06'")
def compacted_partitions(spark, sf_dir):
    """Days of several files, merged and deduplicated by key where they lie."""
    place = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts < timestamp_ntz'2024-01-06'").select("event_id", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    for extra in (False, True):  # a second delivery of every third row
        events.where("event_id % 3 = 0" if extra else "true").repartition(2).write.mode("append").partitionBy("day").parquet(place)
    raw = external("raw.archive", parquet(f"{place}/*/*.parquet"), "event_id bigint, user_id bigint, value double", compaction=Compaction(2, 0, ("event_id",), ("event_id",), "day"))
    p = _project(spark, raw)
    compact(p.engine, p.graph, lambda m: None, now=4_000_000_000_000)
    return spark.read.parquet(place).select("event_id", "user_id", "value")


def _violations(spark: SparkSession, sf_dir: str, table: str, audit: Audit) -> DataFrame:
    own = f"audited_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(own)
    return spark.sql(audit.sql(own))


@query("select event_id, user_id from (select event_id, case when event_id % 50 = 0 then null else user_id end as user_id from events) where user_id is null")
def audit_not_null(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "if(event_id % 50 = 0, null, user_id) AS user_id").createOrReplaceTempView("audited_holes")
    return spark.sql(not_null("user_id").sql("audited_holes"))


@query("select o_custkey, o_orderstatus, count(*) as copies from orders group by 1, 2 having count(*) > 1")
def audit_unique(spark, sf_dir):
    return _violations(spark, sf_dir, "orders", unique("o_custkey", "o_orderstatus"))


@query("select * from orders where o_orderstatus is not null and o_orderstatus not in ('O', 'F')")
def audit_accepted(spark, sf_dir):
    return _violations(spark, sf_dir, "orders", accepted("o_orderstatus", ["O", "F"]))


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 20")
def audit_custom(spark, sf_dir):
    return _violations(spark, sf_dir, "orders", custom("busy", lambda c: f"SELECT o_custkey, count(*) AS n FROM {c.self} GROUP BY 1 HAVING count(*) > 20"))


@query("with v as (select distinct event_id as value from events where event_id % 11 <> 0), l as (select value, lag(value) over (order by value) as before from v) select before as covered_through, value as resumes_at, value - before - 1 as missing from l where value > before + 1")
def audit_contiguous(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 11 <> 0").createOrReplaceTempView("audited_ids")
    return spark.sql(assert_contiguous("event_id").sql("audited_ids"))


@query("with v as (select distinct date_trunc('hour', ts)::timestamp as value from events where user_id % 20 = 0), l as (select value, lag(value) over (order by value) as before from v) select before as covered_through, value as resumes_at from l where value > before + interval 1 hour")
def audit_no_gaps(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 20 = 0").createOrReplaceTempView("audited_times")
    return spark.sql(assert_no_gaps("ts", "hour").sql("audited_times"))


_SIDES = "a as (select * from orders where o_orderkey % 10 <> 1{s}), b as (select o_orderkey, o_custkey, case when o_orderkey % 13 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 17 = 0 then null else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 10 <> 2{s})"
_DIFF = """with {sides} select count(*) filter (where b.o_orderkey is null) as only_in_a, count(*) filter (where a.o_orderkey is null) as only_in_b, count(*) filter (where a.o_orderkey is not null and b.o_orderkey is not null) as in_both, {each}
from a full outer join b on a.o_orderkey = b.o_orderkey"""
_EACH = ", ".join(f"count(*) filter (where a.o_orderkey is not null and b.o_orderkey is not null and a.{c} is distinct from b.{c}) as diff_{c}" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One model at two versions, in two environments."""
    raw = _raw(sf_dir, "orders")
    a = model("mart.orders", Full(), _DDL["orders"], lambda c: f"SELECT * FROM {c.ref(raw)} WHERE o_orderkey % 10 <> 1", grain=["o_orderkey"])
    b = model("mart.orders", Full(), _DDL["orders"], lambda c: f"SELECT o_orderkey, o_custkey, if(o_orderkey % 13 = 0, 'X', o_orderstatus) AS o_orderstatus, if(o_orderkey % 17 = 0, null, o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority FROM {c.ref(raw)} WHERE o_orderkey % 10 <> 2", grain=["o_orderkey"])
    p = _project(spark, raw, a)
    p.apply("one", now=NOW)
    q = _with(p, raw, b)
    q.apply("two", now=NOW)
    return q.table("one", "mart.orders"), q.table("two", "mart.orders")


@query(_DIFF.format(sides=_SIDES.format(s=""), each=_EACH))
def data_diff(spark, sf_dir):
    return compared(*_two_sides(spark, sf_dir), ["o_orderkey"])


@query(_DIFF.format(sides=_SIDES.format(s=" and substr(md5(o_orderkey::varchar), 1, 2) < '33'"), each=_EACH))
def data_diff_sampled(spark, sf_dir):
    return compared(*_two_sides(spark, sf_dir), ["o_orderkey"], 20)


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("select * from (values ('mart.a', 'different'), ('mart.b', 'onlyInB'), ('raw.nation', 'same')) t(model, state)")
def env_diff(spark, sf_dir):
    raw = _raw(sf_dir, "nation")
    a = model("mart.a", Full(), "n_name string", lambda c: f"SELECT n_name FROM {c.ref(raw)}")
    a2 = model("mart.a", Full(), "n_name string", lambda c: f"SELECT lower(n_name) AS n_name FROM {c.ref(raw)}")
    b = model("mart.b", View(), "n_name string", lambda c: f"SELECT n_name FROM {c.ref(a2)}")
    p = _project(spark, raw, a)
    p.apply("one", now=NOW)
    q = _with(p, raw, a2, b)
    q.apply("two", now=NOW)
    d = q.diff("one", "two")
    rows = [(x["model"], "different") for x in d["different"]] + [(m, k) for k in ("onlyInA", "onlyInB", "same") for m in d[k]]
    return _frame(spark, rows, "model string, state string")


@query("select * from (values (0, 'mart.top', 'total'), (1, 'stage.events', 'value'), (2, 'raw.events', 'value')) t(depth, model, column_name)")
def lineage(spark, sf_dir):
    raw, stage = _events(sf_dir)
    top = model("mart.top", Full(), "user_id bigint, total double", lambda c: f"SELECT user_id, sum(value) AS total FROM {c.ref(stage)} GROUP BY user_id")
    rows: list[tuple] = []

    def walk(o, depth):
        rows.append((depth, o.model, o.column))
        for s in o.sources:
            walk(s, depth + 1)

    walk(_project(spark, raw, stage, top).lineage("mart.top", "total"), 0)
    return _frame(spark, rows, "depth int, model string, column_name string")


@query("select * from (values ('mart.top', 'sampled', '2024-01-29T00:00:00.000Z', 'stage.events'), ('raw.events', 'full', null, null), ('stage.events', 'sampled', '2024-01-29T00:00:00.000Z', 'stage.events')) t(model, answerable, complete_through, limited_by)")
def passport(spark, sf_dir):
    raw, stage = _events(sf_dir, answerable="sampled")
    top = model("mart.top", Full(), "user_id bigint, n bigint", lambda c: f"SELECT user_id, count(*) AS n FROM {c.ref(stage)} GROUP BY user_id")
    p = _project(spark, raw, stage, top)
    p.apply("dev", now=NOW)
    rows = [(m["model"], m["effective"]["answerable"], m["effective"]["completeThrough"], m["effective"]["limitedBy"]) for m in p.passport("dev")["models"]]
    return _frame(spark, rows, "model string, answerable string, complete_through string, limited_by string")


@query("select 'stage.events' as model, '2024-01-29T00:00:00.000Z' as done_up_to, 2 as missing, 0 as failed")
def status(spark, sf_dir):
    p = _project(spark, *_events(sf_dir))
    p.apply("dev", now=NOW)
    return _frame(spark, [(x["model"], x["doneUpTo"], x["missing"], x["failed"]) for x in p.status("dev", now=NEXT)["lag"]], "model string, done_up_to string, missing int, failed int")


@query("select * from (values ('stage.alone', false), ('stage.plain', false), ('stage.windowed', true)) t(model, risky)")
def window_warning(spark, sf_dir):
    raw = _raw(sf_dir, "events")

    def m(name, batch, extra):
        return model(name, TimeRange("ts", "2024-01-01", batch_size=batch), "event_id bigint, ts timestamp, n bigint", lambda c: f"SELECT event_id, ts, {extra} AS n FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}")

    p = _project(spark, raw, m("stage.windowed", 30, "count(*) OVER (PARTITION BY user_id)"), m("stage.alone", 1, "count(*) OVER (PARTITION BY user_id)"), m("stage.plain", 30, "user_id"))
    plan = p.plan("dev", now=NOW)
    return _frame(spark, [(a.name, window_risk(p.graph.models[a.name], a.ast) is not None) for a in plan.actions if a.name != "raw.events"], "model string, risky boolean")


@query("select * from (values ('mart.daily', 'indirect', false), ('mart.noise', 'removed', false), ('raw.events', 'unchanged', false), ('stage.events', 'non-breaking', true)) t(model, change, build)")
def plan_categories(spark, sf_dir):
    raw, stage = _events(sf_dir)
    mart = lambda s: model("mart.daily", Full(), "user_id bigint, n bigint", lambda c: f"SELECT user_id, count(*) AS n FROM {c.ref(s)} GROUP BY user_id")
    noise = model("mart.noise", View(), "user_id bigint", lambda c: f"SELECT user_id FROM {c.ref(stage)}")
    p = _project(spark, raw, stage, mart(stage), noise)
    p.apply("dev", now=NOW)
    wider = model("stage.events", stage.kind, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", lambda c: f"SELECT event_id, ts, user_id, event_type, value, props FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}")
    plan = _with(p, raw, wider, mart(wider)).plan("dev", now=NOW)
    return _frame(spark, [(a.name, a.change, a.build and a.reused_from is None) for a in plan.actions], "model string, change string, build boolean")


@query("select c_custkey, c_nationkey, c_mktsegment from customer")
def redacted_projection(spark, sf_dir):
    raw = _raw(sf_dir, "customer")
    m = model("mart.customer", Full(), _DDL["customer"], lambda c: f"SELECT * FROM {c.ref(raw)}", redact=["c_name", "c_acctbal"], audits=[not_null("c_custkey"), unique("c_name")])
    p = _project(spark, raw, m, redacted=["partner"])
    p.apply("partner", now=NOW)
    return p.table("partner", "mart.customer")


@query("select event_id, user_id, cast(null as varchar) as event_type from events where event_id % 2 = 0 union all by name select event_id, user_id, event_type from events where event_id % 2 = 1")
def union_by_name(spark, sf_dir):
    """Two generations of files, the older without a column and with a narrower number."""
    place = f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.where("event_id % 2 = 0").selectExpr("CAST(event_id AS INT) AS event_id", "user_id").write.parquet(f"{place}/old")
    e.where("event_id % 2 = 1").select("event_id", "user_id", "event_type").write.parquet(f"{place}/new")
    raw = external("raw.both", parquet(place, union_by_name=True), "event_id bigint, user_id bigint, event_type string")
    v = model("mart.both", View(), "event_id bigint, user_id bigint, event_type string", lambda c: f"SELECT event_id, user_id, event_type FROM {c.ref(raw)}")
    p = _project(spark, raw, v)
    p.apply("dev", now=NOW)
    return p.table("dev", "mart.both")


@query("select event_id, ts, user_id, event_type, value, case when ts >= timestamp '2024-01-29' then length(props) end as size from events where ts < timestamp '2024-01-31'")
def forward_only_add_column(spark, sf_dir):
    raw, stage = _events(sf_dir)
    p = _project(spark, raw, stage)
    p.apply("dev", now=NOW)
    wider = model("stage.events", stage.kind, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, size int", lambda c: f"SELECT event_id, ts, user_id, event_type, value, length(props) AS size FROM {c.ref(raw)} WHERE ts >= {c.start} AND ts < {c.end}")
    q = _with(p, raw, wider)
    q.apply("dev", now=NEXT, forward_only=["stage.events"])
    return q.table("dev", "stage.events").withColumn("size", F.col("size").cast("bigint"))


@query("select event_id, user_id, ts, lead(ts) over w as until_ts, date_diff('second', ts, lead(ts) over w) as seconds from events window w as (partition by user_id order by ts, event_id)")
def lead_stays(spark, sf_dir):
    raw = _raw(sf_dir, "events")
    seconds = "CAST(unix_timestamp(date_trunc('SECOND', until_ts)) - unix_timestamp(date_trunc('SECOND', ts)) AS BIGINT)"
    return _one(spark, "mart.stays", "event_id bigint, user_id bigint, ts timestamp, until_ts timestamp, seconds bigint",
                lambda c: f"SELECT event_id, user_id, ts, until_ts, {seconds} AS seconds FROM (SELECT event_id, user_id, ts, lead(ts) OVER w AS until_ts FROM {c.ref(raw)} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))", raw)


@query("""with d as (select distinct user_id, date_trunc('day', ts)::timestamp as s from events), n as (select *, case when lag(s) over w = s - interval 1 day then 0 else 1 end as new from d window w as (partition by user_id order by s)),
i as (select *, sum(new) over (partition by user_id order by s) as k from n) select user_id, min(s) as s, max(s) + interval 1 day as e from i group by user_id, k""")
def interval_gaps_islands(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.expr("CAST(date_trunc('DAY', ts) AS TIMESTAMP_NTZ)").alias("s")).distinct()
    return islands(days.withColumn("e", F.expr("s + INTERVAL 1 DAY")), "s", "e", ["user_id"])


@query("select o_orderstatus, year(o_orderdate)::int as y, count(distinct o_custkey) as customers, count(*) as orders from orders group by 1, 2 having count(*) > 10")
def group_having_distinct(spark, sf_dir):
    raw = _raw(sf_dir, "orders")
    return _one(spark, "mart.yearly", "o_orderstatus string, y int, customers bigint, orders bigint", lambda c: f"SELECT o_orderstatus, year(o_orderdate) AS y, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM {c.ref(raw)} GROUP BY 1, 2 HAVING count(*) > 10", raw)


@query("select n_name, r_name from nation cross join region union all select distinct n_name, 'none' from nation")
def cross_union_distinct(spark, sf_dir):
    n, r = _raw(sf_dir, "nation"), _raw(sf_dir, "region")
    return _one(spark, "mart.pairs", "n_name string, r_name string", lambda c: f"SELECT n_name, r_name FROM {c.ref(n)} CROSS JOIN {c.ref(r)} UNION ALL SELECT DISTINCT n_name, 'none' FROM {c.ref(n)}", n, r)


@query("select o_orderkey, c_name, n_name, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderdate >= timestamp '1997-01-01'")
def exported_join(spark, sf_dir):
    """A join whose result is also written to another database."""
    o, c_, n = (_raw(sf_dir, t) for t in ("orders", "customer", "nation"))
    m = model("mart.wide", Full(), "o_orderkey bigint, c_name string, n_name string, o_totalprice double",
              lambda c: f"SELECT o_orderkey, c_name, n_name, o_totalprice FROM {c.ref(o)} JOIN {c.ref(c_)} ON o_custkey = c_custkey JOIN {c.ref(n)} ON c_nationkey = n_nationkey WHERE o_orderdate >= {c.lit(__import__('datetime').datetime(1997, 1, 1))}", export="exported.wide")
    p = _project(spark, o, c_, n, m)
    p.apply("prod", now=NOW)
    return spark.table("exported.wide")
