"""Applying a plan: build and fill what changed, check it, swap views, move pointers.

A generation, and an interval of a table, is a new directory that readers see once the table is pointed there, so they see whole generations and whole intervals. A crash before the ledger's mark
leaves an interval unmarked, and the next plan fills it again. Models whose parents are ready run side by side on one session; a model has one writer.
"""

from __future__ import annotations

import getpass
import logging
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..errors import AuditError, ContractError, EngineError, LoomError, UnavailableError
from ..functions.types import family, literal, quote
from ..operators.audits import gap_sentence
from ..operators.materialize import conformed, scd2, scd2_changes, upsert
from ..sources import embedded
from ..sources.lake import freshness, physical_name, version_root, view_name, write_manifest
from ..sources.readers import external_table, seed_rows
from .engine import HIDDEN, Engine, files_of, interval_rows
from .fingerprint import FINGERPRINT_VERSION
from .graph import Graph
from .interval import GRAINS, Interval, floor_to, intervals_within, partition_key, split_into_batches, stamp
from .metrics import Metrics
from .model import Embedded, External, Full, Model, ScdType2, Seed, TimeRange, UniqueKey, View
from .planner import Action, Plan
from .state import Snapshot, StateStore

log = logging.getLogger("lakeloom")
#: Bytes, by Catalyst's estimate, below which a generation is one file.
SMALL = 4 << 20
#: Bytes of a bucket of a keyed table at its first build, about.
BUCKET_BYTES = 128 << 20


@dataclass
class Result:
    plan: Plan
    built: list[str] = field(default_factory=list)
    promoted: bool = False
    warnings: list[str] = field(default_factory=list)


def contract_problems(declared: StructType, found: StructType) -> list[str]:
    """Missing, extra and otherwise typed columns, all of them."""
    have, want = {f.name: f for f in found.fields}, {f.name: f for f in declared.fields}
    out = [f"column {n} is missing" for n in want if n not in have] + [f"column {n} isn't declared" for n in have if n not in want]
    for n in want.keys() & have.keys():
        a, b = family(want[n].dataType), family(have[n].dataType)
        if "any" not in (a, b) and a != b:
            out.append(f"column {n} is {b}, declared {a}")
    return sorted(out)


def open_catalog(engine: Engine, store: StateStore) -> None:
    """Make the tables and views that the store knows of in a session whose catalog doesn't have them: Spark's default catalog lives in memory."""
    for s in store.snapshots():
        name = physical_name(s.name, s.physical)
        if s.kind in ("external", "embedded") or engine.has_table(name):
            continue
        engine.create_database("_phys")
        if s.kind == TimeRange.tag or store.places(s.name, s.physical):
            engine.interval_table(name, StructType.fromJson(_json(s.columns)), s.location, store.places(s.name, s.physical))
        elif s.kind != "view":
            engine.table_over(name, StructType.fromJson(_json(s.columns)), s.location)
    for s in store.snapshots():
        if s.kind == "view" and not engine.has_table(name := physical_name(s.name, s.physical)):
            engine.create_database("_phys")
            engine.execute(f"CREATE OR REPLACE VIEW {name} AS {s.sql}")
    for env in store.environments():
        for model, fp in store.pointers(env).items():
            s = store.snapshot(model, fp)
            if s and s.kind not in ("external", "embedded") and not engine.has_table(view_name(env, model)):
                _swap_view(engine, env, model, s.physical, StructType.fromJson(_json(s.columns)))


def _json(text: str) -> dict:
    import json

    return json.loads(text)


def catalog_name(engine: Engine, name: str, physical: str) -> str:
    """The table of a version in the catalog that the session names."""
    return f"{engine.spark.conf.get('spark.lakeloom.catalog')}.{name.replace('.', '__')}__{physical[:8]}"


def window_rows(name: str, model: Model, part: Interval) -> str:
    """SQL of a model's rows in ``part``. A lake of files keeps rows by the interval that produced them, so there only the rows' own times can tell."""
    k: TimeRange = model.kind
    bounds = stamp(part.start), stamp(part.end)
    if model.target == "parquet":
        t = quote(k.time_column)
        return f"(SELECT * FROM {name} WHERE {t} >= {bounds[0]} AND {t} < {bounds[1]})"
    step = GRAINS[k.interval]
    keys = partition_key(k.interval, floor_to(k.interval, part.start)), partition_key(k.interval, floor_to(k.interval, part.end + step - 1))
    return interval_rows(name, model.columns, k.time_column, keys, bounds)


def _swap_view(engine: Engine, env: str, model: str, physical: str, schema: StructType) -> None:
    view = view_name(env, model)
    engine.create_database(view.split("`")[1])
    engine.execute(f"CREATE OR REPLACE VIEW {view} AS SELECT {', '.join(quote(c) for c in schema.names)} FROM {physical_name(model, physical)}")


class Executor:
    def __init__(self, engine: Engine, store: StateStore, lake: str, *, workers: int = 4, retries: int = 3, stop: threading.Event | None = None, metrics: Metrics | None = None, sleep: Callable[[float], None] = time.sleep, export_options: dict[str, str] | None = None) -> None:
        self.engine, self.store, self.lake = engine, store, lake
        self.workers, self.retries, self.stop, self.sleep = workers, retries, stop or threading.Event(), sleep
        self.metrics = metrics or Metrics()
        self.models: dict[str, Model] = {}
        self.export_options = export_options or {}

    # names and text
    def _names(self, graph: Graph, plan: Plan) -> Callable[[str], str]:
        def ref(name: str) -> str:
            m = graph.models[name]
            if isinstance(m.kind, External):
                return external_table(self.engine, m)
            if isinstance(m.kind, Embedded):
                return f"({m.body.render(ref)})"
            return physical_name(name, plan.by_name[name].physical)

        return ref

    def _body(self, model: Model, ref, part: Interval | None = None) -> str:
        if part is None:
            return model.body.render(ref, *(2 * [stamp(0)]))

        def window(name: str) -> str | None:
            parent = self.models.get(name)
            return window_rows(ref(name), parent, part) if parent and isinstance(parent.kind, TimeRange) else None

        return model.body.render(ref, stamp(part.start), stamp(part.end), window=window)

    def _checked(self, model: Model, sql: str) -> None:
        if problems := contract_problems(model.schema, self.engine.describe(sql)):
            raise ContractError(model.name, problems)

    def _retry(self, what: Callable[[], None]) -> None:
        """Writes may fail for passing reasons; what fails for good fails after a few tries."""
        for k in range(self.retries + 1):
            try:
                return what()
            except (LoomError, EngineError):
                raise
            except Exception:  # noqa: BLE001
                if k == self.retries:
                    raise
                self.sleep(0.5 * 2**k)

    # audits
    def audit(self, model: Model, own: str, scope: str) -> None:
        """Run the audits that this pass covers over ``own``; the first blocking one with violations ends the apply."""
        for a in model.audits:
            if not (a.scope == scope or "any" in (a.scope, scope)):
                continue
            bad = self.engine.query(a.sql(own))
            n = bad.count()
            if not n:
                self.metrics.add("lakeloom_audits_passed_total")
                continue
            detail = gap_sentence(bad.orderBy("resumes_at").limit(1).collect(), n) if a.gaps else ""
            if a.blocking:
                self.metrics.add("lakeloom_audit_failures_total")
                raise AuditError(model.name, a.name, n, detail)
            log.warning("model=%s audit=%s violations=%d %s", model.name, a.name, n, detail)

    # building
    def _generation(self, model: Model, action: Action, rows: DataFrame) -> tuple[str, int]:
        """Write rows as the next generation; nothing reads it until the table is pointed there."""
        root = version_root(self.lake, model.name, action.physical)
        before = [s.generation for s in self.store.sharing(model.name, action.physical)]
        n = max(before, default=0) + 1
        place = f"{root}/gen={n}"
        staged = f"{root}/_staging/{uuid.uuid4().hex}"

        def write() -> None:
            out = self._cast(model, rows)
            if self.engine.bytes_of(out) < SMALL:  # else as many files and tasks as the sources had
                out = out.coalesce(1)
            out.write.mode("overwrite").parquet(staged)
            self.engine.move(staged, place)

        self._retry(write)
        return place, n

    def _cast(self, model: Model, rows: DataFrame) -> DataFrame:
        return conformed(rows, model.columns).select(*[F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in model.schema.fields])

    def _point(self, model: Model, action: Action, place: str) -> str:
        name = physical_name(model.name, action.physical)
        if model.target == "catalog":
            self.engine.catalog_table(name, catalog_name(self.engine, model.name, action.physical), self.engine.spark.read.schema(model.schema).parquet(place))
        else:
            self.engine.table_over(name, model.schema, place)
        return name

    def _one_shot(self, model: Model, action: Action, rows: DataFrame) -> str:
        place, n = self._generation(model, action, rows)
        if model.audits:
            view = f"_audit_{uuid.uuid4().hex}"
            self.engine.spark.read.schema(model.schema).parquet(place).createOrReplaceTempView(view)
            try:
                self.audit(model, view, "any")
            except AuditError:
                self.engine.delete(place)
                raise
            finally:
                self.engine.spark.catalog.dropTempView(view)
        self._point(model, action, place)
        self._save(model, action, place, n)
        # generations before the last are still read by queries that began earlier; the one before them goes
        self.engine.delete(f"{version_root(self.lake, model.name, action.physical)}/gen={n - 2}")
        return place

    def _save(self, model: Model, action: Action, place: str, generation: int = 0, sql: str = "") -> None:
        self.store.save_snapshot(Snapshot(model.name, action.fingerprint, sql, action.ast, action.physical, model.kind.tag, FINGERPRINT_VERSION, model.schema.json(), place, generation))
        if generation:
            for s in self.store.sharing(model.name, action.physical):  # versions that share the files share the generation
                if s.fingerprint != action.fingerprint:
                    self.store.save_snapshot(Snapshot(**{**s.__dict__, "location": place, "generation": generation}))

    def _held(self, model: Model, action: Action) -> DataFrame:
        """What a model that is kept up has so far; empty where it is new."""
        name = physical_name(model.name, action.physical)
        if self.engine.has_table(name):
            return self.engine.spark.table(name)
        return self.engine.spark.createDataFrame([], model.schema)

    def build(self, model: Model, action: Action, ref, now: int) -> None:
        k = model.kind
        if isinstance(k, External):
            return
        if action.reused_from and not isinstance(k, TimeRange) and not action.refresh:
            source = self.store.sharing(model.name, action.physical)[0]
            self._save(model, action, source.location, source.generation, source.sql)
            return
        if isinstance(k, Seed):
            if action.build:
                self._one_shot(model, action, seed_rows(self.engine, model))
            return
        sql = self._body(model, ref)
        if isinstance(k, Embedded):
            if action.build:
                self._checked(model, sql)
                self.audit(model, f"({sql})", "any")
                self._save(model, action, "")
            return
        if isinstance(k, View):
            if action.build:
                self._checked(model, sql)
                self.audit(model, f"({sql})", "any")
                self.engine.create_database("_phys")
                self.engine.execute(f"CREATE OR REPLACE VIEW {physical_name(model.name, action.physical)} AS {sql}")
                self._save(model, action, "", sql=sql)
        elif isinstance(k, Full):
            if action.build:
                self._checked(model, sql)
                self._one_shot(model, action, self.engine.query(sql))
        elif isinstance(k, UniqueKey):
            self._checked(model, sql)
            rows = self._cast(model, self.engine.query(sql))
            if model.target == "catalog":
                self._one_shot(model, action, upsert(self._held(model, action), rows, k.key))
            else:
                self._keyed(model, action, k.key, rows, lambda held, given: upsert(held, given, k.key))
        elif isinstance(k, ScdType2):
            self._checked_scd(model, sql)
            rows = self.engine.query(sql)
            data = [f for f in model.schema.fields if f.name not in (k.valid_from, k.valid_to)]
            rows = rows.select(*[F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in data])
            reconciled = lambda held, given: scd2(held, given, k.valid_from, k.valid_to, F.expr(stamp(now)))
            if model.target == "catalog":
                self._one_shot(model, action, reconciled(self._held(model, action), rows))
            else:
                changed = lambda held, given: scd2_changes(held, given, k.valid_from, k.valid_to)
                self._keyed(model, action, k.key, rows, reconciled, changed)
        elif isinstance(k, TimeRange):
            self._time_range(model, action, ref)

    def _keyed(self, model: Model, action: Action, key: tuple[str, ...], rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame] = lambda held, rows: rows) -> None:
        """Merge rows into a table of buckets by the key's hash: only buckets with keys that ``changed`` gives are read whole and written anew, as one new directory that partitions are then pointed at.

        The number of buckets is set by the size at the first build. The driver gets bucket numbers alone.
        """
        name, root = physical_name(model.name, action.physical), version_root(self.lake, model.name, action.physical)
        places = self.store.places(model.name, action.physical)
        new = not places
        held = self._held(model, action)
        count = int(next(iter(places)).partition("of")[2]) if places else max(1, min(4096, -(-self.engine.bytes_of(rows) // BUCKET_BYTES)))

        def bucket(df: DataFrame) -> Column:
            at = F.pmod(F.xxhash64(*[df[quote(c)] for c in key]), F.lit(count))
            return F.concat(F.lpad(at.cast("string"), 5, "0"), F.lit(f"of{count:05d}"))

        if new:
            touched = [f"{i:05d}of{count:05d}" for i in range(count)]
            old, given = held, rows
        else:
            moved = changed(held, rows)
            touched = sorted(r[0] for r in moved.select(bucket(moved)).distinct().collect())
            columns = ", ".join(map(quote, model.columns))
            among = ", ".join(literal(b) for b in touched) or "''"
            old = self.engine.query(f"SELECT {columns} FROM {files_of(name)} WHERE {quote(HIDDEN)} IN ({among})")
            given = rows.where(bucket(rows).isin(touched)) if touched else rows.limit(0)
        run, there = f"{root}/runs/{uuid.uuid4().hex}", []

        def write() -> None:
            out = self._cast(model, merged(old, given))
            out.withColumn("__part", bucket(out)).hint("rebalance", "__part").write.mode("overwrite").partitionBy("__part").parquet(run)
            there[:] = [(d.partition("=")[2], f"{run}/{d}") for d in self.engine.directories(run) if d.startswith("__part=")]

        if touched:
            self._retry(write)
        gone = [b for b in touched if b not in dict(there)]
        if model.audits:
            view = f"_audit_{uuid.uuid4().hex}"
            after = {**places, **dict(there)}
            paths = [p for b, p in after.items() if b not in gone]
            seen = self.engine.spark.read.schema(model.schema).parquet(*paths) if paths else self.engine.spark.createDataFrame([], model.schema)
            seen.createOrReplaceTempView(view)
            try:
                self.audit(model, view, "any")
            except AuditError:
                self.engine.delete(run)
                raise
            finally:
                self.engine.spark.catalog.dropTempView(view)
        if new:
            self.store.set_places(model.name, action.physical, there, [])
            self.engine.execute(f"DROP {'VIEW' if self.engine.is_view(name) else 'TABLE'} IF EXISTS {name}")
            self.engine.interval_table(name, model.schema, root, dict(there))
        elif touched:
            self._publish(model, action, name, there, gone)
            self.engine.execute(f"REFRESH TABLE {files_of(name)}")
        self._save(model, action, root)

    def _checked_scd(self, model: Model, sql: str) -> None:
        k = model.kind
        data = StructType([f for f in model.schema.fields if f.name not in (k.valid_from, k.valid_to)])
        if problems := contract_problems(data, self.engine.describe(sql)):
            raise ContractError(model.name, problems)

    def _time_range(self, model: Model, action: Action, ref) -> None:
        k: TimeRange = model.kind
        root = version_root(self.lake, model.name, action.physical)
        if action.build or action.reused_from:
            self._checked(model, self._body(model, ref))
            self.engine.mkdirs(root)
            old = next(iter(self.store.sharing(model.name, action.physical)), None)
            if old and action.reused_from:
                lost = set(StructType.fromJson(_json(old.columns)).names) - set(model.columns)
                if lost:
                    raise ContractError(model.name, [f"a forward-only change can't take columns away: {', '.join(sorted(lost))}"])
            # files of before lack new columns, which read as null
            self.engine.interval_table(physical_name(model.name, action.physical), model.schema, root, self.store.places(model.name, action.physical))
            self._save(model, action, root)
            if action.reused_from:
                self.store.mark(model.name, action.fingerprint, self.store.intervals(model.name, action.reused_from), "done")
        elif action.backfill and not self.engine.has_table(physical_name(model.name, action.physical)):
            self.engine.interval_table(physical_name(model.name, action.physical), model.schema, root, self.store.places(model.name, action.physical))
        size = 1 if model.target == "parquet" else k.batch_size
        batches = [part for whole in action.backfill for part in split_into_batches(k.interval, whole, size)]
        failed = threading.Event()

        def fill(part: Interval) -> None:
            if failed.is_set():
                return
            if self.stop.is_set():
                raise LoomError("stopped: the lock was lost")
            try:
                self._batch(model, action, ref, root, part)
            except BaseException:
                failed.set()
                raise

        if model.target == "parquet":  # a job an interval, whose directories have nothing in common
            with ThreadPoolExecutor(self.workers) as pool:
                list(pool.map(fill, batches))
        else:
            for part in batches:
                fill(part)
        if model.target == "parquet" and action.works:
            self._manifest(model, action, root)

    def _batch(self, model: Model, action: Action, ref, root: str, part: Interval) -> None:
        """Replace the rows of ``part``. Rows that the query gives outside it are added beside, as an INSERT would.

        A table's batch is one new directory. The table's partitions are pointed at its intervals and the store notes them in one transaction; only then the directories of before go. So a reader sees
        an interval as it was or as it is, and a run that dies leaves a directory that nothing points at. A lake has one fixed directory an interval, which is replaced by renaming.
        """
        k: TimeRange = model.kind
        parts = intervals_within(k.interval, part)
        lake = model.target == "parquet"
        run = f"{root}/{'_staging' if lake else 'runs'}/{uuid.uuid4().hex}"
        rows = self._cast(model, self.engine.query(self._body(model, ref, part)))
        table, there, gone = physical_name(model.name, action.physical), [], []
        try:
            if lake:

                def write() -> None:
                    key = partition_key(k.interval, part.start)
                    rows.write.mode("overwrite").parquet(run)
                    self.engine.move(run, f"{root}/interval={key}")
                    there[:] = [(key, f"{root}/interval={key}")]

            else:
                t = F.col(quote(k.time_column)).cast("timestamp_ntz")
                inside = (t >= F.expr(stamp(part.start))) & (t < F.expr(stamp(part.end)))
                form = "yyyy-MM-dd" if k.interval == "day" else "yyyy-MM-dd'T'HH"
                keyed = rows.withColumn("__part", F.when(inside, F.date_format(t, form)).otherwise(F.lit("outside")))

                def write() -> None:
                    # AQE evens out the files of each interval, splitting large ones and joining small ones
                    keyed.hint("rebalance", "__part").write.mode("overwrite").partitionBy("__part").parquet(run)
                    made = {d.partition("=")[2].replace("%3A", ":"): f"{run}/{d}" for d in self.engine.directories(run) if d.startswith("__part=")}
                    beside = made.pop("outside", None)
                    there[:] = [*made.items(), *([(f"outside-{uuid.uuid4().hex}", beside)] if beside else [])]
                    gone[:] = [key for p in parts if (key := partition_key(k.interval, p.start)) not in made]

            self._retry(write)
            if lake:
                self.engine.add_intervals(table, there)
            else:
                self._publish(model, action, table, there, gone)
            self.engine.execute(f"REFRESH TABLE {files_of(table)}")
            if model.audits:
                if model.target == "parquet":
                    own = f"_audit_{uuid.uuid4().hex}"
                    self.engine.spark.read.schema(model.schema).parquet(f"{root}/interval={partition_key(k.interval, part.start)}").createOrReplaceTempView(own)
                else:
                    own = window_rows(table, model, part)
                self.audit(model, own, "interval")
        except Exception:
            self.store.mark(model.name, action.fingerprint, parts, "failed")
            self.metrics.add("lakeloom_intervals_failed_total", len(parts))
            raise
        finally:
            if lake:
                self.engine.delete(run)
        self.store.mark(model.name, action.fingerprint, parts, "done")
        self.metrics.add("lakeloom_intervals_done_total", len(parts))

    def _publish(self, model: Model, action: Action, table: str, there: list[tuple[str, str]], gone: list[str]) -> None:
        held = self.store.places(model.name, action.physical)
        for key, place in there:
            if key in held:
                self.engine.move_interval(table, key, place)
        self.engine.add_intervals(table, [(key, place) for key, place in there if key not in held])
        self.engine.drop_intervals(table, [key for key in gone if key in held])
        for old in self.store.set_places(model.name, action.physical, there, gone):
            self.engine.delete(old)

    def _manifest(self, model: Model, action: Action, root: str) -> None:
        try:
            fresh = freshness(self.store.intervals(model.name, action.fingerprint), len(self.store.intervals(model.name, action.fingerprint, "failed")))
            write_manifest(self.engine, root, model, action.fingerprint, fresh)
        except Exception as e:  # noqa: BLE001 - the data is there; consumers of the manifest see the one before
            log.warning("model=%s manifest not written: %s", model.name, e)

    # the whole
    def _preflight(self, graph: Graph, plan: Plan) -> None:
        for a in plan.actions:
            m = graph.models.get(a.name)
            if m and m.export and m.export.startswith("jdbc:") and a.works and not self.engine.has_driver(m.export.partition("#")[0]):
                raise UnavailableError(f"{m.name}: there is no JDBC driver for {m.export.split(':')[1]}")
            if m and m.target == "catalog":
                if self.engine.spark.conf.get("spark.lakeloom.catalog", "").count(".") != 1:
                    raise UnavailableError(f"{m.name}: the catalog target needs spark.lakeloom.catalog, as catalog.database")
                if isinstance(m.kind, TimeRange):
                    raise UnavailableError(f"{m.name}: what is filled by interval is kept as a table or a lake; the catalog target takes models that are built as a whole")

    def apply(self, graph: Graph, plan: Plan, now: int) -> Result:
        """Everything or, where a model fails, what didn't depend on it - and then nothing is promoted."""
        self._preflight(graph, plan)
        self.models = graph.models
        ref, result = self._names(graph, plan), Result(plan)
        todo = {a.name: a for a in plan.actions if a.name in graph.models}
        failed: list[BaseException] = []
        done: set[str] = set()
        running: dict[Future, str] = {}
        with ThreadPoolExecutor(self.workers) as pool:
            waiting = list(todo)
            while waiting or running:
                for name in [n for n in waiting if graph.models[n].deps <= done]:
                    waiting.remove(name)
                    running[pool.submit(self._timed, graph.models[name], todo[name], ref, now)] = name
                if not running:
                    break
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(f)
                    if e := f.exception():
                        failed.append(e)
                        continue
                    done.add(name)
                    if todo[name].works and not isinstance(graph.models[name].kind, External):
                        result.built.append(name)
        if failed:
            raise failed[0]
        for name in graph.order:
            m, a = graph.models[name], todo[name]
            if isinstance(m.kind, TimeRange) and a.works and any(x.scope == "whole" for x in m.audits):
                self.audit(m, physical_name(name, a.physical), "whole")
        changed = [a for a in plan.actions if a.change != "unchanged" and a.name in graph.models]
        with ThreadPoolExecutor(self.workers) as pool:
            served = [a for a in changed if not isinstance(graph.models[a.name].kind, (External, Embedded))]
            list(pool.map(lambda a: _swap_view(self.engine, plan.env, a.name, a.physical, graph.models[a.name].schema), served))
        for name in graph.order:
            m, a = graph.models[name], todo[name]
            if m.export and a.works:
                self._export(m, self.engine.spark.table(physical_name(name, a.physical)))
        for a in plan.actions:
            if a.change == "removed":
                self.engine.execute(f"DROP VIEW IF EXISTS {view_name(plan.env, a.name)}")
        externals = {n for n, m in graph.models.items() if isinstance(m.kind, External)}
        self.store.promote(plan.env, {n: a.fingerprint for n, a in todo.items()}, externals)
        result.promoted = True
        result.built = [n for n in graph.order if n in result.built]
        self.store.journal_plan(plan.env, getpass.getuser(), {"actions": {a.name: a.change for a in plan.actions if a.change != "unchanged"}, "built": result.built})
        for a in plan.actions:
            self.metrics.add("lakeloom_planned_models_total", 1, category=a.change)
        return result

    def _export(self, model: Model, rows: DataFrame) -> None:
        """To ``database.table`` or ``database`` of this session's catalog, or over JDBC to ``url#schema.table`` or ``url``; a table that isn't named is the model's."""
        if model.export.startswith("jdbc:"):
            url, _, place = model.export.partition("#")
            if embedded.in_process(url) and not rows.sparkSession.sparkContext._jsc.isLocal():
                embedded.write(rows, url, place or model.table, self.export_options)
                return
            rows.write.mode("overwrite").option("truncate", "true").jdbc(url, place or model.table, properties=self.export_options)
            return
        place = model.export if "." in model.export else f"{model.export}.{model.table}"
        self.engine.create_database(place.partition(".")[0])
        rows.write.mode("overwrite").saveAsTable(place)

    def _timed(self, model: Model, action: Action, ref, now: int) -> None:
        began = time.time()
        self.build(model, action, ref, now)
        if action.works and not isinstance(model.kind, External):
            self.metrics.add("lakeloom_snapshots_built_total")
            self.metrics.set("lakeloom_model_build_duration_seconds", time.time() - began, model=model.name)
            log.info("model=%s change=%s seconds=%.2f", model.name, action.change, time.time() - began)
