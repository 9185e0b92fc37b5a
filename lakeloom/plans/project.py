"""The facade: a set of models, a session, a lake and a state store."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.compact import Report, compact
from ..operators.diff import data_diff, env_diff
from ..operators.lineage import Origin, column_lineage
from ..errors import LoomError
from ..sources.lake import physical_name, version_root, view_name
from . import ops
from .engine import Engine, files_of
from .executor import Executor, Result, open_catalog, window_rows
from .fingerprint import canonical_trees, versions
from .graph import Graph, build_graph
from .interval import Interval, millis
from .lock import TTL, held
from .metrics import Metrics
from .model import Embedded, External, Model, ScdType2, TimeRange, UniqueKey
from .passport import environment_passport
from .planner import Plan, plan_changes
from .redact import redact_graph
from .state import StateStore


class Project:
    """``redacted``: environments that must not show the columns which models mark."""

    def __init__(self, spark: SparkSession, models: Iterable[Model], lake: str, state: str | Path = ":memory:", *, redacted: Sequence[str] = (), workers: int = 4, lock_ttl: float = TTL, secrets: Sequence[str] = (), prepare: Sequence[str] = (), export_options: dict[str, str] | None = None) -> None:
        self.engine = Engine(spark, tuple(secrets), tuple(prepare))
        self.graph, self.lake = build_graph(models), lake
        self.store = state if isinstance(state, StateStore) else StateStore(state)
        self.redacted, self.workers, self.lock_ttl = tuple(redacted), workers, lock_ttl
        self.metrics, self.export_options = Metrics(), export_options or {}
        open_catalog(self.engine, self.store)

    def graph_for(self, env: str) -> Graph:
        return redact_graph(self.graph, self.redacted, env)

    def plan(self, env: str, *, now: int | str | None = None, forward_only: Sequence[str] = (), reclassify: dict[str, str] | None = None) -> Plan:
        return plan_changes(env, self.graph_for(env), self.engine, self.store, now=now, forward_only=forward_only, reclassify=reclassify)

    def execute(self, plan: Plan, *, now: int | str | None = None, stop: threading.Event | None = None) -> Result:
        at, began = round(time.time() * 1000) if now is None else millis(now), time.time()
        outcome = "error"
        try:
            out = Executor(self.engine, self.store, self.lake, workers=self.workers, stop=stop, metrics=self.metrics, export_options=self.export_options).apply(self.graph_for(plan.env), plan, at)
            outcome = "ok"
            return out
        finally:
            self.metrics.set("lakeloom_command_duration_seconds", time.time() - began)
            self.metrics.set("lakeloom_last_run_timestamp_seconds", round(time.time()), outcome=outcome)

    def apply(self, env: str, *, now: int | str | None = None, forward_only: Sequence[str] = (), reclassify: dict[str, str] | None = None) -> Result:
        """Plan and execute under the environment's lock."""
        with held(self.store, f"env:{env}", self.lock_ttl) as lost:
            return self.execute(self.plan(env, now=now, forward_only=forward_only, reclassify=reclassify), now=now, stop=lost)

    def run(self, env: str, *, now: int | str | None = None) -> dict:
        return ops.tick(env, self, now=now)

    def restate(self, env: str, model: str, start: str | int, end: str | int, *, dry_run: bool = False) -> dict:
        return ops.restate(env, self.graph, self.store, model, start, end, dry_run=dry_run)

    def janitor(self, *, ttl: int = ops.WEEK, now: int | None = None) -> dict:
        return ops.janitor(self.engine, self.store, self.lake, ttl=ttl, now=now)

    def status(self, env: str, *, now: int | str | None = None) -> dict:
        return ops.status(env, self.graph, self.store, now=None if now is None else millis(now))

    def passport(self, env: str) -> dict:
        return environment_passport(env, self.graph, self.store)

    def table(self, env: str, model: str, start: int | str | None = None, end: int | str | None = None) -> DataFrame:
        """A model as an environment serves it. With bounds only the rows of a model incremental by time from ``start`` on and before ``end``, of which only those intervals' directories are opened."""
        if start is None and end is None:
            return self.engine.spark.table(view_name(env, model))
        m, fp = self.graph_for(env).models[model], self.store.pointers(env).get(model)
        s = self.store.snapshot(model, fp) if fp else None
        if not isinstance(m.kind, TimeRange) or s is None:
            raise LoomError(f"{model} isn't a model incremental by time that {env} serves")
        far = millis("9999-01-01")
        part = Interval(millis(m.kind.start) if start is None else millis(start), far if end is None else millis(end))
        return self.engine.query(f"SELECT * FROM {window_rows(physical_name(model, s.physical), m, part)}")

    def render(self, model: str, env: str | None = None) -> str:
        """A model's query with logical names, or with an environment's."""
        m = self.graph.models[model]
        if m.body is None:
            return ""

        def ref(name: str) -> str:
            r = self.graph.models[name]
            if isinstance(r.kind, External):
                return r.kind.source.place if r.kind.source.kind == "table" else f"{r.kind.source.kind}.`{r.kind.source.place}`"
            return f"({r.body.render(ref)})" if isinstance(r.kind, Embedded) else view_name(env, name)

        return m.body.render((lambda n: n) if env is None else ref)

    def audit(self, env: str, only: Sequence[str] = ()) -> dict:
        """Run the audits of what an environment serves, without building anything. Those that ask about one interval are left out."""
        from ..operators.audits import gap_sentence

        graph = self.graph_for(env)
        if lost := [n for n in only if n not in graph.models]:
            raise LoomError(f"not in this project: {', '.join(lost)}")
        results, skipped = [], []
        for name in graph.order:
            m = graph.models[name]
            if only and name not in only or not m.audits:
                continue
            own = view_name(env, name)
            if isinstance(m.kind, Embedded):
                own = f"({self._redacted_render(graph, m, env)})"
            elif isinstance(m.kind, External):
                from ..sources.readers import external_table

                own = external_table(self.engine, m)
            for a in m.audits:
                if a.scope == "interval":
                    skipped.append({"model": name, "audit": a.name, "reason": "interval-scoped"})
                    continue
                bad = self.engine.query(a.sql(own))
                n = bad.count()
                entry = {"model": name, "audit": a.name, "blocking": a.blocking, "violations": n}
                if n and a.gaps:
                    entry["detail"] = gap_sentence(bad.orderBy("resumes_at").limit(1).collect(), n)
                results.append(entry)
        return {"env": env, "results": results, "blockingViolations": sum(r["violations"] for r in results if r["blocking"]), "skipped": skipped}

    def _redacted_render(self, graph: Graph, model: Model, env: str) -> str:
        def ref(name: str) -> str:
            r = graph.models[name]
            if isinstance(r.kind, Embedded):
                return f"({r.body.render(ref)})"
            if isinstance(r.kind, External):
                from ..sources.readers import external_table

                return external_table(self.engine, r)
            return view_name(env, name)

        return model.body.render(ref)

    def diff(self, a: str, b: str) -> dict:
        return env_diff(self.store.pointers(a), self.store.pointers(b))

    def data_diff(self, a: str, b: str, *, percent: float | None = None) -> dict[str, dict]:
        """Rows of each model whose versions differ between two environments."""
        out = {}
        for entry in self.diff(a, b)["different"]:
            m = self.graph.models.get(entry["model"])
            if m is None or isinstance(m.kind, (External, Embedded)):
                continue
            key = m.grain or (m.kind.key if isinstance(m.kind, (UniqueKey, ScdType2)) else ())
            out[m.name] = data_diff(self.table(a, m.name), self.table(b, m.name), key, percent)
        return out

    def lineage(self, model: str, column: str) -> Origin:
        return column_lineage(self.graph, canonical_trees(self.graph, self.engine, self.store), model, column)

    def compact(self, env: str, *, dry_run: bool = False, now: int | None = None, grace_hours: float = 0.0) -> Report:
        pointers = self.store.pointers(env)

        def root(m: Model) -> str | None:
            s = self.store.snapshot(m.name, pointers[m.name]) if m.name in pointers and isinstance(m.kind, TimeRange) else None
            return version_root(self.lake, m.name, s.physical) if s else None

        with held(self.store, f"env:{env}", self.lock_ttl):
            report = compact(self.engine, self.graph, root, dry_run=dry_run, now=now, default_grace_hours=grace_hours)
        for name in {e["model"] for e in report.compacted} if not dry_run else ():
            s = self.store.snapshot(name, pointers[name]) if name in pointers else None
            if s and s.kind == "incremental_by_time_range":
                self.engine.execute(f"REFRESH TABLE {files_of(physical_name(name, s.physical))}")
        return report

    def versions(self) -> dict[str, str]:
        return {n: fp for n, (fp, _) in versions(self.graph, self.engine, self.store).items()}
