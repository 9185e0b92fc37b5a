"""Operations around apply: ticks, restating, cleaning up, status."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from ..errors import BlockedError, LoomError, StateError
from ..sources.lake import physical_name, version_root
from .engine import Engine, files_of
from .graph import Graph
from .interval import GRAINS, Interval, enumerate_intervals, floor_to, iso, millis
from .lock import held
from .model import ScdType2, TimeRange, UniqueKey
from .state import StateStore

WEEK = 7 * 86_400_000


def restate(env: str, graph: Graph, store: StateStore, model: str, start: str | int, end: str | int, *, dry_run: bool = False) -> dict:
    """Forget what was computed in a range, for a model and all that read it; the next apply computes it again."""
    m = graph.models.get(model)
    if m is None or not isinstance(m.kind, TimeRange):
        raise LoomError(f"{model} isn't a model incremental by time")
    pointers = store.pointers(env)
    if model not in pointers:
        raise StateError(f"{env} doesn't serve {model}")
    a, b = millis(start), millis(end)
    if a >= b:
        raise LoomError("the range is empty")

    def work() -> dict:
        out = []
        for name in [model, *graph.descendants(model)]:
            k = graph.models[name].kind
            if not isinstance(k, TimeRange) or name not in pointers:
                continue
            step = GRAINS[k.interval]
            whole = Interval(floor_to(k.interval, a), floor_to(k.interval, b + step - 1))
            hit = [i for i in store.intervals(name, pointers[name]) if i.start >= whole.start and i.end <= whole.end]
            if not dry_run:
                store.clear(name, pointers[name], whole)
            out.append({"name": name, "fingerprint": pointers[name], "intervals": [{"start": iso(i.start), "end": iso(i.end)} for i in hit]})
        return {"env": env, "model": model, "from": iso(a), "to": iso(b), "interval": m.kind.interval, "dryRun": dry_run, "targets": out}

    if dry_run:
        return work()
    with held(store, f"env:{env}"):
        return work()


def tick(env: str, project, *, now: int | None = None) -> dict:
    """One run of the schedule: fills what time has added, and refuses anything a person should look at. Always journaled."""
    started = round(time.time() * 1000)
    store: StateStore = project.store
    outcome, detail = "error", {}
    try:
        with held(store, f"env:{env}", project.lock_ttl) as lost:
            plan = project.plan(env, now=now)
            if plan.structural:
                raise BlockedError(env, plan.structural)
            result = project.execute(plan, now=now, stop=lost)
            outcome, detail = "ok", {"processed": result.built}
            return {"env": env, "outcome": "ok", "processed": result.built}
    except BlockedError as e:
        outcome, detail = "awaiting-human", {"blockedBy": e.changes}
        raise
    except LoomError as e:
        from ..errors import LockError

        outcome, detail = ("lock-held" if isinstance(e, LockError) else "error"), {"error": str(e)}
        raise
    except Exception as e:
        detail = {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
        raise
    finally:
        store.journal_run(env, started, outcome, detail)


def daemon(run: Callable[[], object], every: float, stop: threading.Event, on_error: Callable[[Exception], None] = lambda e: None) -> None:
    """Tick until stopped; a failed tick is reported and the next one comes."""
    while not stop.is_set():
        try:
            run()
        except Exception as e:  # noqa: BLE001
            on_error(e)
        stop.wait(every)


def janitor(engine: Engine, store: StateStore, lake: str, *, ttl: int = WEEK, now: int | None = None) -> dict:
    """Drop versions that no environment has pointed at for ``ttl`` milliseconds.

    First they are claimed, in one transaction, so that no promotion can revive them; then their tables and files go, unless another version
    uses the same ones; then they are forgotten. A run that dies between is finished by the next.
    """
    now = round(time.time() * 1000) if now is None else now
    removed, warnings = [], []
    with held(store, "janitor"):
        claimed = store.claim_orphans(now - ttl)
        live = {(s.name, s.physical) for s in store.snapshots()}
        for s in claimed:
            try:
                if (s.name, s.physical) not in live and s.kind not in ("external", "embedded"):
                    name = physical_name(s.name, s.physical)
                    engine.execute(f"DROP {'VIEW' if engine.is_view(name) else 'TABLE'} IF EXISTS {name}")
                    if engine.spark.conf.get("spark.lakeloom.catalog", "").count(".") == 1:
                        engine.execute(f"DROP TABLE IF EXISTS {engine.spark.conf.get('spark.lakeloom.catalog')}.{s.name.replace('.', '__')}__{s.physical[:8]}")
                    if s.kind in (TimeRange.tag, UniqueKey.tag, ScdType2.tag):
                        engine.execute(f"DROP TABLE IF EXISTS {files_of(name)}")
                    if s.kind != "view":
                        engine.delete(version_root(lake, s.name, s.physical))
                store.forget(s)
                removed.append(f"{s.name}@{s.fingerprint[:8]}")
            except Exception as e:  # noqa: BLE001 - stays claimed; the next run tries again
                warnings.append(f"{s.name}@{s.fingerprint[:8]}: {e}")
        kept = len(store.snapshots())
    return {"removed": removed, "kept": kept, "warnings": warnings}


def status(env: str, graph: Graph, store: StateStore, *, now: int | None = None) -> dict:
    """What an environment serves and how far each model has come, by the versions that it serves."""
    now = round(time.time() * 1000) if now is None else now
    from .state import VERSION

    pointers, lag = store.pointers(env), []
    for name in graph.order:
        k = graph.models[name].kind
        if name not in pointers or not isinstance(k, TimeRange):
            continue
        done, bad = store.intervals(name, pointers[name]), store.intervals(name, pointers[name], "failed")
        have = {d.start for d in done}
        missing = sum(i.start not in have for i in enumerate_intervals(k.interval, millis(k.start), now))
        lag.append({"model": name, "doneUpTo": iso(max(d.end for d in done)) if done else None, "missing": missing, "failed": len(bad)})
    promoted = store.environments().get(env)
    return {"env": env, "storeVersion": VERSION, "models": len(pointers), "promotedAt": iso(promoted) if promoted else None, "lastPlan": store.last_plan(env), "lag": lag, "ticks": store.last_runs(env)}


def healthy(report: dict) -> bool:
    return not any(x["failed"] for x in report["lag"]) and (not report["ticks"] or report["ticks"][0]["outcome"] != "error")
