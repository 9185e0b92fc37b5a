"""The plan: what differs between the project and an environment, and what that needs. Reads the store and changes nothing but its parse cache."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from ..errors import ReclassifyError, StateError
from .engine import Engine
from .fingerprint import FINGERPRINT_VERSION, fingerprint, versions
from .graph import Graph
from .interval import Interval, enumerate_intervals, iso, merge_intervals, millis, missing_intervals
from .model import Embedded, External, Full, Model, ScdType2, TimeRange, UniqueKey, View
from .state import Snapshot, StateStore
from .tree import diverged, drops_columns, has_window, is_suffix_change

CATEGORIES = ("added", "breaking", "non-breaking", "indirect", "forward-only", "removed", "unchanged")
_INHERITS = (Full, TimeRange, UniqueKey, ScdType2)


@dataclass(frozen=True)
class Explanation:
    reason: str
    diverged: tuple[str, ...] = ()
    cascade_from: tuple[str, ...] = ()


@dataclass(frozen=True)
class Action:
    name: str
    fingerprint: str
    physical: str
    change: str
    ast: str | None = None
    build: bool = False
    refresh: bool = False
    backfill: tuple[Interval, ...] = ()
    reused_from: str | None = None
    reclassified_from: str | None = None
    explain: Explanation | None = None

    @property
    def works(self) -> bool:
        return self.build or self.refresh or bool(self.backfill)


@dataclass(frozen=True)
class Warning_:
    code: str
    model: str
    message: str


@dataclass(frozen=True)
class Plan:
    env: str
    actions: tuple[Action, ...]
    warnings: tuple[Warning_, ...] = ()
    by_name: dict[str, Action] = field(default_factory=dict, compare=False, repr=False)

    @property
    def has_changes(self) -> bool:
        return any(a.change != "unchanged" or a.backfill or a.refresh for a in self.actions)

    @property
    def structural(self) -> list[str]:
        return [f"{a.name} ({a.change})" for a in self.actions if a.change != "unchanged"]


def window_risk(model: Model, ast: str | None) -> str | None:
    """A window over a body that is filled several intervals at a time sees other neighbours than one interval would."""
    if not isinstance(model.kind, TimeRange) or model.kind.batch_size < 2 or model.target == "parquet" or not ast or not has_window(ast):
        return None
    return f"{model.name} has a window function and is filled up to {model.kind.batch_size} intervals at a time, so windows span what one batch holds; set batch_size to 1 if each interval is to stand alone"


def plan_changes(
    env: str, graph: Graph, engine: Engine, store: StateStore, *, now: int | str | None = None, forward_only: Sequence[str] = (), reclassify: dict[str, str] | None = None,
) -> Plan:
    now = round(time.time() * 1000) if now is None else millis(now)
    reclassify = reclassify or {}
    for name in [*forward_only, *reclassify]:
        if name not in graph.models:
            raise ReclassifyError(f"{name} isn't a model of this project")
    for name in forward_only:
        if not isinstance(graph.models[name].kind, TimeRange):
            raise ReclassifyError(f"{name} isn't incremental by time, so it can't be forward-only")
    for name, verdict in reclassify.items():
        if verdict not in ("breaking", "non-breaking"):
            raise ReclassifyError(f"{name}: a verdict is breaking or non-breaking")
    current, found = store.pointers(env), versions(graph, engine, store)
    changes: dict[str, str] = {}
    reused: set[str] = set()
    actions = [_action(graph.models[n], *found[n], current, changes, reused, store, now, set(forward_only), reclassify.get(n)) for n in graph.order]
    actions += [Action(n, fp, fp, "removed") for n, fp in sorted(current.items()) if n not in graph.models]
    warnings = tuple(Warning_("window-over-batch", a.name, w) for a in actions if a.name in graph.models and (w := window_risk(graph.models[a.name], a.ast)))
    return Plan(env, tuple(actions), warnings, {a.name: a for a in actions})


def _action(model: Model, fp: str, ast: str | None, current: dict[str, str], changes: dict[str, str], reused: set[str], store: StateStore, now: int, forward: set[str], verdict: str | None) -> Action:
    name, known = model.name, current.get(model.name)
    physical, reused_from, was = fp, None, None
    explain: Explanation | None = None
    if known is None:
        change = "added"
    elif known == fp:
        change = "unchanged"
    else:
        before = store.snapshot(name, known)
        if before and before.version > FINGERPRINT_VERSION:
            raise StateError(f"{name} was versioned by algorithm {before.version}, this library has {FINGERPRINT_VERSION}; use a newer library")
        moved = tuple(sorted(d for d in model.deps if changes[d] != "unchanged"))
        change, explain = _compared(ast, before, moved)
        if verdict and change in ("breaking", "non-breaking") and verdict != change:
            old = _old_tree(before)
            if verdict == "non-breaking" and (not old or ast is None):
                raise ReclassifyError(f"{name} has no query to hold the verdict against")
            if verdict == "non-breaking" and drops_columns(old, ast):
                raise ReclassifyError(f"{name} loses columns, which readers may use; that can't be non-breaking")
            was, explain = change, Explanation(f"set by the operator from {change} to {verdict}; the planner said: {explain.reason}", explain.diverged)
            change = verdict
        stale = before is not None and before.version < FINGERPRINT_VERSION
        by_parents = change == "indirect" and before is not None and model.deps <= current.keys() and fingerprint(model, ast, [f"{d}={current[d]}" for d in model.deps]) == known
        if before and not stale:
            calm = all(changes[d] in ("unchanged", "forward-only") for d in model.deps)
            if name in forward or by_parents and isinstance(model.kind, TimeRange) and moved and calm:
                change, reused_from, physical = "forward-only", known, before.physical
                why = f"forward-only by request: what {known[:8]} holds stays and history isn't computed again" if name in forward else "only parents changed, and those forward-only"
                explain = Explanation(why, explain.diverged if name in forward else (), () if name in forward else moved)
            elif by_parents and isinstance(model.kind, _INHERITS) and moved and all(changes[d] in ("non-breaking", "forward-only") or changes[d] == "indirect" and d in reused for d in moved):
                reused_from, physical = known, before.physical
                reused.add(name)
                explain = Explanation(f"the parents' changes leave existing data alone; what {known[:8]} holds is used on", (), moved)
    changes[name] = change
    there = store.snapshot(name, fp)
    if there:
        physical = there.physical
    done = isinstance(model.kind, External) or change == "unchanged" or there is not None
    return Action(
        name, fp, physical, change, ast, not done, isinstance(model.kind, (UniqueKey, ScdType2)),
        _backfill(model, fp, reused_from, store, now), reused_from, was, explain,
    )


def _old_tree(before: Snapshot | None) -> str:
    return "" if before is None or before.version < FINGERPRINT_VERSION else before.ast or ""


def _compared(ast: str | None, before: Snapshot | None, moved: tuple[str, ...]) -> tuple[str, Explanation]:
    old = _old_tree(before)
    if ast is None:
        return "breaking", Explanation("there is no query to compare: the source, the file, the schema or a parent changed")
    if not old:
        return "breaking", Explanation("the earlier version's parse tree can't be compared with this one's")
    if old == ast:
        if moved:
            return "indirect", Explanation("the query is the same; parents changed", (), moved)
        return "indirect", Explanation("the query is the same; kind, grain, columns or target changed")
    paths = tuple(diverged(old, ast))
    if is_suffix_change(old, ast):
        return "non-breaking", Explanation("columns were added at the end of the select list and nothing else changed", paths)
    return "breaking", Explanation("the query changed in more than columns at the end of its select list", paths)


def _backfill(model: Model, fp: str, reused_from: str | None, store: StateStore, now: int) -> tuple[Interval, ...]:
    k = model.kind
    if not isinstance(k, TimeRange):
        return ()
    done = set(store.intervals(model.name, fp)) | set(store.intervals(model.name, reused_from) if reused_from else ())
    wanted = enumerate_intervals(k.interval, millis(k.start), now)
    again = sorted(done)[-k.lookback :] if k.lookback else []
    return tuple(merge_intervals(sorted({*missing_intervals(wanted, done), *again})))


def plan_json(plan: Plan) -> dict:
    def one(a: Action) -> dict:
        out: dict = {"name": a.name, "change": a.change}
        if a.reclassified_from:
            out["reclassifiedFrom"] = a.reclassified_from
        if a.reused_from:
            out["reusedFrom"] = a.reused_from
        out |= {"fingerprint": a.fingerprint, "build": a.build, "backfill": [{"start": iso(b.start), "end": iso(b.end)} for b in a.backfill]}
        if a.explain:
            out["explain"] = {"diverged": list(a.explain.diverged), "reason": a.explain.reason} | ({"cascadeFrom": list(a.explain.cascade_from)} if a.explain.cascade_from else {})
        return out

    return {
        "env": plan.env,
        "hasChanges": plan.has_changes,
        "warnings": [{"code": w.code, "model": w.model, "message": w.message} for w in plan.warnings],
        "actions": [one(a) for a in plan.actions],
    }


__all__ = ["Action", "Embedded", "Explanation", "Plan", "View", "plan_changes", "plan_json", "window_risk"]
