"""The command line: ``python -m lakeloom COMMAND``.

Exit codes: 0 done, 1 an error, 2 a person has to look (changes without ``--yes`` where nobody can be asked, or a tick that met changes).
Every ``--json`` payload is an object with ``apiVersion``.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import threading
import traceback
from pathlib import Path

from . import errors as E
from .operators.lineage import printed
from .plans import graph_view, ops, schedule
from .plans.config import DEFAULT, load, models_of, open_project
from .plans.graph import build_graph
from .plans.planner import Plan, plan_json
from .plans.state import migrate

API_VERSION = 1
OK, FAILED, AWAITING = 0, 1, 2

_HINTS = (
    (E.LockError, "wait for the other apply or run; its lock frees itself"),
    (E.BlockedError, "look at `lakeloom plan`, then `lakeloom apply`"),
    (E.StateError, "`lakeloom migrate` brings an older store up to date"),
    (E.AuditError, "look at the rows that the audit selects, mend the model or its source, then apply again: what passed isn't computed again"),
    (E.ContractError, "make the query and the declared schema agree"),
    (E.UnavailableError, "choose another target, or put the driver on Spark's class path"),
)


def show(payload: dict) -> None:
    print(json.dumps({"apiVersion": API_VERSION, **payload}, indent=2, default=str))


def pairs(text: str) -> dict[str, str]:
    """``model=breaking,other=non-breaking``"""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, verdict = part.partition("=")
        if not name or verdict not in ("breaking", "non-breaking"):
            raise E.ReclassifyError(f"{part!r}: write model=breaking or model=non-breaking")
        out[name] = verdict
    return out


def decide(changes: bool, yes: bool, terminal: bool) -> str:
    return "apply" if yes or not changes else "ask" if terminal else "refuse"


def plan_text(plan: Plan, explain: bool = False) -> str:
    marks = {"added": "+", "removed": "-", "breaking": "!", "non-breaking": "~", "indirect": "^", "forward-only": ">", "unchanged": " "}
    lines = [f"plan of {plan.env}" + ("" if plan.has_changes else ": nothing to do")]
    for a in plan.actions:
        if a.change == "unchanged" and not a.works:
            continue
        fill = f", {sum((b.end - b.start) for b in a.backfill) // 3_600_000} h to fill" if a.backfill else ""
        lines.append(f"  {marks[a.change]} {a.name} {a.change}{' (build)' if a.build else ''}{fill}")
        if explain and a.explain:
            lines.append(f"      {a.explain.reason}" + (f" [{', '.join(a.explain.diverged)}]" if a.explain.diverged else ""))
    return "\n".join([*lines, *[f"  warning: {w.message}" for w in plan.warnings]])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lakeloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config", default=DEFAULT)
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--log-level", default="info")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *args: tuple) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about, parents=[shared])
        for names, options in args:
            c.add_argument(*names, **options)
        return c

    env = (["env"], {})
    flag = lambda *n: (list(n), {"action": "store_true"})
    text = lambda *n: (list(n), {"default": None})
    forward, reclass, now = (["--forward-only"], {"default": ""}), (["--reclassify"], {"default": ""}), text("--now")
    metrics = text("--metrics")
    command("init", "write a small project", (["folder"], {"nargs": "?", "default": "."}))
    command("plan", "what an apply would do", env, forward, reclass, now, flag("--explain"))
    command("apply", "build, check and promote", env, forward, reclass, now, flag("--yes", "-y"), metrics)
    command("run", "one tick", env, now, metrics, (["--every"], {"type": float, "default": None}))
    command("restate", "compute a range again", env, (["model"], {}), (["--from"], {"dest": "start", "required": True}), (["--to"], {"dest": "end", "required": True}), flag("--dry-run"))
    command("status", "what is served, and how far it is", env, now)
    command("audit", "run audits over what is served", env, (["models"], {"nargs": "*"}))
    command("render", "a model's query", (["model"], {}), (["env"], {"nargs": "?"}))
    command("graph", "the models", text("--html"))
    command("lineage", "where columns come from", (["model"], {}), (["columns"], {"nargs": "*"}))
    command("passport", "what may be believed", env)
    command("diff", "two environments", (["a"], {}), (["b"], {}), flag("--data"), (["--sample"], {"type": float, "default": None}))
    command("schedule", "ticks by cron or systemd", (["env"], {"nargs": "?"}), (["cron"], {"nargs": "?", "default": "@hourly"}), flag("--remove"), flag("--list"), flag("--print-systemd"))
    command("janitor", "drop what nothing serves", (["--ttl-days"], {"type": float, "default": 7.0}))
    command("compact", "merge small files", env, flag("--dry-run"), (["--grace-hours"], {"type": float, "default": 0.0}))
    command("migrate", "bring the store up to date")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    level = getattr(logging, a.log_level.upper(), logging.INFO)
    form = "%(levelname)s %(message)s" if sys.stderr.isatty() else "ts=%(asctime)s level=%(levelname)s %(message)s"
    logging.basicConfig(stream=sys.stderr, level=level, format=form, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        return _run(a, spark)
    except E.BlockedError as e:
        _failure(e, a)
        return AWAITING
    except Exception as e:  # noqa: BLE001 - the one place that turns errors into a screen and a code
        _failure(e, a)
        return FAILED


def _failure(e: Exception, a: argparse.Namespace) -> None:
    print(f"{type(e).__name__}: {E.mask(str(e))}", file=sys.stderr)
    if hint := next((h for kind, h in _HINTS if isinstance(e, kind)), None):
        print(f"  {hint}", file=sys.stderr)
    if a.log_level.lower() == "debug":
        print(E.mask(traceback.format_exc()), file=sys.stderr)


def _run(a: argparse.Namespace, spark) -> int:
    out = (lambda payload, plain: show(payload)) if a.json else (lambda payload, plain: print(plain))
    if a.command == "init":
        made = scaffold(Path(a.folder))
        out({"created": made}, "\n".join(f"wrote {m}" for m in made))
        return OK
    if a.command == "migrate":
        config, root = load(a.config)
        report = migrate(config.state if Path(config.state).is_absolute() else root / config.state)
        out(report, f"layout {report['from']} -> {report['to']}" + (f", copy at {report['backup']}" if "backup" in report else ""))
        return OK
    if a.command == "graph":
        graph = build_graph(models_of(*load(a.config)))
        if a.html:
            Path(a.html).write_text(graph_view.page(graph))
        out(graph_view.to_json(graph), graph_view.text(graph))
        return OK
    if a.command == "schedule":
        return _schedule(a, out)
    p = open_project(a.config, spark)
    if a.command in ("plan", "apply"):
        return _plan_apply(a, p, out)
    if a.command == "run":
        if a.every:
            stop = threading.Event()
            ops.daemon(lambda: p.run(a.env), a.every, stop, lambda e: _failure(e, a))
            return OK
        try:
            result = p.run(a.env, now=a.now)
        except E.BlockedError as e:
            if a.json:
                show({"env": a.env, "outcome": "awaiting-human", "processed": [], "blockedBy": e.changes})
            raise
        finally:
            if a.metrics:
                p.metrics.write(a.metrics)
        out(result, f"{a.env}: {', '.join(result['processed']) or 'nothing new'}")
    elif a.command == "restate":
        r = p.restate(a.env, a.model, a.start, a.end, dry_run=a.dry_run)
        out(r, "\n".join(f"{t['name']}: {len(t['intervals'])} interval(s) {'would be' if a.dry_run else ''} cleared" for t in r["targets"]))
    elif a.command == "status":
        r = p.status(a.env, now=a.now)
        out(r, "\n".join([f"{a.env}: {r['models']} model(s), promoted {r['promotedAt']}", *[f"  {x['model']}: up to {x['doneUpTo']}, {x['missing']} missing, {x['failed']} failed" for x in r["lag"]]]))
        return OK if ops.healthy(r) else FAILED
    elif a.command == "audit":
        r = p.audit(a.env, a.models)
        out(r, "\n".join(f"{'ok  ' if not x['violations'] else 'FAIL' if x['blocking'] else 'warn'} {x['model']} {x['audit']} {x['violations']} {x.get('detail', '')}".rstrip() for x in r["results"]))
        return FAILED if r["blockingViolations"] else OK
    elif a.command == "render":
        sql = p.render(a.model, a.env)
        out({"model": a.model, "env": a.env, "sql": sql}, sql)
    elif a.command == "lineage":
        trees = [p.lineage(a.model, c) for c in a.columns or p.graph.models[a.model].columns]
        out({"model": a.model, "lineage": [t.to_json() for t in trees]}, "\n".join(map(printed, trees)))
    elif a.command == "passport":
        r = p.passport(a.env)
        out(r, "\n".join(f"{m['model']}: {m['effective']['answerable']}, complete through {m['effective']['completeThrough']} (by {m['effective']['limitedBy']})" for m in r["models"]))
    elif a.command == "diff":
        r = {"a": a.a, "b": a.b, **p.diff(a.a, a.b)}
        if a.data:
            r["data"] = p.data_diff(a.a, a.b, percent=a.sample)
        out(r, json.dumps(r, indent=2))
    elif a.command == "janitor":
        r = p.janitor(ttl=int(a.ttl_days * 86_400_000))
        out(r, f"removed {len(r['removed'])}, kept {r['kept']}")
    elif a.command == "compact":
        r = p.compact(a.env, dry_run=a.dry_run, grace_hours=a.grace_hours)
        out(r.to_json(), f"{len(r.compacted)} partition(s) merged, {len(r.skipped)} left alone")
    return OK


def _plan_apply(a: argparse.Namespace, p, out) -> int:
    forward = [x.strip() for x in a.forward_only.split(",") if x.strip()]
    options = {"now": a.now, "forward_only": forward, "reclassify": pairs(a.reclassify)}
    if a.command == "plan":
        plan = p.plan(a.env, **options)
        out(plan_json(plan), plan_text(plan, a.explain))
        return OK
    from .plans.lock import held

    with held(p.store, f"env:{a.env}", p.lock_ttl) as lost:
        plan = p.plan(a.env, **options)
        if not a.json:
            print(plan_text(plan))
        verdict = decide(plan.has_changes, a.yes, sys.stdin.isatty() and sys.stdout.isatty())
        if verdict == "ask":
            verdict = "apply" if input("apply? [y/N] ").strip().lower() in ("y", "yes") else "refuse"
        if verdict == "refuse":
            out({"env": a.env, "applied": False, "plan": plan_json(plan), "built": [], "promoted": False}, "not applied; add --yes")
            return AWAITING
        try:
            result = p.execute(plan, now=a.now, stop=lost)
        finally:
            if a.metrics:
                p.metrics.write(a.metrics)
    out({"env": a.env, "applied": True, "plan": plan_json(plan), "built": result.built, "promoted": result.promoted}, f"built {', '.join(result.built) or 'nothing'}; {a.env} promoted")
    return OK


def _schedule(a: argparse.Namespace, out) -> int:
    config = Path(a.config)
    if a.list:
        found = schedule.entries()
        out({"entries": found}, "\n".join(found))
        return OK
    if not a.env:
        raise E.LoomError("which environment?")
    if a.print_systemd:
        files = schedule.units(a.env, a.cron, config)
        out({"units": files}, "\n".join(f"# {n}\n{t}" for n, t in files.items()))
    elif a.remove:
        schedule.remove(a.env, config)
        out({"removed": a.env}, f"{a.env} no longer ticks")
    else:
        schedule.register(a.env, a.cron, config)
        out({"registered": a.env, "cron": a.cron}, f"{a.env} ticks at {a.cron}")
    return OK


_PROJECT = {
    "lakeloom_config.py": '"""The project: models of the files below models/."""\n\nfrom lakeloom.plans.config import Config\n\nconfig = Config(discovery=("models/*.py",))\n',
    "models/sales.py": '''"""A seed, a table that is filled day by day, and a sum over it."""

from lakeloom.operators.audits import not_null, unique
from lakeloom.plans.model import Full, TimeRange, model, seed
from pathlib import Path

sales = seed("raw.sales", Path(__file__).parent.parent / "seeds" / "sales.csv", "sold_at timestamp, shop string, amount double")

by_day = model(
    "mart.shop_days",
    TimeRange("day", start="2026-01-01", lookback=1),
    "day timestamp, shop string, total double",
    lambda c: f"SELECT CAST(date_trunc('DAY', sold_at) AS TIMESTAMP_NTZ) AS day, shop, sum(amount) AS total FROM {c.ref(sales)} WHERE sold_at >= {c.start} AND sold_at < {c.end} GROUP BY 1, 2",
    grain=["day", "shop"],
    audits=[not_null("total"), unique("day", "shop")],
)

by_shop = model("mart.shops", Full(), "shop string, total double, days bigint", lambda c: f"SELECT shop, sum(total) AS total, count(*) AS days FROM {c.ref(by_day)} GROUP BY shop")
''',
    "seeds/sales.csv": "sold_at,shop,amount\n2026-01-01 09:00:00,north,12.5\n2026-01-01 17:30:00,south,7\n2026-01-02 11:15:00,north,3.25\n",
}


def scaffold(folder: Path) -> list[str]:
    """Files of a small project that works; none that is there is overwritten."""
    if there := [n for n in _PROJECT if (folder / n).exists()]:
        raise E.LoomError(f"already there: {', '.join(there)}")
    for name, text in _PROJECT.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return list(_PROJECT)
