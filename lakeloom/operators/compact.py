"""Joining the many small files of old partitions, on request without repeated rows."""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..plans.engine import Engine
from ..plans.graph import Graph
from ..plans.interval import floor_to, millis
from ..plans.model import External, Model, TimeRange
from .materialize import dedupe_latest


@dataclass
class Report:
    dry_run: bool
    compacted: list[dict] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def to_json(self) -> dict:
        return {"dryRun": self.dry_run, "compacted": self.compacted, "skipped": self.skipped, "warnings": self.warnings}


def glob_root(place: str) -> str:
    """The path before the first wildcard."""
    m = re.search(r"[*?\[{]", place)
    return place.rstrip("/") if not m else place[: m.start()].rpartition("/")[0]


def partition_day(segment: str, key: str) -> int | None:
    """The day of ``key=2026-01-31...`` in milliseconds."""
    m = re.fullmatch(rf"{re.escape(key)}=(\d{{4}}-\d\d-\d\d).*", segment)
    try:
        return millis(m[1]) if m else None
    except ValueError:
        return None


def targets(graph: Graph, root_of) -> list[tuple[Model, str, str, bool]]:
    """Models to compact, with their directory, partition column and whether the files are ours."""
    out = []
    for name in graph.order:
        m = graph.models[name]
        if isinstance(m.kind, TimeRange) and m.target == "parquet" and (root := root_of(m)):
            out.append((m, root, "interval", True))
        elif isinstance(m.kind, External) and m.compaction:
            out.append((m, glob_root(m.kind.source.place), m.compaction.partition, False))
    return out


#: Bytes of a merged file, about; a partition of more becomes several files, each written by its own task.
FILE_BYTES = 512 << 20


def compact(engine: Engine, graph: Graph, root_of, *, now: int | None = None, dry_run: bool = False, default_grace_hours: float = 0.0, workers: int = 4) -> Report:
    """Merge each partition that is past, has enough files and has been left alone for its grace; checked in this order: undated, current day, already compact, grace.

    Only files that were listed before the read are deleted, so what arrives meanwhile stays. Partitions are merged side by side.
    """
    now = round(time.time() * 1000) if now is None else now
    report, todo = Report(dry_run), []
    for model, root, key, ours in targets(graph, root_of):
        policy = model.compaction
        if not dry_run:
            recover(engine, root)
        by: dict[str, list[tuple[str, int, int]]] = {}
        for f in engine.files(root):
            if f[0].endswith(".parquet"):
                by.setdefault(f[0].rpartition("/")[0], []).append(f)
        for place, files in sorted(by.items()):
            segment = next((s for s in place.split("/")[::-1] if s.startswith(key + "=")), place.rpartition("/")[2])
            day = partition_day(segment, key)
            grace = (policy.grace_hours if policy else default_grace_hours) * 3_600_000
            why = None
            if day is None:
                why = "undated"
            elif day >= floor_to("day", now):
                why = "current-day"
            elif len(files) < (policy.min_files if policy else 2) or len(files) <= _parts(files):
                why = "already-compact"
            elif max(t for _, _, t in files) > now - grace:
                why = "grace-period"
            if why:
                report.skipped.append({"model": model.name, "partition": segment, "reason": why})
                continue
            entry = {"model": model.name, "partition": segment, "files": len(files), "rows": None, "published": None}
            todo.append((entry, model, place, files, ours))
    if dry_run:
        report.compacted += [entry for entry, *_ in todo]
        return report
    with ThreadPoolExecutor(workers) as pool:
        jobs = [(entry, pool.submit(_merge, engine, *rest)) for entry, *rest in todo]
    for entry, job in jobs:
        if e := job.exception():  # the others went on
            report.warnings.append(f"{entry['model']} {entry['partition']}: {e}")
        else:
            report.compacted.append(entry | job.result())
    return report


#: Says, in a partition's directory, which files are replaced by which: all new ones are there under names that scans skip.
INTENT = "_compaction.json"


def _finish(engine: Engine, place: str) -> None:
    """Carry out an intent, from wherever it was left."""
    intent = json.loads(engine.read_text(f"{place}/{INTENT}"))
    waiting = [name for name in intent["new"] if engine.exists(f"{place}/_{name}")]
    arrived = {f"{place}/{name}" for name in intent["new"] if name not in waiting}
    for f in intent["old"]:
        if f not in arrived:  # a new file that has arrived may have an old one's name
            engine.delete(f)
    for name in waiting:
        engine.move(f"{place}/_{name}", f"{place}/{name}")
    engine.delete(f"{place}/{INTENT}")


def recover(engine: Engine, root: str) -> list[str]:
    """Finish what a run that died had begun: intents are carried out, and files of runs that died before theirs go."""
    done = []
    hidden = [f for f in engine.files(root, hidden=True) if f[0].rpartition("/")[2].startswith("_")]
    for f, _, _ in hidden:
        place, _, name = f.rpartition("/")
        if name == INTENT:
            _finish(engine, place)
            done.append(place)
    for f, _, _ in hidden:
        place, _, name = f.rpartition("/")
        if name.endswith(".parquet") and place not in done and engine.exists(f):
            engine.delete(f)
    return done


def _parts(files: list[tuple[str, int, int]]) -> int:
    return max(1, -(-sum(n for _, n, _ in files) // FILE_BYTES))


def _merge(engine: Engine, model: Model, place: str, listed: list[tuple[str, int, int]], ours: bool) -> dict:
    from ..sources.readers import read_union_by_name

    files, n = [f for f, _, _ in listed], _parts(listed)
    df = read_union_by_name(engine.spark, files)
    p = model.compaction
    if p and p.key:
        order = [F.col(c).asc_nulls_last() for c in (*p.key, *p.order)]
        df = dedupe_latest(df, p.key, p.order)
        df = (df.coalesce(1) if n == 1 else df.repartitionByRange(n, *order)).sortWithinPartitions(*order)
    else:
        df = df.coalesce(n)
    staged = f"{place}/_staging-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    made = [f for f, _, _ in engine.files(staged) if f.endswith(".parquet")]
    rows = engine.spark.read.parquet(staged).count()
    stem = "data" if ours else f"compact-{uuid.uuid4().hex[:12]}"
    names = [f"{stem}.parquet"] if len(made) == 1 else [f"{stem}-{k:05d}.parquet" for k in range(len(made))]
    # under names that scans skip until the old files are gone, as an old file may have a new one's name
    for f, name in zip(made, names):
        engine.move(f, f"{place}/_{name}")
    engine.write_text(f"{place}/{INTENT}", json.dumps({"old": files, "new": names}))  # from here on a run that dies is finished by the next
    _finish(engine, place)
    engine.delete(staged)
    return {"rows": rows, "published": names[0] if len(names) == 1 else f"{names[0]} and {len(names) - 1} more"}
