"""Versions: a hash of a model's parsed query, its kind, shape and parents."""

from __future__ import annotations

import hashlib
import json

from ..functions.types import family
from .engine import Engine
from .graph import Graph
from .model import External, Model, ScdType2, Seed, TimeRange, UniqueKey
from .state import StateStore

#: Of the algorithm; a store's older snapshots can't be compared with newer ones.
FINGERPRINT_VERSION = 1


def canonical_text(model: Model) -> str | None:
    """The body with logical names and named bounds; None without a body."""
    return None if model.body is None else model.body.render(lambda name: name)


def kind_payload(model: Model) -> dict:
    """What of a kind makes another version. Where filling starts, in what portions, and what is read again doesn't."""
    k = model.kind
    out: dict = {"tag": k.tag}
    if isinstance(k, TimeRange):
        out |= {"timeColumn": k.time_column, "interval": k.interval}
    elif isinstance(k, UniqueKey):
        out |= {"key": list(k.key)}
    elif isinstance(k, ScdType2):
        out |= {"key": list(k.key), "validFrom": k.valid_from, "validTo": k.valid_to}
    elif isinstance(k, External):
        s = k.source
        out |= {"source": s.kind, "place": s.place} | ({"unionByName": True} if s.union_by_name else {}) | ({"hivePartitioning": True} if s.hive_partitioning else {})
    elif isinstance(k, Seed):
        out |= {"path": k.path, "content": k.digest()}
    return out


def fingerprint(model: Model, ast: str | None, parents: list[str]) -> str:
    """``parents``: ``name=fingerprint`` of each model it reads."""
    payload = {
        "ast": ast,
        "kind": kind_payload(model),
        "grain": list(model.grain),
        "columns": model.columns,
        "families": [family(f.dataType) for f in model.schema.fields],
        "target": model.target,
        "parents": sorted(parents),
    }
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def canonical_trees(graph: Graph, engine: Engine, store: StateStore | None) -> dict[str, str | None]:
    """Parse trees of all bodies; those in the store's cache aren't parsed. The cache is an aid: its failure is never an error."""
    texts = {n: canonical_text(m) for n, m in graph.models.items()}
    keys = {n: hashlib.sha256(f"{FINGERPRINT_VERSION}:{engine.dialect}:{t}".encode()).hexdigest() for n, t in texts.items() if t is not None}
    known: dict[str, str] = {}
    try:
        known = store.canon(sorted(set(keys.values()))) if store else {}
    except Exception:  # noqa: BLE001
        pass
    new = {keys[n]: engine.canonical(texts[n]) for n in keys if keys[n] not in known}
    try:
        if store:
            store.save_canon(new)
    except Exception:  # noqa: BLE001
        pass
    known |= new
    return {n: known[keys[n]] if n in keys else None for n in texts}


def versions(graph: Graph, engine: Engine, store: StateStore | None = None) -> dict[str, tuple[str, str | None]]:
    """name -> (fingerprint, tree), parents first."""
    trees = canonical_trees(graph, engine, store)
    out: dict[str, tuple[str, str | None]] = {}
    for name in graph.order:
        m = graph.models[name]
        out[name] = fingerprint(m, trees[name], [f"{d}={out[d][0]}" for d in m.deps]), trees[name]
    return out
