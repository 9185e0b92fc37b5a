"""What a consumer may believe: declared limits and coverage, narrowed by everything that a model reads."""

from __future__ import annotations

from ..sources.lake import freshness
from .graph import Graph
from .model import ANSWERABLE, TimeRange
from .state import StateStore

NOTHING = {"contiguousThrough": None, "latestInterval": None, "failedIntervals": 0}


def passports(graph: Graph, own: dict[str, dict]) -> dict[str, dict]:
    """``own``: the freshness of each model by its ledger. Parents are folded in before children."""
    out: dict[str, dict] = {}
    for name in graph.order:
        m = graph.models[name]
        fresh = own.get(name, NOTHING)
        parents = [out[d]["effective"] for d in sorted(m.deps)]
        worst = max([m.answerable, *[p["answerable"] for p in parents]], key=ANSWERABLE.index)
        limits = [(p["completeThrough"], p["limitedBy"]) for p in parents if p["limitedBy"]]
        if isinstance(m.kind, TimeRange):
            limits.append((fresh["contiguousThrough"], name))
        # no coverage at all bounds everything; of equal limits the nearest to the source is named
        through, by = min(limits, key=lambda x: (x[0] is not None, x[0] or "", x[1] == name), default=(None, None))
        caveats = {(name, c): None for c in m.caveats}
        for p in parents:
            caveats |= {(c["model"], c["text"]): None for c in p["caveats"]}
        out[name] = {
            "model": name,
            "declared": {"answerable": m.answerable, "caveats": list(m.caveats)},
            "freshness": fresh,
            "effective": {"answerable": worst, "caveats": [{"model": a, "text": b} for a, b in caveats], "completeThrough": through, "limitedBy": by},
        }
    return out


def environment_passport(env: str, graph: Graph, store: StateStore) -> dict:
    """For the models that an environment serves, by the versions that it serves."""
    pointers = store.pointers(env)
    own = {n: freshness(store.intervals(n, fp), len(store.intervals(n, fp, "failed"))) for n, fp in pointers.items()}
    all_ = passports(graph, own)
    return {"env": env, "models": [all_[n] for n in graph.order if n in pointers]}
