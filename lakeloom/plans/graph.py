"""The graph of models, from their references alone."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from ..errors import GraphError
from .model import Model


@dataclass(frozen=True)
class Graph:
    models: dict[str, Model]
    order: tuple[str, ...]
    children: dict[str, tuple[str, ...]]

    def ancestors(self, name: str) -> list[str]:
        """All models that ``name`` reads, directly or not, nearest first."""
        out: dict[str, None] = {}
        layer = sorted(self.models[name].deps)
        while layer:
            out.update(dict.fromkeys(layer))
            layer = sorted({d for n in layer for d in self.models[n].deps} - out.keys())
        return list(out)

    def descendants(self, name: str) -> list[str]:
        """All models that read ``name``, directly or not, in topological order."""
        seen, todo = set(), [name]
        while todo:
            for c in self.children[todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return [n for n in self.order if n in seen]


def build_graph(models: Iterable[Model]) -> Graph:
    """Check and order models; among those that may come next the first by name does, so the order doesn't depend on the input's."""
    by: dict[str, Model] = {}
    for m in models:
        if m.name in by and by[m.name] is not m:
            raise GraphError(f"{m.name} is defined twice")
        by[m.name] = m
    for m in by.values():
        if lost := sorted(m.deps - by.keys()):
            raise GraphError(f"{m.name} refers to unknown models: {', '.join(lost)}")
    children: dict[str, list[str]] = {n: [] for n in by}
    waits = {n: len(m.deps) for n, m in by.items()}
    for n, m in by.items():
        for d in m.deps:
            children[d].append(n)
    ready, order = [n for n, k in waits.items() if not k], []
    heapq.heapify(ready)
    while ready:
        n = heapq.heappop(ready)
        order.append(n)
        for c in children[n]:
            waits[c] -= 1
            if not waits[c]:
                heapq.heappush(ready, c)
    if len(order) < len(by):
        raise GraphError(f"models form a circle: {', '.join(sorted(by.keys() - set(order)))}")
    return Graph(by, tuple(order), {n: tuple(sorted(c)) for n, c in children.items()})
