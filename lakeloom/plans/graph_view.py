"""The graph of models to look at: text, JSON and a page."""

from __future__ import annotations

import html
import json

from .graph import Graph


def layers(graph: Graph) -> list[list[str]]:
    """Models by the longest way from a source."""
    depth: dict[str, int] = {}
    for n in graph.order:
        depth[n] = 1 + max((depth[d] for d in graph.models[n].deps), default=-1)
    out: list[list[str]] = [[] for _ in range(1 + max(depth.values(), default=-1))]
    for n in graph.order:
        out[depth[n]].append(n)
    return out


def text(graph: Graph) -> str:
    return "\n".join(f"{n} [{graph.models[n].kind.tag}]" + (f" <- {', '.join(sorted(graph.models[n].deps))}" if graph.models[n].deps else "") for n in graph.order)


def to_json(graph: Graph) -> dict:
    return {"models": [{"name": n, "kind": graph.models[n].kind.tag, "deps": sorted(graph.models[n].deps)} for n in graph.order]}


def page(graph: Graph, title: str = "models") -> str:
    """One HTML file without anything from elsewhere: boxes in layers, curves between them, and what a box reads and feeds lit on hover."""
    wide, high, gap = 200, 40, 70
    at = {n: (20 + i * (wide + gap), 20 + j * (high + 20)) for i, layer in enumerate(layers(graph)) for j, n in enumerate(layer)}
    w = max((x for x, _ in at.values()), default=0) + wide + 20
    h = max((y for _, y in at.values()), default=0) + high + 20
    curves, boxes = [], []
    for n, (x, y) in at.items():
        m = graph.models[n]
        for d in sorted(m.deps):
            a, b = at[d][0] + wide, at[d][1] + high / 2
            curves.append(f'<path data-a="{html.escape(d)}" data-b="{html.escape(n)}" d="M{a} {b} C{a + gap / 2} {b} {x - gap / 2} {y + high / 2} {x} {y + high / 2}"/>')
        boxes.append(f'<g data-n="{html.escape(n)}"><title>{html.escape(m.description or n)}</title><rect x="{x}" y="{y}" width="{wide}" height="{high}" rx="6"/><text x="{x + 10}" y="{y + 17}">{html.escape(n)}</text><text class="k" x="{x + 10}" y="{y + 32}">{m.kind.tag}</text></g>')
    near = {n: sorted({n, *graph.ancestors(n), *graph.descendants(n)}) for n in graph.order}
    data = json.dumps(near).replace("<", "\\u003c")
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>body{{font:13px sans-serif;margin:0}}rect{{fill:#eef3f8;stroke:#57718a}}path{{fill:none;stroke:#9ab}}.k{{fill:#678;font-size:11px}}.dim{{opacity:.2}}</style>"
        f'<svg width="{w}" height="{h}">{"".join(curves)}{"".join(boxes)}</svg><script>const near={data};const all=[...document.querySelectorAll("g,path")];'
        'for(const g of document.querySelectorAll("g")){g.onmouseenter=()=>{const s=new Set(near[g.dataset.n]);for(const e of all)e.classList.toggle("dim",e.dataset.n?!s.has(e.dataset.n):!(s.has(e.dataset.a)&&s.has(e.dataset.b)))};g.onmouseleave=()=>all.forEach(e=>e.classList.remove("dim"))}</script>'
    )
