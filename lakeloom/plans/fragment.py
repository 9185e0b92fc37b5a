"""Query templates.

A body is an ordinary f-string over a context: ``f"SELECT * FROM {c.ref(events)} WHERE ts >= {c.start}"``. The context's markers print as
private tokens, which :func:`parse` turns into a short list of nodes, so one body can be rendered with logical, canonical or physical names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import ModelError
from ..functions.types import literal, quote

_TOKEN = re.compile("\x02([a-z]+):([^\x03]*)\x03")
_RAW = re.compile(r"@ref\(\s*([A-Za-z_]\w*\.[A-Za-z_]\w*)\s*\)|@(start|end)\b")


@dataclass(frozen=True)
class Node:
    kind: str  # text, ref, window, bound, self
    value: str = ""


@dataclass(frozen=True)
class Fragment:
    nodes: tuple[Node, ...]

    @property
    def refs(self) -> list[str]:
        """Referenced models in order of first use."""
        return list(dict.fromkeys(n.value.partition(":")[0] for n in self.nodes if n.kind in ("ref", "window")))

    @property
    def bounded(self) -> bool:
        return any(n.kind in ("bound", "window") for n in self.nodes)

    @property
    def selfish(self) -> bool:
        return any(n.kind == "self" for n in self.nodes)

    def render(self, ref: Callable[[str], str], start: str = ":start", end: str = ":end", own: str | None = None, window: Callable[[str], str | None] = lambda name: None) -> str:
        """``window``: what stands for a model's rows in the bounds, if it isn't to be read whole and filtered."""
        out = []
        for n in self.nodes:
            if n.kind == "text":
                out.append(n.value)
            elif n.kind == "ref":
                out.append(ref(n.value))
            elif n.kind == "window":
                name, _, column = n.value.partition(":")
                out.append(window(name) or f"(SELECT * FROM {ref(name)} WHERE {quote(column)} >= {start} AND {quote(column)} < {end})")
            elif n.kind == "bound":
                out.append(start if n.value == "start" else end)
            elif own is None:
                raise ModelError("the model's own result can only be read in an audit")
            else:
                out.append(own)
        return "".join(out)


class Context:
    """What a body is given."""

    start = "\x02bound:start\x03"
    end = "\x02bound:end\x03"
    self = "\x02self:\x03"

    def __init__(self) -> None:
        self.models: dict[str, object] = {}

    def ref(self, model: object) -> str:
        """Another model, or its name."""
        name = model if isinstance(model, str) else model.name
        if not isinstance(model, str):
            self.models[name] = model
        return f"\x02ref:{name}\x03"

    def window(self, model: object) -> str:
        """The rows of a model incremental by time within this batch's bounds, of which only those intervals' directories are opened."""
        column = getattr(getattr(model, "kind", None), "time_column", None)
        if column is None:
            raise ModelError(f"{getattr(model, 'name', model)} isn't incremental by time, so it has no window")
        self.models[model.name] = model
        return f"\x02window:{model.name}:{column}\x03"

    def cols(self, model: object, *names: str) -> str:
        """Columns of a model, checked against its schema."""
        missing = [n for n in names if n not in model.columns]
        if missing:
            raise ModelError(f"{model.name} has no column {', '.join(missing)}")
        return ", ".join(map(quote, names))

    @staticmethod
    def lit(value: object) -> str:
        return literal(value)


def parse(text: str) -> Fragment:
    nodes, at = [], 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            nodes.append(Node("text", text[at : m.start()]))
        nodes.append(Node(m[1], m[2]))
        at = m.end()
    if at < len(text):
        nodes.append(Node("text", text[at:]))
    return Fragment(tuple(nodes))


def parse_file(text: str) -> Fragment:
    """The body of a ``.sql`` model: ``@ref(schema.table)``, ``@start`` and ``@end``."""

    def token(m: re.Match) -> str:
        return f"\x02ref:{m[1]}\x03" if m[1] else f"\x02bound:{m[2]}\x03"

    return parse(_RAW.sub(token, text))
