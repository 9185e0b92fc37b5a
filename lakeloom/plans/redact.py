"""Environments that must not show some columns get models without them.

The body is wrapped in a projection, so the version differs by construction; audits that read a redacted column go, and only those.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql.types import StructType

from .fragment import Fragment, Node
from .graph import Graph, build_graph
from .model import Model, projection


def redacted(model: Model) -> Model:
    if not model.redact or model.body is None:
        return model
    gone = set(model.redact)
    keep = [c for c in model.columns if c not in gone]
    body = Fragment((Node("text", f"SELECT {projection(keep)} FROM ("), *model.body.nodes, Node("text", ") AS redacted")))
    return replace(
        model,
        body=body,
        schema=StructType([f for f in model.schema.fields if f.name not in gone]),
        grain=() if gone & set(model.grain) else model.grain,
        audits=tuple(a for a in model.audits if not gone & set(a.columns) and not _mentions(a, gone)),
        redact=(),
    )


def _mentions(audit, gone: set[str]) -> bool:
    """A custom audit goes if its text holds a redacted name as a word."""
    import re

    if audit.columns:
        return False
    text = audit.sql("self")
    return any(re.search(rf"(?<!\w){re.escape(c)}(?!\w)", text) for c in gone)


def redact_graph(graph: Graph, environments: tuple[str, ...], env: str) -> Graph:
    """The graph as ``env`` sees it."""
    if env not in environments:
        return graph
    return build_graph([redacted(graph.models[n]) for n in graph.order])
