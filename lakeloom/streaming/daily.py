"""Ticks as a stream: the nearest thing to streaming that plans by interval have.

New files of an append-only source trigger a tick through ``foreachBatch``; what is computed is decided by the ledger alone, so a batch that comes twice computes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import BlockedError
from ..plans.project import Project


def ticking(project: Project, env: str, source: DataFrame, checkpoint: str, *, now: Callable[[], int] | None = None, available_now: bool = True, blocked: Callable[[BlockedError], None] | None = None) -> StreamingQuery:
    """Start a query over a streaming ``source`` that runs ``env`` for each micro-batch with rows."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.isEmpty():
            return
        try:
            project.run(env, now=now() if now else None)
        except BlockedError as e:
            if blocked is None:
                raise
            blocked(e)

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
