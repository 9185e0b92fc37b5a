"""Half-open time intervals of a day or an hour, in milliseconds since the epoch, UTC."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from typing import NamedTuple

GRAINS = {"day": 86_400_000, "hour": 3_600_000}


class Interval(NamedTuple):
    start: int
    end: int


def millis(value: str | int | dt.datetime) -> int:
    """An ISO text, a datetime (UTC unless it says otherwise) or milliseconds, as milliseconds."""
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return round(value.timestamp() * 1000)


def moment(ms: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


def iso(ms: int) -> str:
    return moment(ms).isoformat(timespec="milliseconds") + "Z"


def stamp(ms: int) -> str:
    """As a literal of Spark SQL."""
    return f"TIMESTAMP_NTZ'{moment(ms).isoformat(sep=' ', timespec='milliseconds')}'"


def floor_to(grain: str, ms: int) -> int:
    return ms // GRAINS[grain] * GRAINS[grain]


def enumerate_intervals(grain: str, start: int, now: int) -> list[Interval]:
    """The complete intervals from the one that holds ``start`` to before the one that holds ``now``."""
    step = GRAINS[grain]
    return [Interval(a, a + step) for a in range(floor_to(grain, start), floor_to(grain, now), step)]


def missing_intervals(wanted: Iterable[Interval], done: Iterable[Interval]) -> list[Interval]:
    have = {d.start for d in done}
    return [w for w in wanted if w.start not in have]


def merge_intervals(parts: Iterable[Interval]) -> list[Interval]:
    """Adjacent intervals joined; the input is sorted and doesn't overlap."""
    out: list[Interval] = []
    for p in parts:
        if out and out[-1].end == p.start:
            out[-1] = Interval(out[-1].start, p.end)
        else:
            out.append(Interval(*p))
    return out


def intervals_within(grain: str, whole: Interval) -> list[Interval]:
    step = GRAINS[grain]
    return [Interval(a, min(a + step, whole.end)) for a in range(whole.start, whole.end, step)]


def split_into_batches(grain: str, whole: Interval, size: int) -> list[Interval]:
    if size < 1:
        raise ValueError("a batch holds at least one interval")
    step = GRAINS[grain] * size
    return [Interval(a, min(a + step, whole.end)) for a in range(whole.start, whole.end, step)]


def partition_key(grain: str, start: int) -> str:
    """``2026-01-31`` or ``2026-01-31T05``."""
    return moment(start).strftime("%Y-%m-%d" if grain == "day" else "%Y-%m-%dT%H")
