"""Audits: queries over a model's result that should return nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from ..errors import ModelError
from ..functions.types import literal, quote
from ..plans.fragment import Context, Fragment, parse

_OWN = Context.self


@dataclass(frozen=True)
class Audit:
    """``scope``: ``any``, ``interval`` (each batch alone) or ``whole`` (the whole table once all is built)."""

    name: str
    body: Fragment
    blocking: bool = True
    scope: str = "any"
    columns: tuple[str, ...] = ()
    gaps: bool = False

    def sql(self, own: str) -> str:
        """The violations, over the query or table ``own``."""
        return self.body.render(lambda r: r, own=own)

    def warn(self) -> Audit:
        return replace(self, blocking=False)

    def per_interval(self) -> Audit:
        return replace(self, scope="interval")

    def whole(self) -> Audit:
        return replace(self, scope="whole")

    def runs_in(self, scope: str) -> bool:
        return "any" in (self.scope, scope) or self.scope == scope


def not_null(column: str) -> Audit:
    return Audit(f"not_null({column})", parse(f"SELECT * FROM {_OWN} WHERE {quote(column)} IS NULL"), columns=(column,))


def unique(*columns: str) -> Audit:
    """Violations are groups of more than one row; nulls are one value."""
    if not columns:
        raise ModelError("unique needs a column")
    c = ", ".join(map(quote, columns))
    return Audit(f"unique({', '.join(columns)})", parse(f"SELECT {c}, count(*) AS copies FROM {_OWN} GROUP BY {c} HAVING count(*) > 1"), columns=columns)


def accepted(column: str, values: list) -> Audit:
    """Nulls pass."""
    if not values:
        raise ModelError("accepted needs a value")
    among = ", ".join(map(literal, values))
    return Audit(f"accepted({column})", parse(f"SELECT * FROM {_OWN} WHERE {quote(column)} IS NOT NULL AND {quote(column)} NOT IN ({among})"), columns=(column,))


def custom(name: str, body: Callable[[Context], str]) -> Audit:
    """Any query; ``c.self`` stands for the model's result."""
    fragment = parse(body(Context()))
    if not fragment.selfish:
        raise ModelError(f"audit {name} doesn't read the model's result")
    return Audit(name, fragment)


def assert_contiguous(column: str) -> Audit:
    """Whole numbers without holes. Distinct values are compared within ranges of 65,536, side by side; only the ranges' first and last values are ordered in one task."""
    c = quote(column)
    return Audit(
        f"contiguous({column})",
        parse(
            f"WITH __values AS (SELECT DISTINCT {c} AS value, floor({c} / 65536) AS part FROM {_OWN} WHERE {c} IS NOT NULL), "
            f"__parts AS (SELECT part, min(value) AS first, lag(max(value)) OVER (ORDER BY part) AS last FROM __values GROUP BY part), "
            f"__pairs AS (SELECT value, lag(value) OVER (PARTITION BY part ORDER BY value) AS before FROM __values UNION ALL SELECT first, last FROM __parts) "
            f"SELECT before AS covered_through, value AS resumes_at, value - before - 1 AS missing FROM __pairs WHERE value > before + 1 ORDER BY resumes_at"
        ),
        columns=(column,),
        gaps=True,
    )


def assert_no_gaps(column: str, grain: str = "day") -> Audit:
    """No empty hour or day between the first and the last."""
    if grain not in ("day", "hour"):
        raise ModelError("grain is day or hour")
    c, unit = quote(column), grain.upper()
    bucket = f"CAST(date_trunc('{unit}', {c}) AS TIMESTAMP_NTZ)"
    return Audit(
        f"no_gaps({column}, {grain})",
        parse(
            f"SELECT before AS covered_through, value AS resumes_at FROM (SELECT value, lag(value) OVER (ORDER BY value) AS before "
            f"FROM (SELECT DISTINCT {bucket} AS value FROM {_OWN} WHERE {c} IS NOT NULL)) WHERE value > before + INTERVAL '1' {unit} ORDER BY resumes_at"
        ),
        columns=(column,),
        gaps=True,
    )


def gap_sentence(rows: list, total: int | None = None) -> str:
    """What the rows of a gap audit say; the first gap in order, whatever order they come in. ``total``: how many there are, where only the first is given."""
    if not rows:
        return ""
    first, more = min(rows, key=lambda r: r["resumes_at"]), (total or len(rows)) - 1
    tail = f" (and {more} further gap{'s' * (more > 1)})" if more else ""
    return f"covered through {first['covered_through']}, resumes at {first['resumes_at']}{tail}"
