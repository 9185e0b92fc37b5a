"""Errors that callers tell apart; each carries what a person needs to act on it."""

from __future__ import annotations

import re


class LoomError(Exception):
    """Any error of this library."""


class ModelError(LoomError):
    """A model's definition is wrong."""


class GraphError(LoomError):
    """Duplicate, unknown or circular models."""


class ContractError(LoomError):
    """A query's columns don't meet the declared schema; all deviations at once."""

    def __init__(self, model: str, problems: list[str]) -> None:
        super().__init__(f"{model}: " + "; ".join(problems))
        self.model, self.problems = model, problems


class AuditError(LoomError):
    def __init__(self, model: str, audit: str, violations: int, detail: str = "") -> None:
        super().__init__(f"{model}: audit {audit} found {violations} violation(s)" + (f" - {detail}" if detail else ""))
        self.model, self.audit, self.violations = model, audit, violations


class EngineError(LoomError):
    """A statement that Spark refused, with the statement; secrets are masked."""

    def __init__(self, statement: str, cause: BaseException, secrets: tuple[str, ...] = ()) -> None:
        super().__init__(mask(f"{str(cause).splitlines()[0] if str(cause) else type(cause).__name__}\nin: {statement}", secrets))


class LockError(LoomError):
    """Someone else holds the lock."""


class BlockedError(LoomError):
    """A tick met changes that a person has to apply."""

    def __init__(self, env: str, changes: list[str]) -> None:
        super().__init__(f"{env}: unapplied changes: {', '.join(changes)}")
        self.changes = changes


class ReclassifyError(LoomError):
    """An operator's verdict contradicts the query."""


class StateError(LoomError):
    """The state store is of another version, or doesn't know what was asked for."""


class UnavailableError(LoomError):
    """A feature whose driver or service isn't there."""


def mask(text: str, secrets: tuple[str, ...] = ()) -> str:
    """``text`` without the given secrets and without values that look like credentials."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(s, "***")
    return re.sub(r"(?i)\b(password|secret|token|access_key|secret_key)(\s*[=:]\s*)('[^']*'|\S+)", r"\1\2***", text)
