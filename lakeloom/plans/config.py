"""A project's configuration is a Python module that defines ``config = Config(...)``; models come from it and from the files it names."""

from __future__ import annotations

import importlib.util
import sys
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import LoomError
from .engine import session
from .model import Model
from .project import Project

DEFAULT = "lakeloom_config.py"


@dataclass(frozen=True)
class Config:
    models: tuple[Model, ...] = ()
    discovery: tuple[str, ...] = ()
    lake: str = "lake"
    state: str = "lakeloom.state.sqlite"
    redacted: tuple[str, ...] = ()
    spark: dict[str, str] = field(default_factory=dict)
    prepare: tuple[str, ...] = ()
    secrets: tuple[str, ...] = ()
    workers: int = 4


def _module(path: Path):
    name = f"_lakeloom_{abs(hash(str(path)))}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        raise LoomError(f"{path} can't be loaded: {e}") from e
    return module


def discover(patterns: tuple[str, ...], root: Path) -> list[Model]:
    """Models bound to names in the files that match; a model that several files import is one, two models of a name are an error."""
    found: dict[str, tuple[Model, Path]] = {}
    for path in sorted({p for pattern in patterns for p in root.glob(pattern) if p.is_file()}):
        if path.suffix != ".py":
            continue
        for value in vars(_module(path.resolve())).values():
            if not isinstance(value, Model):
                continue
            other = found.get(value.name)
            if other and other[0] is not value and other[0] != value:
                raise LoomError(f"{value.name} is defined in {other[1].relative_to(root)} and in {path.relative_to(root)}")
            found.setdefault(value.name, (value, path))
    return [m for m, _ in found.values()]


def load(path: str | Path = DEFAULT) -> tuple[Config, Path]:
    p = Path(path).resolve()
    if not p.is_file():
        raise LoomError(f"there is no configuration at {p}")
    root = str(p.parent)
    if root not in sys.path:
        sys.path.insert(0, root)
    config = getattr(_module(p), "config", None)
    if not isinstance(config, Config):
        raise LoomError(f"{p} doesn't define config = Config(...)")
    return config, p.parent


def models_of(config: Config, root: Path) -> list[Model]:
    """Those listed, those discovered, and all that they refer to."""
    by: dict[str, Model] = {}
    todo = [*config.models, *discover(config.discovery, root)]
    while todo:
        m = todo.pop(0)
        if m.name in by:
            if by[m.name] is not m and by[m.name] != m:
                raise LoomError(f"{m.name} is defined twice")
            continue
        by[m.name] = m
        todo += m.models
    return list(by.values())


def open_project(path: str | Path = DEFAULT, spark: SparkSession | None = None) -> Project:
    config, root = load(path)

    def place(p: str) -> str:
        return p if "://" in p or Path(p).is_absolute() else str(root / p)

    return Project(
        spark or session(**config.spark), models_of(config, root), place(config.lake), place(config.state),
        redacted=config.redacted, workers=config.workers, prepare=config.prepare, secrets=config.secrets,
    )
