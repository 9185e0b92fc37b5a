"""Models: what is to be built, and everything that can be wrong with a definition."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql.types import StructType

from ..errors import ModelError
from ..functions.types import quote, struct
from ..operators.audits import Audit
from .fragment import Context, Fragment, parse, parse_file
from .interval import GRAINS, millis

_NAME = re.compile(r"[A-Za-z_]\w*\.[A-Za-z_]\w*\Z")
ANSWERABLE = ("full", "sampled", "unobservable")


@dataclass(frozen=True)
class Full:
    tag = "full"


@dataclass(frozen=True)
class View:
    tag = "view"


@dataclass(frozen=True)
class Embedded:
    tag = "embedded"


@dataclass(frozen=True)
class TimeRange:
    """Incremental by time: intervals from ``start`` are filled, ``batch_size`` at a time; the last ``lookback`` are read again by every plan."""

    time_column: str
    start: str
    interval: str = "day"
    batch_size: int = 30
    lookback: int = 0
    tag = "incremental_by_time_range"


@dataclass(frozen=True)
class UniqueKey:
    key: tuple[str, ...]
    tag = "incremental_by_unique_key"

    def __init__(self, *key: str) -> None:
        object.__setattr__(self, "key", key)


@dataclass(frozen=True)
class ScdType2:
    key: tuple[str, ...]
    valid_from: str = "valid_from"
    valid_to: str = "valid_to"
    tag = "scd_type_2"


@dataclass(frozen=True)
class Source:
    """Where an external model's rows are: a table's name, or files."""

    kind: str  # table, parquet, csv, json
    place: str
    union_by_name: bool = False
    hive_partitioning: bool = False


@dataclass(frozen=True)
class External:
    source: Source
    tag = "external"


@dataclass(frozen=True)
class Seed:
    path: str
    tag = "seed"

    @property
    def format(self) -> str:
        return "json" if self.path.endswith(".json") else "csv"

    def digest(self) -> str:
        return hashlib.sha256(Path(self.path).read_bytes()).hexdigest()


Kind = Full | View | Embedded | TimeRange | UniqueKey | ScdType2 | External | Seed


@dataclass(frozen=True)
class Compaction:
    """How partitions of many files are merged. ``key`` and ``order`` dedupe; without ``key`` rows are only joined."""

    min_files: int = 2
    grace_hours: float = 24.0
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    partition: str = ""


@dataclass(frozen=True)
class Model:
    name: str
    kind: Kind
    schema: StructType
    body: Fragment | None = None
    deps: frozenset[str] = frozenset()
    grain: tuple[str, ...] = ()
    target: str = "table"
    audits: tuple[Audit, ...] = ()
    redact: tuple[str, ...] = ()
    answerable: str = "full"
    caveats: tuple[str, ...] = ()
    description: str = ""
    export: str | None = None
    compaction: Compaction | None = None
    models: tuple[Model, ...] = field(default=(), compare=False, repr=False)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def namespace(self) -> str:
        return self.name.partition(".")[0]

    @property
    def table(self) -> str:
        return self.name.partition(".")[2]

    @property
    def materialized(self) -> bool:
        return not isinstance(self.kind, (External, Embedded, View))


def _common(name: str, schema, redact: Sequence[str], grain: Sequence[str], answerable: str) -> StructType:
    if not _NAME.match(name):
        raise ModelError(f"{name!r}: a name is schema.table, of letters, digits and underscores")
    s = struct(schema)
    if not s.fields:
        raise ModelError(f"{name}: the schema is empty")
    if len({f.lower() for f in s.names}) < len(s.names):
        raise ModelError(f"{name}: columns repeat")
    for what, columns in (("redact", redact), ("grain", grain)):
        if missing := [c for c in columns if c not in s.names]:
            raise ModelError(f"{name}: {what} names unknown columns: {', '.join(missing)}")
    if set(redact) >= set(s.names):
        raise ModelError(f"{name}: redacting every column leaves nothing")
    if answerable not in ANSWERABLE:
        raise ModelError(f"{name}: answerable is one of {', '.join(ANSWERABLE)}")
    return s


def _check_kind(name: str, kind: Kind, schema: StructType, target: str) -> None:
    names = schema.names
    if isinstance(kind, (External, Seed)):
        raise ModelError(f"{name}: use external() or seed() for this kind")
    if target not in ("table", "parquet", "catalog"):
        raise ModelError(f"{name}: target is table, parquet or catalog")
    if isinstance(kind, (View, Embedded)) and target != "table":
        raise ModelError(f"{name}: a {kind.tag} has no files, so its target can't be {target}")
    if isinstance(kind, (UniqueKey, ScdType2)):
        if not kind.key:
            raise ModelError(f"{name}: the key is empty")
        if missing := [c for c in kind.key if c not in names]:
            raise ModelError(f"{name}: key columns aren't in the schema: {', '.join(missing)}")
        if target == "parquet":
            raise ModelError(f"{name}: {kind.tag} can't be kept as plain parquet")
    if isinstance(kind, ScdType2):
        a, b = kind.valid_from, kind.valid_to
        if a == b or a not in names or b not in names or {a, b} & set(kind.key):
            raise ModelError(f"{name}: valid_from and valid_to are two columns of the schema outside the key")
    if isinstance(kind, TimeRange):
        if kind.time_column not in names:
            raise ModelError(f"{name}: time column {kind.time_column} isn't in the schema")
        if kind.interval not in GRAINS:
            raise ModelError(f"{name}: interval is day or hour")
        if kind.batch_size < 1 or kind.lookback < 0:
            raise ModelError(f"{name}: batch_size is at least 1 and lookback not negative")
        try:
            millis(kind.start)
        except ValueError:
            raise ModelError(f"{name}: start {kind.start!r} isn't a time") from None


def _check_policy(name: str, policy: Compaction | None, schema: StructType) -> None:
    if policy is None:
        return
    if policy.min_files < 2 or policy.grace_hours < 0:
        raise ModelError(f"{name}: compaction takes at least 2 files and a grace that isn't negative")
    if missing := [c for c in (*policy.key, *policy.order) if c not in schema.names]:
        raise ModelError(f"{name}: compaction names unknown columns: {', '.join(missing)}")
    if policy.order and not policy.key:
        raise ModelError(f"{name}: compaction orders only what a key dedupes")


def _built(name: str, kind: Kind, schema: StructType, body: Fragment, target: str, models: dict, **more) -> Model:
    _check_kind(name, kind, schema, target)
    if body.bounded and not isinstance(kind, TimeRange):
        raise ModelError(f"{name}: bounds are only for models incremental by time")
    if body.selfish or name in body.refs:
        raise ModelError(f"{name}: a model can't read itself")
    policy = more.get("compaction")
    _check_policy(name, policy, schema)
    if policy and not (isinstance(kind, TimeRange) and target == "parquet"):
        raise ModelError(f"{name}: compaction is for parquet models incremental by time, and for external parquet")
    return Model(name, kind, schema, body, frozenset(body.refs), target=target, models=tuple(models.values()), **more)


def model(
    name: str, kind: Kind, schema, body: Callable[[Context], str], *, target: str = "table", audits: Sequence[Audit] = (), grain: Sequence[str] = (), redact: Sequence[str] = (),
    answerable: str = "full", caveats: Sequence[str] = (), description: str = "", export: str | None = None, compaction: Compaction | None = None,
) -> Model:
    """A model whose body is called once, here."""
    s = _common(name, schema, redact, grain, answerable)
    _check_kind(name, kind, s, target)
    context = Context()
    fragment = parse(body(context))
    return _built(name, kind, s, fragment, target, context.models, audits=tuple(audits), grain=tuple(grain), redact=tuple(redact), answerable=answerable, caveats=tuple(caveats), description=description, export=export, compaction=compaction)


def sql_model(name: str, kind: Kind, schema, path: str | Path, refs: Sequence[Model | str] = (), **more) -> Model:
    """A model whose body is a ``.sql`` file. The declared ``refs`` have to be those that the file uses."""
    s = _common(name, schema, more.get("redact", ()), more.get("grain", ()), more.get("answerable", "full"))
    fragment = parse_file(Path(path).read_text().strip().rstrip(";"))
    declared = {r if isinstance(r, str) else r.name: r for r in refs}
    if declared.keys() != set(fragment.refs):
        odd = sorted(declared.keys() ^ set(fragment.refs))
        raise ModelError(f"{name}: declared and used references differ: {', '.join(odd)}")
    target = more.pop("target", "table")
    more = {k: tuple(v) if isinstance(v, (list, tuple)) else v for k, v in more.items()}
    return _built(name, kind, s, fragment, target, {k: v for k, v in declared.items() if isinstance(v, Model)}, **more)


def table(name: str) -> Source:
    return Source("table", name)


def parquet(place: str, *, union_by_name: bool = False, hive_partitioning: bool = False) -> Source:
    return Source("parquet", place, union_by_name, hive_partitioning)


def csv(place: str) -> Source:
    return Source("csv", place)


def json(place: str) -> Source:
    return Source("json", place)


def external(name: str, source: Source, schema, *, audits: Sequence[Audit] = (), grain: Sequence[str] = (), answerable: str = "full", caveats: Sequence[str] = (), description: str = "", compaction: Compaction | None = None) -> Model:
    """Rows that something else writes. Their contents aren't part of any version."""
    s = _common(name, schema, (), grain, answerable)
    if source.kind not in ("table", "parquet", "csv", "json") or not source.place.strip():
        raise ModelError(f"{name}: a source is a table or files, with a place")
    if (source.union_by_name or source.hive_partitioning) and source.kind != "parquet":
        raise ModelError(f"{name}: union_by_name and hive_partitioning are for parquet")
    _check_policy(name, compaction, s)
    if compaction and (source.kind != "parquet" or not compaction.partition):
        raise ModelError(f"{name}: compaction of an external needs parquet and the partition column")
    return Model(name, External(source), s, grain=tuple(grain), audits=tuple(audits), answerable=answerable, caveats=tuple(caveats), description=description, compaction=compaction)


def seed(name: str, path: str | Path, schema, *, audits: Sequence[Audit] = (), grain: Sequence[str] = (), description: str = "", caveats: Sequence[str] = (), answerable: str = "full") -> Model:
    """A small csv or json file kept with the project; its content is part of the version."""
    s = _common(name, schema, (), grain, answerable)
    p = Path(path)
    if p.suffix not in (".csv", ".json"):
        raise ModelError(f"{name}: a seed is a .csv or .json file")
    if not p.is_file():
        raise ModelError(f"{name}: {p} isn't there")
    return Model(name, Seed(str(p)), s, grain=tuple(grain), audits=tuple(audits), description=description, answerable=answerable, caveats=tuple(caveats))


def projection(columns: Sequence[str]) -> str:
    return ", ".join(map(quote, columns))
