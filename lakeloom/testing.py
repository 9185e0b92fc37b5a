"""Unit tests of models: rows for what a model reads, and the rows it should give."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .errors import LoomError
from .functions.types import family, quote
from .plans.engine import Engine
from .plans.executor import contract_problems
from .plans.interval import millis, stamp
from .plans.model import Embedded, Model, TimeRange

Rows = Sequence[Mapping[str, object]]
_ACCEPTS = {"text": (str,), "numeric": (int, float), "boolean": (bool,)}


def _frame(spark: SparkSession, model: Model, rows: Rows):
    """Fixture rows with the model's types; columns left out are null, and values of a wrong family are refused."""
    names = set(model.columns)
    for r in rows:
        if odd := sorted(set(r) - names):
            raise LoomError(f"fixture of {model.name} has unknown columns: {', '.join(odd)}")
        for f in model.schema.fields:
            v, kind = r.get(f.name), family(f.dataType)
            if v is not None and kind in _ACCEPTS and (not isinstance(v, _ACCEPTS[kind]) or kind == "numeric" and isinstance(v, bool)):
                raise LoomError(f"fixture of {model.name}: {f.name} is {kind}, not {v!r}")
    text = StructType([StructField(f.name, StringType() if family(f.dataType) != "any" else f.dataType) for f in model.schema.fields])
    values = [tuple(None if (v := r.get(f.name)) is None else v if family(f.dataType) == "any" else str(v).lower() if isinstance(v, bool) else str(v) for f in model.schema.fields) for r in rows]
    df = spark.createDataFrame(values, text)
    return df.select(*[F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in model.schema.fields])


def check_model(spark: SparkSession, model: Model, given: Mapping[str, Rows], expect: Rows, *, start: str | None = None, end: str | None = None, ordered: bool = False) -> None:
    """Run the model's query over the given rows and compare, as a multiset unless ``ordered``. Embedded parents may be left out; they're inlined."""
    engine = Engine(spark)
    views: dict[str, str] = {}
    known = {m.name: m for m in _all(model)}

    def ref(name: str) -> str:
        if name not in given:
            m = known.get(name)
            if m is not None and isinstance(m.kind, Embedded):
                return f"({m.body.render(ref)})"
            raise LoomError(f"{model.name} reads {name}, and there are no rows for it")
        if name not in views:
            views[name] = f"_fixture_{uuid.uuid4().hex}"
            _frame(spark, known[name], given[name]).createOrReplaceTempView(views[name])
        return views[name]

    if isinstance(model.kind, TimeRange) and (start is None or end is None):
        raise LoomError(f"{model.name} is incremental by time: give start and end")
    bounds = [stamp(millis(x)) for x in (start or 0, end or 0)]
    try:
        sql = model.body.render(ref, *bounds)
        if odd := sorted(given.keys() - views.keys()):
            raise LoomError(f"{model.name} doesn't read {', '.join(odd)}")
        df = engine.query(sql)
        if problems := contract_problems(model.schema, df.schema):
            raise LoomError(f"{model.name}: {'; '.join(problems)}")
        conform = [F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in model.schema.fields]
        got = [tuple(r) for r in df.select(*conform).collect()]
        want = [tuple(r) for r in _frame(spark, model, expect).collect()]
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)
    if ordered and got != want:
        raise AssertionError(f"{model.name}: expected {want}, got {got}")
    missing, extra = Counter(map(repr, want)) - Counter(map(repr, got)), Counter(map(repr, got)) - Counter(map(repr, want))
    if missing or extra:
        raise AssertionError(f"{model.name}: missing {list(missing.elements())}, unexpected {list(extra.elements())}")


def _all(model: Model) -> list[Model]:
    return [model, *[x for m in model.models for x in _all(m)]]
