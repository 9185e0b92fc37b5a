"""External sources and seeds as catalog tables with declared schemas: no inference pass, and filters and columns reach the scan."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import UnavailableError
from ..functions.types import literal, quote
from ..plans.engine import Engine
from ..plans.model import Model, Seed, Source


def _columns(schema: StructType) -> str:
    return ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema.fields)


def _csv_schema(spark: SparkSession, place: str, schema: StructType) -> StructType:
    """The file's own columns in its order, with declared types; others are text. Reads one line."""
    from pyspark.sql import types as T

    header = spark.read.option("header", "true").csv(place).columns
    by = {f.name: f for f in schema.fields}
    return T.StructType([by.get(h, T.StructField(h, T.StringType())) for h in header])


def _is_array(spark: SparkSession, place: str) -> bool:
    first = spark.read.text(place).where("trim(value) <> ''").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def _options(spark: SparkSession, kind: str, place: str) -> dict[str, str]:
    if kind == "csv":
        return {"header": "true", "enforceSchema": "false", "emptyValue": "", "nullValue": ""}
    if kind == "json" and _is_array(spark, place):
        return {"multiLine": "true"}
    return {}


def external_table(engine: Engine, model: Model) -> str:
    """The name under which SQL reads an external model; a table for its files is made where there is none."""
    s: Source = model.kind.source
    if s.kind == "table":
        return s.place
    if re.match(r"(?i)(jdbc|postgres|duckdb|sqlite):", s.place):
        raise UnavailableError(f"{model.name}: no driver for {s.place.split(':')[0]} here")
    shape = hashlib.sha256(f"{s}{model.schema.json()}".encode()).hexdigest()[:8]
    name = f"`_ext`.`{model.namespace}__{model.table}__{shape}`"
    if engine.has_table(name):
        if s.hive_partitioning and any(c.isPartition for c in engine.spark.catalog.listColumns(name)):
            engine.execute(f"ALTER TABLE {name} RECOVER PARTITIONS")  # those that came since
        engine.execute(f"REFRESH TABLE {name}")
        return name
    engine.create_database("_ext")
    schema = _csv_schema(engine.spark, s.place, model.schema) if s.kind == "csv" else model.schema
    options = {"path": s.place} | _options(engine.spark, s.kind, s.place)
    parts: list[str] = []
    if s.kind == "parquet":
        if s.hive_partitioning:
            segments = {k for f, _, _ in engine.files(re.split(r"[*?\[{]", s.place)[0].rpartition("/")[0] or s.place) for k in re.findall(r"/([^/=]+)=[^/]*(?=/)", f)}
            parts = [f.name for f in schema.fields if f.name in segments]
        elif not re.search(r"[*?\[{]", s.place):
            options["recursiveFileLookup"] = "true"
    listed = ", ".join(f"{literal(k)} {literal(v)}" for k, v in options.items())
    partitioned = f" PARTITIONED BY ({', '.join(map(quote, parts))})" if parts else ""
    engine.execute(f"CREATE TABLE {name} ({_columns(schema)}) USING {s.kind} OPTIONS ({listed}){partitioned}")
    if parts:
        engine.execute(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def seed_rows(engine: Engine, model: Model) -> DataFrame:
    """A seed's rows with the declared columns and types."""
    kind: Seed = model.kind
    spark = engine.spark
    schema = _csv_schema(spark, kind.path, model.schema) if kind.format == "csv" else model.schema
    return spark.read.options(**_options(spark, kind.format, kind.path)).schema(schema).format(kind.format).load(kind.path)


def read_union_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files of several generations: columns by name, those that a generation lacks are null, and numbers widen."""
    from functools import reduce

    frames: dict[str, list[str]] = {}
    for p in paths:
        frames.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(*ps) for ps in frames.values()])
