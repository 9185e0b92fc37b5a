"""Type families of the schema contract, SQL literals and quoting."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re

from pyspark.sql import types as T

FAMILIES = ("text", "boolean", "numeric", "temporal", "any")


def family(kind: T.DataType) -> str:
    """The family that the contract compares; nested and other types are ``any``, which never deviates."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "any"


_NAMES = {
    "string": T.StringType, "boolean": T.BooleanType, "tinyint": T.ByteType, "byte": T.ByteType, "smallint": T.ShortType, "short": T.ShortType, "int": T.IntegerType, "integer": T.IntegerType,
    "bigint": T.LongType, "long": T.LongType, "float": T.FloatType, "real": T.FloatType, "double": T.DoubleType, "date": T.DateType, "binary": T.BinaryType, "void": T.NullType, "variant": T.VariantType,
    "timestamp": T.TimestampNTZType, "timestamp_ntz": T.TimestampNTZType, "timestamp_ltz": T.TimestampType,
}


def _pieces(text: str) -> list[str]:
    """Parts between commas that no bracket or quote holds."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "`":
            quoted = not quoted
        elif not quoted:
            depth += (c in "<(") - (c in ">)")
            if c == "," and not depth:
                out.append(text[at:i])
                at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def data_type(text: str) -> T.DataType:
    """A type by its SQL name, without a session. Instants have no zone, as sessions are in UTC."""
    low = text.strip().lower()
    if low in _NAMES:
        return _NAMES[low]()
    if m := re.fullmatch(r"(?:decimal|numeric|dec)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", low):
        return T.DecimalType(int(m[1] or 10), int(m[2] or 0))
    if m := re.fullmatch(r"(varchar|char)\s*\(\s*(\d+)\s*\)", low):
        return (T.VarcharType if m[1] == "varchar" else T.CharType)(int(m[2]))
    if m := re.fullmatch(r"(array|map|struct)\s*<(.*)>", text.strip(), re.S | re.I):
        inner = _pieces(m[2])
        if m[1].lower() == "array" and len(inner) == 1:
            return T.ArrayType(data_type(inner[0]))
        if m[1].lower() == "map" and len(inner) == 2:
            return T.MapType(*map(data_type, inner))
        if m[1].lower() == "struct":
            return T.StructType([_field(p) for p in inner])
    raise ValueError(f"unknown type {text!r}")


def _field(text: str) -> T.StructField:
    m = re.fullmatch(r"(?:`((?:[^`]|``)+)`|([^\s:`]+))\s*[\s:]\s*(.+)", text.strip(), re.S)
    if not m:
        raise ValueError(f"{text!r} isn't a column and its type")
    return T.StructField(m[1].replace("``", "`") if m[1] else m[2], data_type(m[3]))


def struct(schema: T.StructType | str | dict[str, str]) -> T.StructType:
    """A schema from a struct type, a DDL text, or column names and types."""
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, dict):
        return T.StructType([T.StructField(k, data_type(v)) for k, v in schema.items()])
    return T.StructType([_field(p) for p in _pieces(schema)])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    """A Python scalar as a SQL literal; the same text for the same value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{value} can't be a SQL literal")
        return repr(value) + ("" if "e" in repr(value) else "D")
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ'{value.replace(tzinfo=None).isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    raise TypeError(f"{type(value).__name__} can't be a SQL literal")
