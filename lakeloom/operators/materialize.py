"""How kinds change what they hold, as DataFrames: old rows and the query's rows in, new rows out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def conformed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[_c(c) for c in columns])


def upsert(held: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``held`` whose key isn't among ``rows``, and all of ``rows``. A null in a key equals nothing, so such rows are added each time."""
    rows = conformed(rows, held.columns)
    keys = rows.select(*[_c(k) for k in key]).where(reduce(lambda a, b: a & b, [_c(k).isNotNull() for k in key])).distinct()
    return held.join(keys, list(key), "left_anti").select(*[_c(c) for c in held.columns]).unionByName(rows)


def scd2(held: DataFrame, rows: DataFrame, valid_from: str, valid_to: str, now: Column) -> DataFrame:
    """Reconcile versions: open rows that the query no longer gives are closed at ``now``, those it gives stay, and rows that it gives and none is open for are opened at ``now``.

    Rows are compared as wholes, nulls being equal; each comparison is one hash-partitioned semi or anti join.
    """
    data = [c for c in held.columns if c not in (valid_from, valid_to)]
    given = rows.select(*[_c(c) for c in data])
    closed, open_ = held.where(_c(valid_to).isNotNull()), held.where(_c(valid_to).isNull())
    wanted = given.distinct().alias("w")
    o = open_.alias("o")
    match = reduce(lambda x, y: x & y, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"w.`{c}`")) for c in data])
    stay = o.join(wanted, match, "left_semi")
    end = o.join(wanted, match, "left_anti").withColumn(valid_to, now.cast(held.schema[valid_to].dataType))
    g, known = given.alias("w"), open_.select(*[_c(c) for c in data]).distinct().alias("o")
    new = g.join(known, match, "left_anti").withColumn(valid_from, now.cast(held.schema[valid_from].dataType)).withColumn(valid_to, F.lit(None).cast(held.schema[valid_to].dataType))
    return closed.unionByName(stay.select(*held.columns)).unionByName(end.select(*held.columns)).unionByName(new.select(*held.columns))


def scd2_changes(held: DataFrame, rows: DataFrame, valid_from: str, valid_to: str) -> DataFrame:
    """The data columns of rows that :func:`scd2` would close or open: those that one side alone has. Nulls are equal."""
    data = [c for c in held.columns if c not in (valid_from, valid_to)]
    sides = held.where(_c(valid_to).isNull()).select(*[_c(c) for c in data], F.lit(1).alias("__side")).unionByName(rows.select(*[_c(c) for c in data], F.lit(2).alias("__side")))
    one = sides.groupBy(*[_c(c) for c in data]).agg(F.bit_or("__side").alias("__side"))
    return one.where("__side <> 3").select(*[_c(c) for c in data])


def range_replaced(held: DataFrame, rows: DataFrame, time_column: str, start: Column, end: Column) -> DataFrame:
    """``held`` outside ``[start, end)`` and rows without a time, with ``rows``."""
    t = _c(time_column)
    return held.where(t.isNull() | (t < start) | (t >= end)).unionByName(conformed(rows, held.columns))


def dedupe_latest(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the first by ``order`` ascending with nulls last. Null keys are one group."""
    from pyspark.sql import Window

    by = [_c(c).asc_nulls_last() for c in (order or key)]
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*[_c(k) for k in key]).orderBy(*by))).where(F.col(rank) == 1).drop(rank)
