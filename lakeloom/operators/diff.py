"""What differs between two versions' rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bucket(key: Sequence[str], percent: float) -> Column:
    """Whether a row is in the sample: by a hash of its key, so that both sides sample the same keys."""
    most = max(1, min(255, int(256 * percent / 100)))
    return F.substring(F.md5(F.concat_ws("|", *[_c(k).cast("string") for k in key])), 1, 2) < f"{most:02x}"


def schema_drift(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"onlyInA": sorted(set(a.columns) - set(b.columns)), "onlyInB": sorted(set(b.columns) - set(a.columns))}


def compared(a: DataFrame, b: DataFrame, key: Sequence[str], percent: float | None = None) -> DataFrame:
    """One row: ``rows_a, rows_b, only_in_a, only_in_b, in_both`` and ``diff_<column>`` for each common column outside the key.

    One full outer join on the key. Null keys match nothing, and keys that repeat on both sides multiply, as in any join.
    """
    if percent is not None:
        a, b = a.where(bucket(key, percent)), b.where(bucket(key, percent))
    shared = [c for c in a.columns if c in b.columns and c not in key]
    left = a.select(*[_c(k).alias(f"k{i}") for i, k in enumerate(key)], *[_c(c).alias(f"a{i}") for i, c in enumerate(shared)], F.lit(True).alias("in_a"))
    right = b.select(*[_c(k).alias(f"k{i}") for i, k in enumerate(key)], *[_c(c).alias(f"b{i}") for i, c in enumerate(shared)], F.lit(True).alias("in_b"))
    both = left.join(right, [f"k{i}" for i in range(len(key))], "full_outer")
    have_a, have_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    counts = [F.count_if(have_a & ~have_b).alias("only_in_a"), F.count_if(have_b & ~have_a).alias("only_in_b"), F.count_if(have_a & have_b).alias("in_both")]
    return both.agg(*counts, *[F.count_if(have_a & have_b & ~F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))).alias(f"diff_{c}") for i, c in enumerate(shared)])


def data_diff(a: DataFrame, b: DataFrame, key: Sequence[str], percent: float | None = None) -> dict:
    """Counts of both sides in full, the comparison by key, and the drift of columns. Without a key only counts."""
    out: dict = {"rowsA": a.count(), "rowsB": b.count(), "schema": schema_drift(a, b)}
    if not key:
        return out
    if missing := [k for k in key if k not in a.columns or k not in b.columns]:
        return out | {"key": None, "reason": f"key columns are missing: {', '.join(missing)}"}
    r = compared(a, b, key, percent).first().asDict()
    changed = {k[5:]: v for k, v in r.items() if k.startswith("diff_") and v}
    return out | {"key": list(key), "onlyInA": r["only_in_a"], "onlyInB": r["only_in_b"], "inBoth": r["in_both"], "changed": changed, "sample": percent}


def env_diff(a: dict[str, str], b: dict[str, str]) -> dict:
    """Two environments' pointers."""
    return {
        "onlyInA": sorted(a.keys() - b.keys()),
        "onlyInB": sorted(b.keys() - a.keys()),
        "different": [{"model": n, "a": a[n][:8], "b": b[n][:8]} for n in sorted(a.keys() & b.keys()) if a[n] != b[n]],
        "same": sorted(n for n in a.keys() & b.keys() if a[n] == b[n]),
    }


def gaps(df: DataFrame, column: str, step: Column | int = 1) -> DataFrame:
    """Islands: ``covered_through, resumes_at`` for each hole in the distinct values of a column."""
    from pyspark.sql import Window

    v = df.select(_c(column).alias("value")).where("value is not null").distinct()
    before = F.lag("value").over(Window.orderBy("value"))
    return v.select(before.alias("covered_through"), F.col("value").alias("resumes_at")).where(F.col("resumes_at") > F.col("covered_through") + step)


def islands(df: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjacent intervals joined, for each key: a running count of breaks numbers the islands."""
    from pyspark.sql import Window

    w = Window.partitionBy(*[_c(k) for k in keys]).orderBy(_c(start))
    new = (F.lag(_c(end)).over(w).isNull() | (F.lag(_c(end)).over(w) != _c(start))).cast("int")
    numbered = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w))
    return numbered.groupBy(*[_c(k) for k in keys], "__island").agg(F.min(_c(start)).alias(start), F.max(_c(end)).alias(end)).drop("__island")


__all__ = ["bucket", "compared", "data_diff", "env_diff", "gaps", "islands", "schema_drift"]
