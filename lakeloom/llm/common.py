"""Shared helpers: safe temporary column names, durable intermediate tables, bounded caches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset one of our own serves a session of one machine, as in tests; on a cluster that is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        place = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables that :func:`stored` made; nothing may read them afterwards."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Arrow batches between the JVM and Python: rows are long, so their number doesn't bound a batch.
BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows, so that Python holds few texts at once; the session's Arrow batches are bounded in bytes likewise."""
    conf = df.sparkSession.conf
    bound = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m"))
    if not 0 < bound <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)

    owner = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # freed batches go back to the system
        _released(owner)
        return fn(sliced(batches))

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dictionary that computes what it misses, in two generations: at ``limit`` entries the dictionary becomes the older generation,
    whose entries come back when they are used, and the one before is dropped. So what is used often stays and a worker's memory is bounded.
    Dropping costs recomputation and never changes a result.
    """

    def __init__(self, compute: Callable, limit: int = 250_000) -> None:
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


_PER_PROCESS: dict = {}
_OWNER: list[str] = []


def _released(owner: str) -> None:
    """Workers outlive tasks: give back what another operator kept in this one."""
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        _PER_PROCESS.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def per_process(key, make: Callable):
    """What ``make`` returns, built once in a Python worker and kept between its tasks of one operator."""
    if key not in _PER_PROCESS:
        _PER_PROCESS.clear()
        _PER_PROCESS[key] = make()
    return _PER_PROCESS[key]
