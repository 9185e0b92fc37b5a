"""The Spark side: a session with fixed settings, parsing, describing, and files that tables stand for."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..errors import EngineError, UnavailableError
from ..functions.types import literal, quote

#: The partition column of interval tables; views over them don't show it.
HIDDEN = "__interval"
#: Results must not depend on what a session happened to be set to.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.groupByAliases": "true"}
_VOLATILE = {"exprId", "origin", "jvmId", "resultId", "planId", "dataset_id"}


def session(app: str = "lakeloom", **conf: str) -> SparkSession:
    """A session with this library's settings; on a cluster the caller's own session is used instead."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see: the cluster's own (``spark.checkpoint.dir``); only where that is unset, as in tests, one of this machine."""
    import tempfile

    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise UnavailableError("spark.checkpoint.dir must name a folder that all executors see")
    return place or tempfile.mkdtemp(prefix="shared-")


def files_of(name: str) -> str:
    """The partitioned table under an interval table's view."""
    return f"{name[:-1]}__files`"


def interval_rows(name: str, columns: list[str], time_column: str, keys: tuple[str, str], bounds: tuple[str, str]) -> str:
    """The rows of an interval table within bounds: of the intervals' own directories, and of those for rows that came outside theirs."""
    t = quote(time_column)
    inside = f"({quote(HIDDEN)} >= {literal(keys[0])} AND {quote(HIDDEN)} < {literal(keys[1])} OR {quote(HIDDEN)} >= 'outside')"
    return f"(SELECT {', '.join(map(quote, columns))} FROM {files_of(name)} WHERE {inside} AND {t} >= {bounds[0]} AND {t} < {bounds[1]})"


class Engine:
    def __init__(self, spark: SparkSession, secrets: tuple[str, ...] = (), prepare: tuple[str, ...] = ()) -> None:
        self.spark, self.secrets = spark, secrets
        self._parser = spark._jsparkSession.sessionState().sqlParser()
        self._lock = threading.Lock()
        self._databases: set[str] = set()
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        for statement in prepare:
            self.execute(statement)

    def query(self, sql: str) -> DataFrame:
        try:
            return self.spark.sql(sql)
        except Exception as e:  # noqa: BLE001
            raise EngineError(sql, e, self.secrets) from None

    def execute(self, sql: str) -> None:
        self.query(sql)

    def describe(self, sql: str) -> StructType:
        """The columns of a query, by analysis alone."""
        return self.query(sql).schema

    @staticmethod
    def bytes_of(rows: DataFrame) -> int:
        """What Catalyst takes the rows' size to be."""
        return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    @property
    def dialect(self) -> str:
        return f"spark-{self.spark.version}"

    def canonical(self, sql: str) -> str:
        """The parse tree as JSON without positions and ids: equal for texts that differ in layout, comments and case of keywords."""
        try:
            with self._lock:
                raw = self._parser.parsePlan(sql).toJSON()
        except Exception as e:  # noqa: BLE001
            raise EngineError(sql, e, self.secrets) from None
        return json.dumps(json.loads(raw, object_hook=_stripped), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    # names
    def has_table(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def is_view(self, name: str) -> bool:
        return self.has_table(name) and self.spark.catalog.getTable(name).tableType == "VIEW"

    def create_database(self, name: str) -> None:
        if name not in self._databases:
            self.execute(f"CREATE DATABASE IF NOT EXISTS {quote(name)}")
            self._databases.add(name)

    def table_over(self, name: str, schema: StructType, location: str) -> None:
        """A table of Parquet files anywhere under ``location``, with just these columns; made anew or pointed there."""
        database = name.partition(".")[0].strip("`")
        self.create_database(database)
        columns = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        self.execute(f"DROP TABLE IF EXISTS {name}")
        self.execute(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true', pathGlobFilter '*.parquet') LOCATION '{location}'")

    def interval_table(self, name: str, schema: StructType, location: str, places: dict[str, str] | None = None) -> None:
        """A view over a table of directories, each a partition by a hidden column of its interval, so that a range of intervals opens only theirs. ``places``: the directories by interval; without,
        those below ``location``."""
        self.create_database(name.partition(".")[0].strip("`"))
        columns = ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        files = files_of(name)
        self.execute(f"DROP TABLE IF EXISTS {files}")
        self.execute(f"CREATE TABLE {files} ({columns}, {quote(HIDDEN)} STRING) USING parquet OPTIONS (pathGlobFilter '*.parquet') PARTITIONED BY ({quote(HIDDEN)}) LOCATION '{location}/_table'")
        self.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT {', '.join(quote(c) for c in schema.names)} FROM {files}")
        if places:
            self.add_intervals(name, list(places.items()))
            return
        keys = [(d.partition("=")[2], d) for d in self.directories(location) if d.startswith("interval=")]
        keys += [(f"outside-{d}", f"outside/{d}") for d in self.directories(f"{location}/outside")]
        self.add_intervals(name, [(k, f"{location}/{d}") for k, d in keys])

    def add_intervals(self, name: str, places: list[tuple[str, str]]) -> None:
        for i in range(0, len(places), 500):
            parts = " ".join(f"PARTITION ({quote(HIDDEN)} = {literal(k)}) LOCATION {literal(place)}" for k, place in places[i : i + 500])
            self.execute(f"ALTER TABLE {files_of(name)} ADD IF NOT EXISTS {parts}")

    def catalog_table(self, name: str, place: str, rows: DataFrame) -> None:
        """Rows as a table of a catalog, ``catalog.database.table``, made anew, under a view ``name``. In the session's own catalog it is a managed table."""
        catalog, database, table = place.split(".")
        if catalog == "spark_catalog":
            self.create_database(database)
            rows.write.mode("overwrite").saveAsTable(f"{database}.{table}")
        else:
            self.execute(f"CREATE NAMESPACE IF NOT EXISTS {quote(catalog)}.{quote(database)}")
            rows.writeTo(place).createOrReplace()
        self.create_database(name.partition(".")[0].strip("`"))
        self.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT {', '.join(quote(c) for c in rows.columns)} FROM {place}")

    def has_driver(self, url: str) -> bool:
        try:
            return self.spark._jvm.java.sql.DriverManager.getDriver(url) is not None
        except Exception:  # noqa: BLE001 - that is how JDBC says no
            return False

    def move_interval(self, name: str, key: str, place: str) -> None:
        """Readers see the interval's rows of before or those of the new directory."""
        self.execute(f"ALTER TABLE {files_of(name)} PARTITION ({quote(HIDDEN)} = {literal(key)}) SET LOCATION {literal(place)}")

    def directories(self, place: str) -> list[str]:
        fs, path = self._fs(place)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def drop_intervals(self, name: str, keys: list[str]) -> None:
        for i in range(0, len(keys), 500):
            parts = ", ".join(f"PARTITION ({quote(HIDDEN)} = {literal(k)})" for k in keys[i : i + 500])
            self.execute(f"ALTER TABLE {files_of(name)} DROP IF EXISTS {parts}")

    # files
    def _fs(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def exists(self, place: str) -> bool:
        fs, path = self._fs(place)
        return fs.exists(path)

    def delete(self, place: str) -> None:
        fs, path = self._fs(place)
        fs.delete(path, True)

    def mkdirs(self, place: str) -> None:
        fs, path = self._fs(place)
        fs.mkdirs(path)

    def move(self, a: str, b: str) -> None:
        """Put the directory ``a`` in the place of ``b``."""
        fs, src = self._fs(a)
        dst = self.spark._jvm.org.apache.hadoop.fs.Path(b)
        fs.mkdirs(dst.getParent())
        if fs.exists(dst):
            fs.delete(dst, True)
        if not fs.rename(src, dst):
            raise OSError(f"can't move {a} to {b}")

    def files(self, place: str, hidden: bool = False) -> list[tuple[str, int, int]]:
        """Path, bytes and time of change of each data file below ``place``, in order; with ``hidden`` also of those whose own names scans skip."""
        fs, path = self._fs(place)
        if not fs.exists(path):
            return []
        out, walk = [], fs.listFiles(path, True)
        while walk.hasNext():
            f = walk.next()
            name = f.getPath().toString().removeprefix("file:")
            parts = name[len(place.removeprefix("file:").rstrip("/")) :].strip("/").split("/")
            if not any(p.startswith(("_", ".")) for p in (parts[:-1] if hidden else parts)):
                out.append((name, f.getLen(), f.getModificationTime()))
        return sorted(out)

    def read_text(self, place: str) -> str:
        fs, path = self._fs(place)
        source = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write_text(self, place: str, text: str) -> None:
        """Write beside and rename, so that no reader sees a part."""
        fs, path = self._fs(place)
        jvm = self.spark._jvm
        beside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{path.getName()}.part")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(beside, path)


def _stripped(x: dict) -> dict:
    return {k: v for k, v in x.items() if k not in _VOLATILE}
