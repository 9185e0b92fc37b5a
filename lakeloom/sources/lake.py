"""Where versions are kept, what a consumer is told about them, and how one reads them without this library's state."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import LoomError
from ..plans.engine import Engine
from ..plans.interval import Interval, iso
from ..plans.model import Model

MANIFEST_VERSION = 1


def version_root(lake: str, name: str, fingerprint: str) -> str:
    schema, _, table = name.partition(".")
    return f"{lake.rstrip('/')}/{schema}/{table}/fp={fingerprint[:8]}"


def physical_name(name: str, fingerprint: str) -> str:
    schema, _, table = name.partition(".")
    return f"`_phys`.`{schema}__{table}__{fingerprint[:8]}`"


def view_name(env: str, name: str) -> str:
    """``prod`` has the schemas' own names, other environments theirs before them."""
    schema, _, table = name.partition(".")
    return f"`{schema if env == 'prod' else f'{env}__{schema}'}`.`{table}`"


def freshness(done: list[Interval], failed: int) -> dict:
    """From the ledger alone: through when there is no gap, the last interval, and how many failed."""
    done = sorted(done)
    through = None
    for i, part in enumerate(done):
        if i and part.start != done[i - 1].end:
            break
        through = part.end
    return {"contiguousThrough": iso(through) if through is not None else None, "latestInterval": iso(max(d.end for d in done)) if done else None, "failedIntervals": failed}


def write_manifest(engine: Engine, root: str, model: Model, fingerprint: str, fresh: dict, effective: dict | None = None) -> None:
    """``manifest.json`` beside a version's files, replaced as a whole."""
    base = root.removeprefix("file:").rstrip("/") + "/"
    document = {
        "manifestVersion": MANIFEST_VERSION,
        "model": model.name,
        "fingerprint": fingerprint,
        "generatedAt": iso(round(time.time() * 1000)),
        "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in model.schema.fields],
        "grain": list(model.grain),
        "answerable": model.answerable,
        "caveats": list(model.caveats),
        "freshness": fresh,
        **({"effective": effective} if effective else {}),
        "files": [{"path": p.removeprefix(base), "bytes": n} for p, n, _ in engine.files(root) if p.endswith(".parquet")],
    }
    engine.write_text(f"{root}/manifest.json", json.dumps(document, indent=2))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a manifest lists: of just those files, whatever else lies beside them."""
    from ..functions.types import struct

    text = Path(path).read_text() if Path(path).exists() else spark.read.text(path, wholetext=True).first()[0]
    doc = json.loads(text)
    if doc["manifestVersion"] > MANIFEST_VERSION:
        raise LoomError(f"{path} has manifest version {doc['manifestVersion']}; this library reads up to {MANIFEST_VERSION}")
    schema = struct({c["name"]: c["type"] for c in doc["columns"]})
    root = path.rpartition("/")[0]
    files = [f"{root}/{f['path']}" for f in doc["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*files)
