"""A table partitioned by service date whose content changes in one step.

``<path>/files/write=<id>/service_date=<day>/`` holds what one write put there and is never changed again.  A version is a
small manifest, ``<path>/versions/<number>.json``: the schema, and for each day the write that holds it.  A write first
stores its files, then publishes the next manifest by renaming it into place, which fails where another writer was
first; that writer reads again and merges anew.  A reader takes the newest manifest, or a given one, and sees that
version whole, whatever is written meanwhile; a crash before the rename leaves the old version.  ``vacuum`` deletes
files that only versions no longer kept refer to.

A manifest has one entry per calendar day, so the driver holds days, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import workspace

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer kept publishing first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    fs, p = _fs(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version; None where there is no table."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        return None
    number = known[-1] if version is None else version
    fs, p = _fs(spark, f"{path}/versions/{number:012d}.json")
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {**json.loads(text), "version": number}


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> bool:
    """True where this writer's manifest became version ``number``."""
    fs, final = _fs(spark, f"{path}/versions/{number:012d}.json")
    fs.mkdirs(final.getParent())
    _, draft = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.exists(final) and fs.rename(draft, final):
        return True
    fs.delete(draft, False)
    return False


def _frame(spark: SparkSession, path: str, state: dict, days=None) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/files/write={w}/service_date={d}" for d, w in sorted(state["days"].items()) if days is None or d in days]
    if not folders:
        return spark.createDataFrame([], schema)
    read = StructType([*schema.fields]).add("write", "string")
    return spark.read.option("basePath", f"{path}/files").schema(read).parquet(*folders).select(*schema.names)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one that is still kept."""
    state = manifest(spark, path, version)
    if state is None:
        raise FileNotFoundError(f"no version {'' if version is None else f'{version} '}of a table at {path}")
    return _frame(spark, path, state)


def read_days(spark: SparkSession, path: str, state: dict, days) -> DataFrame:
    """The rows of some days (as the manifest names them) of the version that ``state`` is the manifest of."""
    return _frame(spark, path, state, set(days))


def change_days(spark: SparkSession, path: str, schema: StructType, touched: list, merge: Callable[[DataFrame], DataFrame], notes: dict | None = None) -> int:
    """Replaces the rows of the ``touched`` days by ``merge`` of their old rows; returns the new version's number.

    A day that ``merge`` leaves without rows leaves the table. ``notes`` are kept in the new manifest.
    """
    days = {NO_DAY if d is None else str(d) for d in touched}
    for _ in range(ATTEMPTS):
        old = manifest(spark, path) or {"schema": schema.jsonValue(), "days": {}, "version": 0}
        write = uuid.uuid4().hex
        folder = f"{path}/files/write={write}"
        with workspace(spark):
            rows = merge(_frame(spark, path, old, days)).select(*StructType.fromJson(old["schema"]).names)
            rows.hint("rebalance", F.col("service_date")).write.partitionBy("service_date").parquet(folder)
        fs, p = _fs(spark, folder)
        found = [s.getPath().getName().removeprefix("service_date=") for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()]
        if outside := set(found) - days:
            fs.delete(p, True)
            raise ValueError(f"rows of days that were not named: {sorted(outside)}")
        kept = {d: w for d, w in old["days"].items() if d not in days}
        number = old["version"] + 1
        if _publish(spark, path, number, {"schema": old["schema"], "days": {**kept, **dict.fromkeys(found, write)}, "notes": notes or {}}):
            return number
        fs.delete(p, True)
    raise Conflict(f"no version of {path} could be published in {ATTEMPTS} attempts")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the manifests before the ``keep`` newest, and files that none of those kept refers to.

    Not to be run beside a writer: its files belong to no version before it publishes.
    """
    known = versions(spark, path)
    for number in known[:-keep]:
        fs, p = _fs(spark, f"{path}/versions/{number:012d}.json")
        fs.delete(p, False)
    used = {(w, d) for v in known[-keep:] for d, w in manifest(spark, path, v)["days"].items()}
    fs, p = _fs(spark, f"{path}/files")
    for s in fs.listStatus(p) if fs.exists(p) else ():
        write = s.getPath().getName().removeprefix("write=")
        for part in fs.listStatus(s.getPath()):
            day = part.getPath().getName().removeprefix("service_date=")
            if part.isDirectory() and (write, day) not in used:
                fs.delete(part.getPath(), True)
        if not any(w == write for w, _ in used):
            fs.delete(s.getPath(), True)
