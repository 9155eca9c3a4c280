"""A store whose ingests happen whole or not at all: data files first, then one manifest that names them.

An ingest writes its tables to folders of its own, which nobody reads yet, and then creates manifest number n + 1, which
lists every folder that is live. Creating that file fails if it is there already, so of two ingests at once one goes first and
the other takes the manifest anew. Readers follow the newest manifest; what a killed job left behind is in no manifest.

Tables: those of a scan are replaced with the scan; SHARED ones grow: insert-if-absent tables keep the first row of a key,
upsert tables the last. Manifests are as long as the store has scans.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of tables that scans share, by what happens to a key that is there already.
INSERT_IF_ABSENT = {"assets": "asset_id"}
UPSERT = {"systems": "system_name"}


class Taken(Exception):
    """Another ingest has created this manifest."""


def _files(spark: SparkSession, root: str) -> tuple:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, root: str) -> int:
    """The number of the newest manifest, 0 for a new store."""
    _, at, files = _files(spark, root)
    if not files.exists(at):
        return 0
    return max((int(s.getPath().getName().split(".")[0]) for s in files.listStatus(at) if s.getPath().getName().endswith(".json")), default=0)


def manifest(spark: SparkSession, root: str, number: int | None = None) -> list[dict]:
    """Live parts, in the order in which they came: table, scan_id (null for shared tables), path."""
    number = version(spark, root) if number is None else number
    return json.loads(spark.read.text(f"{root}/manifests/{number:010d}.json", wholetext=True).first()["value"]) if number else []


def _commit(spark: SparkSession, root: str, number: int, parts: list[dict]) -> None:
    jvm, at, files = _files(spark, root)
    files.mkdirs(at)
    whole, name = jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(at, f"{number:010d}.json")
    out = files.create(whole)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    if files.exists(name) or not files.rename(whole, name):
        files.delete(whole, False)
        raise Taken(f"manifest {number} is there already")


def read(spark: SparkSession, root: str, table: str, scan_id: str | None = None, number: int | None = None) -> DataFrame | None:
    """A table as the newest manifest (or an earlier one) has it, of one scan or of all; None if it has no part of it."""
    parts = [(k, p) for k, p in enumerate(manifest(spark, root, number)) if p["table"] == table and scan_id in (None, p["scan_id"])]
    if not parts:
        return None
    if table in UPSERT:
        order = F.element_at(F.create_map(*[F.lit(x) for k, p in parts for x in (p["path"].rpartition("/")[2], k)]), F.element_at(F.split(F.input_file_name(), "/"), -2))
        rows = spark.read.parquet(*[p["path"] for _, p in parts])
        return rows.withColumn("_order", order).groupBy(UPSERT[table]).agg(F.max_by(F.struct(*rows.columns), "_order").alias("r")).select("r.*")
    return spark.read.parquet(*[p["path"] for _, p in parts])


def ingest(spark: SparkSession, root: str, scan_id: str, tables: dict[str, DataFrame]) -> int:
    """Put a scan's tables in the store, all at once; the manifest's number. The same ingest again changes nothing that is read."""
    written = []
    for table, rows in tables.items():
        if table in INSERT_IF_ABSENT:
            known = read(spark, root, table)
            rows = rows.dropDuplicates([INSERT_IF_ABSENT[table]])
            rows = rows if known is None else rows.join(known.select(INSERT_IF_ABSENT[table]), INSERT_IF_ABSENT[table], "left_anti")
        path = f"{root}/data/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        written.append({"table": table, "scan_id": None if table in INSERT_IF_ABSENT or table in UPSERT else scan_id, "path": path})
    while True:
        number = version(spark, root)
        kept = [p for p in manifest(spark, root, number) if p["scan_id"] != scan_id]
        try:
            _commit(spark, root, number + 1, kept + written)
        except Taken:
            continue
        return number + 1
