"""What the training-data operators share: reading the tables, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that are held as Python objects at a time.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names.

    Where none is set, a local session, as in tests, gets one of its own; on a cluster that is an error, as
    each machine would have a folder of that name.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="estatelens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch tables that stand, with their folders.
_STANDING: dict[int, tuple[DataFrame, str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session may be gone when the program ends
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks of the stages after the table, never the
    stages before it. The table goes away with dropped(), or when the program ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/estatelens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _STANDING[id(out)] = out, path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, column: str, order: list[str]) -> DataFrame:
    """As written(), in buckets by a column and sorted within them: joins on that column leave the table where it is."""
    spark = df.sparkSession
    table = f"estatelens_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{table}"
    df.write.format("parquet").bucketBy(buckets, column).sortBy(*order).option("path", path).saveAsTable(table)
    atexit.register(_forget, spark, table, path)
    return spark.table(table)


def _forget(spark: SparkSession, table: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session may be gone when the program ends
        return
    _delete(spark, path)


def dropped(table: DataFrame | None) -> None:
    """Delete a table that written() gave, once nothing that is still to run reads it."""
    if table is not None and id(table) in _STANDING:
        _, path = _STANDING.pop(id(table))
        _delete(table.sparkSession, path)


def text_slices(batches: Iterator[pa.RecordBatch], id_name: str = "doc_id", text_name: str = "text") -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts, SLICE_ROWS at a time; null texts are empty."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_name))
        texts = batch.column(batch.schema.get_field_index(text_name)).cast(pa.large_binary())
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield ids.slice(at, SLICE_ROWS).to_pylist(), [t or b"" for t in texts.slice(at, SLICE_ROWS).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Groups that one join may broadcast: as many as can each hold more than one in HOT_GROUPS of all rows.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows inner-joined with their groups (one row for each value of keys, with size, the number of its rows).

    Fewer than HOT_GROUPS groups can hold more than total / HOT_GROUPS rows each. These are broadcast, so their rows
    stay where they are and no large group meets in one task; the rest are joined by shuffling.
    """
    limit = max(1, total // HOT_GROUPS)
    named = [F.col(k).alias(f"_{k}") for k in keys]
    hot = groups.filter(F.col(size) > limit)
    marked = rows.join(F.broadcast(hot.select(*named, F.lit(True).alias("_hot"))), [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*[f"_{k}" for k in keys])
    large = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys)
    return large.unionByName(marked.filter("_hot is null").drop("_hot").join(groups.filter(F.col(size) <= limit), keys))
