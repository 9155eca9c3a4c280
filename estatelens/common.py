"""What operators share: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session, as in tests, gets one of its own; on a
    cluster that is an error, as each machine would have a folder of that name."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="estatelens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone when the program ends
        pass


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor costs one step and not all before it."""
    path = f"{shared_folder(df.sparkSession)}/estatelens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """df written once in buckets by a column, so that joins on it leave the table where it is."""
    spark = df.sparkSession
    table = f"estatelens_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df.repartition(n, column).write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(table)
    atexit.register(_forget_table, spark, table, path)
    return spark.table(table)


def _forget_table(spark: SparkSession, table: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session may be gone when the program ends
        return
    _forget(spark, path)
