"""Findings and spans as streams.

Confidence and reach only rise with evidence, so late rows are safe: a tally may be updated at any time and
a verdict never has to be taken back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from estatelens.common import shared_folder
from estatelens.operators.evidence import identified
from estatelens.plans import synth


def edge_counts(spans: DataFrame, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Calls between services per window: a stream-stream join of spans with their parents.

    spans: span_id, parent_span_id, service, operation, ts. A parent is waited for as long as lateness.
    """
    child = spans.filter("parent_span_id <> ''").select(F.col("parent_span_id").alias("wanted"), F.col("service").alias("to_service"), F.col("ts").alias("child_ts")).withWatermark("child_ts", lateness)
    parent = spans.select(F.col("span_id").alias("found"), F.col("service").alias("from_service"), F.col("ts").alias("parent_ts")).withWatermark("parent_ts", lateness)
    pairs = child.join(parent, F.expr("wanted = found")).filter("from_service <> to_service")
    return pairs.groupBy(F.window("child_ts", window), "from_service", "to_service").agg(F.count("*").alias("observations"))


def tally(findings: DataFrame) -> DataFrame:
    """Observations per occurrence and modality, updated as findings arrive; the input of assembly."""
    return identified(findings).groupBy("occurrence_id", "modality").agg(F.count("*").alias("n"))


def start(df: DataFrame, sink: str, mode: str = "complete", once: bool = False) -> StreamingQuery:
    """Run a stream into an in-memory table, with its checkpoint in the shared folder."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(sink).option("checkpointLocation", f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}")
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_table(df: DataFrame, path: str, once: bool = True) -> StreamingQuery:
    """Run an append-mode stream into Parquet files."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def _source(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A Parquet file or folder as a stream, through the given expressions."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    return stream.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def _replayed(df: DataFrame) -> DataFrame:
    """The state of a stream after all that is there has been read, as a table of the shared folder."""
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/estatelens-replay-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    run = df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(target)


def replayed_tally(spark: SparkSession, path: str) -> DataFrame:
    """The streamed tally over all findings of a table."""
    return _replayed(tally(_source(spark, path, synth.FINDINGS)))


def replayed_edges(spark: SparkSession, path: str) -> DataFrame:
    """Streamed calls per day between services over all spans of a table.

    Parents are joined within the stream; the join's output is appended to a table, which is then counted.
    """
    spans = _source(spark, path, synth.SPANS)
    child = spans.filter("parent_span_id <> ''").select(F.col("parent_span_id").alias("wanted"), F.col("service").alias("to_service"), "ts")
    parent = spans.select(F.col("span_id").alias("found"), F.col("service").alias("from_service"))
    pairs = child.join(parent, F.expr("wanted = found")).filter("from_service <> to_service")
    target = f"{shared_folder(spark)}/estatelens-edges-{uuid.uuid4().hex}"
    start_table(pairs.select("from_service", "to_service", "ts"), target).awaitTermination()
    found = spark.read.schema("from_service string, to_service string, ts timestamp").parquet(target)
    return found.groupBy(F.date_trunc("day", "ts").alias("day"), "from_service", "to_service").agg(F.count("*").alias("observations"))
