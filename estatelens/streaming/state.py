"""Streams whose state is bounded: span pairs within an interval, and the standing of each occurrence.

Span pairs. A stream of spans is first parted into those on time and those late, by one rule that a replay repeats exactly: a
span is late if it is older than the newest span of earlier batches by more than the lateness. Late spans go to a table of their
own, with what they missed. Spans on time are joined with their parents under a watermark and an interval condition,
so Spark evicts spans that can no longer meet a partner.

Standing of occurrences. Keyed state holds, per occurrence, how often each modality was seen and until when it is
suppressed; a timer ends the suppression. Each batch gives one row for every occurrence that changed, numbered per
occurrence: the last ones are what a batch job over all rows gives, however the stream was cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from estatelens.common import shared_folder
from estatelens.functions import dims

_MARKS = "batch long, newest timestamp"


def _rewritten(rows: DataFrame, folder: str, batch: int) -> None:
    """A batch's rows in a folder of its own; a batch that is run again writes the same folder again."""
    rows.write.mode("overwrite").parquet(f"{folder}/of={batch:010d}")


def part_by_lateness(spans: DataFrame, target: str, time: str, lateness: str, each: str = "1 second", once: bool = True) -> StreamingQuery:
    """Run a stream into target/on_time and target/late, by batch; late rows carry horizon, the time they came after."""

    def split(rows: DataFrame, batch: int) -> None:
        earlier = rows.sparkSession.read.schema(_MARKS).parquet(f"{target}/marks").filter(F.col("batch") < batch) if batch else None
        newest = F.lit(earlier.agg(F.max("newest")).first()[0] if earlier is not None else None).cast("timestamp")
        horizon = newest - F.expr(f"INTERVAL {lateness}")
        is_late = F.coalesce(F.col(time) < horizon, F.lit(False))
        kept = rows.persist()
        _rewritten(kept.filter(~is_late), f"{target}/on_time", batch)
        _rewritten(kept.filter(is_late).withColumn("horizon", horizon), f"{target}/late", batch)
        _rewritten(kept.agg(F.max(time).alias("newest")).select(F.lit(batch).cast("long").alias("batch"), "newest"), f"{target}/marks", batch)
        kept.unpersist()

    writer = spans.writeStream.foreachBatch(split).option("checkpointLocation", f"{target}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=each)).start()


def bounded_pairs(spans: DataFrame, lateness: str, within: str) -> DataFrame:
    """Pairs of a span and its parent of another service, at most within apart: from_service, to_service, ts of the child.

    spans: span_id, parent_span_id, service, ts. State is evicted once the watermark has passed what could still match.
    """
    child = spans.filter("parent_span_id <> ''").select(F.col("parent_span_id").alias("wanted"), F.col("service").alias("to_service"), F.col("ts").alias("child_ts")).withWatermark("child_ts", lateness)
    parent = spans.select(F.col("span_id").alias("found"), F.col("service").alias("from_service"), F.col("ts").alias("parent_ts")).withWatermark("parent_ts", lateness)
    near = F.expr(f"wanted = found AND child_ts >= parent_ts AND child_ts <= parent_ts + INTERVAL {within}")
    return child.join(parent, near).filter("from_service <> to_service").select("from_service", "to_service", F.col("child_ts").alias("ts"))


def run_to_table(df: DataFrame, target: str) -> StreamingQuery:
    """Run an append-mode stream over all that is there into Parquet files, and give the ended query with its progress."""
    run = df.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def sliced(rows: DataFrame, by: str, name: str) -> str:
    """rows written in files that arrive one after another, in the order of a column of slices; gives the folder."""
    folder = f"{shared_folder(rows.sparkSession)}/estatelens-{name}-{uuid.uuid4().hex}"
    for x in sorted(r[0] for r in rows.select(by).distinct().collect()):  # one row a slice
        rows.filter(F.col(by) == x).drop(by).coalesce(1).write.mode("append").parquet(folder)
    return folder


def replayed_pairs(spans: DataFrame, slices: str, lateness: str, within: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Pairs and late spans of a table of spans that arrives in slices, and the rows of state after each batch of the join."""
    spark = spans.sparkSession
    folder, target = sliced(spans, slices, "arrivals"), f"{shared_folder(spark)}/estatelens-pairs-{uuid.uuid4().hex}"
    schema = spans.drop(slices).schema
    part_by_lateness(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), target, "ts", lateness).awaitTermination()
    on_time = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/on_time")
    run = run_to_table(bounded_pairs(on_time.select(*schema.fieldNames()), lateness, within), f"{target}/pairs")
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in run.recentProgress]
    found = spark.read.schema("from_service string, to_service string, ts timestamp").parquet(f"{target}/pairs")
    late = spark.read.schema(schema.add("horizon", "timestamp")).option("recursiveFileLookup", "true").parquet(f"{target}/late")
    return found, late, held


_STANDING = "occurrence_id string, version long, n_evidence long, confidence double, suppressed boolean"
_GROUP = {m[0]: m[2] for m in dims.MODALITIES}
_CEILING = {m[0]: m[1] for m in dims.MODALITIES}


def confidence(modalities: list[str]) -> float:
    """1 - product over independence groups of (1 - the group's highest ceiling), to 4 places."""
    best: dict[int, float] = {}
    for m in modalities:
        best[_GROUP[m]] = max(best.get(_GROUP[m], 0.0), _CEILING[m])
    miss = 1.0
    for g in range(dims.GROUPS):
        miss *= 1.0 - best.get(g, 0.0)
    return int((1.0 - miss) * 1e4 + 0.5) / 1e4


class Standing(StatefulProcessor):
    """Per occurrence: a count for each modality (13 at most), the end of its suppression, and how many rows it has given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "modality string", "n long")
        self.standing = handle.getValueState("standing", "until long, version long")

    def _row(self, key: tuple, until: int, version: int) -> pd.DataFrame:
        self.standing.update((until, version))
        seen = {k[0]: v[0] for k, v in self.counts.iterator()}
        return pd.DataFrame({"occurrence_id": [key[0]], "version": [version], "n_evidence": [sum(seen.values())], "confidence": [confidence(list(seen))], "suppressed": [until > 0]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, version = self.standing.get() if self.standing.exists() else (0, 0)
        before, now = until, timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for modality, n in batch["modality"].dropna().value_counts().items():
                held = self.counts.getValue((modality,)) if self.counts.containsKey((modality,)) else None
                self.counts.updateValue((modality,), ((held[0] if held else 0) + int(n),))
            ends = batch["until"].dropna()
            if len(ends):
                until = max(until, int(ends.max().timestamp() * 1000))
        if until and until <= now:
            until = 0
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            if until:
                self.handle.registerTimer(until)
        yield self._row(key, until, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, version = self.standing.get()
        if until and until <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, 0, version + 1)

    def close(self) -> None:
        pass


def standing_changes(events: DataFrame, lateness: str = "1 second") -> DataFrame:
    """Changes of each occurrence's standing, as a stream.

    events: occurrence_id, modality (of a finding, else null), until (of a suppression, else null), arrived (when the row came
    in, which is the clock that ends suppressions). Rows must not come in more than lateness after newer ones, which Spark
    would drop; batches may share a time of arrival. The session needs the RocksDB state store.
    """
    timed = events.select("occurrence_id", "modality", "until", "arrived").withWatermark("arrived", lateness)
    return timed.groupBy("occurrence_id").transformWithStateInPandas(Standing(), _STANDING, "append", "EventTime")


#: The state store that keyed state needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed_standing(events: DataFrame, slices: str) -> DataFrame:
    """The changes over a table of events that arrives in slices."""
    spark = events.sparkSession
    folder, target = sliced(events, slices, "events"), f"{shared_folder(spark)}/estatelens-standing-{uuid.uuid4().hex}"
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        run_to_table(standing_changes(spark.readStream.schema(events.drop(slices).schema).option("maxFilesPerTrigger", 1).parquet(folder)), target)
    finally:
        spark.conf.set(ROCKSDB[0], before) if before else spark.conf.unset(ROCKSDB[0])
    return spark.read.schema(_STANDING).parquet(target)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each occurrence."""
    return changes.groupBy("occurrence_id").agg(F.max_by(F.struct("n_evidence", "confidence", "suppressed"), "version").alias("s")).select("occurrence_id", "s.*")
