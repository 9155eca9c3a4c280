"""Places in an order, runs of equal rows and systematic samples, without bringing an order into one task.

Rows are dealt out by ranges of (partition, order), sorted where they are and written with their task and their place in
it. What tasks must know of each other is a table of chunks, one row per task and partition value: how many rows stand before,
and how a run goes on across the border. That table has as many rows as there are tasks, and is the only thing summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.common import cut_lineage


def _dealt(rows: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    """rows in ranges, written: _task, _at (rising by one within a task in the order asked for) and _none, the partition of all."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*partition, *order]
    ranged = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return cut_lineage(ranged.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"), F.lit(0).alias("_none")), "ranges")


def _chunks(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Per task and partition value: _first, the _at of its first row, _before, the rows in earlier tasks, and _n, all rows of the value."""
    each = dealt.groupBy("_task", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_task", *keys, "_first", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"), F.sum("_here").over(Window.partitionBy(*keys)).alias("_n"))


def _with(dealt: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """dealt with its chunk's columns; partition values may be null."""
    renamed = chunks.select(F.col("_task").alias("_task2"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in chunks.columns if c not in ("_task", *keys)])
    same = F.col("_task") == F.col("_task2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return dealt.join(renamed, same).drop("_task2", *[f"_key{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """rows with place, from 1 in the order asked for, and total, the rows of the partition; equal rows stand in any order."""
    dealt, keys = _dealt(rows, order, partition or []), partition or ["_none"]
    placed = _with(dealt, _chunks(dealt, keys), keys)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("place"), F.col("_n").alias("total"))


def runs(rows: DataFrame, order: list[str], key: list[str], partition: list[str]) -> DataFrame:
    """Gaps and islands: consecutive rows with equal keys share a run number, from 1 per partition."""
    dealt, keys = _dealt(rows, order, partition), partition or ["_none"]
    mark = F.struct(*[F.col(k) for k in key])
    chunk = Window.partitionBy("_task", *keys).orderBy("_at")
    changed = (F.row_number().over(chunk) > 1) & ~F.lag(mark).over(chunk).eqNullSafe(mark)
    local = cut_lineage(dealt.withColumn("_run", F.sum(F.when(changed, 1).otherwise(0)).over(chunk.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    each = local.groupBy("_task", *keys).agg(F.min_by(mark, "_at").alias("_head"), F.max_by(mark, "_at").alias("_tail"), F.max("_run").alias("_inner"))
    tasks = Window.partitionBy(*keys).orderBy("_task")
    # a run that crosses a border is not counted anew
    opens = F.when((F.row_number().over(tasks) > 1) & F.lag("_tail").over(tasks).eqNullSafe(F.col("_head")), 0).otherwise(1)
    opened = each.withColumn("_opens", opens)
    start = F.sum(F.col("_opens")).over(tasks.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_inner").over(tasks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stitched = _with(local, opened.select("_task", *keys, start.alias("_start")), keys)
    return stitched.select(*rows.columns, (F.col("_start") + F.col("_run")).alias("run"))


def systematic_sample(rows: DataFrame, order: list[str], size: int = 30, offset: int = 0, partition: list[str] | None = None) -> DataFrame:
    """Every n-th row, n = max(1, rows / size), from an offset on, size rows at most; per partition if given."""
    found = numbered(rows, order, partition)
    step, k = F.greatest(F.lit(1), F.floor(F.col("total") / size)), F.col("place") - 1 - offset
    return found.filter((k >= 0) & (k % step == 0) & (k / step < size)).select(*rows.columns)
