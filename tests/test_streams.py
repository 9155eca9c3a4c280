"""Streams against batch results, whatever the batch cuts, and after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from estatelens.streaming import state

DAY = timedelta(days=1)
BEGAN = datetime(2024, 1, 1)


def events():
    """(occurrence_id, modality, until, arrived) rows in the order in which they arrive, suppressions that end among them."""
    rng, rows = random.Random(3), []
    for k in range(160):
        at = BEGAN + DAY * (k // 8)
        found = rng.random() < 0.8
        rows.append((f"o{rng.randrange(12)}", rng.choice(list(state._GROUP)) if found else None, None if found else at + DAY * rng.randrange(1, 25) + timedelta(hours=12), at))
    return rows


def batch_standing(rows):
    clock, want = max(r[3] for r in rows), {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        seen = [r[1] for r in mine if r[1]]
        want[key] = (len(seen), state.confidence(list(set(seen))), any(r[2] and r[2] > clock for r in mine))
    return want


SCHEMA = "occurrence_id string, modality string, until timestamp, arrived timestamp"


@pytest.mark.parametrize("slices", [1, 4])
def test_standing_equals_the_batch_whatever_the_cuts(spark, slices):
    rows = events()
    table = spark.createDataFrame([(*r, k * slices // len(rows)) for k, r in enumerate(rows)], f"{SCHEMA}, slice int")
    changes = state.replayed_standing(table, "slice")
    got = {r["occurrence_id"]: (r["n_evidence"], r["confidence"], r["suppressed"]) for r in state.latest(changes).collect()}
    assert got == batch_standing(rows)
    versions = changes.groupBy("occurrence_id").agg(F.count("*").alias("n"), F.max("version").alias("last"), F.count_distinct("version").alias("kinds")).collect()
    assert all(r["n"] == r["last"] == r["kinds"] for r in versions)


def test_standing_goes_on_after_a_restart(spark, tmp_path):
    rows, folder, target = events(), str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set(*state.ROCKSDB)
    try:
        for part in (rows[:70], rows[70:]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            state.run_to_table(state.standing_changes(spark.readStream.schema(SCHEMA).parquet(folder)), target)  # a new query over the same checkpoint
    finally:
        spark.conf.unset(state.ROCKSDB[0])
    got = {r["occurrence_id"]: (r["n_evidence"], r["confidence"], r["suppressed"]) for r in state.latest(spark.read.parquet(target)).collect()}
    assert got == batch_standing(rows)


def spans(spark):
    """Spans of three services over 40 days in slices of four days, some of them late."""
    rng, rows = random.Random(5), []
    for k in range(400):
        at = BEGAN + timedelta(hours=k * 2.4)
        late = rng.random() < 0.04
        rows.append((str(k), str(rng.randrange(max(0, k - 40), k + 1)) if k % 5 else "", f"s{rng.randrange(3)}", at, int(((at - BEGAN) / DAY + (9 if late else 0)) // 4)))
    return rows, spark.createDataFrame(rows, "span_id string, parent_span_id string, service string, ts timestamp, slice int")


def test_bounded_pairs_and_late_spans(spark):
    rows, table = spans(spark)
    found, late, held = state.replayed_pairs(table, "slice", "1 day", "2 days")
    newest, kept, missed = None, [], set()
    for s in sorted({r[4] for r in rows}):
        for r in (x for x in rows if x[4] == s):
            (kept.append(r) if newest is None or r[3] >= newest - DAY else missed.add(r[0]))
        newest = max([r[3] for r in rows if r[4] <= s])
    by_id = {r[0]: r for r in kept}
    want = sorted((by_id[r[1]][2], r[2], r[3]) for r in kept if r[1] in by_id and by_id[r[1]][2] != r[2] and by_id[r[1]][3] <= r[3] <= by_id[r[1]][3] + 2 * DAY)
    assert sorted(tuple(r) for r in found.select("from_service", "to_service", "ts").collect()) == want and len(want) > 20
    assert {r["span_id"] for r in late.collect()} == missed and missed
    # a join that forgot nothing would hold every span, once as child and once as parent
    assert max(held) < 0.5 * len(rows) and any(b < a for a, b in zip(held, held[1:], strict=False))


def test_lateness_is_decided_once_when_a_batch_is_run_again(spark, tmp_path):
    rows, table = spans(spark)
    folder, target = state.sliced(table, "slice", "again"), str(tmp_path / "parts")
    schema = table.drop("slice").schema
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    state.part_by_lateness(read(), target, "ts", "1 day").awaitTermination()
    count = lambda kind: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{target}/{kind}").count()
    before = count("on_time"), count("late")
    state.part_by_lateness(read(), target, "ts", "1 day").awaitTermination()
    assert (count("on_time"), count("late")) == before and sum(before) == len(rows)
