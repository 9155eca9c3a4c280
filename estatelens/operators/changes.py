"""What differs between scans, and whether a build may pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import dims

KINDS = ("APPEARED", "REMEDIATED", "REGRESSED", "IMPROVED", "RECLASSIFIED", "UNCHANGED")


def summary(occ: DataFrame) -> DataFrame:
    """What a diff needs of an occurrence."""
    reach = F.col("reachable") if "reachable" in occ.columns else F.lit(None).cast("boolean")
    return occ.select("occurrence_id", "asset_id", "system_id", F.struct("level", "confidence", reach.alias("reachable"), "n_evidence", "modalities").alias("s"))


def diff(before: DataFrame, after: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per occurrence of either scan: kind and reason of the change; the first rule that fits decides."""
    b, a = summary(before).withColumnRenamed("s", "before"), summary(after).withColumnRenamed("s", "after")
    both = b.select("occurrence_id", F.col("asset_id").alias("_ba"), F.col("system_id").alias("_bs"), "before").join(a, "occurrence_id", "full_outer")
    both = both.select("occurrence_id", F.coalesce("asset_id", "_ba").alias("asset_id"), F.coalesce("system_id", "_bs").alias("system_id"), "before", "after")
    both = both.join(assets.select("asset_id", "asset_name"), "asset_id", "left").withColumn("asset_name", F.coalesce("asset_name", "asset_id"))
    rank = lambda c: F.array_position(F.array(*map(F.lit, dims.LEVELS)), c)
    was, now = F.col("before.reachable"), F.col("after.reachable")
    delta = rank(F.col("after.level")) - rank(F.col("before.level"))
    fresh = F.array_sort(F.array_except("after.modalities", "before.modalities"))
    rules: list[tuple[Column, str, Column]] = [
        (F.col("before").isNull(), "APPEARED", F.lit("not present in the previous scan")),
        (F.col("after").isNull(), "REMEDIATED", F.lit("no longer found: the code changed, or the scan no longer reaches it")),
        (was.eqNullSafe(False) & now.eqNullSafe(True), "REGRESSED", F.lit("became reachable")),
        (was.eqNullSafe(True) & now.eqNullSafe(False), "IMPROVED", F.lit("no longer reachable")),
        (was.isNull() & now.isNotNull(), "RECLASSIFIED", F.lit("reachability analyzed for the first time")),
        (was.isNotNull() & now.isNull(), "RECLASSIFIED", F.lit("reachability verdict lost")),
        (delta > 0, "RECLASSIFIED", F.concat(F.lit("assertion rose "), F.col("before.level"), F.lit(" -> "), F.col("after.level"))),
        (delta < 0, "RECLASSIFIED", F.concat(F.lit("assertion fell "), F.col("before.level"), F.lit(" -> "), F.col("after.level"))),
        (F.size(fresh) > 0, "RECLASSIFIED", F.concat(F.lit("corroborated by a new modality: "), F.array_join(fresh, ", "))),
    ]
    kind, reason = F.lit("UNCHANGED"), F.lit("no material change")
    for when, name, why in reversed(rules):
        kind, reason = F.when(when, name).otherwise(kind), F.when(when, why).otherwise(reason)
    return both.withColumns({"kind": kind, "reason": reason})


def diff_counts(changes: DataFrame) -> DataFrame:
    """Rows per kind, zeros included."""
    kinds = changes.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return F.broadcast(kinds).join(changes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def blocking(rows: DataFrame, include_library_surface: bool = False) -> DataFrame:
    """Rows that may block a build: confirmed, reached, and not only as a library's surface unless asked."""
    ok = (F.col("level") == "CONFIRMED") & F.col("reachable").eqNullSafe(True)
    return rows.filter(ok if include_library_surface else ok & (F.col("reached_via") != "LIBRARY_SURFACE"))


def suppression_state(suppressions: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """suppressions with state: expired, stale (not in the scan) or live."""
    present = rows.select("occurrence_id").distinct().withColumn("_present", F.lit(True))
    state = F.when(F.col("expires_at") <= now, "expired").when(F.col("_present").isNull(), "stale").otherwise("live")
    return suppressions.join(present, "occurrence_id", "left").withColumn("state", state).drop("_present")


def valid_suppressions(suppressions: DataFrame, now: Column) -> DataFrame:
    """suppressions with problem: null, or why one is refused (a reason of 10 characters, 365 days at most)."""
    days = (F.unix_micros("expires_at") - F.unix_micros(now)) / 86_400_000_000
    problem = F.when(F.length("reason") < 10, "reason too short").when(days <= 0, "already expired").when(days > 365, "longer than 365 days")
    return suppressions.withColumn("problem", problem)


def gate(rows: DataFrame, accepted: DataFrame, suppressions: DataFrame, now: Column, include_library_surface: bool = False) -> DataFrame:
    """Outcome of each blocking row: suppressed, accepted or introduced. The build passes without introduced rows."""
    live = suppression_state(suppressions, rows, now).filter("state = 'live'").select("occurrence_id").distinct().withColumn("_live", F.lit(True))
    known = accepted.select("occurrence_id").distinct().withColumn("_known", F.lit(True))
    outcome = F.when(F.col("_live").isNotNull(), "suppressed").when(F.col("_known").isNotNull(), "accepted").otherwise("introduced")
    work = rows.filter(F.col("bucket").isin("confidentiality", "authenticity"))
    return blocking(work, include_library_surface).join(live, "occurrence_id", "left").join(known, "occurrence_id", "left").withColumn("outcome", outcome).drop("_live", "_known")


def resolved(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted occurrences that the scan no longer has."""
    return accepted.select("occurrence_id").distinct().join(rows, "occurrence_id", "left_anti")


def rebaseline(rows: DataFrame, suppressions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """A new baseline: accepted ids (blocking rows without live suppressions) and the suppressions that remain."""
    keep = suppressions.filter(F.col("expires_at") > now)
    work = rows.filter(F.col("bucket").isin("confidentiality", "authenticity"))
    return blocking(work).select("occurrence_id").distinct().join(keep, "occurrence_id", "left_anti"), keep
