"""Worklists: ranking by slack under a policy, re-ranking, headline, tickets, display packages, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.common import cut_lineage
from estatelens.functions.assets import round_half_up
from estatelens.functions.mosca import PolicyPack, score


def ranked(occ: DataFrame, assets: DataFrame, pack: PolicyPack, now_year: float, secrecy_years: float | Column = 5.0, overrides: DataFrame | None = None) -> DataFrame:
    """Worklist rows of the vulnerable occurrences, in buckets.

    occ may have reachable (nullable) and via; without them everything counts as unanalysed. Buckets:
    hints (only suspected), unreached (reachable is false), else confidentiality or authenticity; a null
    verdict is worked on. overrides: control_class, migration_years and, if given, system_id.
    """
    rows = occ if "reachable" in occ.columns else occ.withColumns({"reachable": F.lit(None).cast("boolean"), "via": F.lit(None).cast("string")})
    rows = rows.join(assets.filter("quantum_vulnerable").select("asset_id", "asset_name", "primitive", "purpose", "track"), "asset_id")
    years = None
    if overrides is not None:
        rows = rows.join(overrides, [c for c in ("system_id", "control_class") if c in overrides.columns], "left")
        years = F.col("migration_years")
    rows = rows.withColumn("s", score(F.col("track"), F.col("control_class"), pack, now_year, secrecy_years, years))
    bucket = F.when(F.col("level") == "SUSPECTED", "hints").when(F.col("reachable").eqNullSafe(False), "unreached").otherwise(F.lower("track"))
    return rows.select(
        "occurrence_id", "asset_id", "asset_name", "system_id", "control_class", "track", "level", "confidence", "reachable",
        F.coalesce("via", F.lit("UNANALYZED")).alias("reached_via"), bucket.alias("bucket"), "s.*", F.lit(f"{pack.pack_id}@{pack.pack_version}").alias("pack"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Ranked rows with place, the rank in the bucket by rounded slack and occurrence id.

    No bucket is sorted in one task: a row's place is the number of rows with less slack (a running sum
    over the few distinct slacks) plus its place among rows of equal slack, which a prefix of the id (a
    hash) splits further.
    """
    rows = cut_lineage(rows, "ranked")  # read twice below
    head = F.substring("occurrence_id", 1, 2)
    cells = rows.withColumn("_head", head).groupBy("bucket", "slack_years", "_head").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("slack_years", "_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("bucket", "slack_years", "_head").orderBy("occurrence_id"))
    counted = rows.withColumn("_head", head).withColumn("_inside", inside).join(cells.withColumn("_before", before).drop("_n"), ["bucket", "slack_years", "_head"])
    return counted.withColumn("place", F.col("_before") + F.col("_inside")).drop("_head", "_before", "_inside")


def headline(rows: DataFrame) -> DataFrame:
    """One row over what is worked on: rows, late and confirmed, and their shares (0 without rows)."""
    n, late, sure = F.count_if(F.col("bucket").isin("confidentiality", "authenticity")), F.count_if(F.col("bucket").isin("confidentiality", "authenticity") & F.col("late")), F.count_if(F.col("bucket").isin("confidentiality", "authenticity") & (F.col("level") == "CONFIRMED"))
    share = lambda x: F.coalesce(F.floor(F.try_divide(x, n) * 1e4 + 0.5) / 1e4, F.lit(0.0))
    return rows.agg(n.alias("working"), late.alias("late"), sure.alias("confirmed"), share(late).alias("late_share"), share(sure).alias("confirmed_share"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose slack or binding constraint differs between two rankings of the same occurrences."""
    work = F.col("bucket").isin("confidentiality", "authenticity")
    b = before.filter(work).select("occurrence_id", F.col("slack_years").alias("slack_before"), F.col("binding").alias("binding_before"))
    a = after.filter(work).select("occurrence_id", "bucket", "asset_name", "system_id", F.col("slack_years").alias("slack_after"), F.col("binding").alias("binding_after"))
    changed = (F.col("slack_before") != F.col("slack_after")) | (F.col("binding_before") != F.col("binding_after"))
    return a.join(b, "occurrence_id").filter(changed)


def tickets(rows: DataFrame, limit: int = 25) -> DataFrame:
    """The first confirmed rows of both tracks, confidentiality first; the limit (1 to 200) is the report's."""
    order = F.when(F.col("bucket") == "confidentiality", 0).otherwise(1)
    found = rows.filter((F.col("level") == "CONFIRMED") & F.col("bucket").isin("confidentiality", "authenticity"))
    title = F.concat(F.lit("Replace "), F.col("asset_name"), F.lit(" in "), F.col("system_id"))
    out = found.select("occurrence_id", "bucket", order.alias("track_order"), "slack_years", "late", title.alias("title"))
    return out.orderBy("track_order", "slack_years", "occurrence_id").limit(max(1, min(200, limit)))


def labelled(rows: DataFrame) -> DataFrame:
    """Ranked rows with what a person reads: due (years early or late) and driver (which date binds)."""
    years = F.format_number(F.abs("slack_years"), 1)
    due = F.when(F.col("late"), F.concat(F.lit("late by "), years, F.lit(" years"))).otherwise(F.concat(F.lit("due in "), years, F.lit(" years")))
    driver = F.when(F.col("binding") == "REGULATORY", "a fixed deadline").when(F.col("x") > 0, "data recorded today must stay secret").otherwise("the assumed arrival of quantum computers")
    return rows.withColumns({"due": due, "driver": driver})


def overdue_by_control(rows: DataFrame) -> DataFrame:
    """Late rows that are worked on, per control class."""
    return rows.filter(F.col("late") & F.col("bucket").isin("confidentiality", "authenticity")).groupBy("control_class").agg(F.count("*").alias("overdue"))


def confirmed_overdue_by_control(rows: DataFrame) -> DataFrame:
    """Late and confirmed rows that are worked on, per control class."""
    return overdue_by_control(rows.filter("level = 'CONFIRMED'"))


def domain_years(rows: DataFrame) -> DataFrame:
    """One row: the whole years that a common time axis of the worklists needs, 6 at least.

    It holds the longest work and secrecy and the farthest of all deadlines, so that bars of different rows compare.
    """
    work = rows.filter(F.col("bucket").isin("confidentiality", "authenticity"))
    spans = (F.col("x") + F.col("y"), F.col("crqc_slack") + F.col("x") + F.col("y"), F.col("regulatory_slack") + F.col("y"))
    return work.agg(F.ceil(F.greatest(F.lit(6.0), *[F.max(round_half_up(s, 2)) for s in spans])).cast("long").alias("domain_years"))


def tallies(rows: DataFrame) -> DataFrame:
    """One row: all rows found, the confirmed and the confirmed and late of each track, and those worked on that are not confirmed."""
    sure = F.col("level") == "CONFIRMED"
    counts = [F.count("*").alias("found"), F.count_if(F.col("bucket").isin("confidentiality", "authenticity") & ~sure).alias("observed_only")]
    for track in ("confidentiality", "authenticity"):
        own = (F.col("bucket") == track) & sure
        counts += [F.count_if(own).alias(f"{track}_confirmed"), F.count_if(own & F.col("late")).alias(f"{track}_late")]
    return rows.agg(*counts)
