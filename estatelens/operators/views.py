"""Capability against deployment, coverage of an estate, vendor statements against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import dims
from estatelens.functions.assets import round_half_up


def answer(modalities: Column) -> Column:
    """What an occurrence's evidence says: DEPLOYED, CAPABLE, BOTH or NEITHER."""
    deployed, capable = F.exists(modalities, lambda m: m.isin(*dims.DEPLOYMENT)), F.exists(modalities, lambda m: m.isin(*dims.CAPABILITY))
    return F.when(deployed & capable, "BOTH").when(deployed, "DEPLOYED").when(capable, "CAPABLE").otherwise("NEITHER")


def asset_sides(occ: DataFrame) -> DataFrame:
    """Per system and asset: seen deployed, seen capable. Control classes merge."""
    a = answer(F.col("modalities"))
    return occ.withColumn("a", a).groupBy("system_id", "asset_id").agg(F.bool_or(F.col("a").isin("DEPLOYED", "BOTH")).alias("deployed"), F.bool_or(F.col("a").isin("CAPABLE", "BOTH")).alias("capable"))


def system_views(occ: DataFrame) -> DataFrame:
    """Per system: assets deployed, capable, only deployed, only capable, both."""
    d, c = F.col("deployed"), F.col("capable")
    return asset_sides(occ).groupBy("system_id").agg(
        F.count_if(d).alias("deployed"), F.count_if(c).alias("capable"), F.count_if(d & ~c).alias("deployed_only"), F.count_if(~d & c).alias("capable_only"), F.count_if(d & c).alias("corroborated")
    )


def divergences(occ: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that only one side shows, in systems that have both sides."""
    sides = asset_sides(occ)
    both = sides.groupBy("system_id").agg((F.bool_or("deployed") & F.bool_or("capable")).alias("ok")).filter("ok").select("system_id")
    kind = F.when(F.col("deployed") & ~F.col("capable"), "DEPLOYED_WITHOUT_SOURCE").when(F.col("capable") & ~F.col("deployed"), "CAPABLE_BUT_NOT_OBSERVED")
    found = sides.join(both, "system_id").withColumn("kind", kind).filter("kind is not null")
    return found.join(assets.select("asset_id", "asset_name"), "asset_id").select("system_id", "kind", "asset_id", "asset_name")


def coverage(occ: DataFrame) -> DataFrame:
    """Per class of estate: modalities seen, occurrences, assets, systems; zero rows for unexamined classes."""
    classes = dims.estate_classes(occ.sparkSession)
    seen = occ.select("occurrence_id", "asset_id", "system_id", F.explode("modalities").alias("modality")).join(F.broadcast(classes), "modality")
    # an occurrence counts once in a class: first one row per class and occurrence, then plain sums
    once = seen.groupBy("class", "occurrence_id", "asset_id", "system_id").agg(F.count("*").alias("_n"))
    counts = once.groupBy("class").agg(F.count("*").alias("occurrences"), F.countDistinct("asset_id").alias("assets"), F.countDistinct("system_id").alias("systems"))
    kinds = seen.groupBy("class").agg(F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"))
    every = classes.select("class").distinct()
    out = every.join(counts, "class", "left").join(kinds, "class", "left")
    return out.select("class", (F.coalesce("occurrences", F.lit(0)) > 0).alias("examined"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("occurrences", "assets", "systems")], F.coalesce("modalities", F.lit("")).alias("modalities"))


def coverage_statement(report: DataFrame) -> DataFrame:
    """One row: classes examined, and a sentence that names those that were not."""
    n, k = F.count_if("examined"), F.count("*")
    blind = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("examined"), F.col("class")))), ", ")
    text = F.concat(n.cast("string"), F.lit(" of "), k.cast("string"), F.lit(" estate classes examined"), F.when(n < k, F.concat(F.lit("; not examined: "), blind)).otherwise(""))
    return report.agg(n.alias("examined"), k.alias("classes"), text.alias("statement"))


def service_coverage(traced: DataFrame, scanned: DataFrame) -> DataFrame:
    """Services seen in traces against systems scanned: scanned, unscanned, scanned_without_traffic."""
    t, s = traced.select(F.col(traced.columns[0]).alias("service")).distinct(), scanned.select(F.col(scanned.columns[0]).alias("service")).distinct()
    both = t.withColumn("t", F.lit(True)).join(s.withColumn("s", F.lit(True)), "service", "full_outer")
    return both.select("service", F.when(F.col("t").isNull(), "scanned_without_traffic").when(F.col("s").isNull(), "unscanned").otherwise("scanned").alias("state"))


def reconcile(claims: DataFrame, found: DataFrame, assets: DataFrame) -> DataFrame:
    """Vendor claims (system_id, asset_id, roadmap) against what was observed in the vendor's system.

    Verdicts: CORROBORATED, CONTRADICTED_ROADMAP (an available roadmap, but a vulnerable asset on the
    recordable track is still seen), UNDISCLOSED, UNVERIFIED. Statements themselves are no observation.
    """
    systems = claims.select("system_id").distinct()
    seen = found.filter("modality <> 'ASSERTED'").join(systems, "system_id").groupBy("system_id", "asset_id").agg(F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("observed_by"))
    said = claims.groupBy("system_id", "asset_id").agg(F.bool_or(F.col("roadmap") == "available").alias("available"))
    roadmap = claims.groupBy("system_id").agg(F.bool_or(F.col("roadmap") == "available").alias("_available"))
    both = said.join(seen, ["system_id", "asset_id"], "full_outer").join(roadmap, "system_id").join(assets.select("asset_id", "quantum_vulnerable", "purpose"), "asset_id", "left")
    against = F.col("_available") & F.col("quantum_vulnerable") & F.col("purpose").isin(*dims.HARVESTABLE)
    verdict = F.when(F.col("observed_by").isNull(), "UNVERIFIED").when(F.col("available").isNull(), "UNDISCLOSED").when(against, "CONTRADICTED_ROADMAP").otherwise("CORROBORATED")
    return both.select("system_id", "asset_id", verdict.alias("verdict"), F.coalesce("observed_by", F.lit("")).alias("observed_by"))


def migration_estimate(status: Column, available_year: Column, hardware: Column, now_year: float, integration_years: float = 0.5) -> Column:
    """years and control_class of a vendor's roadmap: a stated date counts, anything else is no schedule."""
    more = F.when(hardware, 2.0).otherwise(0.0)
    wait = F.greatest(F.lit(0.0), round_half_up(available_year - now_year, 2))
    dated = (status == "available") | ((status == "committed") & available_year.isNotNull())
    years = F.when(status == "available", integration_years + more).when(dated, round_half_up(wait + integration_years + more, 2)).otherwise(6.0 + more)
    control = F.when(~dated, "VENDOR_LOCKED").when(hardware, "HARDWARE").otherwise("VENDOR_UPGRADEABLE")
    return F.struct(years.alias("years"), control.alias("control_class"))
