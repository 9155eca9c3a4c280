"""Validated intake: payloads are parsed permissively, every rule that a payload breaks is listed, and good and bad rows part.

A payload is one text. Parsing never fails a job: what is no JSON of the kind gets the code "unparseable", and all other rules
are asked of each payload, so a sender learns of all faults at once. Rules are columns; one pass finds and writes both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN = (
    "systemName string, startedAt string, finishedAt string, policyPackId string, secrecyYears double, assets array<struct<id:string,primitive:string>>, "
    "occurrences array<struct<id:string,assetId:string,confidence:double>>, _corrupt string"
)
#: Either kind of trace payload: a bundle of spans, or the OTLP layout.
TRACE = "spans array<struct<spanId:string,parentSpanId:string,service:string,operation:string>>, resourceSpans array<struct<resource:string>>, _corrupt string"
PACK = "packId string, packVersion string, crqcYear double, migrationYearsByControl map<string,double>, _corrupt string"


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def scan_rules(packs: list[str]) -> dict[str, Column]:
    """What a scan payload (column p) may break, by code."""
    began, ended = F.col("p.startedAt").try_cast("timestamp"), F.col("p.finishedAt").try_cast("timestamp")
    occurrences, assets = F.coalesce("p.occurrences", F.array().cast("array<struct<id:string,assetId:string,confidence:double>>")), F.coalesce(F.transform("p.assets", lambda a: a["id"]), F.array().cast("array<string>"))
    ids = F.transform(occurrences, lambda o: o["id"])
    return {
        "system_missing": _blank(F.col("p.systemName")),
        "started_at_invalid": began.isNull(),
        "ends_before_it_starts": F.coalesce(ended < began, F.lit(False)),
        "pack_unknown": ~F.coalesce(F.col("p.policyPackId").isin(*packs), F.lit(False)),
        "secrecy_out_of_range": F.coalesce((F.col("p.secrecyYears") < 0) | (F.col("p.secrecyYears") > 100), F.lit(False)),
        "confidence_out_of_range": F.exists(occurrences, lambda o: F.coalesce((o["confidence"] < 0) | (o["confidence"] > 1), F.lit(True))),
        "occurrence_repeated": F.size(F.array_distinct(ids)) < F.size(ids),
        "asset_undeclared": F.size(F.array_except(F.transform(occurrences, lambda o: o["assetId"]), assets)) > 0,
    }


def trace_rules() -> dict[str, Column]:
    """What a trace payload may break."""
    return {
        "kind_unknown": F.col("p.spans").isNull() & F.col("p.resourceSpans").isNull(),
        "span_without_id": F.coalesce(F.exists("p.spans", lambda s: _blank(s["spanId"]) | _blank(s["service"])), F.lit(False)),
    }


def pack_rules() -> dict[str, Column]:
    """What a policy pack may break."""
    return {
        "id_missing": _blank(F.col("p.packId")),
        "year_out_of_range": ~F.coalesce(F.col("p.crqcYear").between(2000, 2200), F.lit(False)),
        "migration_years_negative": F.coalesce(F.exists(F.map_values("p.migrationYearsByControl"), lambda y: y < 0), F.lit(False)),
    }


def checked(payloads: DataFrame, schema: str, rules: dict[str, Column], text: str = "payload") -> DataFrame:
    """payloads with p, what was parsed, and errors, the codes of all broken rules in the order of the rules; null payloads are unparseable."""
    parsed = payloads.withColumn("p", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col(text).isNull() | F.col("p._corrupt").isNotNull()
    found = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return parsed.withColumn("errors", F.when(broken, F.array(F.lit("unparseable"))).otherwise(found))


def parted(rows: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Checked rows written once under target, and read back as those without and those with errors."""
    rows.withColumn("valid", F.size("errors") == 0).write.mode("overwrite").partitionBy("valid").parquet(target)
    every = rows.sparkSession.read.schema(rows.drop("valid").schema.add("valid", "boolean")).parquet(target)
    return every.filter("valid").drop("valid", "errors"), every.filter("not valid").drop("valid")
