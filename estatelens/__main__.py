"""Command line: python -m estatelens COMMAND ..., over tables and files that Spark reads.

scan writes the tables of a scan below --out (findings, occurrences, assets, worklists, skipped) and prints the
headline; the other commands read them from there. Exit code 1: a gate that fails, a signature that does not hold.
"""

from __future__ import annotations

import argparse
import datetime
import os
import secrets
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.common import cut_lineage
from estatelens.functions.assets import decimal_year
from estatelens.functions.mosca import PACKS
from estatelens.operators import changes, export, intake, ledger, ranking, signing, store
from estatelens.plans import commands
from estatelens.sources import inventories

TABLES = ("findings", "occurrences", "assets", "worklists", "skipped")


def _session() -> SparkSession:
    return SparkSession.builder.appName("estatelens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/{name}")


def _now(a: argparse.Namespace) -> Column:
    return F.lit(a.now).cast("timestamp") if a.now else F.current_timestamp()


def _say(rows: DataFrame, a: argparse.Namespace) -> None:
    """A report as a table, or as one JSON object a line."""
    if a.json:
        for line in rows.toJSON().toLocalIterator():
            print(line)
    else:
        rows.show(1000, truncate=False)


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    spans = commands.load_traces(spark, a.traces) if a.traces else None
    entries = spark.createDataFrame([(x,) for x in a.entry], "file string") if a.entry else None
    result = commands.scan(commands.read_tree(spark, a.root), a.system, PACKS[a.pack], _now(a), a.secrecy_years, a.include_dev, spans=spans, with_binaries=not a.no_binaries, own_entries=entries)
    for name in TABLES:
        getattr(result, name).write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
    result.headline.show(truncate=False)
    export.report_lines(_read(spark, a.out, "occurrences")).show(truncate=False)
    return 0


def worklist(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _read(spark, a.out, "worklists").filter(F.col("bucket") == a.bucket).orderBy("place")
    rows.select("place", "asset_name", "system_id", "slack_years", "reached_via", "occurrence_id").show(a.rows, truncate=False)
    return 0


def ci(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _read(spark, a.out, "worklists")
    none = spark.createDataFrame([], "occurrence_id string, expires_at timestamp, reason string")
    accepted = spark.read.json(a.accepted, schema="occurrence_id string") if a.accepted else none.select("occurrence_id")
    suppressed = spark.read.json(a.suppressions, schema=none.schema) if a.suppressions else none
    outcomes = changes.gate(rows, accepted, suppressed, _now(a), a.library_surface)
    _say(export.gate_report(outcomes), a)
    if a.update_baseline:
        outcomes.filter("outcome in ('introduced', 'accepted')").select("occurrence_id").distinct().write.mode("overwrite").json(a.update_baseline)
    return 0 if outcomes.filter("outcome = 'introduced'").isEmpty() else 1


def bill(spark: SparkSession, a: argparse.Namespace) -> int:
    stamp = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pack = PACKS[a.pack]
    of = (_read(spark, a.out, "occurrences"), _read(spark, a.out, "assets"))
    if a.shards:
        export.write_document(*of, a.to, f"{pack.pack_id}@{pack.pack_version}", stamp, a.profile, a.include_suspected).show(truncate=False)
        return 0
    body = export.document(*of, f"{pack.pack_id}@{pack.pack_version}", stamp, a.profile, a.include_suspected)
    (export.signed(body, a.key) if a.key else body).write.mode("overwrite").json(a.to)
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = export.verified(spark.read.json(a.artifact), a.key)
    rows.groupBy("valid").count().show()
    return 0 if rows.filter("not valid").isEmpty() else 1


def coverage(spark: SparkSession, a: argparse.Namespace) -> int:
    said = commands.coverage_attestation(_read(spark, a.out, "occurrences"))
    if a.key:
        with open(a.secret) as f:
            commands.sign_with(a.key, f.read().strip(), said.withColumnRenamed("digest", "report_digest")).write.mode("overwrite").json(a.to)
    _say(said.drop("body"), a)
    return 0


def verify_coverage(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = "statement string, body string, digest string, key_id string, leaf long, chains array<string>, path array<string>"
    rows = signing.checked(spark.read.schema(schema).json(a.artifact), commands.public_keys(spark, *a.trusted), _now(a))
    _say(rows.select("statement", "key_id", "verdict"), a)
    return 0 if rows.filter("verdict <> 'OK'").isEmpty() else 1


def keygen(spark: SparkSession, a: argparse.Namespace) -> int:
    secret = secrets.token_hex(32)
    with open(os.open(a.secret, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        f.write(secret)
    commands.new_key(spark, a.key.rstrip("/"), secret, a.key_id, a.height, _now(a) + F.make_dt_interval(F.lit(a.days)))
    return 0


def attest(spark: SparkSession, a: argparse.Namespace) -> int:
    statements = spark.read.schema(inventories.ATTESTATION_SCHEMA).json(a.statements)
    year = spark.range(1).select(decimal_year(_now(a), 2).alias("y")).first()["y"]
    verdicts, estimates = commands.attest(statements, commands.Scan(*[_read(spark, a.out, n) for n in TABLES[:4]], None, None), year)
    _say(export.reconcile_report(verdicts), a)
    _say(estimates.orderBy("vendor", "system_id"), a)
    return 0 if verdicts.filter("verdict = 'CONTRADICTED_ROADMAP'").isEmpty() else 1


def estate(spark: SparkSession, a: argparse.Namespace) -> int:
    occ = commands.newest(ledger.read(spark, a.store, "occurrences"), ledger.read(spark, a.store, "systems"))
    year = spark.range(1).select(decimal_year(_now(a), 2).alias("y")).first()["y"]
    rows = cut_lineage(ranking.placed(ranking.ranked(occ, ledger.read(spark, a.store, "assets").dropDuplicates(["asset_id"]), PACKS[a.pack], year, a.secrecy_years)), "estate")
    for report in (ranking.headline(rows), ranking.tallies(rows), ranking.domain_years(rows), ranking.confirmed_overdue_by_control(rows).orderBy(F.desc("overdue"), "control_class")):
        _say(report, a)
    return 0


def policies(spark: SparkSession, a: argparse.Namespace) -> int:
    _say(spark.createDataFrame([(p.pack_id, p.pack_version, p.crqc_year) for p in commands.packs()], "pack_id string, pack_version string, crqc_year double"), a)
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    kinds = {"scan": (intake.SCAN, intake.scan_rules(sorted(PACKS))), "trace": (intake.TRACE, intake.trace_rules()), "pack": (intake.PACK, intake.pack_rules())}
    rows = intake.checked(spark.read.text(a.payloads).toDF("payload"), *kinds[a.kind])
    faults = rows.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("payloads")).orderBy("error")
    _say(faults, a)
    return 0 if faults.isEmpty() else 1


def keep(spark: SparkSession, a: argparse.Namespace) -> int:
    occ = _read(spark, a.out, "occurrences")
    system = occ.select(F.col("system_id").alias("system_name"), F.lit(a.scan_id).alias("last_scan_id")).distinct()
    number = ledger.ingest(spark, a.store, a.scan_id, {"occurrences": occ.withColumn("scan_id", F.lit(a.scan_id)), "assets": _read(spark, a.out, "assets"), "systems": system})
    print(f"manifest {number}")
    return 0


def probe_plan(spark: SparkSession, a: argparse.Namespace) -> int:
    grant = spark.read.json(a.grant, schema="target string, ports array<int>, not_before timestamp, not_after timestamp")
    plan = commands.probe_plan(spark.read.text(a.targets).toDF("target"), grant, F.current_timestamp(), a.skew)
    plan.show(1000, truncate=False)
    export.plan_report(plan).show(truncate=False)
    return 0


def token(spark: SparkSession, a: argparse.Namespace) -> int:
    made = (secrets.token_hex(6), secrets.token_hex(24))
    one = spark.range(1).select(store.mint_token(*map(F.lit, made)).alias("token"), F.lit(made[0]).alias("token_id"), store.token_digest(F.lit(made[1])).alias("digest"))
    one.show(truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="estatelens", description="An inventory of cryptography.")
    sub = top.add_subparsers(dest="command", required=True)

    def add(run, *options: tuple) -> None:
        p = sub.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        for name, extra in options:
            p.add_argument(name, **extra)

    out, pack = ("--out", {"required": True}), ("--pack", {"choices": sorted(PACKS), "default": sorted(PACKS)[0]})
    flag = {"action": "store_true"}
    add(scan, ("root", {}), ("--system", {"required": True}), out, pack, ("--secrecy-years", {"type": float, "default": 5.0}), ("--include-dev", flag), ("--no-binaries", flag), ("--traces", {}), ("--now", {}), ("--entry", {"action": "append"}))
    add(worklist, out, ("--bucket", {"default": "confidentiality"}), ("--rows", {"type": int, "default": 50}))
    add(ci, out, ("--accepted", {}), ("--suppressions", {}), ("--library-surface", flag), ("--now", {}), ("--json", flag), ("--update-baseline", {}))
    add(bill, out, pack, ("--to", {"required": True}), ("--profile", {"choices": sorted(export.PROFILES), "default": "cyclonedx-1.7"}), ("--include-suspected", flag), ("--key", {}), ("--shards", flag))
    add(verify, ("artifact", {}), ("--key", {"required": True}))
    add(probe_plan, ("targets", {}), ("--grant", {"required": True}), ("--skew", {"type": int, "default": 0}))
    add(coverage, out, ("--json", flag), ("--key", {}), ("--secret", {}), ("--to", {}))
    add(verify_coverage, ("artifact", {}), ("--trusted", {"action": "append", "required": True}), ("--now", {}), ("--json", flag))
    add(keygen, ("--key", {"required": True}), ("--secret", {"required": True}), ("--key-id", {"required": True}), ("--height", {"type": int, "default": 10}), ("--days", {"type": int, "default": 365}), ("--now", {}))
    add(attest, ("statements", {}), out, ("--now", {}), ("--json", flag))
    add(estate, ("--store", {"required": True}), pack, ("--secrecy-years", {"type": float, "default": 5.0}), ("--now", {}), ("--json", flag))
    add(policies, ("--json", flag))
    add(check, ("payloads", {}), ("--kind", {"choices": ["scan", "trace", "pack"], "required": True}), ("--json", flag))
    add(keep, out, ("--store", {"required": True}), ("--scan-id", {"required": True}))
    add(token)
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.run is coverage and a.key and not (a.secret and a.to):
        parser().error("coverage --key needs --secret and --to")
    return a.run(_session(), a)


if __name__ == "__main__":
    sys.exit(main())
