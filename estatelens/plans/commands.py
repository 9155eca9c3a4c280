"""What a user asks for, one function each: from trees and exports to worklists, gates, plans and documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.common import cut_lineage
from estatelens.functions.assets import decimal_year
from estatelens.functions.mosca import MIGRATION_YEARS, PACKS, PolicyPack
from estatelens.operators import changes, evidence, export, ranking, reach, scope, signing, store, traces, views
from estatelens.sources import binaries, calls, inventories, text_files
from estatelens.sources.rules import Rule

#: Folders that are never part of a tree, and the bound on a source file.
IGNORED = r"(^|/)(node_modules|\.git|dist|build|coverage|\.venv|venv|vendor|target|__pycache__|\.next|\.turbo)/"
MAX_TEXT = 2 << 20


@dataclass
class Scan:
    """The tables of one scan."""

    findings: DataFrame
    occurrences: DataFrame
    assets: DataFrame
    worklists: DataFrame
    headline: DataFrame
    skipped: DataFrame


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root: path (relative), length, content; ignored folders are left out by their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    relative = F.substring(F.regexp_replace("path", "^file:/*", "/"), F.length(base) + 2, F.lit(1 << 20))
    return files.select(relative.alias("path"), "length", "content").filter(~F.col("path").rlike(IGNORED))


def load_pack(spark: SparkSession, path: str) -> PolicyPack:
    """A policy pack of a JSON file: one small record, so it is read to the driver."""
    schema = "packId string, packVersion string, crqcYear double, regulatoryDeadlines struct<CONFIDENTIALITY:double,AUTHENTICITY:double>, migrationYearsByControl struct<SELF:double,VENDOR_UPGRADEABLE:double,VENDOR_LOCKED:double,HARDWARE:double,PROTOCOL_BILATERAL:double>, signature string"
    r = spark.read.schema(schema).option("multiLine", "true").json(path).first()
    if r is None or r["packId"] is None or r["crqcYear"] is None:
        raise ValueError(f"not a policy pack: {path}")
    d, years = r["regulatoryDeadlines"], r["migrationYearsByControl"]
    return PolicyPack(r["packId"], r["packVersion"], r["crqcYear"], d["CONFIDENTIALITY"] if d else None, d["AUTHENTICITY"] if d else None, MIGRATION_YEARS | {k: v for k, v in (years.asDict() if years else {}).items() if v is not None}, "SIGNED" if r["signature"] else "UNSIGNED")


def packs() -> list[PolicyPack]:
    return [PACKS[k] for k in sorted(PACKS)]


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a trace bundle or an OTLP payload; anything else is an error."""
    columns = spark.read.option("multiLine", "true").json(path).columns
    if "spans" in columns:
        rows = spark.read.schema("spans array<struct<service:string,spanId:string,parentSpanId:string,operation:string>>").option("multiLine", "true").json(path)
        return rows.select(F.posexplode("spans").alias("ord", "s")).select("s.service", F.col("s.spanId").alias("span_id"), F.coalesce("s.parentSpanId", F.lit("")).alias("parent_span_id"), F.coalesce("s.operation", F.lit("")).alias("operation"), "ord")
    if "resourceSpans" in columns:
        return traces.spans_from_otlp(spark.read.schema(traces.OTLP_SCHEMA).option("multiLine", "true").json(path))
    raise ValueError(f"neither a trace bundle nor an OTLP payload: {path}")


def source_files(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text files (path, text) of a tree, and the ones skipped for their size."""
    known = calls.language_of(F.col("path")).isNotNull() | text_files.config_kind(F.col("path")).isNotNull() | text_files.file_name(F.col("path")).rlike(r"(?i)^(package\.json|pnpm-lock\.yaml|poetry\.lock|Pipfile|.*requirements.*\.txt)$")
    wanted = tree.filter(known)
    small = wanted.filter(F.col("length") <= MAX_TEXT).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return small, wanted.filter(F.col("length") > MAX_TEXT).select("path", F.lit("too large").alias("reason"))


def collect(tree: DataFrame, system_id: str, include_dev: bool = False, keys: DataFrame | None = None, with_binaries: bool = True, sources: DataFrame | None = None, own_rules: Sequence[Rule] | DataFrame = ()) -> tuple[DataFrame, DataFrame]:
    """Findings of all detectors over a tree, and what was skipped and why. sources: the tree's sources as calls.parsed() gave them; own_rules: see calls.call_findings()."""
    texts, skipped = source_files(tree)
    # rules, Python's rules and problems all read the parsed sources
    found_calls = calls.calls_of(cut_lineage(calls.parsed(texts), "sources") if sources is None else sources)
    found = [
        calls.call_findings(found_calls, system_id, own_rules), binaries.source_findings(found_calls.filter("language = 'python'"), system_id), text_files.config_findings(texts, system_id),
        text_files.dependency_findings(texts, system_id, include_dev)[0], binaries.certificate_findings(binaries.certificates(tree.filter(F.col("path").rlike(r"(?i)\.(pem|crt|cer|der)$"))), system_id),
    ]
    if with_binaries:
        found.append(binaries.binary_findings(tree.filter(F.col("path").rlike(r"(?i)\.(so|dll|dylib|exe|bin|node)(\.[0-9.]+)?$|/[^./]+$")), system_id))
    if keys is not None:
        found.append(inventories.key_findings(keys, system_id)[0])
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, skipped.union(found_calls.filter("problem is not null").select("path", F.col("problem").alias("reason")).distinct())


def static_reachability(found: DataFrame, tree: DataFrame, sources: DataFrame | None = None, own_entries: DataFrame | None = None) -> DataFrame:
    """Verdicts per occurrence from the tree's module graph, with the packages that its manifests declare; own_entries: files that count as entry points besides those found."""
    texts, _ = source_files(tree)
    sources = cut_lineage(calls.parsed(texts), "sources") if sources is None else sources
    packages = cut_lineage(calls.packages_of(texts), "packages")
    files = calls.with_packages(texts.filter(calls.language_of(F.col("path")).isNotNull()), packages)
    vertices, imports, exported, edges = (cut_lineage(x, "graph") for x in calls.module_graph(files, sources))
    named = reach.resolve_packages(imports, packages.filter("name is not null").select("name", "entry_dir"), vertices)
    every = cut_lineage(reach.resolve_local(imports, vertices).union(reach.resolve_suffix(imports, vertices)).union(named), "edges")
    roots = reach.entry_points(vertices, own_entries)
    functions = calls.calls_of(sources).select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("locator"), "callee", "function").dropDuplicates(["locator", "callee"])
    rows = found.select("occurrence_id", "modality", "locator", F.split_part("raw", F.lit(" "), F.lit(1)).alias("callee")).join(functions, ["locator", "callee"], "left")
    rows = rows.withColumn("file", F.regexp_extract("locator", r"^(.*):[0-9]+$", 1))
    located = rows.withColumn("file", F.when(F.col("modality").isin("SOURCE_AST", "SOURCE_CONFIG") & (F.col("file") != ""), F.col("file")))
    return reach.verdicts(located, reach.walk(every, roots), vertices, reach.live_functions(edges, exported), any_entry=not roots.isEmpty())


def scan(tree: DataFrame, system_id: str, pack: PolicyPack, now: Column, secrecy_years: float = 5.0, include_dev: bool = False, keys: DataFrame | None = None, spans: DataFrame | None = None, with_binaries: bool = True, own_rules: Sequence[Rule] | DataFrame = (), own_entries: DataFrame | None = None) -> Scan:
    """Detect, assemble, decide reach and rank one system, with rules and entry points of the caller if given."""
    if not 0 <= secrecy_years <= 100:
        raise ValueError("secrecy_years must be between 0 and 100")
    sources = cut_lineage(calls.parsed(source_files(tree)[0]), "sources")
    raw, skipped = collect(tree, system_id, include_dev, keys, with_binaries, sources, own_rules)
    # each step is a table: what follows reads it many times
    found = cut_lineage(evidence.identified(raw), "findings")
    verdict = cut_lineage(static_reachability(found, tree, sources, own_entries), "verdicts").select("occurrence_id", "reachable", "via")
    occ = cut_lineage(evidence.occurrences(found).join(verdict, "occurrence_id", "left"), "occurrences")
    if spans is not None:
        graph = traces.service_edges(spans)
        roots = traces.trace_roots(spans).union(traces.self_reachable_systems(occ))
        occ = traces.apply_trace_reachability(occ, traces.reachable_services(graph, roots)).drop("trace_path", "raised")
    return rank(found, occ, evidence.assets(found), pack, now, secrecy_years, skipped)


def rank(found: DataFrame, occ: DataFrame, known: DataFrame, pack: PolicyPack, now: Column, secrecy_years: float, skipped: DataFrame) -> Scan:
    """Worklists and headline of occurrences at a point in time."""
    year = found.sparkSession.range(1).select(decimal_year(now, 2).alias("y")).first()["y"]
    rows = cut_lineage(ranking.placed(ranking.ranked(occ, known, pack, year, secrecy_years)), "worklists")
    return Scan(found, occ, known, rows, ranking.headline(rows), skipped)


def ci(result: Scan, accepted: DataFrame, suppressions: DataFrame, now: Column, include_library_surface: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcome of each blocking row, accepted findings that are gone, and one row that says whether the build passes."""
    rows = changes.gate(result.worklists, accepted, suppressions, now, include_library_surface)
    counts = rows.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("introduced", "accepted", "suppressed")])
    return rows, changes.resolved(result.worklists, accepted), counts.withColumn("passed", F.col("introduced") == 0)


def probe_plan(targets: DataFrame, grant: DataFrame, now: Column, skew_seconds: int = 0) -> DataFrame:
    """Each target text with host, port and the code that allows or refuses it; nothing is probed here."""
    split = targets.select("target", scope.split_target(F.col("target")).alias("t")).select(F.col("target").alias("asked"), "t.host", "t.port")
    return scope.authorize(split, grant, now, skew_seconds)


def estate(root: str, spark: SparkSession, pack: PolicyPack, now_year: float, systems: list[str] | None = None) -> DataFrame:
    """Worklists over the newest scan of every system that a reader may see, with stored service edges applied."""
    scans = store.visible(store.get(spark, root, "scans"), systems or [])
    occ = store.merge_scans(scans, store.get(spark, root, "occurrences"))
    edges = store.get(spark, root, "edges")
    roots = traces.self_reachable_systems(occ).withColumnRenamed("system_id", "service").union(edges.select("from_service").join(edges.select(F.col("to_service").alias("from_service")), "from_service", "left_anti"))
    raised = traces.apply_trace_reachability(occ, traces.reachable_services(edges, roots)).drop("trace_path", "raised")
    return ranking.placed(ranking.ranked(raised, store.get(spark, root, "assets").dropDuplicates(["asset_id"]), pack, now_year))


def newest(occ: DataFrame, systems: DataFrame) -> DataFrame:
    """The occurrences of each system's last scan; systems: system_name, last_scan_id."""
    last = systems.select(F.col("system_name").alias("system_id"), F.col("last_scan_id").alias("scan_id")).distinct()
    return occ.join(last, ["system_id", "scan_id"], "left_semi")


def attest(statements: DataFrame, result: Scan, now_year: float) -> tuple[DataFrame, DataFrame]:
    """Claims against observations, and each vendor's migration estimate."""
    ids = evidence.identified(inventories.attestation_findings(statements, F.current_timestamp()).drop("expired"))
    claims = ids.select("system_id", "asset_id").distinct().join(statements.select("system_id", F.col("roadmap.status").alias("roadmap")), "system_id")
    estimates = statements.select("vendor", "system_id", views.migration_estimate(F.col("roadmap.status"), decimal_year(F.col("roadmap.available_from"), 2), F.coalesce("roadmap.requires_hardware", F.lit(False)), now_year).alias("e")).select("vendor", "system_id", "e.*")
    return views.reconcile(claims, result.findings, result.assets.unionByName(evidence.assets(ids)).dropDuplicates(["asset_id"])), estimates


def coverage_attestation(occ: DataFrame) -> DataFrame:
    """One row: the coverage statement, the canonical report as body and its digest, for signing."""
    report = views.coverage(occ)
    body = report.agg(F.to_json(F.array_sort(F.collect_list(F.struct("assets", "class", "examined", "modalities", "occurrences", "systems")))).alias("body"))
    return views.coverage_statement(report).crossJoin(body.select("body", F.sha2("body", 256).alias("digest")))  # one row each


def derivation(found: DataFrame, occurrence_id: str) -> DataFrame:
    """The factor tree of one occurrence; findings are told by what its id is hashed from, so that no id is hashed for each of them."""
    return evidence.factor_nodes(evidence.of_occurrence(found, occurrence_id))


def bill_of_materials(result: Scan, pack: PolicyPack, timestamp: str, profile: str = "cyclonedx-1.7", include_suspected: bool = False) -> DataFrame:
    return export.document(result.occurrences, result.assets, f"{pack.pack_id}@{pack.pack_version}", timestamp, profile, include_suspected)


def new_key(spark: SparkSession, folder: str, secret: str, key_id: str, height: int, not_after: Column) -> None:
    """A signer's folder: tree, the table of its nodes, public, the row for readers, and used, where leaves are noted before they sign."""
    tree = signing.key_tree(spark, secret, key_id, height)
    tree.write.parquet(f"{folder}/tree")
    signing.public_key(tree, key_id, not_after).write.json(f"{folder}/public")
    spark.createDataFrame([(0,)], "next long").write.json(f"{folder}/used")


def sign_with(folder: str, secret: str, artifacts: DataFrame) -> DataFrame:
    """artifacts (body, ...) signed with the next leaves of a key. They are noted as used first: a run that fails loses leaves, but no leaf signs twice.

    One signer uses a folder at a time.
    """
    spark = artifacts.sparkSession
    artifacts = cut_lineage(artifacts, "to-sign")
    first = spark.read.schema("next long").json(f"{folder}/used").agg(F.max("next").alias("n")).first()["n"]
    needed = artifacts.select(signing.body_digest(F.col("body"))).distinct().count()
    tree = spark.read.parquet(f"{folder}/tree")
    if signing.free_leaves(tree, first) >= needed:
        spark.createDataFrame([(first + needed,)], "next long").write.mode("append").json(f"{folder}/used")
    key_id = public_keys(spark, folder).first()["key_id"]
    return signing.sign(artifacts, tree, secret, key_id, first)


def public_keys(spark: SparkSession, *folders: str) -> DataFrame:
    return spark.read.schema("key_id string, root string, height int, not_after timestamp").json([f"{x}/public" for x in folders])
