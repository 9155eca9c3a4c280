"""The bill-of-materials export: one component per asset, folded from its occurrences, and the document."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import dims
from estatelens.functions.assets import round_half_up

TOOL = "estatelens"
PROFILES = {"cyclonedx-1.7": "1.7", "cyclonedx-1.6": "1.6", "cisa-min-elements": "1.7"}


def components(occ: DataFrame, assets: DataFrame, include_suspected: bool = False) -> DataFrame:
    """Per asset: weakest level (of the first such occurrence), strongest confidence, counts, control classes, reach.

    Suspected occurrences are left out unless asked for.
    """
    rows = occ if include_suspected else occ.filter("level <> 'SUSPECTED'")
    if "reachable" not in rows.columns:
        rows = rows.withColumn("reachable", F.lit(None).cast("boolean"))
    order = F.array_position(F.array(*map(F.lit, dims.LEVELS)), F.col("level"))
    reach = F.when(F.coalesce(F.bool_or("reachable"), F.lit(False)), "true").when(F.count("reachable") == 0, "unanalyzed").otherwise("false")
    folded = rows.groupBy("asset_id").agg(
        F.min_by("level", F.struct(order, F.col("occurrence_id"))).alias("level"),
        F.min_by("downgrade_reason", F.struct(order, F.col("occurrence_id"))).alias("downgrade_reason"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("occurrence_count"),
        F.array_join(F.array_sort(F.collect_set("control_class")), ",").alias("control_classes"),
        reach.alias("reachable"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("modalities")))).alias("modalities"),
    )
    known = assets.select("asset_id", "asset_name", "primitive", "parameters", "purpose", "quantum_vulnerable", "security_bits", "oid", "track")
    named = folded.join(known, "asset_id", "left")
    return named.select("*", dims.lookup(F.col("primitive"), dims.PRIMITIVE_KIND).alias("kind"), round_half_up(F.col("confidence") * 100, 0).cast("int").alias("percent"))


def level_counts(occ: DataFrame) -> DataFrame:
    """One row: occurrences per assertion level."""
    return occ.agg(*[F.count_if(F.col("level") == level).alias(level.lower()) for level in reversed(dims.LEVELS)])


def system_statements(occ: DataFrame) -> DataFrame:
    """Per system: body, the number of its occurrences at each assertion level as canonical JSON, to be signed."""
    counts = occ.groupBy("system_id").agg(*[F.count_if(F.col("level") == level).alias(level.lower()) for level in dims.LEVELS])
    return counts.select("system_id", F.to_json(F.struct(*sorted(x.lower() for x in dims.LEVELS), F.col("system_id").alias("system"))).alias("body"))


def component_json(folded: DataFrame) -> DataFrame:
    """asset_id and the component as canonical JSON."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    functions = F.create_map(*[x for k, v in dims.PURPOSE_FUNCTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    technique = F.transform("modalities", lambda m: F.struct(dims.lookup(m, dims.TECHNIQUES).alias("technique"), m.alias("value")))
    parameter = lambda k: F.get_json_object("parameters", f"$.{k}")
    shape = F.struct(
        F.concat(F.lit("crypto:"), F.col("asset_id")).alias("bom-ref"),
        F.struct(
            F.struct(
                functions[F.col("purpose")].alias("cryptoFunctions"), F.col("kind").alias("primitive"), F.col("security_bits").alias("classicalSecurityLevel"), parameter("curve").alias("curve"),
                F.coalesce(parameter("modulusLength"), parameter("keySize"), parameter("curve")).alias("parameterSetIdentifier"),
            ).alias("algorithmProperties"),
            F.lit("algorithm").alias("assetType"),
            F.col("oid").alias("oid"),
        ).alias("cryptoProperties"),
        F.struct(F.struct(F.col("percent").alias("confidence"), F.lit("name").alias("field"), technique.alias("methods")).alias("identity")).alias("evidence"),
        F.coalesce("asset_name", "asset_id").alias("name"),
        F.array(*[F.struct(F.lit(f"{TOOL}:{k}").alias("name"), text(c).alias("value")) for k, c in (("assertionLevel", "level"), ("confidence", "confidence"), ("quantumVulnerable", "quantum_vulnerable"), ("purpose", "purpose"), ("urgencyTrack", "track"), ("occurrenceCount", "occurrence_count"), ("controlClasses", "control_classes"), ("reachable", "reachable"))]).alias("properties"),
        F.lit("cryptographic-asset").alias("type"),
    )
    return folded.select("asset_id", F.to_json(F.try_parse_json(F.to_json(shape))).alias("component"))


def document(occ: DataFrame, assets: DataFrame, pack: str, timestamp: str, profile: str = "cyclonedx-1.7", include_suspected: bool = False) -> DataFrame:
    """One row: the document as JSON and its serial number, a hash of the rest, so equal evidence gives equal bytes.

    A document is one value; it is as large as the number of distinct assets makes it. Estates whose
    document would not fit in one row are written with write_document(), one component per line under a hash tree.
    """
    rows = component_json(components(occ, assets, include_suspected)).agg(F.array_sort(F.collect_list(F.struct("asset_id", "component"))).alias("rows"))
    counts = level_counts(occ if include_suspected else occ.filter("level <> 'SUSPECTED'"))
    body = F.concat(
        F.lit('{"bomFormat":"CycloneDX","components":['),
        F.array_join(F.transform("rows", lambda r: r["component"]), ","),
        F.lit('],"dependencies":['),
        F.array_join(F.transform("rows", lambda r: F.concat(F.lit('{"dependsOn":[],"ref":"crypto:'), r["asset_id"], F.lit('"}'))), ","),
        F.lit(f'],"metadata":{{"properties":[{{"name":"{TOOL}:policyPack","value":"{pack}"}},{{"name":"{TOOL}:exportProfile","value":"{profile}"}}],"timestamp":"{timestamp}"}},"properties":['),
        F.concat_ws(",", *[F.concat(F.lit(f'{{"name":"{TOOL}:{x.lower()}","value":"'), F.col(x.lower()).cast("string"), F.lit('"}')) for x in reversed(dims.LEVELS)]),
        F.lit(f'],"specVersion":"{PROFILES[profile]}","version":1}}'),
    )
    d = F.sha2("body", 256)
    serial = F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))
    return rows.crossJoin(F.broadcast(counts)).select(body.alias("body")).select(F.concat(F.lit("urn:uuid:"), serial).alias("serial_number"), "body")


#: Hexadecimal digits of a leaf's digest that name its node, from the lowest level to the root.
TREE_LEVELS = (6, 4, 2, 0)


def hash_tree(leaves: DataFrame, levels: tuple[int, ...] = TREE_LEVELS) -> DataFrame:
    """One row: the root of a hash tree over leaves (digest, in hexadecimal) and their number n.

    A node is the SHA-256 of its children's digests in order, and belongs to the digits that they begin with. So no node has
    more than 256 children above the lowest level, no row gathers all leaves, and the root is that of the set of leaves,
    however they are partitioned. Without leaves the root is the SHA-256 of nothing.
    """
    nodes = leaves.select(F.col("digest").alias("name"), "digest", F.lit(1).cast("long").alias("n"))
    for digits in levels:
        parent = F.substring("name", 1, digits) if digits else F.lit("")
        children = F.sort_array(F.collect_list(F.struct("name", "digest")))
        nodes = nodes.groupBy(parent.alias("name")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("n").alias("n"))
    top = nodes.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top


def write_document(occ: DataFrame, assets: DataFrame, target: str, pack: str, timestamp: str, profile: str = "cyclonedx-1.7", include_suspected: bool = False) -> DataFrame:
    """The bill of materials as files: target/components, one component a line, and target/document, one line about all.

    The serial number comes from the root over the components' hashes and the rest of the document, so equal evidence gives an
    equal number, and no task holds more than its share of components. Gives the document's row.
    """
    rows = component_json(components(occ, assets, include_suspected))
    rows.repartitionByRange("asset_id").sortWithinPartitions("asset_id").select(F.col("component").alias("value")).write.mode("overwrite").text(f"{target}/components")
    document_row(rows.sparkSession.read.text(f"{target}/components"), level_counts(occ if include_suspected else occ.filter("level <> 'SUSPECTED'")), pack, timestamp, profile).write.mode("overwrite").json(f"{target}/document")
    return rows.sparkSession.read.schema("root string, n long, header string, serial_number string").json(f"{target}/document")


def document_row(lines: DataFrame, counts: DataFrame, pack: str, timestamp: str, profile: str) -> DataFrame:
    """root, n, header and serial_number of written components (value)."""
    top = hash_tree(lines.select(F.sha2("value", 256).alias("digest"))).crossJoin(F.broadcast(counts))  # one row each
    facts = F.struct(F.lit(PROFILES[profile]).alias("specVersion"), F.lit(timestamp).alias("timestamp"), F.lit(pack).alias("policyPack"), F.lit(profile).alias("exportProfile"), F.struct(*[x.lower() for x in reversed(dims.LEVELS)]).alias("levels"), F.col("n").alias("components"), F.col("root").alias("componentsRoot"))
    d = F.sha2("header", 256)
    serial = F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12))
    return top.select("root", "n", F.to_json(facts).alias("header")).withColumn("serial_number", F.concat(F.lit("urn:uuid:"), serial))


def whole(spark: SparkSession, target: str) -> bool:
    """Whether the components of a written document are those that its row speaks of."""
    said = spark.read.schema("root string, n long").json(f"{target}/document").first()
    found = hash_tree(spark.read.text(f"{target}/components").select(F.sha2("value", 256).alias("digest"))).first()
    return (said["root"], said["n"]) == (found["root"], found["n"])


def keyed_digest(body: Column, key: str) -> Column:
    """HMAC-SHA256 of a text under a key of the caller, in hexadecimal; signatures of artifacts by parties that share it."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in raw).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def signed(artifact: DataFrame, key: str) -> DataFrame:
    """artifact (body, ...) with its signature."""
    return artifact.withColumn("signature", keyed_digest(F.col("body"), key))


def verified(artifact: DataFrame, key: str) -> DataFrame:
    """artifact (body, signature, ...) with valid."""
    return artifact.withColumn("valid", F.coalesce(keyed_digest(F.col("body"), key) == F.col("signature"), F.lit(False)))


def report_lines(occ: DataFrame) -> DataFrame:
    """What a person reads of a scan: a line for each assertion level."""
    n, tainted = F.count("*").cast("string"), F.count_if("tainted").cast("string")
    return occ.groupBy(F.col("level").alias("heading")).agg(F.concat(n, F.lit(" work items, "), tainted, F.lit(" resting on assumptions")).alias("line"))


def gate_report(outcomes: DataFrame) -> DataFrame:
    """What a person reads of a gate: a line for each outcome, and whether the build passes."""
    counts = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    lines = counts.select(F.col("outcome").alias("heading"), F.concat(F.col("n").cast("string"), F.lit(" blocking work items")).alias("line"))
    verdict = outcomes.agg(F.count_if(F.col("outcome") == "introduced").alias("n")).select(F.lit("verdict"), F.when(F.col("n") == 0, "the build passes").otherwise("the build fails"))
    return lines.union(verdict)


def plan_report(plan: DataFrame) -> DataFrame:
    """What a person reads of a probe plan: a line for each code."""
    return plan.groupBy(F.col("code").alias("heading")).agg(F.concat(F.count("*").cast("string"), F.lit(" targets")).alias("line"))


def reconcile_report(verdicts: DataFrame) -> DataFrame:
    """What a person reads of a reconciliation: a line for each system and verdict."""
    return verdicts.groupBy(F.col("system_id").alias("heading"), "verdict").agg(F.count("*").alias("n")).select("heading", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("verdict")).alias("line"))
