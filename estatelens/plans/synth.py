"""Deterministic evidence, spans, scans, grants and statements over the star-schema tables.

The tables hold no cryptography, so queries over them read these views. The expressions are plain SQL that
means the same in other engines, which is how results are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Now, as a year, for everything that needs one.
NOW_YEAR = 2026.66

_PRIMITIVE = "CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'ECDH' WHEN 3 THEN 'X25519' WHEN 4 THEN 'AES' WHEN 5 THEN 'SHA2' WHEN 6 THEN 'ML-KEM' ELSE 'MD5' END"
_PARAMETERS = (
    "CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN concat('{\"modulusLength\":', CAST(1024 * (1 + CAST(floor(l_partkey / 8) AS BIGINT) % 4) AS STRING), '}') WHEN 1 THEN '{\"curve\":\"P-256\"}' WHEN 2 THEN '{\"curve\":\"P-384\"}' "
    "WHEN 4 THEN concat('{\"keySize\":', CAST(128 + 64 * (l_partkey % 3) AS STRING), ',\"mode\":\"GCM\"}') WHEN 5 THEN '{\"outputLength\":256}' WHEN 7 THEN '{\"outputLength\":128}' ELSE '{}' END"
)
_PURPOSE = "CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'KEY_ESTABLISHMENT' ELSE 'DIGITAL_SIGNATURE' END WHEN 1 THEN 'DIGITAL_SIGNATURE' WHEN 4 THEN 'DATA_ENCRYPTION' WHEN 5 THEN 'INTEGRITY' WHEN 7 THEN 'INTEGRITY' ELSE 'KEY_ESTABLISHMENT' END"
_CONTROL = "CASE CAST((l_suppkey + l_linenumber) % 5 AS INT) WHEN 0 THEN 'SELF' WHEN 1 THEN 'VENDOR_UPGRADEABLE' WHEN 2 THEN 'VENDOR_LOCKED' WHEN 3 THEN 'HARDWARE' ELSE 'PROTOCOL_BILATERAL' END"
_MODALITY = (
    "CASE CAST((l_orderkey + 3 * l_linenumber) % 13 AS INT) WHEN 0 THEN 'SOURCE_AST' WHEN 1 THEN 'SOURCE_CONFIG' WHEN 2 THEN 'DEPENDENCY' WHEN 3 THEN 'BINARY_SYMBOL' WHEN 4 THEN 'BINARY_CONSTANT' WHEN 5 THEN 'BINARY_STRING' "
    "WHEN 6 THEN 'HOST_AGENT' WHEN 7 THEN 'NETWORK_ACTIVE' WHEN 8 THEN 'NETWORK_PASSIVE' WHEN 9 THEN 'PKI_CERTIFICATE' WHEN 10 THEN 'CLOUD_KMS_API' WHEN 11 THEN 'RUNTIME_HOOK' ELSE 'ASSERTED' END"
)
FINDINGS = {
    "system_id": "concat('sys-', lpad(CAST(l_suppkey % 40 AS STRING), 2, '0'))",
    "primitive": _PRIMITIVE,
    "parameters": _PARAMETERS,
    "purpose": _PURPOSE,
    "control_class": _CONTROL,
    "modality": _MODALITY,
    "locator": "concat('file-', CAST(l_partkey % 97 AS STRING), ':', CAST(l_linenumber AS STRING))",
    "raw": "concat(l_returnflag, l_linestatus, CAST(l_orderkey % 5 AS STRING))",
    "assumption": "CASE WHEN l_returnflag = 'R' AND l_orderkey % 17 = 0 THEN concat('guess-', CAST(l_orderkey % 3 AS STRING)) END",
    "collected_at": "l_shipdate",
}
SPANS = {
    "span_id": "CAST(event_id AS STRING)",
    "parent_span_id": "CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) END",
    "service": "concat('svc-', lpad(CAST(user_id % 24 AS STRING), 2, '0'))",
    "operation": "event_type",
    "ord": "event_id",
    "ts": "ts",
}
SCANS = {
    "scan_id": "concat('scan-', CAST(o_orderkey AS STRING))",
    "system_name": "concat('sys-', lpad(CAST(o_custkey % 40 AS STRING), 2, '0'))",
    "started_at": "o_orderdate",
}
REACHABLE = "CASE WHEN substr(occurrence_id, 1, 1) < '4' THEN false WHEN substr(occurrence_id, 1, 1) < '8' THEN NULL ELSE true END"
VIA = "CASE WHEN substr(occurrence_id, 1, 1) < '4' THEN 'NONE' WHEN substr(occurrence_id, 1, 1) < '8' THEN NULL WHEN substr(occurrence_id, 1, 1) < 'c' THEN 'ENTRY_POINT' ELSE 'LIBRARY_SURFACE' END"


def _view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[F.expr(e).alias(n) for n, e in columns.items()])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", FINDINGS)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", SPANS)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", SCANS)


def with_reach(occ: DataFrame) -> DataFrame:
    """Occurrences with a verdict that their id decides."""
    return occ.withColumns({"reachable": F.expr(REACHABLE), "via": F.expr(VIA)})


#: A source file of about 190 lines as it repeats in source_tree(), with one call to find in each function.
_SOURCE = "import * as crypto from 'node:crypto';\nimport { other } from './f%d.js';\n" + "".join(
    f"export function work{k}(input, options) {{\n  const size = input.length / 2;\n  for (let i = 0; i < size; i++) {{\n    if (/['\"]/.test(input[i])) {{ other(input[i], {{ deep: [i, size], name: 'n{k}' }}); }}\n  }}\n"
    f"  // crypto.createHash('md5')\n  const digest = crypto.createHash('sha{(1, 256, 512)[k % 3]}').update(input).digest('hex');\n  return `${{digest}}:${{size}}`;\n}}\n\n"
    for k in range(19)
)


def source_tree(spark: SparkSession, files: int) -> DataFrame:
    """path and text of a made tree of JavaScript files; file k imports file k + 1."""
    at = F.col("id").cast("string")
    return spark.range(files).select(F.concat(F.lit("src/f"), at, F.lit(".js")).alias("path"), F.replace(F.lit(_SOURCE), F.lit("%d"), (F.col("id") + 1).cast("string")).alias("text"))


def as_sql(table: str, columns: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"
