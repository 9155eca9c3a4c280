"""Scans as partitioned Parquet tables, and the queries over stored scans and the audit log.

Layout under a root: scans, occurrences, assets, evidence, edges; occurrences, evidence and edges are
partitioned by scan_id, so that one scan is read by partition pruning and replaced by overwriting it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.operators.traces import service_edges

PARTITIONED = ("occurrences", "evidence", "edges")


def put(root: str, table: str, rows: DataFrame) -> None:
    """Write rows; a partitioned table replaces the scans that rows has, so a repeated ingest changes nothing."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("scan_id") if table in PARTITIONED else rows.write.mode("append")).parquet(f"{root}/{table}")


def get(spark: SparkSession, root: str, table: str, scan_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{table}")
    return rows.filter(F.col("scan_id") == scan_id) if scan_id is not None else rows


def check_references(occurrences: DataFrame, assets: DataFrame) -> DataFrame:
    """Occurrences whose asset is not declared; an ingest is valid if there is none."""
    return occurrences.join(assets.select("asset_id"), "asset_id", "left_anti")


def require_references(occurrences: DataFrame, assets: DataFrame) -> DataFrame:
    """occurrences, failing at run time on the first undeclared asset."""
    known = assets.select("asset_id", F.lit(True).alias("_known")).dropDuplicates(["asset_id"])
    ok = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("asset not declared: "), F.col("asset_id")))).otherwise(F.lit(True))
    return occurrences.join(known, "asset_id", "left").filter(ok).drop("_known")


def _newest(system: str = "system_name") -> Window:
    return Window.partitionBy(system).orderBy(F.col("started_at").desc(), F.col("scan_id").desc())


def latest_per_system(scans: DataFrame) -> DataFrame:
    """The newest scan of each system, by an aggregate that keeps one row per task and system."""
    best = F.max_by(F.struct(*scans.columns), F.struct("started_at", "scan_id"))
    return scans.groupBy("system_name").agg(best.alias("r")).select("r.*")


def recent(scans: DataFrame, n: int = 10) -> DataFrame:
    """The newest n scans of each system."""
    return scans.withColumn("nth", F.row_number().over(_newest())).filter(F.col("nth") <= n)


def with_previous(scans: DataFrame) -> DataFrame:
    """Each scan with the newest one of its system that started strictly earlier."""
    by_start = scans.groupBy("system_name", "started_at").agg(F.max("scan_id").alias("last_id"))
    previous = by_start.withColumn("previous_scan_id", F.lag("last_id").over(Window.partitionBy("system_name").orderBy("started_at"))).drop("last_id")
    return scans.join(previous, ["system_name", "started_at"])


def newest_start(scans: DataFrame) -> DataFrame:
    return scans.agg(F.max("started_at").alias("newest_start"))


def scan_summaries(scans: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each scan with its number of occurrences and of distinct assets."""
    counts = occurrences.groupBy("scan_id").agg(F.count("*").alias("occurrence_count"), F.countDistinct("asset_id").alias("asset_count"))
    return scans.join(counts, "scan_id", "left").fillna(0, ["occurrence_count", "asset_count"])


def merge_scans(scans: DataFrame, occurrences: DataFrame) -> DataFrame:
    """The occurrences of the newest scan of each system."""
    return occurrences.join(latest_per_system(scans).select("scan_id"), "scan_id")


def visible(rows: DataFrame, systems: list[str], column: str = "system_name") -> DataFrame:
    """Row-level scope of a reader: an empty list sees all."""
    return rows.filter(F.col(column).isin(*systems)) if systems else rows


def audit_page(log: DataFrame, since: Column | None = None, before: Column | None = None, token_id: str | None = None, limit: int = 100) -> DataFrame:
    """The newest audit rows with since <= at < before of one token or all; the limit is the page's."""
    for ok in ([F.col("at") >= since] if since is not None else []) + ([F.col("at") < before] if before is not None else []) + ([F.col("token_id") == token_id] if token_id else []):
        log = log.filter(ok)
    return log.orderBy(F.col("at").desc(), F.col("event_id").desc()).limit(limit)


def usable_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """How many tokens are neither revoked nor expired."""
    return tokens.agg(F.count_if(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).alias("usable"))


#: A token is a prefix, an id of 12 and a secret of 48 hexadecimal digits, joined by underscores.
TOKEN = r"^est_([0-9a-f]{12})_([0-9a-f]{48})$"


def mint_token(token_id: Column, secret: Column) -> Column:
    """A token's text; id and secret come from a random source of the caller."""
    return F.concat_ws("_", F.lit("est"), token_id, secret)


def token_digest(secret: Column) -> Column:
    """What is stored of a secret."""
    return F.sha2(secret, 256)


def checked_tokens(given: DataFrame, stored: DataFrame) -> DataFrame:
    """given (token, ...) with state: malformed, unknown, wrong secret or ok. stored: token_id, digest.

    Digests are compared, never secrets, so the time of the comparison says nothing about a secret.
    """
    parts = given.withColumns({"_id": F.nullif(F.regexp_extract("token", TOKEN, 1), F.lit("")), "_digest": token_digest(F.regexp_extract("token", TOKEN, 2))})
    known = parts.join(stored.select(F.col("token_id").alias("_id"), F.col("digest").alias("_stored")), "_id", "left")
    state = F.when(F.col("_id").isNull(), "malformed").when(F.col("_stored").isNull(), "unknown").when(F.col("_stored") != F.col("_digest"), "wrong secret").otherwise("ok")
    return known.withColumn("state", state).drop("_id", "_digest", "_stored")


def edges_only(spans: DataFrame) -> DataFrame:
    """What a trace store keeps of spans: service edges without any span's id, time or attributes."""
    return service_edges(spans).select("from_service", "to_service", "observations")
