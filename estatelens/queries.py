"""One query per operator over the driver's tables, with the same question in plain SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens.common import cut_lineage, shared_folder
from estatelens.functions import assets as A
from estatelens.functions import dims, naming
from estatelens.functions.mosca import EO_14412, IR_8547_DRAFT, MIGRATION_YEARS
from estatelens.operators import changes, evidence, export, intake, ledger, order, ranking, reach, scope, signing, store, traces, views
from estatelens.plans import synth
from estatelens.sources import binaries, inventories, text_files
from estatelens.streaming import live, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The SQL side: shared common table expressions

_MODALITIES = ", ".join(f"('{m}', CAST({c} AS DOUBLE), {g}, {sum(x[2] == g for x in dims.MODALITIES[:k])}, {str(d).lower()}, {str(p).lower()})" for k, (m, c, g, d, p) in enumerate(dims.MODALITIES))
_FOUND = f"""dim AS (SELECT * FROM (VALUES {_MODALITIES}) AS t(modality, ceiling, grp, grp_ord, deployment, capability)),
f0 AS ({synth.as_sql("lineitem", synth.FINDINGS)}),
f1 AS (SELECT *, substr(sha256(concat('{{"parameters":', parameters, ',"primitive":"', primitive, '","purpose":"', purpose, '"}}')), 1, 32) AS asset_id FROM f0),
found AS (SELECT *, substr(sha256(concat('{{"assetId":"', asset_id, '","controlClass":"', control_class, '","systemId":"', system_id, '"}}')), 1, 24) AS occurrence_id FROM f1)"""
_TALLY = f"""{_FOUND},
tally AS (SELECT occurrence_id, system_id, asset_id, control_class, f.modality, ceiling, grp, grp_ord, count(*) AS n FROM found f JOIN dim USING (modality) GROUP BY ALL)"""


def _occurrences(source: str = "found", name: str = "occ") -> str:
    miss = " * ".join(["1.0", *(f"(1.0 - coalesce(max(ceiling) FILTER (WHERE grp = {g}), 0.0))" for g in range(dims.GROUPS))])
    return f"""{name}_m AS (SELECT occurrence_id, system_id, asset_id, control_class, modality, count(*) AS n FROM {source} GROUP BY ALL),
{name}_a AS (SELECT occurrence_id, count(DISTINCT assumption) AS n_assumptions, coalesce(string_agg(DISTINCT assumption, '; ' ORDER BY assumption), '') AS assumption_text FROM {source} GROUP BY 1),
{name}_c AS (SELECT occurrence_id, system_id, asset_id, control_class, CAST(sum(n) AS BIGINT) AS n_evidence, string_agg(modality, ',' ORDER BY modality) AS modalities, floor((1.0 - CAST({miss} AS DOUBLE)) * 10000.0 + 0.5) / 10000.0 AS confidence
  FROM {name}_m JOIN dim USING (modality) GROUP BY 1, 2, 3, 4),
{name} AS (SELECT c.*, n_assumptions, assumption_text, n_assumptions > 0 AS tainted,
  CASE WHEN n_assumptions = 0 AND confidence >= 0.85 THEN 'CONFIRMED' WHEN confidence >= 0.5 THEN 'OBSERVED' ELSE 'SUSPECTED' END AS level FROM {name}_c c JOIN {name}_a USING (occurrence_id))"""


_OCC = f"{_FOUND}, {_occurrences()}"
_BITS = "CAST(regexp_extract(parameters, ':([0-9]+)', 1) AS INT)"
_ASSETS = f"""assets AS (SELECT DISTINCT asset_id, primitive, parameters, purpose,
  CASE WHEN primitive IN ('ML-KEM') THEN false WHEN primitive IN ('RSA', 'ECDSA', 'ECDH', 'X25519', 'MD5') THEN true WHEN primitive = 'AES' THEN {_BITS} < 256 ELSE {_BITS} / 2 < 128 END AS quantum_vulnerable,
  CASE WHEN primitive = 'RSA' THEN CASE WHEN {_BITS} >= 3072 THEN 128 WHEN {_BITS} >= 2048 THEN 112 ELSE 80 END WHEN primitive = 'ECDSA' THEN 128 WHEN primitive = 'ECDH' THEN 192 WHEN primitive = 'X25519' THEN 128
    WHEN primitive = 'AES' THEN {_BITS} WHEN primitive = 'SHA2' THEN 128 WHEN primitive = 'MD5' THEN 0 END AS security_bits,
  CASE primitive WHEN 'RSA' THEN '{dims.OIDS["RSA"]}' WHEN 'ECDSA' THEN '{dims.OIDS["ECDSA"]}' WHEN 'X25519' THEN '{dims.OIDS["X25519"]}' WHEN 'MD5' THEN '{dims.OIDS["MD5"]}' WHEN 'ML-KEM' THEN '{dims.OIDS["ML-KEM"]}' END AS oid,
  CASE WHEN parameters = '{{}}' THEN primitive ELSE concat(primitive, '(', replace(replace(replace(replace(parameters, '{{', ''), '}}', ''), '"', ''), ':', '='), ')') END AS asset_name,
  CASE WHEN purpose IN ('KEY_ESTABLISHMENT', 'DATA_ENCRYPTION') THEN 'CONFIDENTIALITY' ELSE 'AUTHENTICITY' END AS track FROM found)"""
_YEARS = "CASE control_class " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in MIGRATION_YEARS.items()) + " END"


def _ranked(pack, name: str, source: str = "occ") -> str:
    deadline = lambda d: "CAST(NULL AS DOUBLE)" if d is None else f"CAST({d} AS DOUBLE)"
    return f"""{name}_s AS (SELECT o.*, {synth.REACHABLE} AS reachable, {synth.VIA} AS via, asset_name, primitive, purpose, track, CASE WHEN track = 'CONFIDENTIALITY' THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x, {_YEARS} AS y,
  CASE WHEN track = 'CONFIDENTIALITY' THEN {deadline(pack.confidentiality_deadline)} ELSE {deadline(pack.authenticity_deadline)} END AS deadline FROM {source} o JOIN assets a USING (asset_id) WHERE quantum_vulnerable),
{name}_r AS (SELECT *, CAST({pack.crqc_year - synth.NOW_YEAR} AS DOUBLE) - (x + y) AS raw_crqc, deadline - CAST({synth.NOW_YEAR} AS DOUBLE) - y AS raw_reg FROM {name}_s),
{name}_b AS (SELECT *, coalesce(raw_reg <= raw_crqc, false) AS by_date FROM {name}_r),
{name} AS (SELECT *, floor(raw_crqc * 100.0 + 0.5) / 100.0 AS crqc_slack, floor(raw_reg * 100.0 + 0.5) / 100.0 AS regulatory_slack, CASE WHEN by_date THEN 'REGULATORY' ELSE 'CRQC' END AS binding,
  floor((CASE WHEN by_date THEN raw_reg ELSE raw_crqc END) * 100.0 + 0.5) / 100.0 AS slack_years, (CASE WHEN by_date THEN raw_reg ELSE raw_crqc END) < 0 AS late, coalesce(via, 'UNANALYZED') AS reached_via,
  CASE WHEN level = 'SUSPECTED' THEN 'hints' WHEN reachable = false THEN 'unreached' ELSE lower(track) END AS bucket FROM {name}_b)"""


# The Spark side: shared inputs


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.identified(synth.findings(spark, sf_dir))


def _occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.occurrences(_found(spark, sf_dir))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.assets(_found(spark, sf_dir))


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings' counts, read once for all parts of a query."""
    return evidence.folded(synth.findings(spark, sf_dir))


def _ranking(spark: SparkSession, sf_dir: str, pack=EO_14412, fold: DataFrame | None = None) -> DataFrame:
    fold = _fold(spark, sf_dir) if fold is None else fold
    return ranking.ranked(synth.with_reach(evidence.occurrences(fold)), evidence.assets(fold), pack, synth.NOW_YEAR)


# E: grouping and confidence


@query("e1_assemble", f"WITH {_FOUND} SELECT occurrence_id, count(*) AS n_evidence, sha256(string_agg(concat(modality, '|', locator, '|', raw), ';' ORDER BY modality, locator, raw)) AS evidence_digest FROM found GROUP BY 1")
def e1(spark, sf):
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["modality"], e["locator"], e["raw"])), ";")
    return evidence.assembled(_found(spark, sf)).select("occurrence_id", F.size("evidence").cast("long").alias("n_evidence"), F.sha2(shown, 256).alias("evidence_digest"))


@query("e2_modality_tally", f"WITH {_TALLY} SELECT occurrence_id, modality, n, grp FROM tally")
def e2(spark, sf):
    return evidence.modality_tally(_found(spark, sf)).select("occurrence_id", "modality", "n", "grp")


@query("e3_group_winners", f"WITH {_TALLY} SELECT occurrence_id, grp, arg_max(modality, ceiling * 100 - grp_ord) AS contributing, max(ceiling) AS ceiling, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - 1 AS BIGINT) AS suppressed FROM tally GROUP BY 1, 2")
def e3(spark, sf):
    return evidence.group_winners(evidence.modality_tally(_found(spark, sf)))


@query("e4_confidence", f"WITH {_OCC} SELECT occurrence_id, system_id, asset_id, control_class, n_evidence, modalities, confidence, tainted FROM occ")
def e4(spark, sf):
    return _occ(spark, sf).select("occurrence_id", "system_id", "asset_id", "control_class", "n_evidence", F.array_join("modalities", ",").alias("modalities"), "confidence", "tainted")


@query("e5_cited_evidence", f"""WITH {_TALLY}, win AS (SELECT occurrence_id, grp, arg_max(modality, ceiling * 100 - grp_ord) AS modality FROM tally GROUP BY 1, 2),
 r AS (SELECT occurrence_id, grp, modality, locator, raw, row_number() OVER (PARTITION BY occurrence_id, grp ORDER BY locator, raw) AS ord FROM found JOIN win USING (occurrence_id, modality)) SELECT * FROM r WHERE ord <= 5""")
def e5(spark, sf):
    return evidence.cited(_found(spark, sf))


_NODES = f"""{_TALLY}, {_occurrences()}, win AS (SELECT occurrence_id, grp, arg_max(modality, ceiling * 100 - grp_ord) AS modality, max(ceiling) AS ceiling FROM tally GROUP BY 1, 2),
 placed AS (SELECT *, row_number() OVER (PARTITION BY occurrence_id ORDER BY grp) - 1 AS place, count(*) OVER (PARTITION BY occurrence_id) AS n FROM win),
 leaf AS (SELECT occurrence_id, place, modality, locator, row_number() OVER (PARTITION BY occurrence_id, grp ORDER BY locator, raw) AS ord FROM found JOIN placed USING (occurrence_id, modality)),
 guess AS (SELECT occurrence_id, assumption, row_number() OVER (PARTITION BY occurrence_id ORDER BY assumption) - 1 AS k FROM (SELECT DISTINCT occurrence_id, assumption FROM found WHERE assumption IS NOT NULL)),
 nodes AS (SELECT occurrence_id AS root_id, 'f' AS address, 'INFERENCE' AS kind, 'noisy-OR across independent evidence groups' AS label, confidence AS value FROM occ
 UNION ALL SELECT occurrence_id, concat('f.', CAST(place AS STRING)), 'INFERENCE', concat('group ', CAST(grp AS STRING), ': ', modality), ceiling FROM placed
 UNION ALL SELECT occurrence_id, concat('f.', CAST(place AS STRING), '.', CAST(ord - 1 AS STRING)), 'EVIDENCE', concat(modality, ' ', locator), 1.0 FROM leaf WHERE ord <= 5
 UNION ALL SELECT g.occurrence_id, concat('f.', CAST(n + k AS STRING)), 'ASSUMPTION', assumption, 1.0 FROM guess g JOIN (SELECT DISTINCT occurrence_id, n FROM placed) USING (occurrence_id))"""


@query("c7_factor_nodes", f"WITH {_NODES} SELECT root_id, address, kind, label, value, kind = 'ASSUMPTION' OR (address = 'f' AND root_id IN (SELECT occurrence_id FROM guess)) AS tainted, kind <> 'INFERENCE' AS is_evidence FROM nodes")
def c7_nodes(spark, sf):
    return evidence.addressed(evidence.factor_nodes(_found(spark, sf))).select("root_id", "address", "kind", "label", "value", "tainted", "is_evidence")


@query("c14_redacted_nodes", f"WITH {_NODES} SELECT root_id, address, replace(replace(replace(label, 'file-11', '(out of scope)'), 'guess-1', '(out of scope)'), 'file-3', '(out of scope)') AS label FROM nodes")
def c14_nodes(spark, sf):
    hidden = spark.createDataFrame([("file-3",), ("guess-1",), ("file-11",)], "name string")
    return evidence.redacted_nodes(evidence.addressed(evidence.factor_nodes(_found(spark, sf))), hidden).select("root_id", "address", "label")


@query("c5_assertion_levels", f"""WITH {_OCC} SELECT occurrence_id, level, CASE WHEN tainted THEN concat('provenance tainted by ', n_assumptions, ' assumption(s): ', assumption_text) WHEN confidence < 0.85 THEN concat('confidence ', CAST(confidence AS STRING), ' below confirm threshold 0.85') END AS downgrade_reason FROM occ""")
def c5(spark, sf):
    return _occ(spark, sf).select("occurrence_id", "level", "downgrade_reason")


@query("flagship_levels", f"WITH {_OCC} SELECT control_class, level, count(*) AS occurrences, count(*) FILTER (WHERE tainted) AS tainted FROM occ GROUP BY 1, 2")
def flagship(spark, sf):
    return evidence.level_summary(_occ(spark, sf))


@query("e2x_rollup_levels", f"WITH {_OCC} SELECT system_id, control_class, count(*) AS occurrences, count(*) FILTER (WHERE level = 'CONFIRMED') AS confirmed FROM occ GROUP BY ROLLUP (system_id, control_class)")
def rollup(spark, sf):
    return _occ(spark, sf).rollup("system_id", "control_class").agg(F.count("*").alias("occurrences"), F.count_if(F.col("level") == "CONFIRMED").alias("confirmed"))


@query("c4_assets", f"WITH {_FOUND}, {_ASSETS} SELECT asset_id, primitive, parameters, purpose, quantum_vulnerable, security_bits, oid, asset_name, track FROM assets")
def c4(spark, sf):
    return _assets(spark, sf)


@query("c7_factor_trees", f"""WITH {_TALLY}, w AS (SELECT occurrence_id, grp, arg_max(modality, ceiling * 100 - grp_ord) AS modality FROM tally GROUP BY 1, 2),
 g AS (SELECT occurrence_id, count(*) AS n_groups, sum(least(5, n)) AS n_leaves FROM w JOIN tally t USING (occurrence_id, modality) GROUP BY 1), a AS (SELECT occurrence_id, count(DISTINCT assumption) AS k FROM found GROUP BY 1)
 SELECT occurrence_id AS root_id, CAST(1 + n_groups + n_leaves + k AS BIGINT) AS n_nodes, 2 AS depth, k > 0 AS tainted, CAST(n_leaves AS BIGINT) AS n_citations FROM g JOIN a USING (occurrence_id)""")
def c7(spark, sf):
    return evidence.explained(evidence.factor_nodes(_found(spark, sf))).select("root_id", "n_nodes", "depth", "tainted", "n_citations")


_ANSWER = f"""side AS (SELECT occurrence_id, system_id, asset_id, bool_or(deployment) AS d, bool_or(capability) AS c FROM tally JOIN (SELECT modality, deployment, capability FROM dim) USING (modality) GROUP BY 1, 2, 3)"""


@query("c8_answers", f"WITH {_TALLY}, {_ANSWER} SELECT occurrence_id, CASE WHEN d AND c THEN 'BOTH' WHEN d THEN 'DEPLOYED' WHEN c THEN 'CAPABLE' ELSE 'NEITHER' END AS answer FROM side")
def c8(spark, sf):
    return _occ(spark, sf).select("occurrence_id", views.answer(F.col("modalities")).alias("answer"))


@query("c10_corroboration", f"WITH {_OCC}, m AS (SELECT occurrence_id, max(ceiling) AS top FROM occ_m JOIN dim USING (modality) GROUP BY 1) SELECT occurrence_id, confidence >= 0.85 AND top < 0.85 AS needs FROM occ JOIN m USING (occurrence_id)")
def c10(spark, sf):
    return _occ(spark, sf).select("occurrence_id", evidence.requires_corroboration(F.col("modalities"), F.col("confidence")).alias("needs"))


# K1, I8, F: worklists


@query("i8_slack", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT occurrence_id, x, y, crqc_slack, regulatory_slack, binding, slack_years, late FROM r")
def i8(spark, sf):
    return _ranking(spark, sf).select("occurrence_id", "x", "y", "crqc_slack", "regulatory_slack", "binding", "slack_years", "late")


@query("k1_worklists", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT occurrence_id, bucket, asset_name, reached_via, slack_years, late, row_number() OVER (PARTITION BY bucket ORDER BY slack_years, occurrence_id) AS place FROM r")
def k1(spark, sf):
    return ranking.placed(_ranking(spark, sf)).select("occurrence_id", "bucket", "asset_name", "reached_via", "slack_years", "late", "place")


@query("e6_headline", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')}, h AS (SELECT count(*) AS working, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE level = 'CONFIRMED') AS confirmed FROM r WHERE bucket IN ('confidentiality', 'authenticity'))
 SELECT *, CASE WHEN working = 0 THEN 0.0 ELSE floor(late / working * 10000.0 + 0.5) / 10000.0 END AS late_share, CASE WHEN working = 0 THEN 0.0 ELSE floor(confirmed / working * 10000.0 + 0.5) / 10000.0 END AS confirmed_share FROM h""")
def e6(spark, sf):
    return ranking.headline(_ranking(spark, sf))


@query("k3_rerank_moved", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')}, {_ranked(IR_8547_DRAFT, 'q')} SELECT occurrence_id, r.bucket, r.asset_name, r.system_id, q.slack_years AS slack_before, q.binding AS binding_before, r.slack_years AS slack_after, r.binding AS binding_after
 FROM r JOIN q USING (occurrence_id) WHERE r.bucket IN ('confidentiality', 'authenticity') AND (q.slack_years <> r.slack_years OR q.binding <> r.binding)""")
def k3(spark, sf):
    fold = _fold(spark, sf)
    return ranking.moved(_ranking(spark, sf, IR_8547_DRAFT, fold), _ranking(spark, sf, fold=fold)).select("occurrence_id", "bucket", "asset_name", "system_id", "slack_before", "binding_before", "slack_after", "binding_after")


@query("m_override_years", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r', "(SELECT * FROM occ)").replace(_YEARS, "CASE WHEN control_class = 'HARDWARE' THEN CAST(9.5 AS DOUBLE) ELSE " + _YEARS + " END")} SELECT occurrence_id, y, slack_years FROM r""")
def m_override(spark, sf):
    overrides = spark.createDataFrame([("HARDWARE", 9.5)], "control_class string, migration_years double")
    return ranking.ranked(synth.with_reach(_occ(spark, sf)), _assets(spark, sf), EO_14412, synth.NOW_YEAR, overrides=overrides).select("occurrence_id", "y", "slack_years")


@query("k8_tickets", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT occurrence_id, bucket, slack_years, late, concat('Replace ', asset_name, ' in ', system_id) AS title FROM r WHERE level = 'CONFIRMED' AND bucket IN ('confidentiality', 'authenticity') ORDER BY CASE bucket WHEN 'confidentiality' THEN 0 ELSE 1 END, slack_years, occurrence_id LIMIT 25")
def k8(spark, sf):
    return ranking.tickets(_ranking(spark, sf)).drop("track_order")


@query("f5_run_packages", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')}, l AS (SELECT *, lag(struct_pack(control_class, late, slack_years, binding)) OVER w AS p FROM r WINDOW w AS (PARTITION BY bucket, system_id ORDER BY slack_years, occurrence_id))
 SELECT occurrence_id, CAST(sum(CASE WHEN p IS NOT DISTINCT FROM struct_pack(control_class, late, slack_years, binding) THEN 0 ELSE 1 END) OVER (PARTITION BY bucket, system_id ORDER BY slack_years, occurrence_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM l""")
def f5(spark, sf):
    return order.runs(_ranking(spark, sf), ["slack_years", "occurrence_id"], ["control_class", "late", "slack_years", "binding"], ["bucket", "system_id"]).select("occurrence_id", "run")


@query("f6_systematic_sample", f"""WITH {_OCC}, n AS (SELECT occurrence_id, system_id, row_number() OVER (PARTITION BY system_id ORDER BY occurrence_id) - 1 AS k, count(*) OVER (PARTITION BY system_id) AS n FROM occ) SELECT occurrence_id, system_id FROM n WHERE k % greatest(1, n // 30) = 0 AND k // greatest(1, n // 30) < 30""")
def f6(spark, sf):
    return order.systematic_sample(_occ(spark, sf).select("occurrence_id", "system_id"), ["occurrence_id"], partition=["system_id"])


@query("f6_estate_sample", f"""WITH {_OCC}, n AS (SELECT occurrence_id, row_number() OVER (ORDER BY occurrence_id) - 3 AS k, count(*) OVER () AS n FROM occ) SELECT occurrence_id FROM n WHERE k >= 0 AND k % greatest(1, n // 30) = 0 AND k // greatest(1, n // 30) < 30""")
def f6_estate(spark, sf):
    return order.systematic_sample(_occ(spark, sf).select("occurrence_id"), ["occurrence_id"], offset=2)


@query("f4_estate_places", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT occurrence_id, row_number() OVER (ORDER BY slack_years, occurrence_id) AS place, count(*) OVER () AS total FROM r""")
def f4_estate(spark, sf):
    return order.numbered(_ranking(spark, sf), ["slack_years", "occurrence_id"]).select("occurrence_id", "place", "total")


@query("k2_track_worklist", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT occurrence_id, slack_years, binding FROM r WHERE bucket = 'authenticity'")
def k2(spark, sf):
    return _ranking(spark, sf).filter("bucket = 'authenticity'").select("occurrence_id", "slack_years", "binding")


@query("c18_labels", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT occurrence_id, CASE WHEN late THEN concat('late by ', printf('%.1f', abs(slack_years)), ' years') ELSE concat('due in ', printf('%.1f', abs(slack_years)), ' years') END AS due, CASE WHEN binding = 'REGULATORY' THEN 'a fixed deadline' WHEN x > 0 THEN 'data recorded today must stay secret' ELSE 'the assumed arrival of quantum computers' END AS driver FROM r")
def c18(spark, sf):
    return ranking.labelled(_ranking(spark, sf)).select("occurrence_id", "due", "driver")


@query("e21_overdue_by_control", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT control_class, count(*) AS overdue FROM r WHERE late AND bucket IN ('confidentiality', 'authenticity') GROUP BY 1")
def e21(spark, sf):
    return ranking.overdue_by_control(_ranking(spark, sf))


_WORK = "bucket IN ('confidentiality', 'authenticity')"


@query("e21_confirmed_overdue", f"WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT control_class, count(*) AS overdue FROM r WHERE late AND level = 'CONFIRMED' AND {_WORK} GROUP BY 1")
def e21_confirmed(spark, sf):
    return ranking.confirmed_overdue_by_control(_ranking(spark, sf))


@query("e21_domain_years", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')}
 SELECT CAST(ceil(greatest(6.0, max(x + y), {round(EO_14412.crqc_year - synth.NOW_YEAR, 2)}::DOUBLE, max(floor((deadline - {synth.NOW_YEAR}::DOUBLE) * 100.0 + 0.5) / 100.0))) AS BIGINT) AS domain_years FROM r WHERE {_WORK}""")
def e21_domain(spark, sf):
    return ranking.domain_years(_ranking(spark, sf))


@query("e21_tallies", f"""WITH {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')} SELECT count(*) AS found, count(*) FILTER (WHERE {_WORK} AND level <> 'CONFIRMED') AS observed_only,
 {", ".join(f"count(*) FILTER (WHERE bucket = '{b}' AND level = 'CONFIRMED') AS {b}_confirmed, count(*) FILTER (WHERE bucket = '{b}' AND level = 'CONFIRMED' AND late) AS {b}_late" for b in ("confidentiality", "authenticity"))} FROM r""")
def e21_tallies(spark, sf):
    return ranking.tallies(_ranking(spark, sf))


@query("e20_histograms", f"WITH {_FOUND} SELECT 'modality' AS dimension, modality AS value, count(*) AS n FROM found GROUP BY 2 UNION ALL SELECT 'primitive', primitive, count(*) FROM found GROUP BY 2")
def e20(spark, sf):
    return evidence.histograms(synth.findings(spark, sf))


# Changes and the gate

_BOTH = f"""{_FOUND}, fa AS (SELECT * FROM found WHERE collected_at < TIMESTAMP '2000-01-01'), fb AS (SELECT * FROM found WHERE collected_at >= TIMESTAMP '1996-01-01'), {_occurrences("fa", "a")}, {_occurrences("fb", "b")}"""
_DIFF = f"""{_BOTH}, j AS (SELECT coalesce(b.occurrence_id, a.occurrence_id) AS occurrence_id, a.occurrence_id AS ao, b.occurrence_id AS bo, a.level AS al, b.level AS bl, string_split(a.modalities, ',') AS am, string_split(b.modalities, ',') AS bm FROM a FULL JOIN b ON a.occurrence_id = b.occurrence_id),
 k AS (SELECT *, list_filter(bm, lambda x: NOT list_contains(am, x)) AS fresh, list_position(['SUSPECTED', 'OBSERVED', 'CONFIRMED'], bl) - list_position(['SUSPECTED', 'OBSERVED', 'CONFIRMED'], al) AS delta FROM j),
 d AS (SELECT occurrence_id, CASE WHEN ao IS NULL THEN 'APPEARED' WHEN bo IS NULL THEN 'REMEDIATED' WHEN delta <> 0 OR len(fresh) > 0 THEN 'RECLASSIFIED' ELSE 'UNCHANGED' END AS kind,
  CASE WHEN ao IS NULL THEN 'not present in the previous scan' WHEN bo IS NULL THEN 'no longer found: the code changed, or the scan no longer reaches it' WHEN delta > 0 THEN concat('assertion rose ', al, ' -> ', bl) WHEN delta < 0 THEN concat('assertion fell ', al, ' -> ', bl)
   WHEN len(fresh) > 0 THEN concat('corroborated by a new modality: ', array_to_string(list_sort(fresh), ', ')) ELSE 'no material change' END AS reason FROM k)"""


def _diff(spark, sf):
    found = _found(spark, sf)
    before, after = found.filter("collected_at < timestamp '2000-01-01'"), found.filter("collected_at >= timestamp '1996-01-01'")
    return changes.diff(evidence.occurrences(before), evidence.occurrences(after), evidence.assets(found))


@query("k6_scan_diff", f"WITH {_DIFF} SELECT * FROM d")
def k6(spark, sf):
    return _diff(spark, sf).select("occurrence_id", "kind", "reason")


@query("e7_diff_counts", f"WITH {_DIFF}, kinds AS (SELECT unnest([{_quoted(changes.KINDS)}]) AS kind) SELECT kind, count(occurrence_id) AS n FROM kinds LEFT JOIN d USING (kind) GROUP BY 1")
def e7(spark, sf):
    return changes.diff_counts(_diff(spark, sf))


_GATE = f"""{_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')}, blocking AS (SELECT * FROM r WHERE level = 'CONFIRMED' AND reachable = true AND reached_via <> 'LIBRARY_SURFACE' AND bucket IN ('confidentiality', 'authenticity')),
 sup AS (SELECT occurrence_id, TIMESTAMP '2026-01-01' + INTERVAL 1 DAY * CAST(ascii(substr(occurrence_id, 2, 1)) AS INT) * 4 AS expires_at FROM occ WHERE substr(occurrence_id, 3, 1) IN ('0', '1', '2')),
 acc AS (SELECT occurrence_id FROM occ WHERE substr(occurrence_id, 3, 1) IN ('2', '3', '4', '5'))"""
_AT = "TIMESTAMP '2026-08-28 00:00:00'"


def _baseline(fold):
    occ = evidence.occurrences(fold)
    days = F.expr("ascii(substr(occurrence_id, 2, 1)) * 4")
    suppressions = occ.filter("substr(occurrence_id, 3, 1) in ('0', '1', '2')").select("occurrence_id", F.expr("timestamp '2026-01-01'").alias("t"), days.alias("d")).select("occurrence_id", F.timestamp_micros(F.unix_micros("t") + F.col("d") * 86_400_000_000).alias("expires_at"), F.lit("planned for the next release").alias("reason"))
    return suppressions, occ.filter("substr(occurrence_id, 3, 1) in ('2', '3', '4', '5')").select("occurrence_id"), F.expr("timestamp '2026-08-28 00:00:00'")


@query("k13_build_gate", f"WITH {_GATE}, live AS (SELECT * FROM sup WHERE expires_at > {_AT} AND occurrence_id IN (SELECT occurrence_id FROM r)) SELECT occurrence_id, CASE WHEN occurrence_id IN (SELECT occurrence_id FROM live) THEN 'suppressed' WHEN occurrence_id IN (SELECT occurrence_id FROM acc) THEN 'accepted' ELSE 'introduced' END AS outcome FROM blocking")
def k13(spark, sf):
    fold = _fold(spark, sf)
    suppressions, accepted, now = _baseline(fold)
    return changes.gate(cut_lineage(_ranking(spark, sf, fold=fold), "ranked"), accepted, suppressions, now).select("occurrence_id", "outcome")


@query("d5_suppression_states", f"WITH {_GATE} SELECT occurrence_id, CASE WHEN expires_at <= {_AT} THEN 'expired' WHEN occurrence_id NOT IN (SELECT occurrence_id FROM r) THEN 'stale' ELSE 'live' END AS state FROM sup")
def d5(spark, sf):
    fold = _fold(spark, sf)
    suppressions, _, now = _baseline(fold)
    return changes.suppression_state(suppressions, _ranking(spark, sf, fold=fold), now).select("occurrence_id", "state")


@query("d5_resolved", f"WITH {_GATE} SELECT occurrence_id FROM acc WHERE occurrence_id NOT IN (SELECT occurrence_id FROM r)")
def d5_resolved(spark, sf):
    fold = _fold(spark, sf)
    return changes.resolved(_ranking(spark, sf, fold=fold), _baseline(fold)[1])


@query("b7_rebaseline", f"WITH {_GATE} SELECT DISTINCT occurrence_id FROM blocking WHERE occurrence_id NOT IN (SELECT occurrence_id FROM sup WHERE expires_at > {_AT})")
def b7(spark, sf):
    fold = _fold(spark, sf)
    suppressions, _, now = _baseline(fold)
    return changes.rebaseline(_ranking(spark, sf, fold=fold), suppressions, now)[0]


@query("c9_blocking", f"WITH {_GATE} SELECT occurrence_id FROM r WHERE level = 'CONFIRMED' AND reachable = true")
def c9(spark, sf):
    return changes.blocking(_ranking(spark, sf), include_library_surface=True).select("occurrence_id")


# Views and coverage

_SIDES = f"{_TALLY}, {_ANSWER}, s AS (SELECT system_id, asset_id, bool_or(d) AS d, bool_or(c) AS c FROM side GROUP BY 1, 2)"


@query("e12_system_views", f"WITH {_SIDES} SELECT system_id, count(*) FILTER (WHERE d) AS deployed, count(*) FILTER (WHERE c) AS capable, count(*) FILTER (WHERE d AND NOT c) AS deployed_only, count(*) FILTER (WHERE c AND NOT d) AS capable_only, count(*) FILTER (WHERE d AND c) AS corroborated FROM s GROUP BY 1")
def e12(spark, sf):
    return views.system_views(_occ(spark, sf))


# evidence of deployment counts as capability for some assets, and the other way for others, so that both sides differ
_ONLY = [next(m for m in one if m not in other) for one, other in ((dims.CAPABILITY, dims.DEPLOYMENT), (dims.DEPLOYMENT, dims.CAPABILITY))]
_SWAPPED = f"CASE WHEN modality IN ({_quoted(dims.DEPLOYMENT)}) AND asset_id < '5' THEN '{_ONLY[0]}' WHEN modality IN ({_quoted(dims.CAPABILITY)}) AND asset_id > 'c' THEN '{_ONLY[1]}' ELSE modality END"


@query("k7_divergences", f"WITH {_FOUND}, tally AS (SELECT DISTINCT occurrence_id, system_id, asset_id, {_SWAPPED} AS modality FROM found), {_ANSWER}, s AS (SELECT system_id, asset_id, bool_or(d) AS d, bool_or(c) AS c FROM side GROUP BY 1, 2), {_ASSETS}, ok AS (SELECT system_id FROM s GROUP BY 1 HAVING bool_or(d) AND bool_or(c)) SELECT system_id, CASE WHEN d AND NOT c THEN 'DEPLOYED_WITHOUT_SOURCE' ELSE 'CAPABLE_BUT_NOT_OBSERVED' END AS kind, asset_id, asset_name FROM s JOIN ok USING (system_id) JOIN assets USING (asset_id) WHERE d <> c")
def k7(spark, sf):
    fold = _fold(spark, sf)
    ids = evidence.identified(fold)
    return views.divergences(evidence.occurrences(ids.withColumn("modality", F.expr(_SWAPPED)).select(*fold.columns)), evidence.assets(fold))


_CLASSES = ", ".join(f"('{c}', '{m}')" for c, every in dims.ESTATE_CLASSES for m in every)
_COVER = f"""{_OCC}, classes AS (SELECT * FROM (VALUES {_CLASSES}) AS t(class, modality)), seen AS (SELECT class, f.* FROM found f JOIN classes USING (modality) WHERE primitive <> 'MD5' AND modality NOT LIKE 'BINARY%'),
 report AS (SELECT c.class, count(DISTINCT occurrence_id) > 0 AS examined, count(DISTINCT occurrence_id) AS occurrences, count(DISTINCT asset_id) AS assets, count(DISTINCT system_id) AS systems, coalesce(string_agg(DISTINCT seen.modality, ',' ORDER BY seen.modality), '') AS modalities FROM (SELECT DISTINCT class FROM classes) c LEFT JOIN seen USING (class) GROUP BY 1)"""


def _coverage(spark, sf):
    return views.coverage(evidence.occurrences(_found(spark, sf).filter("primitive <> 'MD5' and modality not like 'BINARY%'")))


@query("e13_coverage", f"WITH {_COVER} SELECT * FROM report")
def e13(spark, sf):
    return _coverage(spark, sf)


@query("e14_coverage_statement", f"WITH {_COVER} SELECT count(*) FILTER (WHERE examined) AS examined, count(*) AS classes, concat(count(*) FILTER (WHERE examined), ' of ', count(*), ' estate classes examined', CASE WHEN bool_and(examined) THEN '' ELSE concat('; not examined: ', string_agg(class, ', ' ORDER BY class) FILTER (WHERE NOT examined)) END) AS statement FROM report")
def e14(spark, sf):
    return views.coverage_statement(_coverage(spark, sf))


@query("k11_service_coverage", f"""WITH sp AS ({synth.as_sql("events", synth.SPANS)}), t AS (SELECT DISTINCT replace(service, 'svc', 'sys') AS service FROM sp), c AS (SELECT DISTINCT concat('sys-', lpad(CAST(l_suppkey % 40 + 5 AS STRING), 2, '0')) AS service FROM lineitem)
 SELECT coalesce(t.service, c.service) AS service, CASE WHEN t.service IS NULL THEN 'scanned_without_traffic' WHEN c.service IS NULL THEN 'unscanned' ELSE 'scanned' END AS state FROM t FULL JOIN c ON t.service = c.service""")
def k11(spark, sf):
    return views.service_coverage(synth.spans(spark, sf).select(F.regexp_replace("service", "svc", "sys")), synth.findings(spark, sf).select(F.expr("concat('sys-', lpad(cast(int(substr(system_id, 5)) + 5 as string), 2, '0'))")))


_CLAIMS = f"""{_FOUND}, {_ASSETS}, claims AS (SELECT concat('sys-', lpad(CAST(s_suppkey % 40 + 10 AS STRING), 2, '0')) AS system_id, asset_id, CASE WHEN s_suppkey % 40 < 20 THEN 'available' ELSE 'evaluating' END AS roadmap
  FROM supplier JOIN (SELECT asset_id, primitive, row_number() OVER (ORDER BY asset_id) - 1 AS k FROM assets) a ON s_suppkey % 7 = k % 7)"""


@query("k14_reconcile", f"""WITH {_CLAIMS}, said AS (SELECT DISTINCT system_id, asset_id FROM claims), sys AS (SELECT system_id, bool_or(roadmap = 'available') AS av FROM claims GROUP BY 1),
 seen AS (SELECT system_id, asset_id, string_agg(DISTINCT modality, ',' ORDER BY modality) AS observed_by FROM found JOIN sys USING (system_id) WHERE modality <> 'ASSERTED' GROUP BY 1, 2)
 SELECT system_id, asset_id, CASE WHEN observed_by IS NULL THEN 'UNVERIFIED' WHEN said_it IS NULL THEN 'UNDISCLOSED' WHEN av AND quantum_vulnerable AND purpose IN ('KEY_ESTABLISHMENT', 'DATA_ENCRYPTION') THEN 'CONTRADICTED_ROADMAP' ELSE 'CORROBORATED' END AS verdict, coalesce(observed_by, '') AS observed_by
 FROM (SELECT coalesce(s.system_id, o.system_id) AS system_id, coalesce(s.asset_id, o.asset_id) AS asset_id, s.asset_id AS said_it, observed_by FROM said s FULL JOIN seen o ON s.system_id = o.system_id AND s.asset_id = o.asset_id) JOIN sys USING (system_id) LEFT JOIN assets USING (asset_id)""")
def k14(spark, sf):
    found = _found(spark, sf)
    known = evidence.assets(found)
    numbered = order.numbered(known.select("asset_id"), ["asset_id"]).select("asset_id", (F.col("place") - 1).alias("k"))
    s = _table(spark, sf, "supplier").select("s_suppkey", F.expr("concat('sys-', lpad(cast(s_suppkey % 40 + 10 as string), 2, '0'))").alias("system_id"))
    claims = s.join(numbered, F.expr("s_suppkey % 7 = k % 7")).select("system_id", "asset_id", F.expr("case when s_suppkey % 40 < 20 then 'available' else 'evaluating' end").alias("roadmap"))
    return views.reconcile(claims, found, known)


@query("i10_migration_estimates", """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'committed' WHEN 2 THEN 'evaluating' ELSE 'none' END AS status, CASE WHEN s_suppkey % 3 > 0 THEN CAST(2026 + (s_suppkey % 5) AS DOUBLE) END AS avail, s_suppkey % 5 = 0 AS hw FROM supplier),
 d AS (SELECT *, status = 'available' OR (status = 'committed' AND avail IS NOT NULL) AS dated, CASE WHEN hw THEN 2.0 ELSE 0.0 END AS more FROM s)
 SELECT s_suppkey, CASE WHEN status = 'available' THEN 0.5 + more WHEN dated THEN floor((greatest(0.0, floor((avail - 2026.66) * 100.0 + 0.5) / 100.0) + 0.5 + more) * 100.0 + 0.5) / 100.0 ELSE 6.0 + more END::DOUBLE AS years, CASE WHEN NOT dated THEN 'VENDOR_LOCKED' WHEN hw THEN 'HARDWARE' ELSE 'VENDOR_UPGRADEABLE' END AS control_class FROM d""")
def i10(spark, sf):
    s = _table(spark, sf, "supplier").select("s_suppkey", F.expr("case s_suppkey % 4 when 0 then 'available' when 1 then 'committed' when 2 then 'evaluating' else 'none' end").alias("status"), F.expr("case when s_suppkey % 3 > 0 then cast(2026 + (s_suppkey % 5) as double) end").alias("avail"), F.expr("s_suppkey % 5 = 0").alias("hw"))
    return s.select("s_suppkey", views.migration_estimate(F.col("status"), F.col("avail"), F.col("hw"), synth.NOW_YEAR).alias("e")).select("s_suppkey", "e.*")


@query("k15_lifetime_breaches", """WITH c AS (SELECT o_orderkey, o_orderdate + INTERVAL 12000 DAY AS t, o_orderkey % 3 > 0 AS vulnerable FROM orders),
 y AS (SELECT *, floor((year(t) + (epoch_us(t) - epoch_us(make_timestamp(year(t), 1, 1, 0, 0, 0.0))) / (epoch_us(make_timestamp(year(t) + 1, 1, 1, 0, 0, 0.0)) - epoch_us(make_timestamp(year(t), 1, 1, 0, 0, 0.0)))) * 100.0 + 0.5) / 100.0 AS year2 FROM c)
 SELECT o_orderkey, year2 AS not_after_year, floor((year2 - 2031.0) * 100.0 + 0.5) / 100.0 AS overhang FROM y WHERE vulnerable AND year2 > 2031.0""")
def k15(spark, sf):
    c = _table(spark, sf, "orders").select("o_orderkey", A.decimal_year(F.expr("cast(o_orderdate as timestamp) + interval 12000 days"), 2).alias("not_after_year"), F.expr("o_orderkey % 3 > 0").alias("vulnerable"))
    return inventories.lifetime_breaches(c, 2031.0).select("o_orderkey", "not_after_year", "overhang")


# Traces and stored scans

_EDGES = f"""sp AS ({synth.as_sql("events", synth.SPANS)}), pairs AS (SELECT p.service AS from_service, c.service AS to_service, c.operation, c.ord FROM sp c JOIN sp p ON c.parent_span_id = p.span_id WHERE p.service <> c.service),
 edges AS (SELECT from_service, to_service, count(*) AS observations, arg_min(operation, ord) AS operation FROM pairs GROUP BY 1, 2)"""


@query("d7_span_pairs", f"WITH {_EDGES} SELECT from_service, to_service, operation, ord FROM pairs")
def d7(spark, sf):
    return traces.span_pairs(synth.spans(spark, sf))


@query("k9_service_edges", f"WITH {_EDGES} SELECT * FROM edges")
def k9(spark, sf):
    return traces.service_edges(synth.spans(spark, sf))


@query("d8_trace_roots", f"WITH {_EDGES} SELECT DISTINCT service FROM sp WHERE parent_span_id = '' OR parent_span_id NOT IN (SELECT span_id FROM sp)")
def d8(spark, sf):
    return traces.trace_roots(synth.spans(spark, sf))


# the recursion keeps distinct (service, hops) and walks shortest paths only, so cycles end it
_REACH = f"""WITH RECURSIVE {_EDGES}, steps(service, hops) AS (SELECT 'svc-00', 0 UNION SELECT t.to_service, hops + 1 FROM steps w JOIN edges t ON w.service = t.from_service WHERE hops < 24),
 best AS (SELECT service, min(hops) AS hops FROM steps GROUP BY 1), down AS (SELECT from_service, to_service FROM edges JOIN best a ON a.service = from_service JOIN best b ON b.service = to_service WHERE b.hops = a.hops + 1),
 walk(service, hops, path) AS (SELECT 'svc-00', 0, ['svc-00'] UNION ALL SELECT to_service, hops + 1, list_append(path, to_service) FROM walk w JOIN down d ON w.service = d.from_service)"""


def _reached(spark, sf):
    return traces.reachable_services(traces.service_edges(synth.spans(spark, sf)), spark.createDataFrame([("svc-00",)], "service string"))


@query("j7_reachable_services", f"{_REACH} SELECT b.service, CAST(b.hops AS INT) AS hops, array_to_string(min(path), '>') AS path FROM best b JOIN walk w ON b.service = w.service AND b.hops = w.hops GROUP BY 1, 2")
def j7(spark, sf):
    return _reached(spark, sf).select("service", "hops", F.array_join("path", ">").alias("path"))


@query("j8_trace_reachability", f"""{_REACH}, {_OCC}, o AS (SELECT *, {synth.REACHABLE} AS reachable0, {synth.VIA} AS via0 FROM occ), b2 AS (SELECT replace(service, 'svc', 'sys') AS system_id, hops FROM best WHERE hops > 0)
 SELECT occurrence_id, CASE WHEN hops IS NOT NULL THEN true ELSE reachable0 END AS reachable, CASE WHEN hops IS NOT NULL THEN 'TRACE' ELSE via0 END AS via FROM o LEFT JOIN b2 USING (system_id)""")
def j8(spark, sf):
    services = _reached(spark, sf).withColumn("service", F.regexp_replace("service", "svc", "sys"))
    return traces.apply_trace_reachability(synth.with_reach(_occ(spark, sf)), services).select("occurrence_id", "reachable", "via")


@query("e15_promoted_systems", f"""{_REACH}, {_OCC} SELECT system_id, count(*) AS promoted FROM occ JOIN (SELECT replace(service, 'svc', 'sys') AS system_id FROM best WHERE hops > 0) USING (system_id) GROUP BY 1""")
def e15(spark, sf):
    before = synth.with_reach(_occ(spark, sf))
    return traces.promoted_systems(before, traces.apply_trace_reachability(before, _reached(spark, sf).withColumn("service", F.regexp_replace("service", "svc", "sys"))))


@query("c14_redacted_paths", f"{_REACH}, p AS (SELECT b.service, min(path) AS path FROM best b JOIN walk w ON b.service = w.service AND b.hops = w.hops GROUP BY 1) SELECT service, array_to_string(list_filter(path, lambda x: x NOT IN ('svc-01', 'svc-02', 'svc-03')), '>') AS path, CAST(len(list_filter(path, lambda x: x IN ('svc-01', 'svc-02', 'svc-03'))) AS INT) AS hops_out_of_scope FROM p")
def c14(spark, sf):
    hidden = spark.createDataFrame([("svc-01",), ("svc-02",), ("svc-03",)], "service string")
    return traces.redact_paths(_reached(spark, sf), hidden).select("service", F.array_join("path", ">").alias("path"), "hops_out_of_scope")


@query("e23_self_reachable", f"WITH {_OCC} SELECT DISTINCT system_id FROM occ WHERE {synth.VIA} = 'ENTRY_POINT'")
def e23(spark, sf):
    return traces.self_reachable_systems(synth.with_reach(_occ(spark, sf)))


_SCANS = f"s AS ({synth.as_sql('orders', synth.SCANS)})"


@query("f1_latest_scans", f"WITH {_SCANS} SELECT system_name, started_at, scan_id FROM s QUALIFY row_number() OVER (PARTITION BY system_name ORDER BY started_at DESC, scan_id DESC) = 1")
def f1(spark, sf):
    return store.latest_per_system(synth.scans(spark, sf)).select("system_name", "started_at", "scan_id")


@query("f3_recent_scans", f"WITH {_SCANS} SELECT system_name, scan_id, row_number() OVER (PARTITION BY system_name ORDER BY started_at DESC, scan_id DESC) AS nth FROM s QUALIFY nth <= 10")
def f3(spark, sf):
    return store.recent(synth.scans(spark, sf)).select("system_name", "scan_id", "nth")


@query("d19_previous_scan", f"WITH {_SCANS}, t AS (SELECT system_name, started_at, max(scan_id) AS last_id FROM s GROUP BY 1, 2), p AS (SELECT *, lag(last_id) OVER (PARTITION BY system_name ORDER BY started_at) AS previous_scan_id FROM t) SELECT scan_id, previous_scan_id FROM s JOIN p USING (system_name, started_at)")
def d19(spark, sf):
    return store.with_previous(synth.scans(spark, sf)).select("scan_id", "previous_scan_id")


@query("e18_newest_start", f"WITH {_SCANS} SELECT max(started_at) AS newest_start FROM s")
def e18(spark, sf):
    return store.newest_start(synth.scans(spark, sf))


_LINES = "l AS (SELECT concat('scan-', CAST(l_orderkey AS STRING)) AS scan_id, l_linenumber AS occurrence, CAST(l_partkey % 100 AS STRING) AS asset_id FROM lineitem)"


def _scan_lines(spark, sf):
    return _table(spark, sf, "lineitem").select(F.expr("concat('scan-', cast(l_orderkey as string))").alias("scan_id"), F.col("l_linenumber").alias("occurrence"), F.expr("cast(l_partkey % 100 as string)").alias("asset_id"))


@query("e22_scan_summaries", f"WITH {_SCANS}, {_LINES} SELECT s.scan_id, count(occurrence) AS occurrence_count, count(DISTINCT asset_id) AS asset_count FROM s LEFT JOIN l USING (scan_id) GROUP BY 1")
def e22(spark, sf):
    return store.scan_summaries(synth.scans(spark, sf), _scan_lines(spark, sf)).select("scan_id", "occurrence_count", "asset_count")


@query("e19_merge_scans", f"WITH {_SCANS}, {_LINES}, n AS (SELECT scan_id FROM s QUALIFY row_number() OVER (PARTITION BY system_name ORDER BY started_at DESC, scan_id DESC) = 1) SELECT scan_id, occurrence, asset_id FROM l JOIN n USING (scan_id)")
def e19(spark, sf):
    return store.merge_scans(synth.scans(spark, sf), _scan_lines(spark, sf)).select("scan_id", "occurrence", "asset_id")


@query("c13_visible_scans", f"WITH {_SCANS} SELECT scan_id FROM s WHERE system_name IN ('sys-01', 'sys-07')")
def c13(spark, sf):
    return store.visible(synth.scans(spark, sf), ["sys-01", "sys-07"]).select("scan_id")


@query("d22_undeclared_assets", "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 100 AS STRING) AS asset_id FROM lineitem WHERE l_partkey % 100 >= 97")
def d22(spark, sf):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_partkey % 100 as string)").alias("asset_id"))
    return store.check_references(rows, spark.range(97).select(F.col("id").cast("string").alias("asset_id"))).select("l_orderkey", "l_linenumber", "asset_id")


@query("b10_audit_page", "SELECT event_id, ts AS at, CAST(user_id AS STRING) AS token_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100")
def b10(spark, sf):
    log = _table(spark, sf, "events").select("event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("token_id"))
    return store.audit_page(log, token_id="7")


@query("e24_usable_tokens", "SELECT count(*) FILTER (WHERE user_id % 3 > 0 AND (user_id % 5 > 0 OR ts > TIMESTAMP '2024-01-15')) AS usable FROM events")
def e24(spark, sf):
    tokens = _table(spark, sf, "events").select(F.expr("case when user_id % 3 = 0 then ts end").alias("revoked_at"), F.expr("case when user_id % 5 = 0 then ts end").alias("expires_at"))
    return store.usable_tokens(tokens, F.expr("timestamp '2024-01-15'"))


@query("k10_estate_headline", f"""{_REACH}, {_OCC}, {_ASSETS}, {_ranked(EO_14412, 'r')}, b2 AS (SELECT replace(service, 'svc', 'sys') AS system_id FROM best WHERE hops > 0),
 z AS (SELECT *, CASE WHEN level = 'SUSPECTED' THEN 'hints' WHEN reachable = false AND system_id NOT IN (SELECT system_id FROM b2) THEN 'unreached' ELSE lower(track) END AS bucket2 FROM r) SELECT bucket2 AS bucket, count(*) AS n, count(*) FILTER (WHERE late) AS late FROM z GROUP BY 1""")
def k10(spark, sf):
    services = _reached(spark, sf).withColumn("service", F.regexp_replace("service", "svc", "sys"))
    raised = traces.apply_trace_reachability(synth.with_reach(_occ(spark, sf)), services)
    return ranking.ranked(raised, _assets(spark, sf), EO_14412, synth.NOW_YEAR).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


# scope

_HOSTS = "h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/:]+)', 1)) AS host FROM pages)"
_TARGETS = ("*.example.com", "*.theran.example.com", "10.0.0.0/9", "10.128.7.0/24", "2001:db8::/32", "10.200.0.1")
_ADDRESS = "concat('10.', CAST(c_custkey % 256 AS STRING), '.', CAST(CAST(floor(c_custkey / 7) AS BIGINT) % 256 AS STRING), '.', CAST(c_custkey % 199 AS STRING))"


@query("d15_address_targets", f"WITH a AS (SELECT DISTINCT {_ADDRESS} AS host, c_custkey % 256 AS b, CAST(floor(c_custkey / 7) AS BIGINT) % 256 AS c, c_custkey % 199 AS d FROM customer) SELECT host, '10.0.0.0/9' AS target FROM a WHERE b < 128 UNION ALL SELECT host, '10.128.7.0/24' FROM a WHERE b = 128 AND c = 7 UNION ALL SELECT host, '10.200.0.1' FROM a WHERE b = 200 AND c = 0 AND d = 1")
def d15(spark, sf):
    hosts = _table(spark, sf, "customer").select(F.expr(_ADDRESS).alias("host"))
    return scope.matching_targets(hosts, spark.createDataFrame([(t,) for t in _TARGETS], "target string"))


@query("d15_name_targets", f"WITH {_HOSTS} SELECT host, '*.example.com' AS target FROM h WHERE regexp_matches(host, '^[^.]+\\.example\\.com$') UNION ALL SELECT host, '*.theran.example.com' FROM h WHERE regexp_matches(host, '^[^.]+\\.theran\\.example\\.com$')")
def d15_names(spark, sf):
    hosts = _table(spark, sf, "pages").select(F.lower(F.regexp_extract("url", "://([^/:]+)", 1)).alias("host"))
    return scope.matching_targets(hosts, spark.createDataFrame([(t,) for t in _TARGETS], "target string"))


@query("i14_authorize", f"WITH a AS (SELECT c_custkey, {_ADDRESS} AS host, CASE WHEN c_custkey % 3 = 0 THEN 443 ELSE 8443 END AS port FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 256 >= 128 AND NOT (c_custkey % 256 = 128 AND CAST(floor(c_custkey / 7) AS BIGINT) % 256 = 7) THEN 'TARGET_OUT_OF_SCOPE' WHEN port <> 443 THEN 'PORT_OUT_OF_SCOPE' ELSE 'OK' END AS code FROM a")
def i14(spark, sf):
    requests = _table(spark, sf, "customer").select("c_custkey", F.expr(_ADDRESS).alias("host"), F.expr("case when c_custkey % 3 = 0 then 443 else 8443 end").alias("port"))
    grant = spark.createDataFrame([("10.0.0.0/9",), ("10.128.7.0/24",)], "target string").select("target", F.array(F.lit(443)).alias("ports"), F.expr("timestamp '2026-01-01'").alias("not_before"), F.expr("timestamp '2026-12-31'").alias("not_after"))
    return scope.authorize(requests, grant, F.expr("timestamp '2026-08-28'")).select("c_custkey", "code")


@query("i13_addresses", f"SELECT c_custkey, 167772160 + (c_custkey % 256) * 65536 + (CAST(floor(c_custkey / 7) AS BIGINT) % 256) * 256 + c_custkey % 199 AS number, {_ADDRESS} AS host, CASE WHEN c_custkey % 2 = 0 THEN 8443 ELSE 443 END AS port FROM customer")
def i13(spark, sf):
    c = _table(spark, sf, "customer").select("c_custkey", F.expr(f"case when c_custkey % 2 = 0 then concat({_ADDRESS}, ':8443') else {_ADDRESS} end").alias("text")).withColumn("t", scope.split_target(F.col("text")))
    return c.select("c_custkey", scope.ipv4_to_long(F.col("t.host")).alias("number"), "t.host", "t.port")


# I: names and numbers


@query("i9_decimal_years", "SELECT o_orderkey, floor((year(o_orderdate) + (epoch_us(o_orderdate::TIMESTAMP) - epoch_us(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0.0))) / (epoch_us(make_timestamp(year(o_orderdate) + 1, 1, 1, 0, 0, 0.0)) - epoch_us(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0.0)))) * 10000.0 + 0.5) / 10000.0 AS decimal_year FROM orders")
def i9(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", A.decimal_year(F.col("o_orderdate").cast("timestamp")).alias("decimal_year"))


@query("i11_rounding", "SELECT l_orderkey, l_linenumber, floor((l_extendedprice * l_discount) * 100.0 + 0.5) / 100.0 AS rounded FROM lineitem")
def i11(spark, sf):
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.round_half_up(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("rounded"))


@query("i16_scan_ids", "SELECT o_orderkey, concat('team-x-', CAST(o_custkey AS STRING), '-', strftime(o_orderdate, '%Y%m%d%H%M%S'), '-', substr(sha256(concat('Team X/', CAST(o_custkey AS STRING), chr(0), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'))), 1, 8)) AS scan_id FROM orders")
def i16(spark, sf):
    name, t = F.concat(F.lit("Team X/"), F.col("o_custkey").cast("string")), F.col("o_orderdate").cast("timestamp")
    return _table(spark, sf, "orders").select("o_orderkey", A.scan_id(name, t, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("scan_id"))


@query("i19_versions", "SELECT p_partkey, (p_size % 5) < 3 OR ((p_size % 5) = 3 AND (p_partkey % 10) < 5) AS below FROM part")
def i19(spark, sf):
    have = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("-r1"))
    return _table(spark, sf, "part").select("p_partkey", A.version_below(have, "3.5").alias("below"))


#: Names of each vocabulary with what they stand for, by reading the standards: one row per spec.
NAMES = (
    ("hash", "SHA-256", "SHA2", '{"outputLength":256}', None), ("hash", "sha2-512", "SHA2", '{"outputLength":512}', None), ("hash", "MD5", "MD5", '{"outputLength":128}', None), ("hash", "SHA3-384", "SHA3", '{"outputLength":384}', None),
    ("hash", "blake2b512", "UNKNOWN", '{"name":"BLAKE2b","outputLength":512}', None), ("cipher", "aes-256-gcm", "AES", '{"keySize":256,"mode":"GCM"}', "DATA_ENCRYPTION"), ("cipher", "des-ede3-cbc", "3DES", '{"mode":"CBC"}', "DATA_ENCRYPTION"),
    ("cipher", "des-cbc", "UNKNOWN", '{"keySize":56,"mode":"CBC","name":"DES"}', "DATA_ENCRYPTION"), ("cipher", "chacha20-poly1305", "ChaCha20", '{"keySize":256,"mode":"POLY1305"}', "DATA_ENCRYPTION"), ("cipher", "rc4-md5", "RC4", "{}", "DATA_ENCRYPTION"),
    ("jose", "RS256", "RSA", '{"alg":"RS256","padding":"PKCS1v15"}', "DIGITAL_SIGNATURE"), ("jose", "RS256", "SHA2", '{"outputLength":256}', "INTEGRITY"), ("jose", "ES384", "ECDSA", '{"alg":"ES384","curve":"P-384"}', "DIGITAL_SIGNATURE"),
    ("jose", "ES384", "SHA2", '{"outputLength":384}', "INTEGRITY"), ("jose", "RSA-OAEP", "RSA", '{"alg":"RSA-OAEP","padding":"OAEP"}', "KEY_ESTABLISHMENT"), ("jose", "A256GCM", "AES", '{"keySize":256,"mode":"GCM"}', "DATA_ENCRYPTION"),
    ("jose", "none", "UNKNOWN", '{"alg":"none"}', None), ("signature", "sha256WithRSAEncryption", "SHA2", '{"outputLength":256}', "INTEGRITY"), ("signature", "sha256WithRSAEncryption", "RSA", '{"padding":"PKCS1v15"}', "DIGITAL_SIGNATURE"),
    ("signature", "ecdsa-with-SHA384", "ECDSA", "{}", "DIGITAL_SIGNATURE"), ("signature", "ecdsa-with-SHA384", "SHA2", '{"outputLength":384}', "INTEGRITY"), ("ssh", "curve25519-sha256@libssh.org", "X25519", "{}", "KEY_ESTABLISHMENT"),
    ("ssh", "diffie-hellman-group14-sha1", "DH", '{"primeLength":2048}', "KEY_ESTABLISHMENT"), ("ssh", "ecdh-sha2-nistp384", "ECDH", '{"curve":"P-384"}', "KEY_ESTABLISHMENT"), ("ssh", "sntrup761x25519-sha512@openssh.com", "UNKNOWN", '{"name":"sntrup761x25519"}', "KEY_ESTABLISHMENT"),
    ("ssh", "mlkem768x25519-sha256", "ML-KEM", "{}", "KEY_ESTABLISHMENT"), ("ssh", "hmac-sha2-256-etm@openssh.com", "HMAC", '{"hash":"SHA2"}', "INTEGRITY"), ("ssh", "aes128-ctr", "AES", '{"keySize":128,"mode":"CTR"}', "DATA_ENCRYPTION"),
    ("tls", "TLS_AES_128_GCM_SHA256", "AES", '{"keySize":128,"mode":"GCM"}', "DATA_ENCRYPTION"), ("tls", "ECDHE-RSA-AES256-GCM-SHA384", "ECDH", '{"ephemeral":"true"}', "KEY_ESTABLISHMENT"), ("tls", "ECDHE-RSA-AES256-GCM-SHA384", "RSA", "{}", "CERTIFICATE_AUTH"),
    ("tls", "ECDHE-RSA-AES256-GCM-SHA384", "AES", '{"keySize":256,"mode":"GCM"}', "DATA_ENCRYPTION"), ("tls", "ECDHE-RSA-AES256-GCM-SHA384", "SHA2", '{"outputLength":384}', "INTEGRITY"), ("tls", "AES128-SHA", "RSA", '{"mode":"KEY_TRANSPORT"}', "KEY_ESTABLISHMENT"),
    ("tls", "AES128-SHA", "RSA", "{}", "CERTIFICATE_AUTH"), ("tls", "AES128-SHA", "SHA1", '{"outputLength":160}', "INTEGRITY"),
)
_NAME_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in NAMES)


@query("i1_i7_names", f"SELECT r.vocabulary, r.name, r.primitive, r.parameters, r.purpose, n_nationkey FROM (VALUES {_NAME_ROWS}) AS r(vocabulary, name, primitive, parameters, purpose) CROSS JOIN nation")
def names(spark, sf):
    rows = spark.createDataFrame(sorted({(v, n) for v, n, *_ in NAMES}), "vocabulary string, name string").crossJoin(_table(spark, sf, "nation").select("n_nationkey"))
    specs = F.array().cast(naming.SPECS)
    for vocabulary, of in naming.VOCABULARIES.items():
        specs = F.when(F.col("vocabulary") == vocabulary, of(F.col("name"))).otherwise(specs)
    return rows.select("vocabulary", "name", "n_nationkey", F.explode(specs).alias("s")).select("vocabulary", "name", "s.primitive", "s.parameters", "s.purpose", "n_nationkey")


@query("c15_crypto_sounding", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def c15(spark, sf):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("@scope/aes-"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("raspberry"), F.col("p_partkey").cast("string")))
    return _table(spark, sf, "part").filter(text_files.looks_cryptographic(name)).select("p_partkey")


@query("c11_path_kinds", "SELECT page_id, page_id % 4 = 0 AS test, CASE WHEN page_id % 5 = 1 THEN 'nginx' WHEN page_id % 5 = 2 THEN 'sshd' END AS config FROM pages")
def c11(spark, sf):
    p = F.expr("concat('repo/', case when page_id % 4 = 0 then 'tests/' else 'src/' end, case when page_id % 5 = 1 then 'nginx.conf' when page_id % 5 = 2 then 'sshd_config' else 'main.py' end)")
    return _table(spark, sf, "pages").select("page_id", reach.is_test_path(p).alias("test"), text_files.config_kind(p).alias("config"))


@query("c17_asset_names", f"WITH {_FOUND}, {_ASSETS} SELECT asset_name, count(*) AS n FROM found JOIN (SELECT asset_id, asset_name FROM assets) USING (asset_id) GROUP BY 1")
def c17(spark, sf):
    return _found(spark, sf).groupBy("asset_name").agg(F.count("*").alias("n"))


# B: export


@query("b2_components", f"""WITH {_OCC}, {_ASSETS}, o AS (SELECT *, {synth.REACHABLE} AS reachable, list_position(['SUSPECTED', 'OBSERVED', 'CONFIRMED'], level) AS rank FROM occ WHERE level <> 'SUSPECTED')
 SELECT asset_id, arg_min(level, rank) AS level, max(confidence) AS confidence, count(*) AS occurrence_count, string_agg(DISTINCT control_class, ',' ORDER BY control_class) AS control_classes, CASE WHEN bool_or(coalesce(reachable, false)) THEN 'true' WHEN count(reachable) = 0 THEN 'unanalyzed' ELSE 'false' END AS reachable,
 CAST(floor(max(confidence) * 100 + 0.5) AS INT) AS percent FROM o GROUP BY 1""")
def b2(spark, sf):
    return export.components(synth.with_reach(_occ(spark, sf)), _assets(spark, sf)).select("asset_id", "level", "confidence", "occurrence_count", "control_classes", "reachable", "percent")


@query("e10_level_counts", f"WITH {_OCC} SELECT count(*) FILTER (WHERE level = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE level = 'OBSERVED') AS observed, count(*) FILTER (WHERE level = 'SUSPECTED') AS suspected FROM occ")
def e10(spark, sf):
    return export.level_counts(_occ(spark, sf))


@query("b1_document")
def b1(spark, sf):
    return export.document(synth.with_reach(_occ(spark, sf)), _assets(spark, sf), "eo-14412@1.0.0", "2026-08-28T00:00:00Z").select("serial_number", F.length("body").alias("size"))


_TREE_OF_DIGESTS = "n0 AS (SELECT digest AS name, digest, 1 AS n FROM leaves), " + ", ".join(
    f"n{k + 1} AS (SELECT substr(name, 1, {digits}) AS name, sha256(string_agg(digest, '' ORDER BY name)) AS digest, sum(n) AS n FROM n{k} GROUP BY 1)" for k, digits in enumerate(export.TREE_LEVELS)
)


@query("b1_document_root", f"""WITH {_OCC}, {_ASSETS}, o AS (SELECT asset_id, count(*) AS n, count(DISTINCT system_id) AS systems FROM occ WHERE level <> 'SUSPECTED' GROUP BY 1),
 leaves AS (SELECT sha256(concat_ws('|', asset_id, asset_name, purpose, CAST(n AS STRING), CAST(systems AS STRING))) AS digest FROM o JOIN assets USING (asset_id)
 UNION ALL SELECT sha256(concat('occurrence|', occurrence_id)) FROM occ), {_TREE_OF_DIGESTS} SELECT digest AS root, CAST(n AS BIGINT) AS n FROM n{len(export.TREE_LEVELS)}""")
def b1_root(spark, sf):
    occ = _occ(spark, sf)
    folded = occ.filter("level <> 'SUSPECTED'").groupBy("asset_id").agg(F.count("*").alias("n"), F.count_distinct("system_id").alias("systems")).join(_assets(spark, sf), "asset_id")
    of_assets = folded.select(F.sha2(F.concat_ws("|", "asset_id", "asset_name", "purpose", F.col("n").cast("string"), F.col("systems").cast("string")), 256).alias("digest"))
    return export.hash_tree(of_assets.union(occ.select(F.sha2(F.concat(F.lit("occurrence|"), "occurrence_id"), 256))))


@query("b3_vocabulary", f"WITH {_FOUND} SELECT DISTINCT primitive, CASE primitive " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.PRIMITIVE_KIND.items()) + " END AS kind FROM found")
def b3(spark, sf):
    return synth.findings(spark, sf).select("primitive").distinct().select("primitive", dims.lookup(F.col("primitive"), dims.PRIMITIVE_KIND).alias("kind"))


# A: sources, over records made of the tables


@query("a35_otlp_spans", f"SELECT service, span_id, parent_span_id, operation FROM ({synth.as_sql('events', synth.SPANS)}) WHERE CAST(span_id AS BIGINT) % 11 > 0")
def a35(spark, sf):
    s = synth.spans(spark, sf)
    attribute = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value")))
    route = F.array(F.struct(F.lit("rpc.method").alias("key"), F.struct(F.col("operation").alias("stringValue")).alias("value")))
    span = F.struct(F.lit("t").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.when(F.col("ord") % 2 == 0, F.col("operation")).otherwise("").alias("name"), route.alias("attributes"))
    resource = F.struct(F.when(F.col("ord") % 11 > 0, attribute).otherwise(F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")).alias("attributes"))
    payload = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return traces.spans_from_otlp(s.select(F.from_json(payload, traces.OTLP_SCHEMA).alias("p")).select("p.*")).select("service", "span_id", "parent_span_id", "operation")


_KEY_SPECS = ("RSA_2048", "ECC_NIST_P256", "SYMMETRIC_DEFAULT", "HMAC_256", "ML_DSA_65", "MYSTERY")


@query("a21_key_findings", """WITH k AS (SELECT s_suppkey, s_suppkey % 6 AS k, s_suppkey % 5 > 0 AS enabled, s_suppkey % 4 = 0 AS hsm FROM supplier)
 SELECT CAST(s_suppkey AS STRING) AS locator, CASE k WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'AES' WHEN 3 THEN 'HMAC' ELSE 'ML-DSA' END AS primitive,
 CASE k WHEN 0 THEN '{"modulusLength":2048}' WHEN 1 THEN '{"curve":"P-256"}' WHEN 2 THEN '{"keySize":256,"mode":"GCM"}' WHEN 3 THEN '{"outputLength":256}' ELSE '{"keySpec":"ML_DSA_65"}' END AS parameters,
 CASE k WHEN 0 THEN 'KEY_ESTABLISHMENT' WHEN 1 THEN 'DIGITAL_SIGNATURE' WHEN 2 THEN 'KEY_ESTABLISHMENT' WHEN 3 THEN 'INTEGRITY' ELSE 'DIGITAL_SIGNATURE' END AS purpose, CASE WHEN hsm THEN 'HARDWARE' ELSE 'VENDOR_UPGRADEABLE' END AS control_class FROM k WHERE enabled AND k < 5""")
def a21(spark, sf):
    by = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = _table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("KeyId"), F.lit(None).cast("string").alias("Arn"), by(*_KEY_SPECS).alias("KeySpec"), by("ENCRYPT_DECRYPT", "SIGN_VERIFY", "ENCRYPT_DECRYPT", "GENERATE_VERIFY_MAC", "SIGN_VERIFY", "SIGN_VERIFY").alias("KeyUsage"),
        (F.col("s_suppkey") % 5 > 0).alias("Enabled"), F.when(F.col("s_suppkey") % 4 == 0, "AWS_CLOUDHSM").alias("Origin"), F.lit(None).cast("string").alias("CreationDate"), F.col("s_name").alias("Description"), F.lit("1").alias("account"), F.lit("r").alias("region"), F.lit(None).cast("boolean").alias("rotation_enabled"),
    )
    found, _ = inventories.key_findings(inventories.from_aws(rows), "keys")
    return found.select("locator", "primitive", "parameters", "purpose", "control_class")


@query("a26_package_notes", "SELECT CAST(p_partkey AS STRING) AS host_id, 'openssl' AS name, concat(CAST(p_size % 5 AS STRING), '.', CAST(p_partkey % 10 AS STRING)) AS version, '3.5' AS needed FROM part WHERE (p_size % 5) < 3 OR ((p_size % 5) = 3 AND (p_partkey % 10) < 5)")
def a26(spark, sf):
    version = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    flat = _table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("host"), F.lit("package").alias("kind"), F.lit("").alias("where"), F.lit("openssl").alias("what"), version.alias("value"))
    return inventories.package_notes(inventories.from_flat(flat)[0])


@query("a24_host_findings", """SELECT concat('sys-', CAST(c_custkey % 10 AS STRING)) AS system_id, s.primitive, s.parameters, count(*) AS n FROM customer CROSS JOIN (VALUES (0, 'AES', '{"keySize":256,"mode":"CTR"}'), (0, 'RC4', '{}'), (1, 'X25519', '{}'), (1, 'DH', '{"primeLength":2048}'), (2, 'ECDH', '{"curve":"P-384","ephemeral":"true"}')) AS s(k, primitive, parameters) WHERE c_custkey % 3 = k GROUP BY 1, 2, 3""")
def a24(spark, sf):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % 3 + 1).cast("int"))
    flat = _table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("host"), F.lit("config").alias("kind"), F.lit("/etc/x").alias("where"), pick("Ciphers", "KexAlgorithms", "ssl_ecdh_curve").alias("what"), pick("aes256-ctr,!md5,+arcfour", "curve25519-sha256 diffie-hellman-group14-sha1", "secp384r1:bogus").alias("value"))
    hosts = inventories.from_flat(flat)[0].withColumn("system_id", F.concat(F.lit("sys-"), (F.col("host_id").cast("long") % 10).cast("string")))
    return inventories.host_findings(hosts, "none")[0].groupBy("system_id", "primitive", "parameters").agg(F.count("*").alias("n"))


@query("a14_dependencies", "SELECT concat('d', CAST(n_nationkey AS STRING), '/requirements.txt') AS file, 'paramiko' AS name, primitive FROM nation CROSS JOIN (VALUES ('ECDH'), ('DH'), ('X25519'), ('RSA'), ('ECDSA'), ('EdDSA'), ('DSA'), ('AES'), ('3DES')) AS t(primitive) UNION ALL SELECT concat('d', CAST(n_nationkey AS STRING), '/package.json'), 'md5', 'MD5' FROM nation")
def a14(spark, sf):
    n = _table(spark, sf, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("d"))
    files = n.select(F.concat("d", F.lit("/requirements.txt")).alias("path"), F.lit("# deps\nParamiko[gssapi]==3.4.0 ; python_version > '3'\n\nflask\n-r other.txt\n").alias("text"))
    files = files.union(n.select(F.concat("d", F.lit("/package.json")), F.lit('{"name":"x","dependencies":{"md5":"^2.3.0","left-pad":"1.0.0"},"devDependencies":{"node-forge":"1.0.0"}}')))
    found, _ = text_files.dependency_findings(files, "deps")
    return found.select(F.regexp_extract("locator", "^(.*):[0-9]+$", 1).alias("file"), F.lower(F.regexp_extract("raw", "^[a-z]+:([^@ ]+)", 1)).alias("name"), "primitive")


_NGINX = "http {\n  ssl_protocols TLSv1 TLSv1.2;\n  ssl_ciphers ECDHE-RSA-AES128-GCM-SHA256:!aNULL\n    :DHE-RSA-AES256-SHA;\n  ssl_ecdh_curve X25519:secp384r1;\n}\n"


@query("a10_configs", """SELECT concat('c', CAST(n_nationkey AS STRING), '/nginx.conf') AS file, t.line_no, t.directive, t.primitive FROM nation CROSS JOIN (VALUES (1, 'ssl_protocols', 'SHA1'), (3, 'ssl_ciphers', 'ECDH'), (3, 'ssl_ciphers', 'RSA'), (3, 'ssl_ciphers', 'AES'), (3, 'ssl_ciphers', 'SHA2'), (3, 'ssl_ciphers', 'DH'), (3, 'ssl_ciphers', 'RSA'), (3, 'ssl_ciphers', 'SHA1'), (5, 'ssl_ecdh_curve', 'X25519'), (5, 'ssl_ecdh_curve', 'ECDH')) AS t(line_no, directive, primitive)
 UNION ALL SELECT concat('c', CAST(n_nationkey AS STRING), '/sshd_config'), t.line_no, t.directive, t.primitive FROM nation CROSS JOIN (VALUES (2, 'kexalgorithms', 'X25519'), (2, 'kexalgorithms', 'DH'), (4, 'macs', 'HMAC')) AS t(line_no, directive, primitive)""".replace("(1, 'ssl_protocols'", "(2, 'ssl_protocols'"))
def a10(spark, sf):
    n = _table(spark, sf, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("d"))
    files = n.select(F.concat("d", F.lit("/nginx.conf")).alias("path"), F.lit(_NGINX).alias("text")).union(n.select(F.concat("d", F.lit("/sshd_config")), F.lit("# ssh\nKexAlgorithms +curve25519-sha256,diffie-hellman-group16-sha512\nCiphers -aes128-cbc\nMACs hmac-sha2-256\n")))
    return text_files.config_detections(files).select("file", "line_no", "directive", "primitive")


_SYMBOLS = (("RSA_sign", "RSA"), ("_EVP_aes_256_gcm", "AES"), ("EVP_sha3_512", "SHA3"), ("MLKEM768_encap", "ML-KEM"), ("printf", None), ("X25519_keypair@plt", "X25519"), ("EVP_md5", "MD5"))


@query("a31_symbols", f"SELECT r_regionkey, s.symbol, s.primitive FROM region CROSS JOIN (VALUES {', '.join(f"('{s}', '{p}')" for s, p in _SYMBOLS if p)}) AS s(symbol, primitive)")
def a31(spark, sf):
    rows = _table(spark, sf, "region").select("r_regionkey").crossJoin(spark.createDataFrame([(s,) for s, _ in _SYMBOLS], "symbol string"))
    return rows.withColumn("spec", binaries.symbol_spec(F.col("symbol"))).filter("spec is not null").select("r_regionkey", "symbol", "spec.primitive")


@query("a29_constants", "SELECT n_nationkey, 'aes-sbox' AS constant, CAST(64 + n_nationkey AS BIGINT) AS first_offset, CAST(least(8, 1 + n_nationkey % 9) AS BIGINT) AS hits FROM nation")
def a29(spark, sf):
    sbox = "637c777bf26b6fc53001672bfed7ab76ca82c97dfa5947f0add4a2af9ca472c0"
    content = F.concat(F.unhex(F.repeat(F.lit("00"), (64 + F.col("n_nationkey")).cast("int"))), F.unhex(F.repeat(F.lit(sbox), (1 + F.col("n_nationkey") % 9).cast("int"))))
    files = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"), content.alias("content"))
    return binaries.observed(files).filter("kind = 'constant'").groupBy(F.col("path").cast("int").alias("n_nationkey"), F.col("value").alias("constant")).agg(F.min("offset").alias("first_offset"), F.count("*").alias("hits"))


_PYTHON = "import hashlib\nfrom cryptography.hazmat.primitives.asymmetric import rsa as r\nimport jwt\n\ndef f():\n    hashlib.md5(b'x', usedforsecurity=False)\n    hashlib.new('sha256')\n    k = r.generate_private_key(public_exponent=65537, key_size=2048)\n    return jwt.encode({}, k, algorithm='RS256')\n"


@query("a6_python_rules", """SELECT n_nationkey, t.* FROM nation CROSS JOIN (VALUES (6, 'MD5', '{"outputLength":128}', true), (7, 'SHA2', '{"outputLength":256}', false), (8, 'RSA', '{"modulusLength":2048}', false), (9, 'RSA', '{"alg":"RS256","padding":"PKCS1v15"}', false), (9, 'SHA2', '{"outputLength":256}', false)) AS t(line, primitive, parameters, tainted)""")
def a6(spark, sf):
    files = _table(spark, sf, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.lit(_PYTHON).alias("text"))
    found = binaries.source_findings(binaries.source_calls(files), "src")
    return found.select(F.regexp_extract("locator", "^([0-9]+)", 1).cast("int").alias("n_nationkey"), F.regexp_extract("locator", ":([0-9]+)$", 1).cast("int").alias("line"), "primitive", "parameters", F.col("assumption").isNotNull().alias("tainted"))


@query("a33_handshakes", "SELECT concat('h', CAST(s_suppkey AS STRING)) AS locator, t.primitive, t.state FROM supplier CROSS JOIN (VALUES ('AES', 'SELECTED'), ('ECDH', 'OFFERED'), ('RSA', 'OFFERED'), ('SHA2', 'OFFERED')) AS t(primitive, state)")
def a33(spark, sf):
    rows = _table(spark, sf, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("target"), F.lit("tls").alias("protocol"), F.lit("TLS_AES_128_GCM_SHA256").alias("selected"), F.array(F.lit("ECDHE-RSA-AES128-GCM-SHA256"), F.lit("TLS_AES_128_GCM_SHA256")).alias("offered"))
    return binaries.handshake_findings(rows, "net").select("locator", "primitive", F.split_part("raw", F.lit(" "), F.lit(1)).alias("state"))


@query("a37_attestations", "SELECT concat('sys-', CAST(s_nationkey AS STRING)) AS system_id, 'RSA' AS primitive, s_suppkey % 2 = 0 AS expired, count(*) AS n FROM supplier GROUP BY 1, 2, 3")
def a37(spark, sf):
    s = _table(spark, sf, "supplier")
    claim = F.array(F.struct(F.lit("RSA").alias("primitive"), F.lit('{"modulusLength": 2048}').alias("parameters"), F.lit("KEY_ESTABLISHMENT").alias("purpose")))
    statements = s.select(F.col("s_name").alias("vendor"), F.lit("box").alias("product"), F.lit("1").alias("version"), F.concat(F.lit("sys-"), F.col("s_nationkey").cast("string")).alias("system_id"), F.lit(None).cast("string").alias("control_class"), F.expr("case when s_suppkey % 2 = 0 then timestamp '2026-01-01' else timestamp '2027-01-01' end").alias("valid_until"), claim.alias("claims"))
    return inventories.attestation_findings(statements, F.expr("timestamp '2026-08-28'")).groupBy("system_id", "primitive", "expired").agg(F.count("*").alias("n"))


# Static reachability


def _graph(spark, sf):
    """Files f<k>.ts that import ../src/f<2k+1> and ../src/f<2k+2> without extension."""
    f = _table(spark, sf, "part").select("p_partkey", F.expr("concat('src/f', cast(p_partkey as string), '.ts')").alias("file"))
    files = f.select("file", F.lit(None).cast("string").alias("package"), F.expr("p_partkey % 50 = 49").alias("is_test"), F.expr("case when p_partkey = 1 then 'http' end").alias("entry_kind"), F.expr("p_partkey % 3 = 0").alias("published"))
    step = f.select("file", "p_partkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    imports = step.select("file", F.expr("concat('./../src/f', cast(2 * p_partkey + ordinal as string))").alias("spec"), "ordinal")
    return files, imports


_TREE = "e AS (SELECT a.p_partkey AS p, b.p_partkey AS c, b.p_partkey % 2 AS ordinal FROM part a JOIN part b ON CAST(floor(b.p_partkey / 2) AS BIGINT) = a.p_partkey AND b.p_partkey > 0)"


@query("d16_import_edges", f"WITH {_TREE} SELECT concat('src/f', CAST(p AS STRING), '.ts') AS from_file, concat('src/f', CAST(c AS STRING), '.ts') AS to_file, CAST(ordinal AS INT) AS ordinal FROM e")
def d16(spark, sf):
    files, imports = _graph(spark, sf)
    return reach.resolve_local(imports, files).select("from_file", "to_file", "ordinal")


@query("j2_walk", f"WITH RECURSIVE {_TREE}, w(k, hops) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT c, hops + 1 FROM w JOIN e ON p = k) SELECT concat('src/f', CAST(k AS STRING), '.ts') AS file, hops FROM w")
def j2(spark, sf):
    files, imports = _graph(spark, sf)
    return reach.walk(reach.resolve_local(imports, files), reach.entry_points(files)).select("file", "hops")


@query("d18_suffix_imports", "SELECT concat('src/f', CAST(p_partkey AS STRING), '.ts') AS from_file, concat('src/f', CAST(p_partkey + 1 AS STRING), '.ts') AS to_file FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def d18(spark, sf):
    files, _ = _graph(spark, sf)
    imports = _table(spark, sf, "part").select(F.expr("concat('src/f', cast(p_partkey as string), '.ts')").alias("file"), F.expr("concat('@/f', cast(p_partkey + 1 as string))").alias("spec"), F.lit(0).alias("ordinal"))
    return reach.resolve_suffix(imports, files).select("from_file", "to_file")


@query("d17_package_imports", "SELECT concat('src/f', CAST(p_partkey AS STRING), '.ts') AS from_file, 'src/f7.ts' AS to_file FROM part WHERE p_partkey % 10 = 0")
def d17(spark, sf):
    files, _ = _graph(spark, sf)
    imports = _table(spark, sf, "part").select(F.expr("concat('src/f', cast(p_partkey as string), '.ts')").alias("file"), F.expr("case when p_partkey % 10 = 0 then '@org/core/f7' else 'lodash/fp' end").alias("spec"), F.lit(0).alias("ordinal"))
    packages = spark.createDataFrame([("@org/core", "src"), ("@org", "elsewhere")], "name string, entry_dir string")
    return reach.resolve_packages(imports, packages, files).select("from_file", "to_file")


@query("j5_verdicts", f"""WITH RECURSIVE {_TREE}, w(k, hops) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT c, hops + 1 FROM w JOIN e ON p = k),
 v AS (SELECT p_partkey, CASE WHEN p_partkey % 20 = 3 THEN 'OBSERVED' WHEN p_partkey % 20 = 4 THEN NULL WHEN p_partkey % 50 <> 49 AND k IS NOT NULL THEN 'ENTRY_POINT' WHEN p_partkey % 50 <> 49 AND p_partkey % 3 = 0 THEN 'LIBRARY_SURFACE' ELSE 'NONE' END AS via FROM part LEFT JOIN w ON k = p_partkey)
 SELECT CAST(p_partkey AS STRING) AS occurrence_id, via, CASE WHEN via IS NOT NULL THEN via <> 'NONE' END AS reachable FROM v""")
def j5(spark, sf):
    files, imports = _graph(spark, sf)
    walked = reach.walk(reach.resolve_local(imports, files), reach.entry_points(files))
    rows = _table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("occurrence_id"), F.expr("case when p_partkey % 20 = 3 then 'NETWORK_ACTIVE' when p_partkey % 20 = 4 then 'DEPENDENCY' else 'SOURCE_AST' end").alias("modality"), F.expr("concat('src/f', cast(p_partkey as string), '.ts')").alias("file"))
    return reach.verdicts(rows, walked, files).select("occurrence_id", "via", "reachable")


@query("k19_why_unreached", f"""WITH RECURSIVE {_TREE}, w(k, hops) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT c, hops + 1 FROM w JOIN e ON p = k) SELECT CAST(p_partkey AS STRING) AS occurrence_id, CASE WHEN p_partkey % 50 = 49 THEN 'only a test uses it' ELSE 'no entry point imports its file' END AS reasons FROM part LEFT JOIN w ON k = p_partkey WHERE p_partkey % 50 = 49 OR k IS NULL""")
def k19(spark, sf):
    files, imports = _graph(spark, sf)
    walked = reach.walk(reach.resolve_local(imports, files), reach.entry_points(files))
    rows = files.select(F.regexp_extract("file", "f([0-9]+)", 1).alias("occurrence_id"), F.lit("SOURCE_AST").alias("modality"), "file")
    return reach.why_unreached(rows, walked, files)


# A store after several ingests, one of which is repeated and one of which replaces a scan


@query("b4_after_ingests", f"""WITH {_OCC}, k AS (SELECT *, ascii(substr(occurrence_id, 1, 1)) % 3 AS k FROM occ)
 SELECT scan_id, level, count(*) AS occurrences, (SELECT count(DISTINCT asset_id) FROM k) AS assets, (SELECT max(note) FROM (VALUES ('replaced')) AS v(note)) AS note FROM
 (SELECT 'scan-1' AS scan_id, level FROM k WHERE k IN (0, 1) AND level <> 'SUSPECTED' UNION ALL SELECT 'scan-2', level FROM k WHERE k IN (1, 2)) GROUP BY 1, 2""")
def b4(spark, sf):
    # each of the four ingests writes parts of the same occurrences
    occ = cut_lineage(_occ(spark, sf).select("occurrence_id", "level", "asset_id", (F.ascii(F.substring("occurrence_id", 1, 1)) % 3).alias("k")), "occurrences")
    root = f"{shared_folder(spark)}/estatelens-store-{uuid.uuid4().hex}"

    def put(scan, rows, note):
        held = rows.select(F.lit(scan).alias("scan_id"), "occurrence_id", "level", "asset_id")
        systems = spark.range(1).select(F.lit("all").alias("system_name"), F.lit(note).alias("note"))
        ledger.ingest(spark, root, scan, {"occurrences": held, "assets": held.select("asset_id"), "systems": systems})

    put("scan-1", occ.filter("k in (0, 1)"), "first")
    put("scan-2", occ.filter("k in (1, 2)"), "second")
    put("scan-2", occ.filter("k in (1, 2)"), "again")
    put("scan-1", occ.filter("k in (0, 1) and level <> 'SUSPECTED'"), "replaced")
    every = ledger.read(spark, root, "assets").agg(F.count("*").alias("assets")).crossJoin(ledger.read(spark, root, "systems").select("note"))  # one row each
    return ledger.read(spark, root, "occurrences").groupBy("scan_id", "level").agg(F.count("*").alias("occurrences")).crossJoin(F.broadcast(every))


# Intake of payloads with many kinds of faults

#: By code: which orders have the fault, in SQL of both engines.
_FAULTS = {
    "system_missing": "o_orderkey % 7 = 0", "started_at_invalid": "o_orderkey % 11 = 0", "ends_before_it_starts": "o_orderkey % 5 = 0 AND o_orderkey % 11 > 0", "pack_unknown": "o_custkey % 13 = 0",
    "secrecy_out_of_range": "o_custkey % 101 > 95", "confidence_out_of_range": "o_totalprice > 250000", "occurrence_repeated": "o_orderkey % 17 = 0", "asset_undeclared": "o_custkey % 6 = 0",
}


@query("a39_intake_errors", "SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'unparseable' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in _FAULTS.items()) + ") END AS errors FROM orders")
def a39(spark, sf):
    has = lambda code: F.expr(_FAULTS[code])
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    occurrence = lambda name, asset, sure: F.struct(name.alias("id"), asset.alias("assetId"), sure.alias("confidence"))
    sure = F.when(has("confidence_out_of_range"), 1.5).otherwise(0.5)
    payload = F.to_json(F.struct(
        F.when(~has("system_missing"), F.col("o_custkey").cast("string")).alias("systemName"), F.when(F.expr("o_orderkey % 11 = 0"), "soon").otherwise(day).alias("startedAt"), F.when(F.expr("o_orderkey % 5 = 0"), "1970-01-01").otherwise(day).alias("finishedAt"),
        F.when(has("pack_unknown"), "none").otherwise("eo-14412").alias("policyPackId"), F.when(has("secrecy_out_of_range"), 100.5).otherwise(5.0).alias("secrecyYears"), F.array(F.struct(F.lit("a").alias("id"), F.lit("RSA").alias("primitive"))).alias("assets"),
        F.array(occurrence(F.lit("x"), F.lit("a"), F.lit(1.0)), occurrence(F.when(has("occurrence_repeated"), "x").otherwise("y"), F.when(has("asset_undeclared"), "b").otherwise("a"), sure)).alias("occurrences"),
    ))
    sent = _table(spark, sf, "orders").select("o_orderkey", F.when(F.expr("o_orderkey % 19 = 0"), F.substring(payload, 1, 40)).otherwise(payload).alias("payload"))
    good, bad = intake.parted(intake.checked(sent, intake.SCAN, intake.scan_rules(["eo-14412"])), f"{shared_folder(spark)}/estatelens-intake-{uuid.uuid4().hex}")
    return good.select("o_orderkey", F.lit("").alias("errors")).union(bad.select("o_orderkey", F.array_join("errors", ",")))


# L: streams


# What a person reads


@query("b6_gate_lines", f"""WITH g AS ({ORACLE_SQL["k13_build_gate"]}) SELECT outcome AS heading, concat(count(*), ' blocking work items') AS line FROM g GROUP BY 1
 UNION ALL SELECT 'verdict', CASE WHEN count(*) FILTER (WHERE outcome = 'introduced') = 0 THEN 'the build passes' ELSE 'the build fails' END FROM g""")
def b6_gate(spark, sf):
    return export.gate_report(cut_lineage(QUERIES["k13_build_gate"](spark, sf), "outcomes"))


@query("b6_plan_lines", f"SELECT code AS heading, concat(count(*), ' targets') AS line FROM ({ORACLE_SQL['i14_authorize']}) GROUP BY 1")
def b6_plan(spark, sf):
    return export.plan_report(QUERIES["i14_authorize"](spark, sf))


@query("b6_reconcile_lines", f"SELECT system_id AS heading, concat(count(*), ' ', verdict) AS line FROM ({ORACLE_SQL['k14_reconcile']}) GROUP BY system_id, verdict")
def b6_reconcile(spark, sf):
    return export.reconcile_report(QUERIES["k14_reconcile"](spark, sf))


# Statements about each system, signed with a key whose public half verifies them

_SECRET, _KEY, _HEIGHT = "a fixed secret, as the SQL beside this query signs as well", "coverage-2026", 6


def _signing_sql(height: int) -> str:
    """The key's tree and the signatures in SQL: chains of hashes as lists that are folded."""
    advanced = lambda value, tag, start, end: f"list_reduce(list_transform(range({start}, {end}), lambda s: CAST(s AS STRING)), lambda a, s: sha256(concat({tag}, '/', c, '/', s, '/', a)), {value})"
    first = lambda tag: f"sha256(concat('{_SECRET}/', {tag}, '/', c))"
    levels = [
        f"""n{k} AS (SELECT node // 2 AS node, sha256(concat('{_KEY}/tree/{k}/', node // 2, '/', min_by(digest, node), '/', max_by(digest, node))) AS digest FROM n{k - 1} GROUP BY 1)"""
        for k in range(1, height + 1)
    ]
    return f"""chain AS (SELECT unnest(range({signing.CHAINS})) AS c), leaf0 AS (SELECT unnest(range({1 << height})) AS node), leaf1 AS (SELECT node, concat('{_KEY}/', node) AS tag FROM leaf0),
 ends AS (SELECT node, tag, c, {advanced(first("tag"), "tag", "0", "15")} AS v FROM leaf1, chain),
 n0 AS (SELECT node, sha256(concat(tag, '/', string_agg(v, '' ORDER BY c))) AS digest FROM ends GROUP BY node, tag), {", ".join(levels)},
 body AS (SELECT system_id, concat('{{"confirmed":', count(*) FILTER (WHERE level = 'CONFIRMED'), ',"observed":', count(*) FILTER (WHERE level = 'OBSERVED'), ',"suspected":', count(*) FILTER (WHERE level = 'SUSPECTED'), ',"system":"', system_id, '"}}') AS body FROM occ GROUP BY 1),
 dg AS (SELECT system_id, sha256(body) AS digest, row_number() OVER (ORDER BY sha256(body)) - 1 AS leaf FROM body),
 d1 AS (SELECT *, concat('{_KEY}/', leaf) AS tag, list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(digest, i, 1)) - 1) AS own FROM dg),
 d2 AS (SELECT *, concat(digest, lpad(lower(to_hex(960 - list_sum(own)::BIGINT)), 3, '0')) AS digits FROM d1),
 d3 AS (SELECT *, strpos('0123456789abcdef', substr(digits, c + 1, 1)) - 1 AS place FROM d2, chain),
 sg AS (SELECT system_id, leaf, digest, sha256(string_agg({advanced(first("tag"), "tag", "0", "place")}, ',' ORDER BY c)) AS chains_sha256 FROM d3 GROUP BY 1, 2, 3)"""


@query("k12_signed_statements", f"""WITH {_OCC}, {_signing_sql(_HEIGHT)} SELECT system_id, leaf, digest, chains_sha256, (SELECT digest FROM n{_HEIGHT}) AS root,
 CASE CAST(right(system_id, 2) AS INT) % 4 WHEN 1 THEN 'DIGEST_MISMATCH' WHEN 2 THEN 'BAD_SIGNATURE' WHEN 3 THEN CASE WHEN CAST(right(system_id, 2) AS INT) % 8 = 3 THEN 'BAD_KEY' ELSE 'EXPIRED_KEY' END ELSE 'OK' END AS verdict FROM sg""")
def k12_signed(spark, sf):
    tree = signing.key_tree(spark, _SECRET, _KEY, _HEIGHT)
    keys = signing.public_key(tree, _KEY, F.expr("timestamp '2027-01-01'"))
    made = cut_lineage(signing.sign(export.system_statements(_occ(spark, sf)), tree, _SECRET, _KEY), "signed")
    # some statements are changed, with and without their digest; some readers do not know the key, or look when it is over
    k = F.substring("system_id", -2, 2).cast("int")
    shown = made.withColumn("given", F.when(k % 4 == 1, F.concat("body", F.lit(" "))).when(k % 4 == 2, F.replace("body", F.lit('"observed":'), F.lit('"observed":1'))).otherwise(F.col("body")))
    other = keys.withColumn("key_id", F.lit("another"))
    given = shown.select("system_id", "leaf", F.col("given").alias("body"), F.when(k % 4 == 2, signing.body_digest(F.col("given"))).otherwise(F.col("digest")).alias("digest"), "key_id", "chains", "path", F.col("digest").alias("signed"))
    readers = ((keys, k % 4 != 3, "2026-08-28"), (other, k % 8 == 3, "2026-08-28"), (keys, k % 8 == 7, "2028-01-01"))
    a, b, c = (signing.checked(given.filter(rows), known, F.expr(f"timestamp '{at}'")) for known, rows, at in readers)
    return a.union(b).union(c).select("system_id", "leaf", F.col("signed").alias("digest"), F.sha2(F.array_join("chains", ","), 256).alias("chains_sha256"), "verdict").crossJoin(F.broadcast(keys.select("root")))


@query("l1_stream_edges", f"WITH {_EDGES.replace('c.ord FROM', 'c.ord, c.ts FROM')} SELECT date_trunc('day', ts) AS day, from_service, to_service, count(*) AS observations FROM pairs GROUP BY 1, 2, 3")
def l1(spark, sf):
    return live.replayed_edges(spark, f"{sf}/events.parquet")


@query("l2_stream_tally", f"WITH {_FOUND} SELECT occurrence_id, modality, count(*) AS n FROM found GROUP BY 1, 2")
def l2(spark, sf):
    return live.replayed_tally(spark, f"{sf}/lineitem.parquet")


@query("l3_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started_at, count(*) AS events FROM s GROUP BY user_id, k")
def l3(spark, sf):
    e = _table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("started_at"), "events")


from estatelens import source_queries  # noqa: E402, F401  the detectors' queries register themselves


_SLICED = f"""s0 AS (SELECT *, floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + CASE WHEN ord % 50 = 7 THEN 10 ELSE 0 END) / 6) AS slice FROM ({synth.as_sql("events", synth.SPANS)})),
 s1 AS (SELECT *, (SELECT max(ts) FROM s0 e WHERE e.slice < s0.slice) - INTERVAL 2 DAY AS horizon FROM s0),
 on_time AS (SELECT * FROM s1 WHERE horizon IS NULL OR ts >= horizon)"""


def _arriving(spark, sf):
    """Spans with the slice in which they come in: six days each, and one in fifty ten days late."""
    day = F.expr("datediff(cast(ts as date), date'2024-01-01') + case when ord % 50 = 7 then 10 else 0 end")
    return synth.spans(spark, sf).select("span_id", "parent_span_id", "service", F.col("ts").cast("timestamp").alias("ts"), F.floor(day / 6).alias("slice"))


@query("l4_bounded_pairs", f"""WITH {_SLICED} SELECT date_trunc('day', c.ts) AS day, p.service AS from_service, c.service AS to_service, count(*) AS observations
 FROM on_time c JOIN on_time p ON c.parent_span_id = p.span_id WHERE c.parent_span_id <> '' AND c.service <> p.service AND c.ts >= p.ts AND c.ts <= p.ts + INTERVAL 5 DAY GROUP BY 1, 2, 3""")
def l4(spark, sf):
    pairs, _, _ = state.replayed_pairs(_arriving(spark, sf), "slice", "2 days", "5 days")
    return pairs.groupBy(F.date_trunc("day", "ts").alias("day"), "from_service", "to_service").agg(F.count("*").alias("observations"))


@query("l5_late_spans", f"WITH {_SLICED} SELECT span_id, service FROM s1 WHERE ts < horizon")
def l5(spark, sf):
    _, late, _ = state.replayed_pairs(_arriving(spark, sf), "slice", "2 days", "5 days")
    return late.select("span_id", "service")


_STOOD = {
    "occurrence_id": "concat('occ-', CAST(o_custkey % 150 AS STRING))",
    "modality": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'SOURCE_AST' WHEN 1 THEN 'DEPENDENCY' WHEN 2 THEN 'BINARY_STRING' WHEN 3 THEN 'NETWORK_PASSIVE' WHEN 4 THEN 'ASSERTED' ELSE 'BINARY_SYMBOL' END END",
    "until": "CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 300 DAY + INTERVAL 12 HOUR END",
    "arrived": "CAST(o_orderdate AS TIMESTAMP)",
}


@query("l6_standing", f"""WITH e AS ({synth.as_sql("orders", _STOOD)}), m(modality, ceiling, grp) AS (VALUES ('SOURCE_AST', 0.95, 0), ('DEPENDENCY', 0.35, 0), ('BINARY_STRING', 0.30, 1), ('NETWORK_PASSIVE', 0.80, 2), ('ASSERTED', 0.40, 5), ('BINARY_SYMBOL', 0.85, 1)),
 g AS (SELECT occurrence_id, grp, max(CAST(ceiling AS DOUBLE)) AS c FROM e JOIN m USING (modality) GROUP BY 1, 2),
 p AS (SELECT occurrence_id, floor((1 - (1 - coalesce(max(c) FILTER (WHERE grp = 0), 0)) * (1 - coalesce(max(c) FILTER (WHERE grp = 1), 0)) * (1 - coalesce(max(c) FILTER (WHERE grp = 2), 0)) * (1 - coalesce(max(c) FILTER (WHERE grp = 5), 0))) * 1e4 + 0.5) / 1e4 AS confidence FROM g GROUP BY 1)
 SELECT occurrence_id, count(modality) AS n_evidence, coalesce(any_value(confidence), 0) AS confidence, coalesce(max(until) > (SELECT max(arrived) FROM e), false) AS suppressed FROM e LEFT JOIN p USING (occurrence_id) GROUP BY 1""")
def l6(spark, sf):
    events = _table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _STOOD.items()], F.expr("floor(year(o_orderdate) / 2)").alias("slice"))
    return state.latest(state.replayed_standing(events, "slice"))
