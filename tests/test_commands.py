"""From a tree on disk to worklists, a gate and a document."""

import json

import pytest
from pyspark.sql import functions as F

from estatelens.functions.mosca import EO_14412
from estatelens.operators import store
from estatelens.plans import commands

TREE = {
    "src/server.ts": "import { run } from './keys';\nimport http from 'http';\nhttp.createServer(run);\n",
    "src/keys.ts": "import crypto from 'crypto';\nexport function run() { crypto.generateKeyPairSync('rsa', { modulusLength: 2048 }); }\n",
    "src/orphan.ts": "import crypto from 'crypto';\nexport const x = () => crypto.createHash('md5');\n",
    "src/app.py": "import hashlib\nif __name__ == '__main__':\n    hashlib.sha1(b'')\n",
    "conf/nginx.conf": "ssl_ciphers ECDHE-RSA-AES128-GCM-SHA256;\n",
    "requirements.txt": "paramiko==3\n",
    "node_modules/x/index.js": "require('crypto').createHash('md5')\n",
    "broken.py": "def (\n",
}
AT = F.expr


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return commands.scan(commands.read_tree(spark, str(root)), "shop", EO_14412, AT("timestamp '2026-08-28'"))


def test_scan(result):
    rows = {(r["asset_name"], r["reached_via"], r["bucket"]) for r in result.worklists.collect()}
    assert ("RSA(modulusLength=2048)", "ENTRY_POINT", "confidentiality") in rows
    assert ("MD5(outputLength=128)", "NONE", "unreached") in rows
    assert ("SHA1(outputLength=160)", "ENTRY_POINT", "authenticity") in rows
    assert ("ECDH(ephemeral=true)", "DEPLOYED_CONFIG", "confidentiality") in rows
    assert any(b == "hints" for *_, b in rows)
    assert {tuple(r) for r in result.skipped.collect()} == {("broken.py", "does not parse")}
    assert not result.findings.filter("locator like '%node_modules%'").count()


def test_gate_and_document(spark, result):
    none = spark.createDataFrame([], "occurrence_id string")
    no_suppressions = spark.createDataFrame([], "occurrence_id string, expires_at timestamp, reason string")
    now = AT("timestamp '2026-08-28'")
    rows, _, outcome = commands.ci(result, none, no_suppressions, now)
    assert outcome.first()["passed"] is False and outcome.first()["introduced"] == rows.count() > 0
    assert commands.ci(result, rows.select("occurrence_id"), no_suppressions, now)[2].first()["passed"] is True
    a, b = (commands.bill_of_materials(result, EO_14412, "2026-08-28T00:00:00Z").first() for _ in range(2))
    body = json.loads(a["body"])
    assert a == b and body["specVersion"] == "1.7" and {c["name"] for c in body["components"]} >= {"RSA(modulusLength=2048)"}
    assert commands.derivation(result.findings, rows.first()["occurrence_id"]).filter("path = ''").count() == 1
    assert len(commands.coverage_attestation(result.occurrences).first()["digest"]) == 64


def test_estate(spark, result, tmp_path):
    root = str(tmp_path)
    scans = spark.createDataFrame([("s1", "shop", "2026-01-01"), ("s0", "shop", "2025-01-01")], "scan_id string, system_name string, t string").select("scan_id", "system_name", F.to_timestamp("t").alias("started_at"))
    store.put(root, "scans", scans)
    store.put(root, "assets", result.assets)
    store.put(root, "occurrences", result.occurrences.withColumn("scan_id", F.lit("s1")))
    store.put(root, "edges", spark.createDataFrame([("t1", "web", "shop", 3, "GET")], "scan_id string, from_service string, to_service string, observations long, operation string"))
    via = {r["asset_name"]: r["reached_via"] for r in commands.estate(root, spark, EO_14412, 2026.66).collect()}
    assert via["RSA(modulusLength=2048)"] == "ENTRY_POINT"  # a system that is reached on its own is a root
    assert commands.estate(root, spark, EO_14412, 2026.66, ["other"]).count() == 0


def test_packs_and_traces(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"packId": "p", "packVersion": "2", "crqcYear": 2030, "regulatoryDeadlines": {"CONFIDENTIALITY": None, "AUTHENTICITY": 2032}, "migrationYearsByControl": {"SELF": 1}}))
    pack = commands.load_pack(spark, str(tmp_path / "p.json"))
    assert (pack.confidentiality_deadline, pack.authenticity_deadline, pack.migration_years["SELF"], pack.migration_years["HARDWARE"], pack.trust) == (None, 2032.0, 1.0, 6.0, "UNSIGNED")
    (tmp_path / "t.json").write_text(json.dumps({"from": "a", "to": "b", "spans": [{"service": "x", "spanId": "1"}]}))
    (tmp_path / "o.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "y"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "1", "name": "", "attributes": [{"key": "http.route", "value": {"stringValue": "/r"}}]}]}]}]}))
    assert commands.load_traces(spark, str(tmp_path / "t.json")).first()["service"] == "x"
    assert commands.load_traces(spark, str(tmp_path / "o.json")).first()["operation"] == "/r"
    with pytest.raises(ValueError, match="neither"):
        commands.load_traces(spark, str(tmp_path / "p.json"))


def test_probe_plan(spark):
    targets = spark.createDataFrame([("a.example.com:443",), ("b.other.com",)], "target string")
    grant = spark.createDataFrame([("*.example.com",)], "target string").select("target", F.array().cast("array<int>").alias("ports"), AT("timestamp '2026-01-01'").alias("not_before"), AT("timestamp '2027-01-01'").alias("not_after"))
    assert {r["asked"]: r["code"] for r in commands.probe_plan(targets, grant, AT("timestamp '2026-06-01'")).collect()} == {"a.example.com:443": "OK", "b.other.com": "TARGET_OUT_OF_SCOPE"}
