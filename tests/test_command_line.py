"""The command line over a small tree."""

import json

import pytest

from estatelens import __main__ as cli
from estatelens.operators import export, ledger


def test_from_scan_to_verified_bill(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "package.json").write_text('{"name": "app", "private": true, "dependencies": {"md5": "2"}}')
    (tree / "src" / "server.ts").write_text("import http from 'node:http';\nimport crypto from 'crypto';\nhttp.createServer(f);\ncrypto.generateKeyPairSync('rsa', { modulusLength: 2048 });\n")
    out, bill = str(tmp_path / "out"), str(tmp_path / "bill")
    assert cli.main(["scan", str(tree), "--system", "app", "--out", out, "--no-binaries"]) == 0
    found = spark.read.parquet(f"{out}/findings")
    assert {r["primitive"] for r in found.collect()} == {"RSA", "MD5"}
    assert {r["reached_via"] for r in spark.read.parquet(f"{out}/worklists").filter("asset_name like 'RSA%'").collect()} == {"ENTRY_POINT"}
    assert cli.main(["worklist", "--out", out]) == 0
    assert cli.main(["ci", "--out", out]) in (0, 1)
    assert cli.main(["bill", "--out", out, "--to", bill, "--include-suspected", "--key", "k"]) == 0
    assert cli.main(["verify", bill, "--key", "k"]) == 0 and cli.main(["verify", bill, "--key", "other"]) == 1
    baseline, shards, root = (str(tmp_path / x) for x in ("baseline", "shards", "store"))
    assert cli.main(["ci", "--out", out, "--json", "--update-baseline", baseline]) in (0, 1)
    assert cli.main(["ci", "--out", out, "--accepted", baseline, "--now", "2026-01-01"]) == 0
    assert cli.main(["bill", "--out", out, "--to", shards, "--include-suspected", "--shards"]) == 0 and export.whole(spark, shards)
    assert cli.main(["coverage", "--out", out, "--json"]) == 0
    assert cli.main(["keep", "--out", out, "--store", root, "--scan-id", "s1"]) == 0 and ledger.read(spark, root, "occurrences", "s1").count() == spark.read.parquet(f"{out}/occurrences").count()
    assert cli.main(["estate", "--store", root, "--now", "2026-08-28", "--json"]) == 0
    key, other, signed = (str(tmp_path / x) for x in ("key", "other", "signed"))
    for folder in (key, other):
        assert cli.main(["keygen", "--key", folder, "--secret", f"{folder}.secret", "--key-id", "coverage", "--height", "1", "--now", "2026-01-01"]) == 0
    for _ in range(2):
        assert cli.main(["coverage", "--out", out, "--key", key, "--secret", f"{key}.secret", "--to", signed]) == 0
    assert {r["leaf"] for r in spark.read.json(signed).collect()} == {1}
    assert cli.main(["verify-coverage", signed, "--trusted", key, "--now", "2026-08-28"]) == 0
    assert cli.main(["verify-coverage", signed, "--trusted", other, "--now", "2026-08-28"]) == 1
    assert cli.main(["verify-coverage", signed, "--trusted", key, "--now", "2027-08-28"]) == 1
    with pytest.raises(ValueError, match="free leaves"):
        cli.main(["coverage", "--out", out, "--key", key, "--secret", f"{key}.secret", "--to", str(tmp_path / "third")])
    statement = {"vendor": "v", "product": "p", "version": "1", "system_id": "app", "valid_until": "2090-01-01T00:00:00Z", "roadmap": {"status": "evaluating"}, "claims": [{"primitive": "AES", "parameters": "{}", "purpose": "DATA_ENCRYPTION"}]}
    (tmp_path / "statements").write_text(json.dumps(statement) + "\n")
    assert cli.main(["attest", str(tmp_path / "statements"), "--out", out, "--json"]) == 0
    assert json.loads(spark.read.json(bill).first()["body"])["bomFormat"] == "CycloneDX"


def test_plan_and_token(spark, tmp_path):
    (tmp_path / "targets").write_text("a.example.org\nb.other.org:8443\n")
    (tmp_path / "grant").write_text('{"target": "*.example.org", "ports": [443], "not_before": "2020-01-01T00:00:00Z", "not_after": "2090-01-01T00:00:00Z"}\n')
    assert cli.main(["probe-plan", str(tmp_path / "targets"), "--grant", str(tmp_path / "grant")]) == 0
    assert cli.main(["token"]) == 0 and cli.main(["policies", "--json"]) == 0
    (tmp_path / "payloads").write_text('{"spans": []}\n{"other": 1}\n')
    assert cli.main(["check", str(tmp_path / "payloads"), "--kind", "trace", "--json"]) == 1
