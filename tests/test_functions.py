"""Names, assets, numbers and scores against known values."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from estatelens.functions import assets, mosca, naming
from estatelens.operators import scope
from estatelens.queries import NAMES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    rows = spark.createDataFrame(sorted({(v, n) for v, n, *_ in NAMES}), "v string, n string")
    got = set()
    for vocabulary, of in naming.VOCABULARIES.items():
        for r in rows.filter(F.col("v") == vocabulary).select("n", F.explode(of(F.col("n"))).alias("s")).select("n", "s.*").collect():
            got.add((vocabulary, *r))
    assert got == set(NAMES)


@pytest.mark.parametrize("name", ["", "nonsense", "TLS", "aes"])
def test_names_that_mean_little_do_not_fail(spark, name):
    for of in naming.VOCABULARIES.values():
        assert isinstance(one(spark, of(F.lit(name))), list)
        assert isinstance(one(spark, of(F.lit(None).cast("string"))), (list, type(None)))


def golden(value, size):
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:size]


def test_ids_are_hashes_of_canonical_json(spark):
    rsa = one(spark, assets.asset_id(F.lit("RSA"), F.lit('{"modulusLength":2048}'), F.lit("KEY_ESTABLISHMENT")))
    assert rsa == "c6331ba3b2b40234da6dda460f49a7e6" == golden({"purpose": "KEY_ESTABLISHMENT", "primitive": "RSA", "parameters": {"modulusLength": 2048}}, 32)
    assert one(spark, assets.asset_id(F.lit("AES"), F.lit('{"keySize":256,"mode":"GCM"}'), F.lit("DATA_ENCRYPTION"))) == "74aa9a8b3f6b59dd8365fecb2ac30dce"
    assert one(spark, assets.asset_id(F.lit("X25519"), F.lit("{}"), F.lit("KEY_ESTABLISHMENT"))) == "dfd63780cf4e6829146ba93333973b86"
    assert one(spark, assets.occurrence_id(F.lit("payments-api"), F.lit(rsa), F.lit("SELF"))) == "93777224e6cb945ab7c90df3"
    odd = 'a"b\\c'
    assert one(spark, assets.occurrence_id(F.lit(odd), F.lit(rsa), F.lit("SELF"))) == golden({"systemId": odd, "assetId": rsa, "controlClass": "SELF"}, 24)


def test_canonical_json(spark):
    assert one(spark, assets.canonical_json(F.lit('{"b": [1, {"z": 1, "a": 2}], "a": "x"}'))) == '{"a":"x","b":[1,{"a":2,"z":1}]}'
    assert one(spark, assets.canonical_json(F.lit("{nope"))) is None


@pytest.mark.parametrize(
    ("primitive", "parameters", "bits", "vulnerable"),
    [
        ("RSA", '{"modulusLength":2048}', 112, True), ("RSA", '{"keySize":"3072"}', 128, True), ("RSA", "{}", None, True), ("ECDSA", '{"curve":"P-384"}', 192, True), ("ECDSA", '{"curve":"P-224"}', None, True),
        ("AES", '{"keySize":128}', 128, True), ("AES", '{"keySize":256}', 256, False), ("AES", "{}", None, False), ("ChaCha20", "{}", 256, False), ("SHA2", '{"outputLength":256}', 128, False), ("SHA2", '{"outputLength":224}', 112, True),
        ("MD5", "{}", 0, True), ("ML-KEM", "{}", None, False), ("HMAC", "{}", None, False),
    ],
)
def test_asset_facts(spark, primitive, parameters, bits, vulnerable):
    p, j = F.lit(primitive), F.lit(parameters)
    assert one(spark, assets.security_bits(p, j)) == bits
    assert one(spark, assets.quantum_vulnerable(p, j)) is vulnerable


def test_rounding_is_half_up_on_the_double(spark):
    assert one(spark, assets.round_half_up(F.lit(1.005), 2)) == 1.0
    assert one(spark, assets.round_half_up(F.lit(-0.125), 2)) == -0.12


def test_decimal_year(spark):
    assert one(spark, assets.decimal_year(F.expr("timestamp '2026-08-28'"))) == 2026.6548


@pytest.mark.parametrize(("have", "below"), [("3.4.9", True), ("3.5", False), ("3.5.1", False), ("3", True), ("x", True), ("7p1", False), ("3.5-r1", False)])
def test_versions(spark, have, below):
    assert one(spark, assets.version_below(F.lit(have), "3.5")) is below


@pytest.mark.parametrize(
    ("track", "control", "crqc", "regulatory", "binding", "late"),
    [
        ("CONFIDENTIALITY", "SELF", 2.84, 3.84, "CRQC", False), ("CONFIDENTIALITY", "VENDOR_LOCKED", -0.66, 0.34, "CRQC", True), ("CONFIDENTIALITY", "PROTOCOL_BILATERAL", -1.66, -0.66, "CRQC", True),
        ("AUTHENTICITY", "HARDWARE", 2.34, -0.66, "REGULATORY", True),
    ],
)
def test_slack(spark, track, control, crqc, regulatory, binding, late):
    s = one(spark, mosca.score(F.lit(track), F.lit(control), mosca.EO_14412, 2026.66))
    assert (s["crqc_slack"], s["regulatory_slack"], s["binding"], s["late"]) == (crqc, regulatory, binding, late)


def test_slack_without_deadline_and_with_overrides(spark):
    s = one(spark, mosca.score(F.lit("AUTHENTICITY"), F.lit("SELF"), mosca.IR_8547_DRAFT, 2026.66))
    assert s["binding"] == "CRQC" and s["regulatory_slack"] is None
    assert one(spark, mosca.score(F.lit("AUTHENTICITY"), F.lit("SELF"), mosca.EO_14412, 2026.66, migration_years=F.lit(9.0)))["y"] == 9.0


@pytest.mark.parametrize(
    ("target", "host", "ok"),
    [
        ("10.0.0.0/8", "10.255.0.1", True), ("10.0.0.0/8", "11.0.0.1", False), ("0.0.0.0/0", "1.2.3.4", True), ("1.2.3.4/32", "1.2.3.5", False), ("10.0.0.0/33", "10.0.0.1", False), ("*.example.com", "a.example.com", True),
        ("*.example.com", "a.b.example.com", False), ("*.example.com", "example.com", False), ("2001:db8::/32", "2001:db8:1::1", True), ("2001:db8::/33", "2001:db8:8000::1", False), ("2001:db8::1", "2001:0db8:0:0:0:0:0:1", True),
        ("Example.com.", "example.com", True), ("01.2.3.4", "1.2.3.4", False), ("*", "x", False),
    ],
)
def test_targets(spark, target, host, ok):
    assert one(spark, scope.target_matches(F.lit(target), F.lit(host))) is ok
    hosts, targets = spark.createDataFrame([(host,)], "host string"), spark.createDataFrame([(target,)], "target string")
    assert bool(scope.matching_targets(hosts, targets).count()) is ok


@pytest.mark.parametrize(("text", "host", "port"), [("h:8443", "h", 8443), ("[2001:db8::1]:22", "2001:db8::1", 22), ("h.example.", "h.example", 443), ("[::1]", "::1", 443)])
def test_split_target(spark, text, host, port):
    assert tuple(one(spark, scope.split_target(F.lit(text)))) == (host, port)


def test_authorize_codes(spark):
    requests = spark.createDataFrame([("10.0.0.1", 443), ("10.0.0.1", 22), ("11.0.0.1", 443)], "host string, port int")
    grant = spark.createDataFrame([("10.0.0.0/8",)], "target string").select("target", F.array(F.lit(443)).alias("ports"), F.expr("timestamp '2026-01-01'").alias("not_before"), F.expr("timestamp '2026-02-01'").alias("not_after"))
    at = lambda t, skew=0: [r["code"] for r in scope.authorize(requests, grant, F.expr(f"timestamp '{t}'"), skew).orderBy("host", F.desc("port")).collect()]
    assert at("2026-01-15") == ["OK", "PORT_OUT_OF_SCOPE", "TARGET_OUT_OF_SCOPE"]
    assert at("2025-12-31 23:58:00") == ["NOT_YET_VALID"] * 3 and at("2025-12-31 23:58:00", 9999)[0] == "OK"
    assert at("2026-03-01") == ["EXPIRED"] * 3


def test_keyed_digest_is_hmac(spark):
    import hashlib
    import hmac

    from pyspark.sql import functions as F

    from estatelens.operators import export

    rows = [("",), ("body",), ("ünïcode 文",)]
    for key in ("k", "x" * 100):
        got = export.verified(export.signed(spark.createDataFrame(rows, "body string"), key), key).select("body", "signature", "valid").collect()
        assert all(r["signature"] == hmac.new(key.encode(), r["body"].encode(), hashlib.sha256).hexdigest() and r["valid"] for r in got)
    changed = export.verified(export.signed(spark.createDataFrame(rows, "body string"), "k").withColumn("body", F.concat("body", F.lit("!"))), "k")
    assert not changed.filter("valid").count()


def test_reports(spark):
    from estatelens.operators import export

    outcomes = spark.createDataFrame([("introduced",), ("accepted",), ("accepted",)], "outcome string")
    assert {tuple(r) for r in export.gate_report(outcomes).collect()} == {("introduced", "1 blocking work items"), ("accepted", "2 blocking work items"), ("verdict", "the build fails")}
    assert export.gate_report(outcomes.filter("outcome = 'accepted'")).filter("heading = 'verdict'").first()["line"] == "the build passes"
    assert {tuple(r) for r in export.plan_report(spark.createDataFrame([("OK",), ("EXPIRED",)], "code string")).collect()} == {("OK", "1 targets"), ("EXPIRED", "1 targets")}
    assert {tuple(r) for r in export.reconcile_report(spark.createDataFrame([("s", "UNVERIFIED")], "system_id string, verdict string")).collect()} == {("s", "1 UNVERIFIED")}
