"""Signatures with separate keys: what holds, what does not, and that the verifier's side cannot sign."""

import hashlib

import pytest
from pyspark.sql import functions as F

from estatelens.functions.mosca import EO_14412
from estatelens.operators import signing

SECRET = "not a secret outside of this test, 40 characters"
AT = "timestamp '2026-08-28'"


@pytest.fixture(scope="module")
def tree(spark):
    return signing.key_tree(spark, SECRET, "k1", 3)


@pytest.fixture(scope="module")
def keys(tree):
    return signing.public_key(tree, "k1", F.expr("timestamp '2027-01-01'"))


@pytest.fixture(scope="module")
def signed(spark, tree):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, ""), (5, "b"), (6, "ü" * 500)], "id int, body string")
    return spark.createDataFrame(signing.sign(rows, tree, SECRET, "k1").collect())


def verdicts(rows, keys, at=AT):
    return {r["id"]: r["verdict"] for r in signing.checked(rows, keys, F.expr(at)).collect()}


def test_all_hold(signed, keys):
    assert set(verdicts(signed, keys).values()) == {"OK"} and signing.reused_leaves(signed).isEmpty()
    leaf = {r["id"]: r["leaf"] for r in signed.collect()}
    assert leaf[3] == leaf[4] and leaf[2] == leaf[5] and len(set(leaf.values())) == 4


def test_against_plain_python(signed, keys):
    sha = lambda *x: hashlib.sha256("/".join(map(str, x)).encode()).hexdigest()
    root = keys.first()["root"]
    for r in signed.collect():
        tag = f"k1/{r['leaf']}"
        digits = [int(c, 16) for c in r["digest"]]
        digits += [int(c, 16) for c in f"{sum(15 - d for d in digits):03x}"]
        ends = []
        for c, (place, value) in enumerate(zip(digits, r["chains"], strict=True)):
            for s in range(place, 15):
                value = sha(tag, c, s, value)
            ends.append(value)
        node, at = sha(tag, "".join(ends)), r["leaf"]
        for level, sibling in enumerate(r["path"], 1):
            left, right = (sibling, node) if at & 1 else (node, sibling)
            at >>= 1
            node = sha("k1", "tree", level, at, left, right)
        assert node == root


@pytest.mark.parametrize(
    ("change", "verdict"),
    [
        (lambda: {"body": F.lit("other")}, "DIGEST_MISMATCH"),
        (lambda: {"body": F.lit("other"), "digest": signing.body_digest(F.lit("other"))}, "BAD_SIGNATURE"),
        (lambda: {"key_id": F.lit("k2")}, "BAD_KEY"),
        (lambda: {"key_id": F.lit(None).cast("string")}, "BAD_KEY"),
        (lambda: {"leaf": F.col("leaf") + 1}, "BAD_SIGNATURE"),
        (lambda: {"leaf": F.col("leaf") + 8}, "BAD_SIGNATURE"),
        (lambda: {"leaf": F.lit(None).cast("long")}, "BAD_SIGNATURE"),
        (lambda: {"chains": F.lit(None).cast("array<string>")}, "BAD_SIGNATURE"),
        (lambda: {"chains": F.transform("chains", lambda x, i: F.when(i == 66, F.lit(None)).otherwise(x))}, "BAD_SIGNATURE"),
        (lambda: {"chains": F.slice("chains", 1, 66)}, "BAD_SIGNATURE"),
        (lambda: {"path": F.slice("path", 1, 2)}, "BAD_SIGNATURE"),
        (lambda: {"path": F.reverse("path")}, "BAD_SIGNATURE"),
    ],
)
def test_changes_are_seen(signed, keys, change, verdict):
    assert set(verdicts(signed.filter("id = 1").withColumns(change()), keys).values()) == {verdict}


def test_keys_expire_and_others_do_not_hold(spark, signed, keys):
    assert set(verdicts(signed, keys, "timestamp '2028-01-01'").values()) == {"EXPIRED_KEY"}
    other = signing.public_key(signing.key_tree(spark, SECRET[::-1], "k1", 3), "k1", F.expr("timestamp '2027-01-01'"))
    assert set(verdicts(signed, other).values()) == {"BAD_SIGNATURE"}


def test_leaves_run_out_and_are_not_given_twice(spark, tree, signed):
    rows = spark.range(5).select(F.col("id").cast("string").alias("body"))
    assert sorted(r["leaf"] for r in signing.sign(rows, tree, SECRET, "k1", 3).collect()) == [3, 4, 5, 6, 7]
    with pytest.raises(ValueError, match="free leaves"):
        signing.sign(rows, tree, SECRET, "k1", 4)
    with pytest.raises(ValueError, match="characters"):
        signing.key_tree(spark, "short", "k1", 1)
    again = signing.sign(rows, tree, SECRET, "k1", 0)
    assert not signing.reused_leaves(signed.select("key_id", "leaf", "digest").union(again.select("key_id", "leaf", "digest"))).isEmpty()
    assert signing.sign(rows.limit(0), tree, SECRET, "k1").count() == 0


def test_a_key_of_one_leaf(spark):
    tree = signing.key_tree(spark, SECRET, "k0", 0)
    made = signing.sign(spark.createDataFrame([("a",)], "body string"), tree, SECRET, "k0")
    assert signing.checked(made, signing.public_key(tree, "k0", F.expr("timestamp '2027-01-01'")), F.expr(AT)).first()["verdict"] == "OK"


def test_trust_of_packs(spark, tree, keys):
    made = signing.sign(spark.createDataFrame([("eo", signing.pack_body(EO_14412))], "name string, body string"), tree, SECRET, "k1", 7)
    edited = made.withColumns({"name": F.lit("edited"), "body": F.replace("body", F.lit("2035"), F.lit("2050"))})
    bare = made.withColumns({"name": F.lit("bare"), "chains": F.lit(None).cast("array<string>")})
    trust = lambda k: {r["name"]: r["trust"] for r in signing.pack_trust(made.union(edited).union(bare), k, F.expr(AT)).collect()}
    assert trust(keys) == {"eo": "SIGNED", "edited": "UNTRUSTED", "bare": "UNSIGNED"}
    assert trust(None) == {"eo": "UNTRUSTED", "edited": "UNTRUSTED", "bare": "UNSIGNED"}
    assert "migration" not in signing.pack_body(EO_14412)
