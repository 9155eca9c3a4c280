"""Signatures with separate keys for signing and verifying, made of SHA-256 alone, as column expressions.

Spark has a hash function but no elliptic curves, so an artifact is signed with a one-time key of hash chains (Winternitz), and
the one-time keys of a signer stand under a hash tree (Merkle) whose root is the public key. Whoever has the root can verify
and cannot sign. A key of height h signs 2^h different artifacts; the signer must never use a leaf for two, so numbers of
leaves go up and are never given back (sign() takes the first free one and refuses to go beyond the last).

A digest of 64 hexadecimal digits and 3 digits of a checksum name a place in each of 67 chains of 16 values; the signature
shows those values, and hashing on to the ends of the chains gives the one-time public key. Each step hashes where it is
taken (key, leaf, chain, step), so that no value serves elsewhere. The secret must be random and at least 32 characters long.

This is neither Ed25519 nor a standardised profile of hash signatures: both sides need this module.

Defined results: a null body has the digest of an empty text; equal bodies share a leaf and a signature; an artifact that
lacks a signature or whose parts have a wrong number or are null is a BAD_SIGNATURE; unknown keys are a BAD_KEY.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.common import cut_lineage
from estatelens.functions.mosca import PolicyPack
from estatelens.operators import order

#: Values of a chain, digits of a digest, and of the checksum.
STEPS, DIGITS, CHECKS = 16, 64, 3
CHAINS = DIGITS + CHECKS
LEAST_SECRET = 32


def body_digest(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")), 256)


def _tag(key_id: Column, leaf: Column) -> Column:
    return F.concat_ws("/", key_id, leaf.cast("string"))


def _places(digest: Column) -> Column:
    """The place in each chain that a digest names: its digits, and those of the sum of what they lack."""
    at = lambda text, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.conv(F.substring(text, i, F.lit(1)), 16, 10).cast("int"))
    own = at(digest, DIGITS)
    lacking = F.aggregate(own, F.lit(0), lambda a, d: a + F.lit(STEPS - 1) - d)
    return F.concat(own, at(F.lpad(F.lower(F.hex(lacking)), CHECKS, "0"), CHECKS))


def _advanced(value: Column, tag: Column, chain: Column, start: Column, end: Column) -> Column:
    """A chain's value at end from the one at start."""
    steps = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, value, lambda a, s: F.sha2(F.concat_ws("/", tag, chain.cast("string"), s.cast("string"), a), 256))


def _first(secret: str, tag: Column, chain: Column) -> Column:
    return F.sha2(F.concat_ws("/", F.lit(secret), tag, chain.cast("string")), 256)


def _one_time(ends: Column, tag: Column) -> Column:
    return F.sha2(F.concat_ws("/", tag, F.array_join(ends, "")), 256)


def _parent(key_id: Column, level: Column, node: Column, left: Column, right: Column) -> Column:
    return F.sha2(F.concat_ws("/", key_id, F.lit("tree"), level.cast("string"), node.cast("string"), left, right), 256)


def key_tree(spark: SparkSession, secret: str, key_id: str, height: int) -> DataFrame:
    """All nodes of a key's tree (level, node, digest), leaves at level 0: the signer's table. Nothing in it is secret."""
    if len(secret) < LEAST_SECRET:
        raise ValueError(f"a secret needs at least {LEAST_SECRET} random characters")
    if not 0 <= height <= 30:
        raise ValueError("height must be between 0 and 30")
    tag, key = _tag(F.lit(key_id), F.col("node")), F.lit(key_id)
    last = F.lit(STEPS - 1)
    ends = F.transform(F.sequence(F.lit(0), F.lit(CHAINS - 1)), lambda c: _advanced(_first(secret, tag, c), tag, c, F.lit(0), last))
    leaves = spark.range(1 << height).select(F.lit(0).alias("level"), F.col("id").alias("node"), _one_time(ends, tag).alias("digest"))
    tree = level = cut_lineage(leaves, "leaves")
    for k in range(1, height + 1):
        pairs = level.groupBy(F.shiftright("node", 1).alias("node")).agg(F.min_by("digest", "node").alias("left"), F.max_by("digest", "node").alias("right"))
        level = pairs.select(F.lit(k).alias("level"), "node", _parent(key, F.lit(k), F.col("node"), F.col("left"), F.col("right")).alias("digest"))
        tree = tree.union(level)
    return cut_lineage(tree, "key-tree")


def public_key(tree: DataFrame, key_id: str, not_after: Column) -> DataFrame:
    """One row (key_id, root, height, not_after) to hand to those who verify."""
    return tree.agg(F.max_by("digest", "level").alias("root"), F.max("level").alias("height")).select(F.lit(key_id).alias("key_id"), "root", "height", not_after.alias("not_after"))


def free_leaves(tree: DataFrame, first: int) -> int:
    """How many different artifacts a key can still sign."""
    return max(0, (1 << tree.agg(F.max("level").alias("h")).first()["h"]) - first)


def sign(artifacts: DataFrame, tree: DataFrame, secret: str, key_id: str, first: int = 0) -> DataFrame:
    """artifacts (body, ...) with digest, key_id, leaf, chains and path. Different bodies take leaves from first on, in the order of their digests."""
    known = cut_lineage(artifacts.withColumn("digest", body_digest(F.col("body"))), "artifacts")
    different = known.select("digest").distinct()
    height = tree.agg(F.max("level").alias("h")).first()["h"]
    needed, free = different.count(), free_leaves(tree, first)
    if first < 0 or needed > free:
        raise ValueError(f"the key has {free} free leaves and {needed} artifacts differ")
    leaves = order.numbered(different, ["digest"]).select("digest", (F.col("place") - 1 + first).alias("leaf"))
    # the sibling of each node between a leaf and the root
    asked = leaves.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(height - 1)) if height else F.array().cast("array<int>")).alias("level"))
    asked = asked.withColumn("node", F.expr("shiftright(leaf, level) ^ 1"))
    paths = asked.join(tree, ["level", "node"]).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("path"))
    paths = paths.select("leaf", F.transform("path", lambda p: p["digest"]).alias("path"))
    tag = _tag(F.lit(key_id), F.col("leaf"))
    shown = F.transform(_places(F.col("digest")), lambda place, c: _advanced(_first(secret, tag, c), tag, c, F.lit(0), place))
    made = leaves.join(paths, "leaf", "left").select("digest", F.lit(key_id).alias("key_id"), "leaf", shown.alias("chains"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))
    return known.join(made, "digest").select(*artifacts.columns, "digest", "key_id", "leaf", "chains", "path")


def _root() -> Column:
    """The root that a signature leads to."""
    tag = _tag(F.col("key_id"), F.col("leaf"))
    ends = F.transform(F.arrays_zip(_places(F.col("digest")).alias("place"), F.col("chains").alias("value")), lambda z, c: _advanced(z["value"], tag, c, z["place"], F.lit(STEPS - 1)))

    def up(low: Column, step: Column) -> Column:
        level, sibling = step["level"], step["sibling"]
        right = F.pmod(F.floor(F.col("leaf") / F.pow(F.lit(2), level - 1)), F.lit(2)) == 1
        return _parent(F.col("key_id"), level, F.floor(F.col("leaf") / F.pow(F.lit(2), level)), F.when(right, sibling).otherwise(low), F.when(right, low).otherwise(sibling))

    steps = F.transform("path", lambda p, i: F.struct((i + 1).alias("level"), p.alias("sibling")))
    return F.aggregate(steps, _one_time(ends, tag), up)


def checked(signed: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """signed (body, digest, key_id, leaf, chains, path, ...) with verdict: OK, DIGEST_MISMATCH, BAD_KEY, EXPIRED_KEY or BAD_SIGNATURE.

    keys are those that the reader trusts (public_key() of each signer); a key that comes with an artifact proves nothing.
    """
    trusted = keys.select("key_id", F.col("root").alias("_root"), F.col("height").alias("_height"), F.col("not_after").alias("_until"))
    rows = signed.join(trusted, "key_id", "left")
    shaped = (F.size("chains") == CHAINS) & (F.size("path") == F.col("_height")) & (F.col("leaf") >= 0) & (F.col("leaf") < F.pow(F.lit(2), F.col("_height")))
    verdict = (
        F.when(~body_digest(F.col("body")).eqNullSafe(F.col("digest")), "DIGEST_MISMATCH").when(F.col("_root").isNull(), "BAD_KEY").when(at > F.col("_until"), "EXPIRED_KEY")
        .when(F.coalesce(shaped, F.lit(False)), F.when(_root().eqNullSafe(F.col("_root")), "OK").otherwise("BAD_SIGNATURE")).otherwise("BAD_SIGNATURE")
    )
    return rows.select(*signed.columns, verdict.alias("verdict"))


def reused_leaves(signed: DataFrame) -> DataFrame:
    """Leaves that signed different artifacts, which a signer must not do: key_id, leaf, artifacts."""
    return signed.groupBy("key_id", "leaf").agg(F.countDistinct("digest").alias("artifacts")).filter("artifacts > 1")


def pack_body(pack: PolicyPack) -> str:
    """What a publisher signs of a policy: identity and dates. Migration years are the user's own and stay outside."""
    signed = ("pack_id", "pack_version", "crqc_year", "confidentiality_deadline", "authenticity_deadline")
    return json.dumps({k: getattr(pack, k) for k in sorted(signed)}, separators=(",", ":"))


def pack_trust(packs: DataFrame, keys: DataFrame | None, at: Column) -> DataFrame:
    """packs (body, digest, key_id, leaf, chains, path, ...) with trust (SIGNED, UNSIGNED, UNTRUSTED) and reason."""
    none = packs.sparkSession.createDataFrame([], "key_id string, root string, height int, not_after timestamp")
    rows = checked(packs, none if keys is None else keys, at)
    unsigned = F.coalesce(F.size("chains") <= 0, F.lit(True))
    reason = (
        F.when(unsigned, "no publisher has signed this policy")
        .when(F.col("verdict") == "OK", "the holder of the publisher's key has signed these dates")
        .when(F.col("verdict") == "BAD_KEY", "signed, but no key of this publisher is trusted here")
        .when(F.col("verdict") == "EXPIRED_KEY", "the publisher's key has expired")
        .otherwise("the dates are not those that were signed")
    )
    return rows.select(*packs.columns, F.when(unsigned, "UNSIGNED").when(F.col("verdict") == "OK", "SIGNED").otherwise("UNTRUSTED").alias("trust"), reason.alias("reason"))
