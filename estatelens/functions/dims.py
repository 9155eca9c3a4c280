"""Dimension tables: fixed values of the domain, as plain Python data and as small broadcastable DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evidence modality, ceiling, independence group, deployment view, capability view.
MODALITIES = (
    ("SOURCE_AST", 0.95, 0, False, True),
    ("SOURCE_CONFIG", 0.90, 0, False, True),
    ("DEPENDENCY", 0.35, 0, False, True),
    ("BINARY_SYMBOL", 0.85, 1, False, True),
    ("BINARY_CONSTANT", 0.90, 1, False, True),
    ("BINARY_STRING", 0.30, 1, False, True),
    ("HOST_AGENT", 0.90, 1, True, False),
    ("NETWORK_ACTIVE", 0.98, 2, True, False),
    ("NETWORK_PASSIVE", 0.80, 2, True, False),
    ("PKI_CERTIFICATE", 0.99, 3, True, False),
    ("CLOUD_KMS_API", 0.97, 3, True, False),
    ("RUNTIME_HOOK", 0.97, 4, True, False),
    ("ASSERTED", 0.40, 5, False, True),
)
GROUPS = 6
DEPLOYMENT = tuple(m[0] for m in MODALITIES if m[3])
CAPABILITY = tuple(m[0] for m in MODALITIES if m[4])

#: Purposes whose traffic can be recorded now and read later.
HARVESTABLE = ("KEY_ESTABLISHMENT", "DATA_ENCRYPTION")
PURPOSES = ("KEY_ESTABLISHMENT", "DATA_ENCRYPTION", "DIGITAL_SIGNATURE", "CERTIFICATE_AUTH", "INTEGRITY", "KEY_DERIVATION", "RANDOMNESS")
CONTROL_CLASSES = ("SELF", "VENDOR_UPGRADEABLE", "VENDOR_LOCKED", "HARDWARE", "PROTOCOL_BILATERAL")
#: Assertion levels from weak to strong, and the confidences at which the upper two begin.
LEVELS = ("SUSPECTED", "OBSERVED", "CONFIRMED")
OBSERVE_THRESHOLD, CONFIRM_THRESHOLD = 0.5, 0.85

#: Families of algorithms.
SHOR_BROKEN = ("RSA", "ECDSA", "ECDH", "DH", "DSA", "EdDSA", "X25519", "X448")
PQ_SAFE = ("ML-KEM", "ML-DSA", "SLH-DSA", "LMS", "XMSS")
CLASSICALLY_BROKEN = ("3DES", "RC4", "MD5", "SHA1")
#: Security bits of named curves.
CURVE_BITS = {
    "P-256": 128, "P-384": 192, "P-521": 256, "secp256r1": 128, "secp384r1": 192, "secp521r1": 256, "secp256k1": 128,
    "prime256v1": 128, "Curve25519": 128, "X25519": 128, "X448": 224, "Ed25519": 128, "Ed448": 224,
}
#: Object identifiers.
OIDS = {
    "RSA": "1.2.840.113549.1.1.1", "ECDSA": "1.2.840.10045.2.1", "DSA": "1.2.840.10040.4.1", "DH": "1.2.840.113549.1.3.1", "X25519": "1.3.101.110",
    "X448": "1.3.101.111", "SHA1": "1.3.14.3.2.26", "MD5": "1.2.840.113549.2.5", "ML-KEM": "2.16.840.1.101.3.4.4", "ML-DSA": "2.16.840.1.101.3.4.3",
}

#: Classes of an estate and the modalities that examine each.
ESTATE_CLASSES = (
    ("APPLICATION_SOURCE", ("SOURCE_AST", "RUNTIME_HOOK")),
    ("DEPLOYED_CONFIG", ("SOURCE_CONFIG", "HOST_AGENT")),
    ("DEPENDENCIES", ("DEPENDENCY",)),
    ("VENDOR_BINARIES", ("BINARY_SYMBOL", "BINARY_CONSTANT", "BINARY_STRING")),
    ("CERTIFICATES", ("PKI_CERTIFICATE",)),
    ("MANAGED_KEYS", ("CLOUD_KMS_API",)),
    ("NETWORK_ENDPOINTS", ("NETWORK_ACTIVE", "NETWORK_PASSIVE")),
    ("HOSTS", ("HOST_AGENT",)),
    ("APPLIANCES", ("NETWORK_ACTIVE", "ASSERTED")),
    ("THIRD_PARTY_SAAS", ("ASSERTED",)),
)

#: Bill-of-materials vocabulary of primitives, purposes and modalities.
PRIMITIVE_KIND = {
    "RSA": "pke", "ECDSA": "signature", "ECDH": "key-agree", "DH": "key-agree", "DSA": "signature", "EdDSA": "signature", "X25519": "key-agree", "X448": "key-agree",
    "ML-KEM": "kem", "ML-DSA": "signature", "SLH-DSA": "signature", "LMS": "signature", "XMSS": "signature", "AES": "block-cipher", "ChaCha20": "stream-cipher",
    "3DES": "block-cipher", "RC4": "stream-cipher", "SHA1": "hash", "SHA2": "hash", "SHA3": "hash", "MD5": "hash", "HMAC": "mac", "PBKDF2": "kdf", "Argon2": "kdf",
    "scrypt": "kdf", "UNKNOWN": "unknown",
}
PURPOSE_FUNCTIONS = {
    "KEY_ESTABLISHMENT": ("keygen", "encapsulate", "decapsulate"), "DATA_ENCRYPTION": ("encrypt", "decrypt"), "DIGITAL_SIGNATURE": ("sign", "verify"),
    "CERTIFICATE_AUTH": ("sign", "verify"), "INTEGRITY": ("digest", "tag"), "KEY_DERIVATION": ("keyderive",), "RANDOMNESS": ("generate",),
}
TECHNIQUES = {
    "SOURCE_AST": "source-code-analysis", "SOURCE_CONFIG": "source-code-analysis", "DEPENDENCY": "manifest-analysis", "BINARY_SYMBOL": "binary-analysis",
    "BINARY_CONSTANT": "binary-analysis", "BINARY_STRING": "binary-analysis", "HOST_AGENT": "filename", "RUNTIME_HOOK": "instrumentation",
    "NETWORK_ACTIVE": "dynamic-analysis", "NETWORK_PASSIVE": "dynamic-analysis", "PKI_CERTIFICATE": "certificate", "CLOUD_KMS_API": "attestation", "ASSERTED": "attestation",
}


def lookup(key: Column, table: dict[str, object]) -> Column:
    """The value of a key in a fixed table, null without one."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)


def modalities(spark: SparkSession) -> DataFrame:
    """modality, ceiling, grp, grp_ord (place inside the group), deployment, capability; 13 rows."""
    rows = [(m, c, g, sum(x[2] == g for x in MODALITIES[:k]), d, p) for k, (m, c, g, d, p) in enumerate(MODALITIES)]
    return spark.createDataFrame(rows, "modality string, ceiling double, grp int, grp_ord int, deployment boolean, capability boolean")


def estate_classes(spark: SparkSession) -> DataFrame:
    """class, modality; one row per pair."""
    return spark.createDataFrame([(c, m) for c, every in ESTATE_CLASSES for m in every], "class string, modality string")
