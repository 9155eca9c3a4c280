"""Algorithm names of many vocabularies as specs: arrays of (primitive, parameters, purpose) columns.

Each function takes a column of names and gives array<struct<primitive, parameters, purpose>>, empty if the
name means nothing; parameters are canonical JSON. All are expressions, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions.dims import lookup

#: Dashless hash names to primitive and output bits.
HASHES = {
    "md5": ("MD5", 128), "md5sha1": ("MD5", 128), "sha1": ("SHA1", 160), "sha": ("SHA1", 160), "sha224": ("SHA2", 224), "sha256": ("SHA2", 256), "sha384": ("SHA2", 384),
    "sha512": ("SHA2", 512), "sha512224": ("SHA2", 224), "sha512256": ("SHA2", 256), "sha3224": ("SHA3", 224), "sha3256": ("SHA3", 256), "sha3384": ("SHA3", 384),
    "sha3512": ("SHA3", 512), "blake2b512": ("UNKNOWN", 512), "blake2s256": ("UNKNOWN", 256),
}
#: Curve spellings.
CURVES = {
    "p-256": "P-256", "prime256v1": "P-256", "secp256r1": "P-256", "nistp256": "P-256", "p-384": "P-384", "secp384r1": "P-384", "nistp384": "P-384", "p-521": "P-521",
    "secp521r1": "P-521", "nistp521": "P-521", "secp256k1": "secp256k1", "p-224": "P-224", "secp224r1": "P-224", "x25519": "X25519", "curve25519": "X25519",
    "ed25519": "Ed25519", "x448": "X448", "ed448": "Ed448",
}
#: Bits of the numbered Diffie-Hellman groups.
DH_GROUPS = {"1": 768, "5": 1536, "14": 2048, "15": 3072, "16": 4096, "17": 6144, "18": 8192}
#: Ciphers without a primitive of their own.
OTHER_CIPHERS = {"des": "DES", "rc2": "RC2", "blowfish": "Blowfish", "cast5": "CAST5", "idea": "IDEA"}

SPECS = "array<struct<primitive:string,parameters:string,purpose:string>>"


def spec(primitive: str | Column, purpose: str | Column | None, **parameters: object) -> Column:
    """One spec; parameters that are null are left out."""
    columns = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in sorted(parameters.items())]
    text = F.to_json(F.struct(*columns)) if columns else F.lit("{}")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(as_column(primitive).alias("primitive"), text.alias("parameters"), as_column(purpose).alias("purpose"))


def _none() -> Column:
    return F.array().cast(SPECS)


def _some(*specs: Column) -> Column:
    return F.array(*specs).cast(SPECS)


def _kept(*optional: Column) -> Column:
    """An array of the specs that are not null."""
    return F.array_compact(F.array(*optional)).cast(SPECS)


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of a match, null without one."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def _hash(name: Column, purpose: str | None) -> Column:
    """A hash spec or null."""
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "^-+|-+$", ""), "^sha2-([0-9])", "sha$1"), "-", "")
    primitive, bits = lookup(key, {k: v[0] for k, v in HASHES.items()}), lookup(key, {k: v[1] for k, v in HASHES.items()})
    shown = F.when(key == "blake2b512", "BLAKE2b").when(key == "blake2s256", "BLAKE2s")
    return F.when(primitive.isNotNull(), spec(primitive, purpose, outputLength=bits, name=shown))


def hash_from_name(name: Column, purpose: str | None = None) -> Column:
    return _kept(_hash(name, purpose))


def _mode(n: Column) -> Column:
    return F.upper(_first(n, "(cbc|ecb|gcm|ctr|ofb|cfb|ccm|xts|siv)"))


def _cipher(name: Column) -> Column:
    n = F.lower(F.trim(name))
    other = _first(n, "^(des|rc2|blowfish|cast5|idea)(?:[-_]|$)")
    use = "DATA_ENCRYPTION"
    size, mode = _first(n, r"^aes[-_]?(128|192|256)?(?:[-_](\w+))?", 1), _first(n, r"^aes[-_]?(128|192|256)?(?:[-_](\w+))?", 2)
    return (
        F.when(n.rlike("^(des-ede|des-cbc3|3des|desede|des3|tripledes)"), spec("3DES", use, mode=_mode(n)))
        .when(other.isNotNull(), spec("UNKNOWN", use, name=lookup(other, OTHER_CIPHERS), keySize=F.when(other == "des", 56), mode=_mode(n)))
        .when(n.rlike("^(rc4|arcfour|arc4)"), spec("RC4", use))
        .when(n.rlike("^chacha20"), spec("ChaCha20", use, keySize=256, mode=F.when(n.contains("poly1305"), "POLY1305")))
        .when(n.rlike("^aes"), spec("AES", use, keySize=size.cast("int"), mode=F.upper(mode)))
    )


def cipher_from_name(name: Column) -> Column:
    return _kept(_cipher(name))


def normalize_curve(name: Column) -> Column:
    """The usual name of a curve, null if unknown."""
    return lookup(F.lower(F.trim(name)), CURVES)


def jose_algorithm(name: Column) -> Column:
    a = F.upper(F.trim(name))
    bits = a.substr(-3, 3).try_cast("int")
    digest = F.when(bits > 0, spec("SHA2", "INTEGRITY", outputLength=bits))
    signed = "DIGITAL_SIGNATURE"
    curve = F.when(a == "ES256", "P-256").when(a == "ES384", "P-384").when(a == "ES512", "P-521").otherwise("secp256k1")
    return (
        F.when(a == "NONE", _some(spec("UNKNOWN", None, alg="none")))
        .when(a.startswith("HS"), _kept(spec("HMAC", signed, alg=a), digest))
        .when(a.startswith("RSA-OAEP") | (a == "RSA1_5"), _some(spec("RSA", "KEY_ESTABLISHMENT", alg=a, padding=F.when(a == "RSA1_5", "PKCS1v15").otherwise("OAEP"))))
        .when(a.startswith("RS") | a.startswith("PS"), _kept(spec("RSA", signed, alg=a, padding=F.when(a.startswith("PS"), "PSS").otherwise("PKCS1v15")), digest))
        .when(a.startswith("ES"), _kept(spec("ECDSA", signed, alg=a, curve=curve), digest))
        .when(a == "EDDSA", _some(spec("EdDSA", signed, alg=a)))
        .when(a.startswith("ECDH-ES"), _some(spec("ECDH", "KEY_ESTABLISHMENT", alg=a)))
        .when(a.startswith("A") & a.contains("GCM"), _some(spec("AES", "DATA_ENCRYPTION", mode="GCM", keySize=F.coalesce(F.substring(F.regexp_replace(a, "[^0-9]", ""), 1, 3).try_cast("int"), F.lit(0)))))
        .otherwise(_none())
    )


def signature_from_name(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.trim(name)), "with", "-")
    pss = n.contains("pss")
    signed = "DIGITAL_SIGNATURE"

    def part(raw: Column) -> Column:
        p = F.regexp_replace(raw, "(encryption|signature)$", "")
        return (
            F.when(p.isin("rsa", "rsassa"), spec("RSA", signed, padding=F.when(pss, "PSS").otherwise("PKCS1v15")))
            .when(p.isin("ecdsa", "ec"), spec("ECDSA", signed))
            .when(p == "dsa", spec("DSA", signed))
            .when(p == "ed25519", spec("EdDSA", signed, curve="Ed25519"))
            .when(p == "ed448", spec("EdDSA", signed, curve="Ed448"))
            .when(~p.isin("", "with", "md"), _hash(p, "INTEGRITY"))
        )

    return F.array_compact(F.transform(F.filter(F.split(n, "[-_]"), lambda x: x != ""), part)).cast(SPECS)


def ssh_algorithm(name: Column) -> Column:
    n = F.lower(F.trim(name))
    est, signed = "KEY_ESTABLISHMENT", "DIGITAL_SIGNATURE"
    mac = F.regexp_replace(F.regexp_replace(n, "^hmac-", ""), "-etm@.*", "")
    return (
        F.when(n.startswith("curve25519-sha256"), _some(spec("X25519", est)))
        .when(n.startswith("ecdh-sha2-nistp"), _some(spec("ECDH", est, curve=normalize_curve(F.regexp_replace(n, "^ecdh-sha2-", "")))))
        .when(n.startswith("diffie-hellman-group"), _some(spec("DH", est, primeLength=lookup(_first(n, "group([0-9]+)"), DH_GROUPS))))
        .when(n.startswith("mlkem") | n.contains("ml-kem"), _some(spec("ML-KEM", est)))
        .when(n.startswith("sntrup"), _some(spec("UNKNOWN", est, name=F.coalesce(_first(n, "^(sntrup[0-9]+(?:x25519)?)"), F.lit("sntrup")))))
        .when(n.startswith("ssh-rsa") | n.startswith("rsa-sha2"), _some(spec("RSA", signed)))
        .when(n.startswith("ssh-ed25519"), _some(spec("EdDSA", signed, curve="Ed25519")))
        .when(n.startswith("ecdsa-sha2-nistp"), _some(spec("ECDSA", signed, curve=normalize_curve(F.regexp_replace(n, "^ecdsa-sha2-", "")))))
        .when(n.startswith("ssh-dss"), _some(spec("DSA", signed)))
        .when(n.startswith("hmac-"), _some(spec("HMAC", "INTEGRITY", hash=_hash(mac, None)["primitive"])))
        .otherwise(_kept(_cipher(F.regexp_replace(n, "@openssh[.]com$", ""))))
    )


def tls_cipher_suite(name: Column) -> Column:
    n = F.upper(F.trim(name))
    bare = F.regexp_replace(n, "^TLS[-_]", "")
    lower = lambda x: F.lower(F.regexp_replace(x, "_", "-"))
    est, auth = "KEY_ESTABLISHMENT", "CERTIFICATE_AUTH"
    exchange = (
        F.when(bare.rlike("ECDHE|EECDH"), spec("ECDH", est, ephemeral="true"))
        .when(bare.rlike("DHE|EDH"), spec("DH", est, ephemeral="true"))
        .when(bare.rlike("^ECDH[-_]"), spec("ECDH", est, ephemeral="false"))
        .when(bare.rlike("^DH[-_]"), spec("DH", est, ephemeral="false"))
        .when(~bare.rlike("^(ADH|AECDH|PSK|SRP|KRB5|GOST|NULL|AECDHE)"), spec("RSA", est, mode="KEY_TRANSPORT"))
    )
    who = F.when(bare.contains("ECDSA"), spec("ECDSA", auth)).when(bare.contains("DSS"), spec("DSA", auth)).when(~bare.rlike("^(ADH|AECDH|PSK|SRP|NULL)"), spec("RSA", auth))
    bulk = _cipher(lower(_first(n, "(AES[-_]?(?:128|256)[-_]?(?:GCM|CBC|CCM)|CHACHA20[-_]POLY1305|3DES|DES[-_]CBC3|RC4)")))
    mac = _hash(_first(n, "(SHA384|SHA256|SHA1|SHA|MD5)$"), "INTEGRITY")
    modern = _kept(_cipher(lower(F.regexp_replace(n, "^TLS_", ""))))
    return F.when(n.startswith("TLS_AES_") | n.startswith("TLS_CHACHA20"), modern).otherwise(_kept(exchange, who, bulk, mac))


#: By vocabulary.
VOCABULARIES: dict[str, Callable[[Column], Column]] = {
    "hash": hash_from_name, "cipher": cipher_from_name, "jose": jose_algorithm, "signature": signature_from_name, "ssh": ssh_algorithm, "tls": tls_cipher_suite,
}
