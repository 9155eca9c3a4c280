"""Derived columns of cryptographic assets, content hashes and number helpers.

Parameters of an asset are canonical JSON text: keys sorted, numbers as numbers. An id is the head of the
SHA-256 of the canonical JSON of what it names, so equal content has equal ids everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens.functions import dims


def canonical_json(text: Column) -> Column:
    """JSON text with keys sorted at every level and no white space; null if it cannot be parsed."""
    return F.to_json(F.try_parse_json(text))


def _quoted(text: Column) -> Column:
    """A string as JSON: what stands for x in {"x":...}."""
    return F.rtrim(F.substring(F.to_json(F.struct(text.alias("x"))), 6, 1 << 30), F.lit("}"))


def _hash_of(size: int, **fields: Column) -> Column:
    """The head of the hash of an object whose values are JSON already."""
    parts = [x for k in sorted(fields) for x in (F.lit(("," if k != min(fields) else "{") + f'"{k}":'), fields[k])]
    return F.substring(F.sha2(F.concat(*parts, F.lit("}")), 256), 1, size)


def asset_id(primitive: Column, parameters: Column, purpose: Column) -> Column:
    return _hash_of(32, parameters=parameters, primitive=_quoted(primitive), purpose=_quoted(purpose))


def occurrence_id(system_id: Column, asset: Column, control_class: Column) -> Column:
    return _hash_of(24, assetId=F.concat(F.lit('"'), asset, F.lit('"')), controlClass=_quoted(control_class), systemId=_quoted(system_id))


def _number(parameters: Column, *keys: str) -> Column:
    """The first of these parameters that is a number or a string of digits."""
    return F.coalesce(*[F.get_json_object(parameters, f"$.{k}").try_cast("double") for k in keys])


def security_bits(primitive: Column, parameters: Column) -> Column:
    """Classical security bits, null if unknown."""
    modulus = _number(parameters, "modulusLength", "keySize", "bits", "primeLength")
    by_modulus = F.when(modulus >= 15360, 256).when(modulus >= 7680, 192).when(modulus >= 3072, 128).when(modulus >= 2048, 112).when(modulus >= 1024, 80).when(modulus.isNotNull(), 0)
    curve = F.coalesce(F.get_json_object(parameters, "$.curve"), F.get_json_object(parameters, "$.namedCurve"))
    by_curve = F.coalesce(dims.lookup(curve, dims.CURVE_BITS), F.floor(_number(parameters, "keySize", "bits") / 2).cast("int"))
    key = _number(parameters, "keySize", "keyLength", "bits").cast("int")
    output = F.floor(_number(parameters, "outputLength", "bits", "size") / 2).cast("int")
    return (
        F.when(primitive.isin("RSA", "DH", "DSA"), by_modulus)
        .when(primitive.isin("ECDSA", "ECDH", "EdDSA"), by_curve)
        .when(primitive == "X25519", 128)
        .when(primitive == "X448", 224)
        .when(primitive == "AES", key)
        .when(primitive == "ChaCha20", F.coalesce(key, F.lit(256)))
        .when(primitive == "3DES", 112)
        .when(primitive.isin("RC4", "SHA1", "MD5"), 0)
        .when(primitive.isin("SHA2", "SHA3"), output)
    )


def quantum_vulnerable(primitive: Column, parameters: Column) -> Column:
    safe_from = F.when(primitive.isin("AES", "ChaCha20"), 256).when(primitive.isin("SHA2", "SHA3"), 128)
    weak = F.coalesce(security_bits(primitive, parameters) < safe_from, F.lit(False))
    return F.when(primitive.isin(*dims.PQ_SAFE), False).when(primitive.isin(*dims.SHOR_BROKEN, *dims.CLASSICALLY_BROKEN), True).otherwise(weak)


def asset_name(primitive: Column, parameters: Column) -> Column:
    """PRIMITIVE(k=v,...) with keys sorted."""
    pairs = F.array_sort(F.map_entries(F.from_json(parameters, "map<string,string>")))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")
    return F.when(F.size(pairs) > 0, F.concat(primitive, F.lit("("), shown, F.lit(")"))).otherwise(primitive)


def track_for(purpose: Column) -> Column:
    """Which of two clocks applies to a purpose."""
    return F.when(purpose.isin(*dims.HARVESTABLE), "CONFIDENTIALITY").otherwise("AUTHENTICITY")


def oid(primitive: Column) -> Column:
    return dims.lookup(primitive, dims.OIDS)


def with_asset_facts(df):
    """df (primitive, parameters, purpose) with asset_id and all derived columns of an asset."""
    p, j, u = F.col("primitive"), F.col("parameters"), F.col("purpose")
    return df.withColumns(
        {"asset_id": asset_id(p, j, u), "quantum_vulnerable": quantum_vulnerable(p, j), "security_bits": security_bits(p, j), "oid": oid(p), "asset_name": asset_name(p, j), "track": track_for(u)}
    )


def round_half_up(x: Column, places: int) -> Column:
    """Rounds the binary double with halves toward plus infinity, unlike SQL's round()."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


def decimal_year(t: Column, places: int = 4) -> Column:
    """A UTC timestamp as a year with a fraction."""
    year = F.year(t)
    start, end = F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    share = (F.unix_micros(t) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))
    return round_half_up(year + share, places)


def slug(text: Column, size: int = 24) -> Column:
    """Lower case, runs of other characters to one dash, none at the ends, at most size characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def stamp(t: Column) -> Column:
    """14 digits of a UTC timestamp."""
    return F.date_format(t, "yyyyMMddHHmmss")


def scan_id(system_name: Column, started_at: Column, iso: Column) -> Column:
    """slug-stamp-hash of a scan; iso is the start as ISO text, as hashed."""
    return F.concat_ws("-", slug(system_name), stamp(started_at), F.substring(F.sha2(F.concat(system_name, F.lit("\0"), iso), 256), 1, 8))


def iso_or(text: Column, default: Column) -> Column:
    """A timestamp from ISO text, or the default if it is none."""
    return F.coalesce(F.try_to_timestamp(text), default)


def version_below(have: Column, want: str) -> Column:
    """Component-wise version compare: a missing or odd part of have is below, a missing part of want ends it."""
    parts = F.split(have, r"[.\-+_~]")
    number = lambda k: F.regexp_extract(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    out = F.lit(False)
    for k, w in reversed(list(enumerate(want.split(".")))):
        out = F.when(number(k).isNull(), True).when(number(k) != int(w), number(k) < int(w)).otherwise(out)
    return out
