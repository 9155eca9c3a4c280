"""Scan authority: host and address parsing, target matching, authorisation of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of clock skew that are forgiven at most.
MAX_SKEW = 300


def normalize_host(host: Column) -> Column:
    """Lower case, no trailing dot, no brackets."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^\[(.*)\]$", "$1"), r"\.$", "")


def ipv4_to_long(text: Column) -> Column:
    """An IPv4 address as a number; null for anything else, leading zeros included."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    pattern = rf"^{octet}\.{octet}\.{octet}\.{octet}$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("long")
    return part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)


def ipv6_to_hex(text: Column) -> Column:
    """An IPv6 address as 32 hex digits; null for anything else (no embedded IPv4, no zone)."""
    ok = text.contains(":") & text.rlike("^[0-9a-fA-F:]{2,39}$") & ~text.rlike(":::") & (F.size(F.split(text, "::")) <= 2) & ~text.rlike("(^:[^:])|([^:]:$)") & ~text.rlike("[0-9a-fA-F]{5,}")
    wide = lambda part: F.transform(F.filter(F.split(part, ":"), lambda x: x != ""), lambda x: F.lower(F.lpad(x, 4, "0")))
    head, tail = wide(F.split_part(text, F.lit("::"), F.lit(1))), wide(F.split_part(text, F.lit("::"), F.lit(2)))
    short = text.contains("::")
    missing = 8 - F.size(head) - F.when(short, F.size(tail)).otherwise(0)
    fill = F.when(missing > 0, F.array_repeat(F.lit("0000"), missing)).otherwise(F.array().cast("array<string>"))
    full = F.when(short, F.concat(head, fill, tail)).otherwise(head)
    return F.when(ok & F.when(short, missing >= 1).otherwise(F.size(head) == 8), F.array_join(full, ""))


def split_target(text: Column) -> Column:
    """host and port of h:p, [v6]:p or a bare host (port 443)."""
    bracketed, plain = r"^\[([^\]]+)\](?::([0-9]+))?$", r"^([^:]+):([0-9]+)$"
    host = F.when(text.rlike(bracketed), F.regexp_extract(text, bracketed, 1)).when(text.rlike(plain), F.regexp_extract(text, plain, 1)).otherwise(text)
    port = F.when(text.rlike(bracketed), F.regexp_extract(text, bracketed, 2)).when(text.rlike(plain), F.regexp_extract(text, plain, 2)).otherwise("")
    return F.struct(normalize_host(host).alias("host"), F.coalesce(port.try_cast("int"), F.lit(443)).alias("port"))


def target_kind(target: Column) -> Column:
    """cidr4, cidr6, glob, exact, or invalid."""
    base, bits = F.split_part(target, F.lit("/"), F.lit(1)), F.split_part(target, F.lit("/"), F.lit(2))
    n = F.when(bits.rlike("^(0|[1-9][0-9]{0,2})$"), bits.cast("int"))
    return (
        F.when(target.contains("/") & ipv4_to_long(base).isNotNull() & (n <= 32), "cidr4")
        .when(target.contains("/") & ipv6_to_hex(base).isNotNull() & (n <= 128), "cidr6")
        .when(target.contains("/"), "invalid")
        .when(target.rlike(r"^\*\.[^*]+$"), "glob")
        .when(target.contains("*"), "invalid")
        .otherwise("exact")
    )


def target_matches(target: Column, host: Column) -> Column:
    """Whether a grant's target covers a host: CIDR range, one wildcard label, or the same name."""
    kind, base, bits = target_kind(target), F.split_part(target, F.lit("/"), F.lit(1)), F.split_part(target, F.lit("/"), F.lit(2)).try_cast("int")
    v4, v6 = ipv4_to_long(host), ipv6_to_hex(host)
    block = F.pow(F.lit(2.0), 32 - bits).cast("long")
    in4 = F.floor(v4 / block) == F.floor(ipv4_to_long(base) / block)
    binary = lambda x: F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    in6 = F.substring(binary(v6), F.lit(1), bits) == F.substring(binary(ipv6_to_hex(base)), F.lit(1), bits)
    suffix = F.substring(target, F.lit(2), F.length(target))
    glob = host.endswith(suffix) & ~F.substring(host, F.lit(1), F.length(host) - F.length(suffix)).contains(".") & (F.length(host) > F.length(suffix))
    same = F.when(v4.isNotNull(), v4 == ipv4_to_long(target)).when(v6.isNotNull(), v6 == ipv6_to_hex(target)).otherwise(host == normalize_host(target))
    return F.coalesce(F.when(kind == "cidr4", in4).when(kind == "cidr6", in6).when(kind == "glob", glob).when(kind == "exact", same), F.lit(False))


def matching_targets(hosts: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (host, target) that match, by equi-joins: ranges and globs become keys of a few fixed widths.

    An IPv4 range of n bits is keyed by (n, its first n bits), so a host is looked up once per width that
    the grant uses; a glob by its suffix; a name by itself. No pair is formed that does not match, but for
    IPv6 ranges, which compare within equal first bits as well.
    """
    t = targets.select(F.col("target")).distinct().withColumns({"kind": target_kind(F.col("target")), "base": F.split_part("target", F.lit("/"), F.lit(1)), "bits": F.split_part("target", F.lit("/"), F.lit(2)).try_cast("int")})
    block = F.pow(F.lit(2.0), 32 - F.col("bits")).cast("long")
    hex_bits = F.floor(F.col("bits") / 4).cast("int")
    plain = lambda name: F.coalesce(ipv6_to_hex(name), name)
    key = (
        F.when(F.col("kind") == "cidr4", F.concat(F.lit("4:"), F.col("bits").cast("string"), F.lit(":"), F.floor(ipv4_to_long(F.col("base")) / block).cast("string")))
        .when(F.col("kind") == "cidr6", F.concat(F.lit("6:"), hex_bits.cast("string"), F.lit(":"), F.substring(ipv6_to_hex(F.col("base")), F.lit(1), hex_bits)))
        .when(F.col("kind") == "glob", F.concat(F.lit("g:"), F.substring("target", 3, 1 << 20)))
        .otherwise(F.concat(F.lit("="), plain(normalize_host(F.col("target")))))
    )
    keyed = t.filter("kind <> 'invalid'").withColumn("key", key)
    host = F.col("host")
    v4, v6 = ipv4_to_long(host), ipv6_to_hex(host)
    keys = F.concat(
        F.array(F.concat(F.lit("="), plain(host)), F.concat(F.lit("g:"), F.regexp_replace(host, r"^[^.]*\.", ""))),
        F.when(v4.isNotNull(), F.transform("_w4", lambda n: F.concat(F.lit("4:"), n.cast("string"), F.lit(":"), F.floor(v4 / F.pow(F.lit(2.0), 32 - n).cast("long")).cast("string")))).otherwise(F.array().cast("array<string>")),
        F.when(v6.isNotNull(), F.transform("_w6", lambda n: F.concat(F.lit("6:"), n.cast("string"), F.lit(":"), F.substring(v6, F.lit(1), n)))).otherwise(F.array().cast("array<string>")),
    )
    # at most 33 widths of either kind
    widths = keyed.agg(F.collect_set(F.when(F.col("kind") == "cidr4", F.col("bits"))).alias("_w4"), F.collect_set(F.when(F.col("kind") == "cidr6", hex_bits)).alias("_w6"))
    looked = hosts.select(host).distinct().crossJoin(F.broadcast(widths)).select(host, F.explode(F.array_distinct(keys)).alias("key"))
    return looked.join(keyed.select("key", "target"), "key").filter(target_matches(F.col("target"), host)).select("host", "target").distinct()


def authorize(requests: DataFrame, grants: DataFrame, now: Column, skew_seconds: int = 0) -> DataFrame:
    """requests (host, port) under one grant (target rows, ports array, not_before, not_after): code per request.

    Codes in order: NOT_YET_VALID, EXPIRED, TARGET_OUT_OF_SCOPE, PORT_OUT_OF_SCOPE, OK; no ports means any.
    """
    skew = max(0, min(MAX_SKEW, skew_seconds))
    terms = grants.agg(F.first("ports").alias("_ports"), F.min("not_before").alias("_from"), F.max("not_after").alias("_to"))
    hit = matching_targets(requests, grants).select("host").distinct().withColumn("_hit", F.lit(True))
    later = lambda t, s: F.timestamp_micros(F.unix_micros(t) + s * 1_000_000)
    code = (
        F.when(later(now, skew) < F.col("_from"), "NOT_YET_VALID")
        .when(later(now, -skew) > F.col("_to"), "EXPIRED")
        .when(F.col("_hit").isNull(), "TARGET_OUT_OF_SCOPE")
        .when((F.size("_ports") > 0) & ~F.array_contains("_ports", F.col("port")), "PORT_OUT_OF_SCOPE")
        .otherwise("OK")
    )
    return requests.join(hit, "host", "left").crossJoin(F.broadcast(terms)).withColumn("code", code).drop("_hit", "_ports", "_from", "_to")
