"""Sources over small inputs made here."""

import struct

import pytest


from estatelens.sources import binaries, inventories, text_files

# DER, written by hand


def tlv(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else (b"\x82" + size.to_bytes(2, "big"))
    return bytes([tag]) + head + body


def oid(text):
    first, second, *rest = map(int, text.split("."))
    out = [bytes([first * 40 + second])]
    for n in rest:
        digits = [n & 0x7F]
        while n := n >> 7:
            digits.append(n & 0x7F | 0x80)
        out.append(bytes(reversed(digits)))
    return tlv(6, b"".join(out))


def spki_rsa(bits=2048):
    key = tlv(0x30, tlv(2, b"\0" + b"\xc1" * (bits // 8)), tlv(2, b"\1\0\1"))
    return tlv(0x30, tlv(0x30, oid("1.2.840.113549.1.1.1"), tlv(5)), tlv(3, b"\0" + key))


def name(text):
    return tlv(0x30, tlv(0x31, tlv(0x30, oid("2.5.4.3"), tlv(12, text.encode()))))


def certificate(ca=False, signature="1.2.840.113549.1.1.11"):
    algorithm = tlv(0x30, oid(signature), tlv(5))
    constraints = tlv(0xA3, tlv(0x30, tlv(0x30, oid("2.5.29.19"), tlv(4, tlv(0x30, tlv(1, b"\xff")))))) if ca else b""
    validity = tlv(0x30, tlv(23, b"250101000000Z"), tlv(24, b"20350101000000Z"))
    body = tlv(0x30, tlv(0xA0, tlv(2, b"\2")), tlv(2, b"\7"), algorithm, name("issuer"), validity, name("subject"), spki_rsa(), constraints)
    return tlv(0x30, body, algorithm, tlv(3, b"\0" + b"\x55" * 64))


def elf(symbols, needed):
    names = b"\0" + b"".join(s.encode() + b"\0" for s in symbols)
    table = b"".join(struct.pack("<IBBHQQ", names.index(s.encode() + b"\0"), 0, 0, 0, 0, 0) for s in symbols)
    libs = b"\0" + b"".join(s.encode() + b"\0" for s in needed)
    dynamic = b"".join(struct.pack("<QQ", 1, libs.index(s.encode() + b"\0")) for s in needed)
    blobs, at, sections = [table, names, dynamic, libs], 64, [(0, 0, 0, 0, 0)]
    for blob, kind, link, entry in zip(blobs, (11, 3, 6, 3), (2, 0, 4, 0), (24, 0, 16, 0), strict=True):
        sections.append((kind, at, len(blob), link, entry))
        at += len(blob)
    head = b"\x7fELF\2\1\1" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, at, 0, 64, 0, 0, 64, len(sections), 0)
    return head + b"".join(blobs) + b"".join(struct.pack("<IIQQQQIIQQ", 0, k, 0, 0, o, n, link, 0, 0, e) for k, o, n, link, e in sections)


def test_certificates(spark):
    import base64

    pem = b"-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(certificate()) + b"-----END CERTIFICATE-----\n"
    files = spark.createDataFrame([("a.pem", bytearray(pem + pem)), ("ca.der", bytearray(certificate(ca=True, signature="1.2.840.10045.4.3.3"))), ("junk", bytearray(b"0\x82\xff\xff")), ("empty", bytearray())], "path string, content binary")
    facts = binaries.certificates(files)
    rows = {r["path"]: r for r in facts.collect()}
    assert set(rows) == {"a.pem", "ca.der"} and facts.count() == 3
    a = rows["a.pem"]
    assert (a["subject"], a["issuer"], a["ca"], a["key"], a["bits"], a["signature"], a["not_after"][:4]) == ("subject", "issuer", False, "RSA", 2048, "sha256WithRSA", "2035")
    got = {(r["primitive"], r["parameters"], r["control_class"]) for r in binaries.certificate_findings(facts, "s").collect()}
    assert got == {("RSA", '{"modulusLength":2048}', "SELF"), ("SHA2", '{"outputLength":256}', "SELF"), ("RSA", '{"padding":"PKCS1v15"}', "SELF"), ("RSA", '{"modulusLength":2048}', "PROTOCOL_BILATERAL"), ("ECDSA", "{}", "PROTOCOL_BILATERAL"), ("SHA2", '{"outputLength":384}', "PROTOCOL_BILATERAL")}


def test_embedded_keys_and_constants():
    data = b"\0" * 80 + certificate() + b"pad" + spki_rsa() + bytes.fromhex(binaries.CONSTANTS[1][4])
    kinds = [(k, a) for k, a, _ in binaries.find_der(data)]
    assert kinds == [("certificate", "RSA"), ("public-key", "RSA")]
    assert [n for n, _ in binaries.find_constants(data)] == ["sha256-k"]
    swapped = b"".join(bytes.fromhex(binaries.CONSTANTS[1][4])[i : i + 4][::-1] for i in range(0, 32, 4))
    assert binaries.find_constants(swapped * 12) == [("sha256-k-le", 32 * k) for k in range(8)]


def test_elf(spark):
    data = elf(["RSA_sign", "EVP_aes_128_cbc", "main"], ["libssl.so.3"])
    assert binaries.elf_symbols(data) == (["EVP_aes_128_cbc", "RSA_sign", "main"], ["libssl.so.3"], False)
    assert binaries.elf_symbols(data[:200])[2] is True
    files = spark.createDataFrame([("x.so", bytearray(data + b"OpenSSL 3.0.2 15 Mar 2022\0")), ("tiny", bytearray(b"x"))], "path string, content binary")
    found = binaries.observed(files)
    assert {(r["library"], r["version"]) for r in binaries.fingerprints(found).collect()} == {("OpenSSL", "3.0.2")}
    assert found.filter("kind = 'skipped'").count() == 1
    assert {(r["primitive"], r["parameters"]) for r in binaries.binary_findings(files, "s").collect()} == {("RSA", "{}"), ("AES", '{"keySize":128,"mode":"CBC"}')}


@pytest.mark.parametrize("head", [b"\x7fELF\2\1", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe", b"MZ"])
def test_hostile_binaries_end(head):
    parse = {"elf": binaries.elf_symbols, "macho": binaries.macho_symbols, "pe": binaries.pe_symbols}[binaries.detect_format(head + b"\xff" * 4096)]
    for filler in (b"\xff", b"\0", b"\x7f"):
        for size in (0, 1, 60, 4096):
            symbols, libraries, _ = parse(head + filler * size)
            assert symbols == [] and libraries == []


def test_strings():
    assert binaries.extract_strings(b"\0OpenSSL 1\1ab\1\0" + "wide text".encode("utf-16-le")) == ["OpenSSL 1", "wide text"]


def test_kexinit(spark):
    lists = [b"curve25519-sha256,diffie-hellman-group14-sha1", b"ssh-ed25519", b"aes256-ctr", b"aes256-ctr", b"hmac-sha2-256", b"hmac-sha2-256"]
    message = bytes([20]) + b"c" * 16 + b"".join(len(x).to_bytes(4, "big") + x for x in lists)
    assert binaries.parse_kexinit(message[:40]) is None
    outcomes = binaries.kexinit_outcomes(spark.createDataFrame([("h:22", bytearray(message)), ("h:23", bytearray(b"x"))], "target string, content binary"))
    assert {r["primitive"] for r in binaries.handshake_findings(outcomes, "s").collect()} == {"X25519", "DH", "EdDSA", "AES", "HMAC"}


def test_python_calls():
    calls, aliases = binaries.python_calls("import hashlib as h\nfrom .keys import make\ndef f(x):\n    h.sha256(x).update(make(1, n='a'))\n")
    assert aliases == [("h", "hashlib"), ("make", ".keys.make")]
    assert [(line, f, c) for line, f, c, _, _ in calls] == [(4, "f", "hashlib.sha256.update"), (4, "f", "hashlib.sha256"), (4, "f", ".keys.make")]
    assert calls[1][3] == ["x"] and calls[2][4] == {"n": "a"}
    assert binaries.python_calls("def (") is None


def test_manifests(spark):
    files = spark.createDataFrame(
        [
            ("a/pnpm-lock.yaml", "packages:\n  /node-forge@1.3.1:\n  '@peculiar/x509@1.9.0': {}\n  @peculiar/x509@1.9.0:\n"),
            ("a/poetry.lock", '[[package]]\nname = "PyCrypto"\ncategory = "main"\n\n[[package]]\nname = "rsa"\ngroups = ["dev"]\n'),
            ("a/Pipfile", '[packages]\npyjwt = "*"\n[dev-packages]\nparamiko = "*"\n[requires]\npython_version = "3"\n'),
            ("a/dev-requirements.txt", "ecdsa\n"),
            ("a/requirements.txt", "jwt_tools==1\nnothing\n"),
            ("b/package.json", "not json"),
        ],
        "path string, text string",
    )
    got = {(r["name"], r["dev"]) for r in text_files.declared(files).collect()}
    assert {("node-forge", False), ("@peculiar/x509", False), ("PyCrypto", False), ("rsa", True), ("pyjwt", False), ("paramiko", True), ("ecdsa", True), ("nothing", False)} <= got and ("python_version", False) not in got
    found, odd = text_files.dependency_findings(files, "s")
    assert {r["control_class"] for r in found.filter("raw like '%PyCrypto%'").collect()} == {"VENDOR_LOCKED"}
    assert not found.filter("raw like '%rsa %' and raw like 'pypi:rsa%'").count()
    assert {r["uncatalogued"] for r in odd.collect()} == {"pypi:jwt_tools"}
    assert text_files.dependency_findings(files, "s", include_dev=True)[0].filter("raw like 'pypi:rsa%'").count() == 2


def test_other_configs(spark):
    files = spark.createDataFrame(
        [
            ("e/openssl.cnf", "# c\ndefault_bits = 1024 # old\ndefault_md=sha1\ndefault_days = 365\ncurve_name = prime256v1\n"),
            ("e/java.security", "jdk.tls.disabledAlgorithms=MD5, \\\n  RC4, DES\nother=1\n"),
            ("e/readme.md", "default_md = md5"),
        ],
        "path string, text string",
    )
    got = {(r["file"], r["directive"], r["primitive"], r["line_no"]) for r in text_files.config_detections(files).collect()}
    assert got == {("e/openssl.cnf", "default_bits", "RSA", 2), ("e/openssl.cnf", "default_md", "SHA1", 3), ("e/openssl.cnf", "curve_name", "ECDSA", 5)} | {("e/java.security", "jdk.tls.disabledAlgorithms", p, 1) for p in ("MD5", "RC4", "UNKNOWN")}


def test_key_adapters(spark):
    azure = spark.createDataFrame([("k1", "RSA-HSM", None, "A" * 342, ["sign"], True, 0, None, "sub"), ("k2", "EC", "P-256", None, ["wrapKey"], None, None, "d", None)], "kid string, kty string, crv string, n string, key_ops array<string>, enabled boolean, created long, description string, subscription string")
    got = {r["id"]: r for r in inventories.from_azure(azure).collect()}
    assert (got["k1"]["key_spec"], got["k1"]["usage"], got["k1"]["hsm_backed"], got["k1"]["created_at"]) == ("RSA_2048", "SIGN_VERIFY", True, "1970-01-01T00:00:00.000Z")
    assert (got["k2"]["key_spec"], got["k2"]["usage"], got["k2"]["enabled"]) == ("EC_P-256", "KEY_AGREEMENT", True)
    gcp = spark.createDataFrame([("projects/p/locations/eu/keyRings/r", "EC_SIGN_P256_SHA256", "DISABLED", "HSM", None, None, None)], "name string, algorithm string, state string, protectionLevel string, createTime string, purpose string, rotation_enabled boolean")
    r = inventories.from_gcp(gcp).first()
    assert (r["scope"], r["region"], r["usage"], r["enabled"], r["hsm_backed"]) == ("p", "eu", "SIGN_VERIFY", False, True)
    found, _ = inventories.key_findings(inventories.from_azure(azure).unionByName(inventories.from_gcp(gcp)), "s")
    assert {(x["locator"], x["primitive"], x["control_class"]) for x in found.collect()} == {("k1", "RSA", "HARDWARE"), ("k2", "ECDH", "VENDOR_UPGRADEABLE")}
    assert inventories.key_findings(inventories.from_gcp(gcp), "s", include_disabled=True)[0].count() == 1


def test_host_adapters(spark):
    rows = [
        ("crypto_packages", "h1", {"name": "openssl", "version": "3.0.2"}), ("crypto_config", "h1", {"path": "/etc/ssh", "label": "Ciphers", "value": "aes128-ctr", "running": "0"}),
        ("crypto_certificates", "h1", {"path": "/c.pem", "key_algorithm": "rsaEncryption", "key_strength": "2048"}), ("crypto_config", None, {"hostname": "h2", "path": "p"}), ("other", "h1", {}),
    ]
    hosts, skipped = inventories.from_osquery(spark.createDataFrame(rows, "name string, hostIdentifier string, columns map<string,string>"))
    assert skipped.first()["skipped"] == 2 and hosts.count() == 1
    found, _ = inventories.host_findings(hosts, "s")
    assert [(r["primitive"], r["parameters"], r["purpose"]) for r in found.collect()] == [("RSA", '{"modulusLength":2048,"padding":"PKCS1v15"}', "CERTIFICATE_AUTH")]
    idle = inventories.host_findings(hosts, "s", include_inactive=True)[0].filter("primitive = 'AES'").first()
    assert idle["assumption"] is not None
    facts = spark.createDataFrame([("h", None, "Debian", "12", {"openssl": ["3.5.0"]}, {"/etc/x": {"macs": "hmac-sha1"}})], "host_id string, fqdn string, distribution string, distribution_version string, packages map<string,array<string>>, configs map<string,map<string,string>>")
    host = inventories.from_facts(facts)
    assert host.first()["os"] == "Debian 12" and inventories.package_notes(host).count() == 0
    assert [r["primitive"] for r in inventories.host_findings(host, "s")[0].collect()] == ["SHA1"]


def test_unknown_tokens_are_reported(spark):
    flat = spark.createDataFrame([("h", "config", "/e", "Ciphers", "aes128-ctr,bogus"), ("h", "listener", "443", "TLS_AES_128_GCM_SHA256", None), ("h", "listener", "x", "y", None), ("", "config", "a", "b", "c")], "host string, kind string, where string, what string, value string")
    hosts, skipped = inventories.from_flat(flat)
    found, unknown = inventories.host_findings(hosts, "s")
    assert skipped.first()["skipped"] == 2 and {r["token"] for r in unknown.collect()} == {"bogus"} and found.count() == 2


def test_breaches_need_a_deadline(spark):
    rows = spark.createDataFrame([("s", True, 2040.0)], "system_id string, vulnerable boolean, not_after_year double")
    assert inventories.lifetime_breaches(rows, None).count() == 0 and inventories.lifetime_breaches(rows, 2031.0).first()["overhang"] == 9.0
