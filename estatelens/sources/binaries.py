"""Program files, certificates, handshakes and Python sources as findings.

Parsing of bytes and of syntax runs in Arrow batches, one file at a time with the stated bounds; matching
against rules is done by column expressions afterwards. Private key bytes are recognised and never kept.
"""

from __future__ import annotations

import ast
import hashlib
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.functions import naming

#: Bounds: file size, hits of a signature, DER structures of a file, symbols of a table.
MIN_BYTES, MAX_BYTES, MAX_HITS, MAX_DER, MAX_SYMBOLS = 64, 512 << 20, 8, 256, 200_000

#: Byte constants: id, primitive, parameters, purpose, bytes, word size (0: no other byte order).
CONSTANTS = (
    ("aes-sbox", "AES", "{}", "DATA_ENCRYPTION", "637c777bf26b6fc53001672bfed7ab76ca82c97dfa5947f0add4a2af9ca472c0", 0),
    ("sha256-k", "SHA2", '{"outputLength":256}', "INTEGRITY", "428a2f9871374491b5c0fbcfe9b5dba53956c25b59f111f1923f82a4ab1c5ed5", 4),
    ("sha512-k", "SHA2", '{"outputLength":512}', "INTEGRITY", "428a2f98d728ae227137449123ef65cdb5c0fbcfec4d3b2fe9b5dba58189dbbc", 8),
    ("sha1-h", "SHA1", '{"outputLength":160}', "INTEGRITY", "67452301efcdab8998badcfe10325476c3d2e1f05a827999", 4),
    ("md5-t", "MD5", '{"outputLength":128}', "INTEGRITY", "d76aa478e8c7b756242070dbc1bdceee", 4),
    ("p256-prime", "ECDSA", '{"curve":"P-256"}', "DIGITAL_SIGNATURE", "ffffffff00000001000000000000000000000000ffffffffffffffffffffffff", 0),
    ("p256-b", "ECDSA", '{"curve":"P-256"}', "DIGITAL_SIGNATURE", "5ac635d8aa3a93e7b3ebbd55769886bc651d06b0cc53b0f63bce3c3e27d2604b", 0),
    ("p384-prime", "ECDSA", '{"curve":"P-384"}', "DIGITAL_SIGNATURE", "ff" * 31 + "fe" + "ffffffff0000000000000000ffffffff", 0),
    ("x25519-basepoint", "X25519", "{}", "KEY_ESTABLISHMENT", "09" + "00" * 31, 0),
    ("chacha-sigma", "ChaCha20", '{"keySize":256}', "DATA_ENCRYPTION", b"expand 32-byte k".hex(), 0),
    ("des-pc1", "3DES", "{}", "DATA_ENCRYPTION", "39312921191109013a322a221a120a02", 0),
)


def needles() -> list[tuple[str, bytes]]:
    """The constants in both byte orders where words have one."""
    out = []
    for name, _, _, _, text, word in CONSTANTS:
        data = bytes.fromhex(text)
        out.append((name, data))
        if word:
            out.append((name + "-le", b"".join(data[i : i + word][::-1] for i in range(0, len(data), word))))
    return out


_NEEDLES = tuple(needles())


def find_constants(data: bytes) -> list[tuple[str, int]]:
    """(constant, offset) of up to MAX_HITS places of each, overlaps included."""
    out = []
    for name, needle in _NEEDLES:
        at, hits = data.find(needle), 0
        while at >= 0 and hits < MAX_HITS:
            out.append((name, at))
            at, hits = data.find(needle, at + 1), hits + 1
    return out


def each_string(data: bytes, least: int = 6) -> Iterator[str]:
    """Printable runs, ASCII and then UTF-16 little-endian, one at a time: a file can hold far more than memory should."""
    for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data):
        yield m[0].decode()
    # possessive: else a long run keeps a place to go back to for each of its characters
    for m in re.finditer(rb"(?:[\x20-\x7e]\x00){%d,}+" % least, data):
        yield m[0].decode("utf-16-le")


def extract_strings(data: bytes, least: int = 6) -> list[str]:
    """All of each_string()."""
    return list(each_string(data, least))


#: Strings of a file held in memory to know repeats by; later ones wait in so many temporary files.
_HELD, _PARTS = 200_000, 64


def once(strings: Iterable[str]) -> Iterator[str]:
    """Each of some printable strings once; those beyond the first _HELD are dealt by hash, and each part is settled by itself."""
    held: set[str] = set()
    parts: list = []
    with ExitStack() as stack:
        for s in strings:
            if s in held:
                continue
            if len(held) < _HELD:
                held.add(s)
                yield s
            else:
                if not parts:
                    parts = [stack.enter_context(tempfile.TemporaryFile("w+", encoding="ascii", newline="\n")) for _ in range(_PARTS)]
                parts[hash(s) % _PARTS].write(s + "\n")
        held.clear()
        for part in parts:
            part.seek(0)
            yield from dict.fromkeys(line[:-1] for line in part)


def detect_format(data: bytes) -> str | None:
    """elf, macho, pe or null by magic number."""
    if data[:4] == b"\x7fELF":
        return "elf"
    if data[:4] in (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe"):
        return "macho"
    return "pe" if data[:2] == b"MZ" else None


def _name(table: bytes, at: int) -> str:
    end = table.find(b"\0", at, at + 512)
    return table[at : end if end >= 0 else at + 512].decode("latin-1") if 0 <= at < len(table) else ""


def elf_symbols(data: bytes) -> tuple[list[str], list[str], bool]:
    """Symbols, needed libraries, and whether a table ran past the end of the file."""
    if len(data) < 52 or data[4] not in (1, 2):
        return [], [], True
    wide, end = data[4] == 2, "<" if data[5] == 1 else ">"
    try:
        offset = struct.unpack_from(end + ("Q" if wide else "I"), data, 40 if wide else 32)[0]
        size, count = struct.unpack_from(end + "HH", data, 58 if wide else 46)
    except struct.error:
        return [], [], True
    sections, truncated = [], False
    for k in range(count):
        at = offset + k * size
        if at + size > len(data):
            truncated = True
            break
        if wide:
            _, kind, _, _, place, length, link = struct.unpack_from(end + "IIQQQQI", data, at)
            entry = struct.unpack_from(end + "Q", data, at + 56)[0]
        else:
            _, kind, _, _, place, length, link = struct.unpack_from(end + "IIIIIII", data, at)
            entry = struct.unpack_from(end + "I", data, at + 36)[0]
        sections.append((kind, place, length, link, entry))
    body = lambda s: data[s[1] : s[1] + s[2]]
    symbols, needed = set(), set()
    for s in sections:
        if s[3] >= len(sections):
            continue
        truncated |= s[1] + s[2] > len(data) and s[0] != 8
        if s[0] in (2, 11) and s[4]:
            names, table = body(sections[s[3]]), body(s)
            for k in range(min(len(table) // s[4], MAX_SYMBOLS)):
                if name := _name(names, struct.unpack_from(end + "I", table, k * s[4])[0]):
                    symbols.add(name)
        if s[0] == 6:
            names, table, step = body(sections[s[3]]), body(s), 16 if wide else 8
            for k in range(len(table) // step):
                tag, value = struct.unpack_from(end + ("QQ" if wide else "II"), table, k * step)
                if tag == 1:
                    needed.add(_name(names, value))
    return sorted(symbols), sorted(needed - {""}), truncated


def macho_symbols(data: bytes) -> tuple[list[str], list[str], bool]:
    """As elf_symbols, for Mach-O; slices of a fat file are merged, leading underscores dropped."""
    if data[:4] == b"\xca\xfe\xba\xbe":
        symbols, libraries, truncated = set(), set(), False
        for k in range(min(32, struct.unpack_from(">I", data, 4)[0] if len(data) >= 8 else 0)):
            if 8 + 20 * (k + 1) > len(data):
                return sorted(symbols), sorted(libraries), True
            at, size = struct.unpack_from(">II", data, 8 + 20 * k + 8)
            a, b, c = macho_symbols(data[at : at + size])
            symbols, libraries, truncated = symbols | set(a), libraries | set(b), truncated or c or at + size > len(data)
        return sorted(symbols), sorted(libraries), truncated
    if len(data) < 32:
        return [], [], True
    end = "<" if data[:4] in (b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe") else ">"
    wide = data[:4] in (b"\xfe\xed\xfa\xcf", b"\xcf\xfa\xed\xfe")
    at, symbols, libraries, truncated = 32 if wide else 28, set(), set(), False
    for _ in range(min(4096, struct.unpack_from(end + "I", data, 16)[0])):
        if at + 8 > len(data):
            truncated = True
            break
        command, size = struct.unpack_from(end + "II", data, at)
        if size < 8:
            truncated = True
            break
        if command == 2 and at + 24 <= len(data):
            place, count, names, length = struct.unpack_from(end + "IIII", data, at + 8)
            table, step = data[names : names + length], 16 if wide else 12
            for k in range(min(count, MAX_SYMBOLS)):
                if place + (k + 1) * step > len(data):
                    truncated = True
                    break
                if name := _name(table, struct.unpack_from(end + "I", data, place + k * step)[0]):
                    symbols.add(name.removeprefix("_"))
        elif command & 0x7FFFFFFF in (0xC, 0x18, 0x1F, 0x20) and at + 12 <= len(data):
            libraries.add(_name(data[at : at + size], struct.unpack_from(end + "I", data, at + 8)[0]))
        at += size
    return sorted(symbols), sorted(libraries - {""}), truncated


def pe_symbols(data: bytes) -> tuple[list[str], list[str], bool]:
    """Imported names and lower-cased DLLs of a PE file; ordinal imports are skipped."""
    try:
        base = struct.unpack_from("<I", data, 60)[0]
        if data[base : base + 4] != b"PE\0\0":
            return [], [], True
        count, optional = struct.unpack_from("<H", data, base + 6)[0], struct.unpack_from("<H", data, base + 20)[0]
        head = base + 24
        wide = struct.unpack_from("<H", data, head)[0] == 0x20B
        imports = struct.unpack_from("<I", data, head + (112 if wide else 96) + 8)[0]
        table = [struct.unpack_from("<IIII", data, head + optional + 40 * k + 8) for k in range(min(count, 96))]
    except struct.error:
        return [], [], True

    def place(address: int) -> int | None:
        return next((address - a + raw for size, a, raw_size, raw in table if a <= address < a + max(size, raw_size)), None)

    symbols, libraries, budget = set(), set(), len(data) // (8 if wide else 4)
    at = place(imports) if imports else None
    while at is not None and at + 20 <= len(data) and budget > 0:
        names, _, _, dll, thunks = struct.unpack_from("<IIIII", data, at)
        if not (names or dll or thunks):
            return sorted(symbols), sorted(libraries), False
        if (where := place(dll)) is not None:
            libraries.add(_name(data, where).lower())
        step, flag = (8, 1 << 63) if wide else (4, 1 << 31)
        entry = place(names or thunks)
        while entry is not None and entry + step <= len(data) and budget > 0:
            budget -= 1
            value = struct.unpack_from("<Q" if wide else "<I", data, entry)[0]
            if not value:
                break
            if not value & flag and (where := place(value)) is not None:
                symbols.add(_name(data, where + 2))
            entry += step
        at += 20
        budget -= 1
    return sorted(symbols - {""}), sorted(libraries - {""}), bool(imports)


#: Key algorithms by object identifier.
KEY_OIDS = {
    "1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECDSA", "1.2.840.10040.4.1": "DSA", "1.2.840.113549.1.3.1": "DH", "1.3.101.110": "X25519", "1.3.101.111": "X448", "1.3.101.112": "EdDSA", "1.3.101.113": "EdDSA",
    "2.16.840.1.101.3.4.4.1": "ML-KEM", "2.16.840.1.101.3.4.4.2": "ML-KEM", "2.16.840.1.101.3.4.4.3": "ML-KEM", "2.16.840.1.101.3.4.3.17": "ML-DSA", "2.16.840.1.101.3.4.3.18": "ML-DSA", "2.16.840.1.101.3.4.3.19": "ML-DSA",
}
#: Curves and signature algorithms by object identifier.
CURVE_OIDS = {"1.2.840.10045.3.1.7": "P-256", "1.3.132.0.34": "P-384", "1.3.132.0.35": "P-521", "1.3.132.0.10": "secp256k1", "1.3.132.0.33": "P-224"}
SIGNATURE_OIDS = {
    "1.2.840.113549.1.1.4": "md5WithRSA", "1.2.840.113549.1.1.5": "sha1WithRSA", "1.2.840.113549.1.1.11": "sha256WithRSA", "1.2.840.113549.1.1.12": "sha384WithRSA", "1.2.840.113549.1.1.13": "sha512WithRSA",
    "1.2.840.113549.1.1.10": "rsassa-pss", "1.2.840.10045.4.1": "ecdsa-with-SHA1", "1.2.840.10045.4.3.2": "ecdsa-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.2.840.10045.4.3.4": "ecdsa-with-SHA512",
    "1.3.101.112": "ed25519", "1.3.101.113": "ed448", "1.2.840.10040.4.3": "dsa-with-SHA1",
}


class Tlv:
    """One DER element: tag, content, children on demand."""

    __slots__ = ("content", "end", "tag")

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.tag, size, head = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or head + n > len(data):
                raise ValueError("length")
            size, head = int.from_bytes(data[head : head + n], "big"), head + n
        if head + size > len(data):
            raise ValueError("overrun")
        self.content, self.end = data[head : head + size], head + size

    def children(self) -> list[Tlv]:
        out, at = [], 0
        while at + 2 <= len(self.content):
            out.append(Tlv(self.content, at))
            at = out[-1].end
        return out


def decode_oid(content: bytes) -> str:
    values, value = [], 0
    for b in content:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            values.append(value)
            value = 0
    first = min(2, values[0] // 40) if values else 0
    return ".".join(map(str, [first, values[0] - 40 * first, *values[1:]] if values else []))


def _key_facts(spki: Tlv) -> tuple[str, str | None, int | None]:
    """Algorithm, curve and bits of a SubjectPublicKeyInfo."""
    algorithm, key = spki.children()[:2]
    ids = algorithm.children()
    name = KEY_OIDS.get(decode_oid(ids[0].content), "UNKNOWN")
    curve = CURVE_OIDS.get(decode_oid(ids[1].content)) if len(ids) > 1 and ids[1].tag == 6 else None
    bits = None
    if name == "RSA":
        modulus = Tlv(key.content[1:]).children()[0].content.lstrip(b"\0")
        bits = len(modulus) * 8 - (8 - modulus[0].bit_length() if modulus else 0)
    return name, curve, bits


def _time(x: Tlv) -> str | None:
    text = x.content.decode("ascii", "replace")
    try:
        form = "%y%m%d%H%M%SZ" if x.tag == 23 else "%Y%m%d%H%M%SZ"
        return datetime.strptime(text, form).replace(tzinfo=UTC).isoformat()
    except ValueError:
        return None


def _common_name(name: Tlv) -> str:
    found = []
    for part in name.children():
        for pair in part.children():
            oid, value = pair.children()[:2]
            found.append((decode_oid(oid.content), value.content.decode("utf-8", "replace")))
    return next((v for o, v in found if o == "2.5.4.3"), ",".join(v for _, v in found))


def certificate_facts(der: bytes) -> dict | None:
    """Facts of one DER certificate; null if it is none."""
    try:
        body, signature = Tlv(der).children()[:2]
        parts = body.children()
        if parts and parts[0].tag == 0xA0:
            parts = parts[1:]
        _, _, issuer, validity, subject, spki = parts[:6]
        name, curve, bits = _key_facts(spki)
        start, end = validity.children()[:2]
        ca = any(decode_oid(e.children()[0].content) == "2.5.29.19" and b"\x01\x01\xff" in e.children()[-1].content for x in parts[6:] if x.tag == 0xA3 for e in x.children()[0].children())
        signed_by = SIGNATURE_OIDS.get(decode_oid(signature.children()[0].content))
    except (ValueError, IndexError, TypeError):
        return None
    return {
        "subject": _common_name(subject), "issuer": _common_name(issuer), "ca": ca, "not_before": _time(start), "not_after": _time(end), "key": name, "curve": curve, "bits": bits,
        "signature": signed_by, "fingerprint": hashlib.sha256(der).hexdigest(),
    }


def pem_blocks(data: bytes) -> list[bytes]:
    """The certificates of a file: PEM blocks, or the file itself as DER."""
    import base64

    blocks = re.findall(rb"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", data, re.S)
    if not blocks:
        return [data] if data[:1] == b"\x30" else []
    out = []
    for block in blocks:
        try:
            out.append(base64.b64decode(block))
        except ValueError:
            continue
    return out


def find_der(data: bytes) -> list[tuple[str, str | None, int]]:
    """(kind, key algorithm, offset) of embedded certificates, public keys and private keys, MAX_DER at most."""
    out, at = [], data.find(b"\x30\x82")
    while at >= 0 and len(out) < MAX_DER:
        step = at + 1
        try:
            top = Tlv(data, at)
            parts = top.children()
            kinds = [p.tag for p in parts]
            if kinds[:3] == [0x30, 0x30, 3] and certificate_facts(data[at : top.end]):
                out.append(("certificate", certificate_facts(data[at : top.end])["key"], at))
                step = top.end
            elif kinds == [0x30, 3]:
                out.append(("public-key", _key_facts(top)[0], at))
                step = top.end
            elif kinds[:3] == [2, 0x30, 4]:
                out.append(("private-key", KEY_OIDS.get(decode_oid(parts[1].children()[0].content)), at))
                step = top.end
            elif kinds[:9] == [2] * 9:
                out.append(("private-key", "RSA", at))
                step = top.end
        except (ValueError, IndexError):
            pass
        at = data.find(b"\x30\x82", step)
    return out


def parse_kexinit(data: bytes) -> dict[str, list[str]] | None:
    """Name lists of an SSH key exchange message; null if it is none."""
    names = ("kex", "host_key", "cipher_out", "cipher_in", "mac_out", "mac_in")
    if len(data) < 17 or data[0] != 20:
        return None
    at, out = 17, {}
    for name in names:
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out[name] = [x for x in data[at + 4 : at + 4 + size].decode("ascii", "replace").split(",") if x]
        at += 4 + size
    return out


_OBSERVED = "path string, kind string, value string, detail string, offset long, hits long"
#: Rows, and characters of strings, that a task gathers before it hands them on.
_ROWS, _CHARS = 50_000, 64 << 20


def _facts(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of one file; the first place of a constant, in either byte order, carries the number of its hits."""
    if len(data) < MIN_BYTES or len(data) > MAX_BYTES:
        yield (path, "skipped", "size", None, len(data), None)
        return
    constants = find_constants(data)
    places: dict[str, list[int]] = {}
    for name, at in constants:
        places.setdefault(name.removesuffix("-le"), []).append(at)
    for name, at in constants:
        found = places.get(name.removesuffix("-le"))
        first = found is not None and min(found) == at
        yield (path, "constant", name, None, at, len(found) if first else None)
        if first:
            del places[name.removesuffix("-le")]
    yield from ((path, "der", k, algorithm, at, None) for k, algorithm, at in find_der(data))
    yield from ((path, "string", s, None, None, None) for s in once(s for s in each_string(data) if CRYPTO_TEXT.search(s.lower())))
    if kind := detect_format(data):
        symbols, libraries, truncated = {"elf": elf_symbols, "macho": macho_symbols, "pe": pe_symbols}[kind](data)
        yield from ((path, "symbol", s, None, None, None) for s in symbols)
        yield from ((path, "library", x, None, None, None) for x in libraries)
        yield (path, "format", kind, "truncated" if truncated else None, None, None)


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shown = lambda rows: pd.DataFrame(rows, columns=[x.split()[0] for x in _OBSERVED.split(", ")]).astype({"offset": "Int64", "hits": "Int64"})
    rows, chars = [], 0
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            for row in _facts(path, data):
                rows.append(row)
                chars += len(row[2])
                if len(rows) >= _ROWS or chars >= _CHARS:
                    yield shown(rows)
                    rows, chars = [], 0
    yield shown(rows)


#: Strings worth keeping, in lower case (ignoring case takes more than twice as long), and libraries that name themselves in strings.
CRYPTO_TEXT = re.compile(r"openssl|boringssl|libressl|mbed ?tls|wolfssl|gnutls|libsodium|bouncycastle|\bnss +[0-9.]|tls_|(?:rsa|ecdsa|ecdh|aes|sha)[-_ ]?[0-9]{3}|chacha20|curve25519|ed25519|md5|sha-?1\b")
FINGERPRINTS = (
    ("OpenSSL", r"OpenSSL\s+(\d+\.\d+\.\d+[a-z]?(?:-[\w.]+)?)"),
    ("BoringSSL", r"BoringSSL(?:\s+([\w.]+))?"),
    ("LibreSSL", r"LibreSSL\s+([\d.]+)"),
    ("mbedTLS", r"mbed\s?TLS\s+([\d.]+)"),
    ("wolfSSL", r"wolfSSL\s+([\d.]+)"),
    ("GnuTLS", r"GnuTLS\s+([\d.]+)"),
    ("NSS", r"\bNSS\s+([\d.]+)"),
    ("libsodium", r"libsodium\s+([\d.]+)"),
    ("Bouncy Castle", r"BouncyCastle(?:\s+v?([\d.]+))?"),
)
_E, _S, _D, _I, _K = "KEY_ESTABLISHMENT", "DIGITAL_SIGNATURE", "DATA_ENCRYPTION", "INTEGRITY", "KEY_DERIVATION"
#: Symbol rules in order: pattern, primitive, purpose, how parameters are read (m modulus, c curve, a AES, o output).
SYMBOL_RULES = (
    (r"^(RSA_(sign|verify|public_encrypt|private_decrypt|generate_key|generate_multi_prime_key)|RSA_padding_add)", "RSA", _S, "m"),
    (r"^(ECDSA_(do_sign|do_verify|sign|verify)|ECDSA_SIG_)", "ECDSA", _S, "c"),
    (r"^(ECDH_compute_key|EC_POINT_mul|EC_KEY_(new|generate_key|set_group))", "ECDH", _E, "c"),
    (r"^(DH_(compute_key|generate_key|new)|DH_check)", "DH", _E, ""),
    (r"^(DSA_(do_sign|do_verify|sign|verify|generate_key))", "DSA", _S, ""),
    (r"^(X25519|x25519_|curve25519_)", "X25519", _E, ""),
    (r"^(ED25519_(sign|verify|keypair)|ed25519_)", "EdDSA", _S, ""),
    (r"^(AES_(encrypt|decrypt|set_encrypt_key|set_decrypt_key|cbc_encrypt)|aes_v8_|aesni_)", "AES", _D, ""),
    (r"^(DES_(ecb3_encrypt|ede3_cbc_encrypt|set_key)|des_ede3)", "3DES", _D, ""),
    (r"^(RC4|rc4_)", "RC4", _D, ""),
    (r"^(ChaCha20|chacha20_|CRYPTO_chacha)", "ChaCha20", _D, ""),
    (r"^(MD5_(Init|Update|Final)|md5_block)", "MD5", _I, ""),
    (r"^(SHA1_(Init|Update|Final)|sha1_block)", "SHA1", _I, ""),
    (r"^(SHA(224|256|384|512)_(Init|Update|Final)|sha(256|512)_block)", "SHA2", _I, "o"),
    (r"^(SHA3_|KeccakF)", "SHA3", _I, ""),
    (r"^(HMAC_(Init|Update|Final|CTX)|hmac_)", "HMAC", _I, ""),
    (r"(?i)^(PKCS5_PBKDF2_HMAC|pbkdf2)", "PBKDF2", _K, ""),
    (r"^(EVP_PBE_scrypt|scrypt_)", "scrypt", _K, ""),
    (r"(?i)^(argon2)", "Argon2", _K, ""),
    (r"(?i)^(ML_KEM|mlkem|kyber)", "ML-KEM", _E, ""),
    (r"(?i)^(ML_DSA|mldsa|dilithium)", "ML-DSA", _S, ""),
    (r"(?i)^(SLH_DSA|slhdsa|sphincs)", "SLH-DSA", _S, ""),
    (r"^EVP_aes_(128|192|256)_", "AES", _D, "a"),
    (r"^EVP_des_ede3", "3DES", _D, "a"),
    (r"^EVP_rc4", "RC4", _D, ""),
    (r"^EVP_chacha20", "ChaCha20", _D, "256"),
    (r"^EVP_md5(_sha1)?$", "MD5", _I, "o128"),
    (r"^EVP_sha1$", "SHA1", _I, "o160"),
    (r"^EVP_sha(224|256|384|512)(_(224|256))?$", "SHA2", _I, "e"),
    (r"^EVP_(sha3_(224|256|384|512)|shake(128|256))$", "SHA3", _I, ""),
)


def symbol_spec(symbol: Column) -> Column:
    """The spec of a symbol by the first rule that fits; null if none does."""
    s = F.regexp_replace(F.regexp_replace(symbol, "^_+", ""), "@.*$", "")
    number = lambda pattern: F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).cast("int")
    curve = naming.normalize_curve(F.regexp_replace(F.regexp_extract(s, r"(?i)(?:NID_)?(?:X9_62_)?(prime256v1|secp[0-9]{3}[kr]1|nistp[0-9]{3}|P-?[0-9]{3})", 1), "(?i)^p([0-9])", "p-$1"))
    parameters = {
        "": {}, "m": {"modulusLength": number("([0-9]{3,4})")}, "c": {"curve": curve}, "o": {"outputLength": number("(224|256|384|512)")}, "e": {"outputLength": number("([0-9]{3})$")}, "256": {"keySize": 256},
        "o128": {"outputLength": 128}, "o160": {"outputLength": 160},
        "a": {"keySize": number("_(128|192|256)_"), "mode": F.upper(F.nullif(F.regexp_extract(s, r"_(gcm|ccm|cbc|ctr|ecb|ofb|cfb[0-9]*|xts|ocb|wrap)(?:$|_)", 1), F.lit("")))},
    }
    out = F.lit(None).cast("struct<primitive:string,parameters:string,purpose:string>")
    for pattern, primitive, purpose, how in reversed(SYMBOL_RULES):
        out = F.when(s.rlike(pattern), naming.spec(primitive, purpose, **parameters[how])).otherwise(out)
    return out


def _observed(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_observe, _OBSERVED)


def observed(files: DataFrame) -> DataFrame:
    """What files (path, content: binaryFile source) hold: constant, der, string, symbol, library, format and skipped rows."""
    return _observed(files).drop("hits")


def fingerprints(found: DataFrame) -> DataFrame:
    """Libraries and versions that strings name, once per file, library and version; found is read once."""
    named = [F.when(F.col("value").rlike(pattern), F.struct(F.lit(library).alias("library"), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("version"))) for library, pattern in FINGERPRINTS]
    # explode() would filter on the array, and so match every pattern twice
    each = found.filter("kind = 'string'").select("path", F.explode_outer(F.array(*named)).alias("f")).filter("f is not null")
    return each.select("path", "f.library", "f.version").distinct()


def binary_findings(files: DataFrame, system_id: str) -> DataFrame:
    """Findings of program files by constants, symbols and embedded keys; each file is parsed once."""
    found = _observed(files).filter("hits is not null or kind = 'symbol' or (kind = 'der' and detail is not null)")
    shape = lambda *s: F.struct(*[x.alias(k) for k, x in zip(("primitive", "parameters", "purpose"), s, strict=True)])
    kind, constant = F.col("kind"), F.regexp_replace("value", "-le$", "")
    table = F.create_map(*[x for name, *spec, _, _ in CONSTANTS for x in (F.lit(name), shape(*map(F.lit, spec)))])
    spec = F.when(kind == "constant", F.try_element_at(table, constant)).when(kind == "symbol", symbol_spec(F.col("value"))).otherwise(shape(F.col("detail"), F.lit("{}"), F.lit(_S)))
    raw = F.when(kind == "constant", F.concat_ws(" ", constant, F.col("hits").cast("string"), F.lit("hit(s)"))).when(kind == "symbol", F.col("value")).otherwise(F.concat("value", F.lit(" at "), F.col("offset").cast("string")))
    modality = F.when(kind == "symbol", "BINARY_SYMBOL").otherwise("BINARY_CONSTANT")
    # a filter on the spec itself would be pushed below, and the rules matched twice
    rows = found.select("path", raw.alias("raw"), modality.alias("modality"), F.explode_outer(F.array(spec)).alias("spec")).filter("spec is not null")
    return rows.select(F.lit(system_id).alias("system_id"), "spec.primitive", "spec.parameters", "spec.purpose", F.lit("VENDOR_LOCKED").alias("control_class"), "modality", F.col("path").alias("locator"), "raw", F.lit(None).cast("string").alias("assumption"))


_CERTIFICATE = "path string, subject string, issuer string, ca boolean, not_before string, not_after string, key string, curve string, bits int, signature string, fingerprint string"


def certificates(files: DataFrame) -> DataFrame:
    """Facts of the certificates in files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | facts for p, data in zip(batch["path"], batch["content"], strict=True) for der in pem_blocks(bytes(data)) if (facts := certificate_facts(der))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CERTIFICATE.split(", ")]).astype({"bits": "Int32"})

    return files.select("path", "content").mapInPandas(run, _CERTIFICATE)


def certificate_findings(facts: DataFrame, system_id: str) -> DataFrame:
    """Per certificate: its key, its issuer's signature and the digest of that signature."""
    key = naming.spec(F.col("key"), "CERTIFICATE_AUTH", curve=F.col("curve"), modulusLength=F.col("bits"))
    signed = F.transform(naming.signature_from_name(F.col("signature")), lambda s: F.struct(s["primitive"], s["parameters"], F.when(s["purpose"] == _S, "CERTIFICATE_AUTH").otherwise(s["purpose"]).alias("purpose")))
    every = F.concat(F.array(key).cast(naming.SPECS), F.coalesce(signed.cast(naming.SPECS), F.array().cast(naming.SPECS)))
    control = F.when(F.col("ca"), "PROTOCOL_BILATERAL").otherwise("SELF")
    return facts.select("*", F.explode(every).alias("spec")).select(F.lit(system_id).alias("system_id"), "spec.primitive", "spec.parameters", "spec.purpose", control.alias("control_class"), F.lit("PKI_CERTIFICATE").alias("modality"), F.col("fingerprint").alias("locator"), F.concat(F.lit("certificate of "), F.col("subject")).alias("raw"), F.lit(None).cast("string").alias("assumption"))


def handshake_findings(outcomes: DataFrame, system_id: str) -> DataFrame:
    """Findings of recorded handshakes: target, protocol (tls or ssh), selected, offered array; an asset counts once per target."""
    specs = F.when(F.col("protocol") == "tls", naming.tls_cipher_suite(F.col("token"))).otherwise(naming.ssh_algorithm(F.col("token")))
    chosen = outcomes.select("target", "protocol", F.col("selected").alias("token"), F.lit(0).alias("ord"), F.lit("SELECTED").alias("state")).filter("token is not null")
    listed = outcomes.select("target", "protocol", F.posexplode("offered").alias("k", "token")).select("target", "protocol", "token", (F.col("k") + 1).alias("ord"), F.lit("OFFERED").alias("state"))
    rows = chosen.union(listed).withColumn("spec", F.explode(specs))
    once = rows.groupBy("target", "spec").agg(F.min_by(F.struct("state", "token"), "ord").alias("first"))
    return once.select(F.lit(system_id).alias("system_id"), "spec.primitive", "spec.parameters", F.coalesce("spec.purpose", F.lit(_D)).alias("purpose"), F.lit("PROTOCOL_BILATERAL").alias("control_class"), F.lit("NETWORK_ACTIVE").alias("modality"), F.col("target").alias("locator"), F.concat_ws(" ", "first.state", "first.token").alias("raw"), F.lit(None).cast("string").alias("assumption"))


def kexinit_outcomes(messages: DataFrame) -> DataFrame:
    """Recorded SSH key exchange messages (target, content) as outcomes for handshake_findings()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for target, data in zip(batch["target"], batch["content"], strict=True):
                if lists := parse_kexinit(bytes(data)):
                    rows.append((target, "ssh", None, list(dict.fromkeys(x for names in lists.values() for x in names))))
            yield pd.DataFrame(rows, columns=["target", "protocol", "selected", "offered"])

    return messages.select("target", "content").mapInPandas(run, "target string, protocol string, selected string, offered array<string>")


# Python sources


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        inner = _dotted(node.func)
        return ".".join([inner, *reversed(parts)]) if inner else None
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _literal(node: ast.AST) -> str | None:
    """A literal's text or a dotted name; anything else is unresolved and is not guessed."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, bool)):
        return str(node.value)
    return _dotted(node.func) if isinstance(node, ast.Call) else _dotted(node)


def python_calls(text: str) -> tuple[list[tuple], list[tuple[str, str]]] | None:
    """Calls (line, function, callee with aliases resolved, arguments, keywords) and imports (alias, module); null if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    aliases: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                aliases[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                aliases[a.asname or a.name] = "." * node.level + (f"{node.module}." if node.module else "") + a.name
    calls: list[tuple] = []

    def visit(node: ast.AST, function: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inside = child.name if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else function
            if isinstance(child, ast.Call) and (name := _dotted(child.func)):
                head, _, rest = name.partition(".")
                full = aliases.get(head, head) + (f".{rest}" if rest else "")
                calls.append((child.lineno, function, full, [_literal(a) for a in child.args], {k.arg: _literal(k.value) for k in child.keywords if k.arg}))
            visit(child, inside)

    visit(tree, None)
    return calls, sorted(aliases.items())


_CALLS = "path string, line int, function string, callee string, args array<string>, kwargs map<string,string>, problem string"


def source_calls(files: DataFrame) -> DataFrame:
    """Calls of Python files (path, text); files that do not parse give one row with a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                found = python_calls(text or "")
                rows += [(path, None, None, None, None, None, "does not parse")] if found is None else [(path, line, f, c, a, {k: v for k, v in kw.items() if v is not None}, None) for line, f, c, a, kw in found[0]]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CALLS.split(", ")]).astype({"line": "Int32"})

    return files.select("path", "text").mapInPandas(run, _CALLS)


def source_findings(calls: DataFrame, system_id: str) -> DataFrame:
    """Findings of Python calls by rules on the resolved callee: hashlib, hmac, pyca, PyCryptodome, PyJWT, paramiko."""
    c = F.col("callee")
    arg = lambda k: F.get(F.col("args"), F.lit(k))
    kw = lambda k: F.try_element_at(F.col("kwargs"), F.lit(k))
    last = F.regexp_extract(c, r"([^.]+)$", 1)
    number = lambda x: x.try_cast("int")
    one = lambda *s: F.array_compact(F.array(*s)).cast(naming.SPECS)
    curve = naming.normalize_curve(F.regexp_extract(F.coalesce(arg(0), kw("curve"), F.lit("")), r"([^.]+)$", 1))
    algorithms = F.coalesce(kw("algorithm"), arg(2))
    module = lambda name: c.startswith(name)
    mode = F.regexp_extract(F.coalesce(arg(1), kw("mode"), F.lit("")), r"(?:MODE_|modes\.)(\w+)", 1)
    shaped = F.upper(F.nullif(mode, F.lit("")))
    specs = (
        F.when(c == "hashlib.new", naming.hash_from_name(F.coalesce(arg(0), F.lit("")), _I))
        .when(c == "hashlib.pbkdf2_hmac", one(naming.spec("PBKDF2", _K, iterations=number(arg(3)))))
        .when(c == "hashlib.scrypt", one(naming.spec("scrypt", _K)))
        .when(module("hashlib."), naming.hash_from_name(F.replace(last, F.lit("_"), F.lit("-")), _I))
        .when(c.isin("hmac.new", "hmac.digest"), one(naming.spec("HMAC", _I)))
        .when(c.rlike(r"asymmetric\.rsa\.generate_private_key$") | (c == "rsa.generate_private_key"), one(naming.spec("RSA", _S, modulusLength=number(F.coalesce(kw("key_size"), arg(1))))))
        .when(c.rlike(r"asymmetric\.ec\.generate_private_key$"), one(naming.spec("ECDSA", _S, curve=curve)))
        .when(c.rlike(r"asymmetric\.(ed25519|ed448)\.\w+\.generate$"), one(naming.spec("EdDSA", _S)))
        .when(c.rlike(r"asymmetric\.x25519\.\w+\.generate$"), one(naming.spec("X25519", _E)))
        .when(c.rlike(r"asymmetric\.dh\.generate_parameters$"), one(naming.spec("DH", _E, primeLength=number(kw("key_size")))))
        .when(c.rlike(r"primitives\.hashes\.(\w+)$"), naming.hash_from_name(last, _I))
        .when(c.rlike(r"ciphers\.algorithms\.(AES|TripleDES|ChaCha20|ARC4|Blowfish)$"), naming.cipher_from_name(last))
        .when(c.rlike(r"^Crypto(dome)?\.Cipher\.(AES|DES3|ARC4|ChaCha20)\.new$"), F.transform(naming.cipher_from_name(F.regexp_extract(c, r"Cipher\.(\w+)\.new", 1)), lambda s: naming.spec(s["primitive"], s["purpose"], mode=shaped)).cast(naming.SPECS))
        .when(c.rlike(r"^Crypto(dome)?\.PublicKey\.RSA\.generate$"), one(naming.spec("RSA", _S, modulusLength=number(F.coalesce(arg(0), kw("bits"))))))
        .when(c.rlike(r"^Crypto(dome)?\.Hash\.(\w+)\.new$"), naming.hash_from_name(F.regexp_extract(c, r"Hash\.(\w+)\.new", 1), _I))
        .when(c.isin("jwt.encode", "jwt.decode"), naming.jose_algorithm(F.coalesce(algorithms, F.lit(""))))
        .when(c.rlike(r"^paramiko\.RSAKey\.generate$"), one(naming.spec("RSA", _S, modulusLength=number(F.coalesce(kw("bits"), arg(0))))))
        .when(c.rlike(r"^paramiko\.ECDSAKey\.generate$"), one(naming.spec("ECDSA", _S)))
        .otherwise(F.array().cast(naming.SPECS))
    )
    harmless = F.when(kw("usedforsecurity") == "False", "the call states that the digest is not used for security")
    rows = calls.filter("callee is not null").select("*", harmless.alias("assumption"), F.explode(specs).alias("spec"))
    return rows.select(F.lit(system_id).alias("system_id"), "spec.primitive", "spec.parameters", F.coalesce("spec.purpose", F.lit(_D)).alias("purpose"), F.lit("SELF").alias("control_class"), F.lit("SOURCE_AST").alias("modality"), F.concat_ws(":", "path", F.col("line").cast("string")).alias("locator"), F.col("callee").alias("raw"), "assumption")
