"""Queries of the detectors: files made of the table part, each variant of a file by p_partkey, and what must be found, in SQL.

A query has variants (k, name, content) and the rows (k, ...) that its operator must give for them. Part number p
holds the variant p modulo their number, in the folder d<p>, so every row of the table is a file.
"""

from __future__ import annotations

import base64
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.operators import export, reach, scope, store
from estatelens.plans import commands, synth
from estatelens.queries import _ASSETS, _OCC, _TREE, _assets, _found, _graph, _occ, _table, query
from estatelens.sources import binaries, calls, inventories, text_files
from estatelens.sources.rules import DUAL_USE, RC2, SINGLE_DES, Rule


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def expected(count: int, columns: str, rows: list[tuple]) -> str:
    """SQL: p and the columns of the rows (k, ...) of each part's variant."""
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    return f"SELECT p_partkey AS p, {columns} FROM part JOIN (VALUES {values}) AS w(k, {columns}) ON p_partkey % {count} = w.k"


#: Made files of a task.
FILES = 20_000


def dealt(keys: DataFrame, column: str) -> DataFrame:
    """keys dealt over the cores by a column: a file is far larger than its key, so a table in one small piece would be parsed by one task.

    A task gets FILES at most, about, so that what it sorts does not grow with the table; rows are counted from the table's footers.
    """
    return keys.repartition(max(4 * keys.sparkSession.sparkContext.defaultParallelism, -(-keys.count() // FILES)), column)


def files(spark: SparkSession, sf: str, variants: list[tuple[str, str | bytes]]) -> DataFrame:
    """path and text or content of each part's variant."""
    binary = isinstance(variants[0][1], bytes)
    made = spark.createDataFrame([(k, n, bytearray(c) if binary else c) for k, (n, c) in enumerate(variants)], "k int, name string, content binary" if binary else "k int, name string, text string")
    keyed = dealt(_table(spark, sf, "part").select("p_partkey"), "p_partkey").select("p_partkey", (F.col("p_partkey") % len(variants)).cast("int").alias("k"))
    return keyed.join(F.broadcast(made), "k").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("name")).alias("path"), "content" if binary else "text")


def part_of(path: str) -> Column:
    """The part of a path or locator."""
    return F.regexp_extract(path, "^d([0-9]+)/", 1).cast("long").alias("p")


def line_of(locator: str) -> Column:
    return F.regexp_extract(locator, ":([0-9]+)$", 1).cast("int").alias("line")


def sources(name: str, variants: list[tuple[str, str]], rows: list[tuple]) -> None:
    """A query of the rules of one language: line, primitive, parameters, purpose and whether the rule guesses it."""

    @query(name, expected(len(variants), "line, primitive, parameters, purpose, guessed", rows))
    def run(spark, sf):
        found = calls.call_findings(calls.calls(files(spark, sf, variants)), "src")
        return found.select(part_of("locator"), line_of("locator"), "primitive", "parameters", "purpose", F.col("raw").contains("(RULE_DEFAULT)").alias("guessed"))


_KEX, _SIG, _ENC, _DIG, _KDF = "KEY_ESTABLISHMENT", "DIGITAL_SIGNATURE", "DATA_ENCRYPTION", "INTEGRITY", "KEY_DERIVATION"

# Rules by language

SCRIPTS = [
    ("a.ts", "import * as crypto from 'node:crypto';\nimport { createHash as h } from 'crypto';\nconst quote = /['\"]/; crypto.createHash('sha512');\ncrypto.generateKeyPairSync('rsa', { modulusLength: 3072 });\n// crypto.createHash('md5')\nother.createHash('md5');\nh('sha1');\n"),
    ("b.js", "const crypto = require('crypto');\nconst half = total / 2; crypto.createCipheriv('aes-192-cbc', k, iv); const other = a / b;\ncrypto.pbkdf2Sync(p, s, 100_000, 32, 'sha256');\ncrypto.generateKeyPairSync('rsa-pss', { modulusLength: 2048 });\nf(1, g(" + "x, " * 40 + "1), crypto.createECDH('secp384r1'));\n"),
    ("c.mjs", "import jwt from 'jsonwebtoken';\njwt.sign({}, key, { algorithm: 'ES384' });\ncrypto.createHash('md5');\nawait crypto.subtle.generateKey({ name: 'ECDSA', namedCurve: 'P-256' }, true, ['sign']);\n"),
    ("d.ts", "import CryptoJS from 'crypto-js';\nimport AES from 'crypto-js/aes';\nCryptoJS.MD5(x);\nAES.encrypt(x, k);\nconst s = `crypto.createHash('md5')`;\n"),
]
sources("a5_script_rules", SCRIPTS, [
    (0, 3, "SHA2", '{"outputLength":512}', _DIG, False), (0, 4, "RSA", '{"modulusLength":3072}', _KEX, True), (0, 7, "SHA1", '{"outputLength":160}', _DIG, False),
    (1, 2, "AES", '{"keySize":192,"mode":"CBC"}', _ENC, False), (1, 3, "PBKDF2", '{"hash":"SHA2","iterations":100000}', _KDF, False), (1, 4, "RSA", '{"modulusLength":2048,"padding":"PSS"}', _SIG, False), (1, 5, "ECDH", '{"curve":"P-384"}', _KEX, False),
    (2, 2, "ECDSA", '{"alg":"ES384","curve":"P-384"}', _SIG, False), (2, 2, "SHA2", '{"outputLength":384}', _DIG, False), (2, 4, "ECDSA", '{"curve":"P-256"}', _SIG, False),
    (3, 3, "MD5", '{"outputLength":128}', _DIG, False), (3, 4, "AES", '{"mode":"CBC"}', _ENC, False),
])
sources("a7_go_rules", [
    ("a.go", 'package main\nimport (\n\tcryptorsa "crypto/rsa"\n\t"crypto/md5"\n)\nfunc main() {\n\tcryptorsa.GenerateKey(rand.Reader, 2048)\n\tmd5.Sum(b)\n\trsa.GenerateKey(nil, 512)\n}\n'),
    ("b.go", 'package b\nimport (\n\t"crypto/sha512"\n\t"crypto/ecdsa"\n\t"crypto/elliptic"\n)\nfunc f() {\n\tsha512.New()\n\tecdsa.GenerateKey(elliptic.P384(), r)\n}\n'),
    ("c.go", 'package c\nimport "example.com/own/hmac"\nfunc f() {\n\thmac.New(x)\n\tsha256.Sum256(y)\n}\n'),
], [
    (0, 7, "RSA", '{"modulusLength":2048}', _KEX, True), (0, 8, "MD5", '{"outputLength":128}', _DIG, False), (1, 8, "SHA2", '{"outputLength":512}', _DIG, False), (1, 9, "ECDSA", '{"curve":"P-384"}', _SIG, True),
])
sources("a7_java_rules", [
    ("A.java", 'import javax.crypto.Cipher;\nclass A { void f() {\nCipher.getInstance("AES/GCM/NoPadding");\nMessageDigest.getInstance("SHA-384");\nKeyPairGenerator.getInstance("EC");\n} }\n'),
    ("B.java", 'import com.acme.Cipher;\nclass B { void f() {\nCipher.getInstance("DESede/CBC/PKCS5Padding");\n} }\n'),
    ("C.java", 'import java.security.*;\nclass C { void f() {\nSignature.getInstance("SHA256withRSA");\nCipher.getInstance(name);\n} }\n'),
], [
    (0, 3, "AES", '{"mode":"GCM","padding":"NOPADDING"}', _ENC, False), (0, 4, "SHA2", '{"outputLength":384}', _DIG, False), (0, 5, "ECDSA", "{}", _SIG, True),
    (2, 3, "SHA2", '{"outputLength":256}', _DIG, False), (2, 3, "RSA", '{"padding":"PKCS1v15"}', _SIG, False),
])
sources("a7_rust_rules", [
    ("a.rs", "use rsa::RsaPrivateKey as PrivKey;\nuse p256::{ecdsa::SigningKey, elliptic_curve as curve};\nfn main() {\n let k = PrivKey::new(&mut rng, 4096);\n let s = SigningKey::random(&mut rng);\n HmacBuilder::make();\n}\n"),
    ("b.rs", "use sha2::Sha512;\nfn f<'a>(x: &'a str) {\n let h = Sha512::new();\n let q = '\"'; let c = Aes128Gcm::new(key);\n}\n"),
    ("c.rs", "use crate::own::Digest;\nfn f() {\n Digest::new();\n let x = own::Hmacs::verify(y);\n}\n"),
], [
    (0, 4, "RSA", '{"modulusLength":4096}', _KEX, True), (0, 5, "ECDSA", '{"curve":"P-256"}', _SIG, False), (1, 3, "SHA2", '{"outputLength":512}', _DIG, False), (1, 4, "AES", '{"keySize":128,"mode":"GCM"}', _ENC, False),
])
sources("a7_csharp_rules", [
    ("A.cs", "using System.Security.Cryptography;\nclass P { static void Main() {\nvar r = RSA.Create(2048);\nvar d = SHA384.Create();\n} }\n"),
    ("B.cs", "using Acme.Tools;\nclass Q { void F() {\nvar r = RSA.Create(1024);\n} }\n"),
], [(0, 3, "RSA", '{"modulusLength":2048}', _KEX, True), (0, 4, "SHA2", '{"outputLength":384}', _DIG, False)])
sources("a7_c_rules", [
    ("a.c", "#include <openssl/evp.h>\nint main() {\nEVP_EncryptInit_ex(ctx, EVP_aes_256_gcm(), 0, 0, 0);\nRSA_generate_key_ex(r, 4096, e, 0);\n/* MD5_Init(c); */\n}\n"),
    ("b.c", "#include <openssl/ec.h>\nvoid f() {\nEC_KEY_new_by_curve_name(NID_X9_62_prime256v1);\nSHA256_Init(&c);\nchar q = '\"'; RC4_set_key(k, 16, d);\n}\n"),
], [
    (0, 3, "AES", '{"keySize":256,"mode":"GCM"}', _ENC, False), (0, 4, "RSA", '{"modulusLength":4096}', _KEX, True), (1, 3, "ECDSA", '{"curve":"P-256"}', _SIG, True), (1, 4, "SHA2", '{"outputLength":256}', _DIG, False), (1, 5, "RC4", "{}", _ENC, False),
])

# What findings rest on; the sizes in every file are made of its own row

_NOTED = [
    ("Keys.java", 'import java.security.*;\nclass A { void f() {\nKeyPairGenerator.getInstance("RSA");\nMessageDigest.getInstance("SHA-256");\nKeyPairGenerator.getInstance("EC");\n} }\n'),
    ("keys.go", 'package k\nimport (\n\t"crypto/des"\n\t"crypto/rsa"\n)\nfunc f() {\n\trsa.GenerateKey(r, BITS)\n\tdes.NewCipher(k)\n\trsa.SignPSS(r, k)\n}\n'),
    ("Old.cs", "using System.Security.Cryptography;\nclass P { void F() {\nvar r = RC2.Create();\nvar d = DES.Create();\nvar k = RSA.Create(BITS);\n} }\n"),
    ("keys.c", "#include <openssl/evp.h>\nvoid f() {\nEVP_PKEY_CTX_new_id(EVP_PKEY_RSA, 0);\nRSA_generate_key_ex(r, BITS, e, 0);\nRSA_sign(1, m, n, s, l, r);\n}\n"),
]
_NOTES = [
    (0, 3, "RSA", DUAL_USE, None), (0, 4, "SHA2", None, None), (0, 5, "ECDSA", DUAL_USE, None), (1, 7, "RSA", DUAL_USE, "y"), (1, 8, "UNKNOWN", SINGLE_DES, None), (1, 9, "RSA", None, None),
    (2, 3, "UNKNOWN", RC2, None), (2, 4, "UNKNOWN", SINGLE_DES, None), (2, 5, "RSA", DUAL_USE, "y"), (3, 3, "RSA", DUAL_USE, None), (3, 4, "RSA", DUAL_USE, "y"), (3, 5, "RSA", None, None),
]


@query("a7_notes", f"SELECT p, line, primitive, note, CASE WHEN sized = 'y' THEN CAST(1024 + 8 * (p % 400) AS INT) END AS bits FROM ({expected(len(_NOTED), 'line, primitive, note, sized', _NOTES)})")
def a7_notes(spark, sf):
    bits = F.lit(1024) + 8 * (part_of("path") % 400)
    varied = files(spark, sf, _NOTED).withColumn("text", F.replace("text", F.lit("BITS"), bits.cast("string")))
    found = calls.call_findings(calls.calls(varied), "src")
    note = F.nullif(F.regexp_extract("raw", " note=(.*)$", 1), F.lit(""))
    return found.select(part_of("locator"), line_of("locator"), "primitive", note.alias("note"), F.get_json_object("parameters", "$.modulusLength").cast("int").alias("bits"))


# A4, M: rules of the caller, beside the fixed ones and before them; every file is made of its own row

_OWN_RULES = (
    Rule("js", r"(^|\.)seal$", "@acme/vault", _ENC, "AES", {"keySize": ("member", "bits"), "mode": ("text", "GCM")}),
    Rule("js", r"(^|\.)(stamp|seal)$", "@acme/vault|acme-stamp", _SIG, "RSA", {"modulusLength": ("argument", 1)}, by_default=True),
    Rule("js", r"(^|\.)createHash$", "acme-crypto", _DIG, "SHA3", {"outputLength": ("argument", 0)}),
)


@query("m_own_rules", """WITH f AS (SELECT p_partkey AS p, p_size AS n, p_partkey % 4 AS k FROM part)
    SELECT p, 2 AS line, 'AES' AS primitive, concat('{"keySize":', CAST(64 * n AS STRING), ',"mode":"GCM"}') AS parameters, 'DATA_ENCRYPTION' AS purpose, false AS guessed FROM f WHERE k IN (0, 1)
    UNION ALL SELECT p, 3, 'RSA', concat('{"modulusLength":', CAST(1024 + n AS STRING), '}'), 'DIGITAL_SIGNATURE', true FROM f WHERE k IN (0, 1, 2)
    UNION ALL SELECT p, 2, 'RSA', '{}', 'DIGITAL_SIGNATURE', true FROM f WHERE k = 2
    UNION ALL SELECT p, 5, CASE WHEN k = 1 THEN 'SHA3' ELSE 'SHA2' END, concat('{"outputLength":', CASE WHEN n % 2 = 0 THEN '256' ELSE '512' END, '}'), 'INTEGRITY', false FROM f WHERE k IN (0, 1, 2)""")
def own_rules(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    vault = F.when(k == 0, "@acme/vault").when(k == 1, "@acme/vault/node").when(k == 2, "acme-stamp").otherwise("other-vault")
    hashes = F.when(k == 1, "acme-crypto").when(k == 3, "acme-cryptography").otherwise("node:crypto")
    bits = F.when(n % 2 == 0, "256").otherwise("512")
    text = F.concat(
        F.lit("import * as vault from '"), vault, F.lit("';\nvault.seal(data, { bits: "), (n * 64).cast("string"), F.lit(" });\nvault.stamp(data, "), (n + 1024).cast("string"), F.lit(");\nimport * as c from '"), hashes,
        F.lit("';\nc.createHash("), F.when(k == 1, bits).otherwise(F.concat(F.lit("'sha"), bits, F.lit("'"))), F.lit(");\n"),
    )
    made = dealt(_table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/a.mjs")).alias("path"), text.alias("text"))
    found = calls.call_findings(calls.calls(made), "src", _OWN_RULES)
    return found.select(part_of("locator"), line_of("locator"), "primitive", "parameters", "purpose", F.col("raw").contains("(RULE_DEFAULT)").alias("guessed"))


# Parsing, graphs, entry points

_NESTED = [
    ("a.ts", "import { sign as s } from './keys.js';\nimport * as http from 'node:http';\nexport function outer(a) {\n  function inner() { s('x', 1); }\n  http.get(a, { host: 'h', port: 80 });\n}\nrun(`t${x}`, [1], /re(/, 'z');\n"),
    ("b.py", "import hashlib as hl\nfrom .keys import make\ndef f(x):\n    hl.sha256(x)\n    make(1, n='a')\n"),
]
_CALLED = [
    (0, 3, "outer", "outer", "a", ""), (0, 4, "inner", "inner", "", ""), (0, 4, "inner", "sign", "x,1", ""), (0, 5, "outer", "http.get", "a,?", "host=h,port=80"), (0, 7, None, "run", "?,?,?,z", ""),
    (1, 4, "f", "hashlib.sha256", "x", ""), (1, 5, "f", ".keys.make", "1", "n=a"),
]


@query("a2_parsed_calls", expected(2, "line, function, callee, args, members", _CALLED))
def a2(spark, sf):
    shown = F.array_join("args", ",", "?")
    members = F.array_join(F.transform(F.array_sort(F.map_entries("kwargs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return calls.calls(files(spark, sf, _NESTED)).select(part_of("path"), "line", "function", "callee", shown.alias("args"), members.alias("members"))


@query("a3_imports", expected(2, "alias, spec", [(0, "s", "./keys.js"), (0, "http", "node:http"), (1, "hl", "hashlib"), (1, "make", ".keys")]))
def a3(spark, sf):
    return calls.parsed(files(spark, sf, _NESTED)).select(part_of("path"), F.explode("imports").alias("i")).select("p", "i.alias", "i.spec")


@query("j1_call_edges", expected(2, "caller, callee", [(0, "outer", "outer"), (0, "outer", "get"), (0, "inner", "inner"), (0, "inner", "sign"), (0, "", "run"), (1, "f", "sha256"), (1, "f", "make")]))
def j1(spark, sf):
    typed = files(spark, sf, _NESTED).select("*", F.lit(None).cast("string").alias("package"), F.lit(False).alias("published"))
    return calls.module_graph(typed)[3].select(part_of("file"), "caller", "callee")


_ENTRIES = [
    ("server.ts", "http.createServer(f);"), ("app/x/route.ts", "export const GET = 1;"), ("bin.js", "#!/usr/bin/env node\nrun();"), ("lib.ts", "export const x = 1;"), ("m.go", "package main\nfunc main() {}"), ("s.go", "http.ListenAndServe(a, b)"),
    ("wsgi.py", "x = 1"), ("t.py", "if __name__ == '__main__':\n    run()"), ("w.py", "app = Flask(__name__)"), ("A.java", "public static void main(String[] a) {}"), ("l.rs", "fn main() {}"), ("P.cs", "static async Task Main() {}"), ("x.c", "int main(void) {}"), ("y.c", "int other(void) {}"),
]
_KINDS = "http-server framework-route package-bin - package-main framework-route python-wsgi python-main framework-route package-main package-main package-main package-main -".split()


@query("c12_entry_kinds", expected(len(_ENTRIES), "kind", [(k, x) for k, x in enumerate(_KINDS)]))
def c12(spark, sf):
    kind = calls.entry_kind(F.col("path"), F.col("text"), calls.language_of(F.col("path")))
    return files(spark, sf, _ENTRIES).select(part_of("path"), F.coalesce(kind, F.lit("-")).alias("kind"))


_TREE_FILES = [("a.ts", SCRIPTS[0][1]), ("nginx.conf", "ssl_protocols TLSv1;\n"), ("package.json", '{"name":"x","dependencies":{"md5":"^2.3.0"}}'), ("notes.md", "crypto.createHash('md5')"), ("big.js", "x" * 10), ("broken.py", "def (")]
_KIND_COUNTS = [(0, "SOURCE_AST", 3), (1, "SOURCE_CONFIG", 1), (2, "DEPENDENCY", 1), (5, "skipped: does not parse", 1)]


@query("a1_scan_source", expected(6, "what, n", _KIND_COUNTS))
def a1(spark, sf):
    tree = files(spark, sf, _TREE_FILES).select("path", F.length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    found, skipped = commands.collect(tree, "src", with_binaries=False)
    rows = found.select("locator", F.col("modality").alias("what")).union(skipped.select("path", F.concat(F.lit("skipped: "), F.col("reason"))))
    return rows.groupBy(part_of("locator"), "what").agg(F.count("*").alias("n"))


# Paths, liveness, no entry point, packages


@query("j3_call_paths", f"WITH RECURSIVE {_TREE}, w(k, path) AS (SELECT 1::BIGINT, 'src/f1.ts' UNION ALL SELECT c, concat(path, '>src/f', CAST(c AS STRING), '.ts') FROM w JOIN e ON p = k) SELECT k AS p_partkey, path FROM w WHERE k % 3 = 0")
def j3(spark, sf):
    modules, imports = _graph(spark, sf)
    walked = reach.walk(reach.resolve_local(imports, modules), reach.entry_points(modules))
    number = F.regexp_extract("file", "f([0-9]+)", 1).cast("long")
    paths = reach.call_paths(walked, modules.filter(number % 3 == 0).select("file"))
    return paths.select(number.alias("p_partkey"), F.array_join("path", ">").alias("path"))


@query("j4_live_functions", "SELECT p_partkey AS p, name FROM part JOIN (VALUES (0, 'api'), (0, 'helper'), (0, 'deep'), (1, 'api')) AS w(k, name) ON p_partkey % 2 = w.k")
def j4(spark, sf):
    p = _table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file"), (F.col("p_partkey") % 2).alias("k"))
    chain = spark.createDataFrame([(0, "api", "helper"), (0, "helper", "deep"), (0, "dead", "deeper"), (1, "dead", "api"), (1, "dead", "dead")], "k long, caller string, callee string")
    live = reach.live_functions(p.join(F.broadcast(chain), "k").select("file", "caller", "callee"), p.select("file", F.lit("api").alias("name")))
    return live.select(F.col("file").cast("long").alias("p"), "name")


@query("j6_no_entry_point", "SELECT CAST(p_partkey AS STRING) AS occurrence_id, CAST(NULL AS STRING) AS via FROM part")
def j6(spark, sf):
    modules, imports = _graph(spark, sf)
    modules = modules.withColumn("entry_kind", F.lit(None).cast("string"))
    roots = reach.entry_points(modules)
    rows = modules.select(F.regexp_extract("file", "f([0-9]+)", 1).alias("occurrence_id"), F.lit("SOURCE_AST").alias("modality"), "file")
    walked = reach.walk(reach.resolve_local(imports, modules), roots)
    return reach.verdicts(rows, walked, modules, any_entry=not roots.isEmpty()).select("occurrence_id", "via")


@query("j10_packages", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'libs/core' WHEN p_partkey % 4 = 1 THEN 'libs/core/deep' WHEN p_partkey % 4 = 2 THEN 'libs/app' END AS package, p_partkey % 4 IN (0, 1) AND p_partkey % 8 < 4 AS published FROM part""")
def j10(spark, sf):
    folder = F.element_at(F.array(*map(F.lit, ("libs/core/", "libs/core/deep/", "libs/app/", "other/"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(folder, F.when(F.col("p_partkey") % 8 < 4, "src/f").otherwise("tests/f"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    manifests = spark.createDataFrame([("libs/core/package.json", '{"name":"@org/core"}'), ("libs/core/deep/package.json", '{"name":"@org/deep","private":false}'), ("libs/app/package.json", '{"name":"app","private":true}')], "path string, text string")
    placed = calls.with_packages(_table(spark, sf, "part").select("p_partkey", path.alias("path")), calls.packages_of(manifests))
    return placed.select("p_partkey", "package", "published")


# Configuration and lock files

_CONFIGS = [
    ("openssl.cnf", "# c\ndefault_bits = 1024 # old\ndefault_md=sha1\ndefault_days = 365\ncurve_name = prime256v1\n"), ("java.security", "jdk.tls.disabledAlgorithms=MD5, \\\n  RC4, DES\nother=1\n"),
    ("sshd_config", "HostKeyAlgorithms ssh-ed25519,ssh-rsa\nMACs -hmac-md5\nCiphers +aes256-gcm@openssh.com\n"), ("ssh_config", "KexAlgorithms mlkem768x25519-sha256\n"), ("readme.md", "default_md = md5"),
]


@query("a11_a13_configs", expected(5, "line_no, directive, primitive, purpose", [
    (0, 2, "default_bits", "RSA", "CERTIFICATE_AUTH"), (0, 3, "default_md", "SHA1", _DIG), (0, 5, "curve_name", "ECDSA", "CERTIFICATE_AUTH"),
    (1, 1, "jdk.tls.disabledAlgorithms", "MD5", _DIG), (1, 1, "jdk.tls.disabledAlgorithms", "RC4", _ENC), (1, 1, "jdk.tls.disabledAlgorithms", "UNKNOWN", _ENC),
    (2, 1, "hostkeyalgorithms", "EdDSA", _SIG), (2, 1, "hostkeyalgorithms", "RSA", _SIG), (2, 3, "ciphers", "AES", _ENC), (3, 1, "kexalgorithms", "ML-KEM", _KEX),
]))
def a11(spark, sf):
    return text_files.config_detections(files(spark, sf, _CONFIGS)).select(part_of("file"), "line_no", "directive", "primitive", "purpose")


_LOCKS = [
    ("pnpm-lock.yaml", "packages:\n  /node-forge@1.3.1:\n  '@peculiar/x509@1.9.0': {}\n  @peculiar/x509@1.9.0:\n"), ("poetry.lock", '[[package]]\nname = "PyCrypto"\ncategory = "main"\n\n[[package]]\nname = "rsa"\ngroups = ["dev"]\n'),
    ("Pipfile", '[packages]\npyjwt = "*"\n[dev-packages]\nparamiko = "*"\n[requires]\npython_version = "3"\n'), ("requirements.txt", "Paramiko[x]==3.4.0 ; python_version > '3'\n# c\nflask>=2\n-r o.txt\nflask>=3\n"), ("package.json", '{\n"dependencies": {"md5": "^2"},\n"devDependencies": {"jose": "5"}\n}'), ("package.json", "not json"),
]
_DECLARED = [
    (0, "npm", "node-forge", "1.3.1", False, 2), (0, "npm", "@peculiar/x509", "1.9.0", False, 4), (1, "pypi", "PyCrypto", None, False, 2), (1, "pypi", "rsa", None, True, 6), (2, "pypi", "pyjwt", None, False, 2), (2, "pypi", "paramiko", None, True, 4),
    (3, "pypi", "Paramiko", "3.4.0", False, 1), (3, "pypi", "flask", "2", False, 3), (3, "pypi", "flask", "3", False, 5), (4, "npm", "md5", "^2", False, 2), (4, "npm", "jose", "5", True, 3),
]


@query("a15_manifests", expected(6, "ecosystem, name, version, dev, line_no", _DECLARED))
def a15(spark, sf):
    return text_files.declared(files(spark, sf, _LOCKS)).select(part_of("file"), "ecosystem", "name", "version", "dev", "line_no")


@query("f7_first_declared", expected(6, "primitive, control_class", [(0, p, "VENDOR_UPGRADEABLE") for p in ("RSA", "RSA", "ECDSA", "AES", "3DES", "RC4", "SHA1", "MD5", "SHA2", "RSA", "ECDSA", "EdDSA")] + [(1, p, "VENDOR_LOCKED") for p in ("RSA", "RSA", "DSA", "AES", "3DES", "RC4", "MD5", "SHA1")] + [(2, p, "VENDOR_UPGRADEABLE") for p in ("RSA", "ECDSA", "HMAC", "EdDSA")] + [(3, p, "VENDOR_UPGRADEABLE") for p in ("ECDH", "DH", "X25519", "RSA", "ECDSA", "EdDSA", "DSA", "AES", "3DES")] + [(4, "MD5", "VENDOR_UPGRADEABLE")]))
def f7(spark, sf):
    return text_files.dependency_findings(files(spark, sf, _LOCKS), "deps")[0].select(part_of("locator"), "primitive", "control_class")


# Certificates and program files


def _tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def _oid(text: str) -> bytes:
    first, second, *rest = map(int, text.split("."))
    out = bytes([first * 40 + second])
    for n in rest:
        digits = [n & 0x7F]
        while n := n >> 7:
            digits.append(n & 0x7F | 0x80)
        out += bytes(reversed(digits))
    return _tlv(6, out)


def _public_key(bits: int) -> bytes:
    return _tlv(0x30, _tlv(0x30, _oid("1.2.840.113549.1.1.1"), _tlv(5)), _tlv(3, b"\0" + _tlv(0x30, _tlv(2, b"\0" + b"\xc1" * (bits // 8)), _tlv(2, b"\1\0\1"))))


def _certificate(bits: int, signature: str, ca: bool) -> bytes:
    """A certificate in DER, made here."""
    algorithm, name = _tlv(0x30, _oid(signature), _tlv(5)), lambda x: _tlv(0x30, _tlv(0x31, _tlv(0x30, _oid("2.5.4.3"), _tlv(12, x))))
    constraints = _tlv(0xA3, _tlv(0x30, _tlv(0x30, _oid("2.5.29.19"), _tlv(4, _tlv(0x30, _tlv(1, b"\xff")))))) if ca else b""
    body = _tlv(0x30, _tlv(0xA0, _tlv(2, b"\2")), _tlv(2, b"\7"), algorithm, name(b"issuer"), _tlv(0x30, _tlv(23, b"250101000000Z"), _tlv(24, b"20350101000000Z")), name(b"subject"), _public_key(bits), constraints)
    return _tlv(0x30, body, algorithm, _tlv(3, b"\0" + b"\x55" * 64))


_SHA256_RSA, _ECDSA_SHA384 = "1.2.840.113549.1.1.11", "1.2.840.10045.4.3.3"
_PEM = b"-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(_certificate(1024, _SHA256_RSA, False)) + b"-----END CERTIFICATE-----\n"
_CERTIFICATES = [("a.pem", _PEM), ("ca.der", _certificate(2048, _ECDSA_SHA384, True)), ("junk.der", b"0\x82\xff\xff"), ("two.pem", _PEM + _PEM)]


@query("a18_certificates", expected(4, "bits, ca, signature, n", [(0, 1024, False, "sha256WithRSA", 1), (1, 2048, True, "ecdsa-with-SHA384", 1), (3, 1024, False, "sha256WithRSA", 2)]))
def a18(spark, sf):
    return binaries.certificates(files(spark, sf, _CERTIFICATES)).groupBy(part_of("path"), "bits", "ca", "signature").agg(F.count("*").alias("n"))


@query("a19_certificate_findings", """WITH w AS (SELECT * FROM (VALUES (0, 'RSA', '{"modulusLength":1024}', 'SELF', 1), (0, 'SHA2', '{"outputLength":256}', 'SELF', 1), (0, 'RSA', '{"padding":"PKCS1v15"}', 'SELF', 1), (1, 'RSA', '{"modulusLength":2048}', 'PROTOCOL_BILATERAL', 1), (1, 'ECDSA', '{}', 'PROTOCOL_BILATERAL', 1), (1, 'SHA2', '{"outputLength":384}', 'PROTOCOL_BILATERAL', 1), (3, 'RSA', '{"modulusLength":1024}', 'SELF', 2), (3, 'SHA2', '{"outputLength":256}', 'SELF', 2), (3, 'RSA', '{"padding":"PKCS1v15"}', 'SELF', 2)) AS w(k, primitive, parameters, control_class, m))
 SELECT primitive, parameters, control_class, CAST(sum(m) AS BIGINT) AS n FROM part JOIN w ON p_partkey % 4 = k GROUP BY 1, 2, 3""")
def a19(spark, sf):
    found = binaries.certificate_findings(binaries.certificates(files(spark, sf, _CERTIFICATES)), "pki")
    return found.groupBy("primitive", "parameters", "control_class").agg(F.count("*").alias("n"))


def _elf(symbols: list[str], needed: list[str]) -> bytes:
    """A program file with a symbol table and a list of libraries, made here."""
    names, libs = b"\0" + b"".join(s.encode() + b"\0" for s in symbols), b"\0" + b"".join(s.encode() + b"\0" for s in needed)
    table = b"".join(struct.pack("<IBBHQQ", names.index(s.encode() + b"\0"), 0, 0, 0, 0, 0) for s in symbols)
    dynamic = b"".join(struct.pack("<QQ", 1, libs.index(s.encode() + b"\0")) for s in needed)
    blobs, at, sections = [table, names, dynamic, libs], 64, [(0, 0, 0, 0, 0)]
    for blob, kind, link, entry in zip(blobs, (11, 3, 6, 3), (2, 0, 4, 0), (24, 0, 16, 0), strict=True):
        sections.append((kind, at, len(blob), link, entry))
        at += len(blob)
    head = b"\x7fELF\2\1\1" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, at, 0, 64, 0, 0, 64, len(sections), 0)
    return head + b"".join(blobs) + b"".join(struct.pack("<IIQQQQIIQQ", 0, k, 0, 0, o, n, link, 0, 0, e) for k, o, n, link, e in sections)


_PROGRAMS = [
    ("x.so", _elf(["RSA_sign", "EVP_aes_128_cbc", "main"], ["libssl.so.3"]) + b"OpenSSL 1.0.2k-fips 26 Jan 2017\0"), ("y.bin", b"\0" * 80 + _certificate(2048, _SHA256_RSA, False) + b"pad" + _public_key(1024) + bytes.fromhex(binaries.CONSTANTS[1][4])),
    ("tiny", b"x"), ("s.exe", b"MZ" + b"\xff" * 200 + "wolfSSL 5.6.3".encode("utf-16-le") + b"\0\0"),
]


@query("a27_a32_program_facts", expected(4, "kind, value", [
    (0, "symbol", "RSA_sign"), (0, "symbol", "EVP_aes_128_cbc"), (0, "symbol", "main"), (0, "library", "libssl.so.3"), (0, "format", "elf"), (0, "string", "EVP_aes_128_cbc"), (0, "string", "OpenSSL 1.0.2k-fips 26 Jan 2017"),
    (1, "der", "certificate"), (1, "der", "public-key"), (1, "constant", "sha256-k"), (2, "skipped", None), (3, "format", "pe"), (3, "string", "wolfSSL 5.6.3"),
]))
def a27(spark, sf):
    value = F.when(F.col("kind") != "skipped", F.col("value"))
    return binaries.observed(files(spark, sf, _PROGRAMS)).select(part_of("path"), "kind", value.alias("value"))


@query("a31_fingerprints", expected(4, "library, version", [(0, "OpenSSL", "1.0.2k-fips"), (3, "wolfSSL", "5.6.3")]))
def a31f(spark, sf):
    return binaries.fingerprints(binaries.observed(files(spark, sf, _PROGRAMS))).select(part_of("path"), "library", "version")


@query("a27_binary_findings", expected(4, "primitive, modality", [(0, "RSA", "BINARY_SYMBOL"), (0, "AES", "BINARY_SYMBOL"), (1, "RSA", "BINARY_CONSTANT"), (1, "RSA", "BINARY_CONSTANT"), (1, "SHA2", "BINARY_CONSTANT")]))
def a27f(spark, sf):
    return binaries.binary_findings(files(spark, sf, _PROGRAMS), "bin").select(part_of("locator"), "primitive", "modality")


# Key stores and hosts


@query("a20_key_adapters", """SELECT concat('k', CAST(s_suppkey AS STRING)) AS id, CASE s_suppkey % 4 WHEN 0 THEN concat('RSA_', CAST(1024 * (1 + s_suppkey % 3) AS STRING)) WHEN 1 THEN 'EC_P-256' WHEN 2 THEN 'EC_SIGN_P256_SHA256' ELSE 'GOOGLE_SYMMETRIC_ENCRYPTION' END AS key_spec,
 CASE s_suppkey % 4 WHEN 0 THEN 'SIGN_VERIFY' WHEN 1 THEN 'KEY_AGREEMENT' WHEN 2 THEN 'SIGN_VERIFY' ELSE 'ENCRYPT_DECRYPT' END AS usage, s_suppkey % 4 IN (0, 2) AS hsm_backed, s_suppkey % 4 <> 2 AS enabled FROM supplier""")
def a20(spark, sf):
    s = _table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("k"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("id"))
    none, characters = F.lit(None).cast("string"), ((128 * (1 + F.col("s_suppkey") % 3) * 4 + 2) / 3).cast("int")
    azure = s.filter("k < 2").select(
        F.col("id").alias("kid"), F.when(F.col("k") == 0, "RSA-HSM").otherwise("EC").alias("kty"), F.when(F.col("k") == 1, "P-256").alias("crv"), F.when(F.col("k") == 0, F.repeat(F.lit("A"), characters)).alias("n"), F.when(F.col("k") == 0, F.array(F.lit("sign"))).otherwise(F.array(F.lit("wrapKey"))).alias("key_ops"),
        F.lit(True).alias("enabled"), F.lit(0).cast("long").alias("created"), none.alias("description"), none.alias("subscription"),
    )
    gcp = s.filter("k > 1").select(
        F.col("id").alias("name"), F.when(F.col("k") == 2, "EC_SIGN_P256_SHA256").otherwise("GOOGLE_SYMMETRIC_ENCRYPTION").alias("algorithm"), F.when(F.col("k") == 2, "DISABLED").otherwise("ENABLED").alias("state"), F.when(F.col("k") == 2, "HSM").otherwise("SOFTWARE").alias("protectionLevel"),
        none.alias("createTime"), F.when(F.col("k") == 3, "ENCRYPT_DECRYPT").alias("purpose"), F.lit(None).cast("boolean").alias("rotation_enabled"),
    )
    return inventories.from_azure(azure).unionByName(inventories.from_gcp(gcp)).select("id", "key_spec", "usage", "hsm_backed", "enabled")


@query("a23_host_adapters", """SELECT concat('h', CAST(c_custkey AS STRING)) AS host_id, CASE WHEN c_custkey % 3 = 2 THEN 'Debian 12' ELSE '' END AS os, CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE 1 END AS packages, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS configs FROM customer""")
def a23(spark, sf):
    c = _table(spark, sf, "customer").select((F.col("c_custkey") % 3).alias("k"), F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("host"))
    package = F.create_map(F.lit("name"), F.lit("openssl"), F.lit("version"), F.lit("3.0.2"))
    config = F.create_map(F.lit("path"), F.lit("/etc/ssh"), F.lit("label"), F.lit("Ciphers"), F.lit("value"), F.lit("aes128-ctr"))
    rows = c.filter("k < 2").select(F.when(F.col("k") == 0, "crypto_packages").otherwise("crypto_config").alias("name"), F.col("host").alias("hostIdentifier"), F.when(F.col("k") == 0, package).otherwise(config).alias("columns"))
    facts = c.filter("k = 2").select(F.col("host").alias("host_id"), F.lit(None).cast("string").alias("fqdn"), F.lit("Debian").alias("distribution"), F.lit("12").alias("distribution_version"), F.create_map(F.lit("openssl"), F.array(F.lit("3.5.0"))).alias("packages"), F.create_map(F.lit("/etc/x"), F.create_map(F.lit("macs"), F.lit("hmac-sha1"))).alias("configs"))
    hosts = inventories.from_osquery(rows)[0].unionByName(inventories.from_facts(facts))
    return hosts.select("host_id", "os", F.size("packages").alias("packages"), F.size("configs").alias("configs"))


@query("d21_hosts_of_system", "SELECT concat('h', CAST(c_custkey AS STRING)) AS host_id FROM customer WHERE c_custkey % 3 IN (0, 1)")
def d21(spark, sf):
    system = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "pay").otherwise("other")
    hosts = _table(spark, sf, "customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("host_id"), system.alias("system_id"))
    return inventories.hosts_of(hosts, "pay").select("host_id")


@query("i18_modulus_bits", "SELECT p_partkey, CAST(8 * floor((p_size + 40) * 3 / 4) AS INT) AS bits FROM part")
def i18(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", inventories.modulus_bits(F.repeat(F.lit("A"), F.col("p_size").cast("int") + 40)).alias("bits"))


@query("i20_iso_or", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2026-01-01' ELSE o_orderdate::TIMESTAMP END AS at FROM orders")
def i20(spark, sf):
    from estatelens.functions.assets import iso_or

    text = F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return _table(spark, sf, "orders").select("o_orderkey", iso_or(text, F.expr("timestamp '2026-01-01'")).alias("at"))


# B1, K4, K5: documents and derivations


@query("b1_components_of_document", f"""WITH {_OCC}, {_ASSETS}, o AS (SELECT asset_id, count(*) AS n, max(confidence) AS confidence FROM occ WHERE level <> 'SUSPECTED' GROUP BY 1) SELECT concat('crypto:', asset_id) AS ref, asset_name AS name, oid, CAST(n AS STRING) AS occurrences, CAST(floor(confidence * 100 + 0.5) AS INT) AS percent, purpose FROM o JOIN assets USING (asset_id)""")
def b1c(spark, sf):
    body = export.document(synth.with_reach(_occ(spark, sf)), _assets(spark, sf), "eo-14412@1.0.0", "2026-08-28T00:00:00Z")
    shape = "components array<struct<`bom-ref`:string,name:string,cryptoProperties:struct<oid:string>,evidence:struct<identity:struct<confidence:int>>,properties:array<struct<name:string,value:string>>>>"
    c = body.select(F.explode(F.from_json("body", shape)["components"]).alias("c"))
    value = lambda name: F.get(F.filter("c.properties", lambda p: p["name"] == f"estatelens:{name}"), F.lit(0))["value"]
    return c.select(F.col("c.bom-ref").alias("ref"), "c.name", "c.cryptoProperties.oid", value("occurrenceCount").alias("occurrences"), F.col("c.evidence.identity.confidence").alias("percent"), value("purpose").alias("purpose"))


@query("k4_derivation", f"""WITH {_OCC}, one AS (SELECT occurrence_id AS id, n_assumptions FROM occ WHERE occurrence_id = (SELECT min(occurrence_id) FROM occ)),
 g AS (SELECT grp, arg_max(modality, ceiling * 100 - grp_ord) AS top FROM (SELECT DISTINCT modality FROM found JOIN one ON occurrence_id = id) JOIN dim USING (modality) GROUP BY 1),
 n AS (SELECT count(*) AS m FROM found JOIN one ON occurrence_id = id JOIN g ON modality = top GROUP BY grp)
 SELECT 'INFERENCE' AS kind, (SELECT count(*) FROM g) + 1 AS n UNION ALL SELECT 'EVIDENCE', CAST(sum(least(5, m)) AS BIGINT) FROM n UNION ALL SELECT 'ASSUMPTION', n_assumptions FROM one WHERE n_assumptions > 0""")
def k4(spark, sf):
    first = _occ(spark, sf).agg(F.min("occurrence_id")).first()[0]
    return commands.derivation(_found(spark, sf), first).groupBy("kind").agg(F.count("*").alias("n"))


# IPv6 and probe plans


@query("d15_ipv6_targets", "SELECT DISTINCT concat('2001:db8:', CAST(c_custkey % 10 AS STRING), '::', CAST(c_custkey % 7 AS STRING)) AS host, CASE WHEN c_custkey % 10 < 8 THEN '2001:db8::/45' END AS target FROM customer WHERE c_custkey % 10 < 8 UNION ALL SELECT DISTINCT '2001:db8:9::3', '2001:DB8:9:0::3' FROM customer WHERE c_custkey % 10 = 9 AND c_custkey % 7 = 3")
def d15v6(spark, sf):
    hosts = _table(spark, sf, "customer").select(F.expr("concat('2001:db8:', cast(c_custkey % 10 as string), '::', cast(c_custkey % 7 as string))").alias("host"))
    return scope.matching_targets(hosts, spark.createDataFrame([("2001:db8::/45",), ("2001:DB8:9:0::3",), ("10.0.0.0/8",)], "target string"))


@query("k16_probe_plan", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'TARGET_OUT_OF_SCOPE' WHEN c_custkey % 3 = 0 THEN 'PORT_OUT_OF_SCOPE' ELSE 'OK' END AS code FROM customer")
def k16(spark, sf):
    name = F.concat(F.lit("h"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 4, ".a.b.example.org").otherwise(".example.org"), F.when(F.col("c_custkey") % 3 == 0, ":8443").otherwise(""))
    grant = spark.createDataFrame([("*.example.org",)], "target string").select("target", F.array(F.lit(443)).alias("ports"), F.expr("timestamp '2026-01-01'").alias("not_before"), F.expr("timestamp '2026-12-31'").alias("not_after"))
    plan = commands.probe_plan(_table(spark, sf, "customer").select(name.alias("target")), grant, F.expr("timestamp '2026-08-28'"))
    return plan.select(F.regexp_extract("host", "^h([0-9]+)", 1).cast("long").alias("c_custkey"), "code")


@query("i14_authorize_times", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NOT_YET_VALID' WHEN 1 THEN 'EXPIRED' ELSE 'OK' END AS code FROM customer")
def i14t(spark, sf):
    requests = _table(spark, sf, "customer").select("c_custkey", F.lit("a.example.org").alias("host"), F.lit(443).alias("port"))
    grant = spark.createDataFrame([("a.example.org",)], "target string").select("target", F.array().cast("array<int>").alias("ports"), F.expr("timestamp '2026-01-01'").alias("not_before"), F.expr("timestamp '2026-12-31'").alias("not_after"))
    at = lambda k, day: scope.authorize(requests.filter(F.col("c_custkey") % 3 == k), grant, F.expr(f"timestamp '{day}'"), 300).select("c_custkey", "code")
    return at(0, "2025-12-31").union(at(1, "2027-01-01")).union(at(2, "2026-12-31 00:04:00"))


# Reports, signatures, edges, tokens, tallies


@query("b9_edges_without_spans", f"SELECT replace(f, 'svc', 'sys') AS from_service, count(*) AS n FROM (SELECT DISTINCT p.service AS f, c.service AS t FROM ({synth.as_sql('events', synth.SPANS)}) c JOIN ({synth.as_sql('events', synth.SPANS)}) p ON c.parent_span_id = p.span_id WHERE p.service <> c.service) GROUP BY 1")
def b9(spark, sf):
    kept = store.edges_only(synth.spans(spark, sf))
    return kept.groupBy(F.regexp_replace("from_service", "svc", "sys").alias("from_service")).agg(F.count("*").alias("n"))


@query("i17_tokens", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'malformed' WHEN s_suppkey % 4 = 1 THEN 'unknown' WHEN s_suppkey % 4 = 2 THEN 'wrong secret' ELSE 'ok' END AS state FROM supplier")
def i17(spark, sf):
    s = _table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).alias("k"), F.lpad(F.hex("s_suppkey"), 12, "0").alias("i"))
    made = store.mint_token(F.lower("i"), F.repeat(F.lower("i"), 4))
    stored = s.filter("k <> 1").select(F.lower("i").alias("token_id"), store.token_digest(F.repeat(F.lower("i"), 4)).alias("digest"))
    given = F.when(F.col("k") == 0, "est_short").when(F.col("k") == 2, store.mint_token(F.lower("i"), F.repeat(F.lit("f" * 12), 4))).otherwise(made)
    return store.checked_tokens(s.select("s_suppkey", given.alias("token")), stored).select("s_suppkey", "state")


@query("b6_report_lines", f"WITH {_OCC} SELECT level AS heading, concat(CAST(count(*) AS STRING), ' work items, ', CAST(count(*) FILTER (WHERE tainted) AS STRING), ' resting on assumptions') AS line FROM occ GROUP BY 1")
def b6(spark, sf):
    return export.report_lines(_occ(spark, sf))


@query("b8_signed_artifact", "SELECT c_custkey, c_custkey % 2 = 0 AS valid FROM customer")
def b8(spark, sf):
    c = _table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("body"))
    signed = c.select("c_custkey", "body", export.keyed_digest(F.col("body"), "k1").alias("signature"))
    changed = signed.withColumn("body", F.when(F.col("c_custkey") % 2 == 0, F.col("body")).otherwise(F.concat("body", F.lit(" "))))
    return changed.select("c_custkey", (export.keyed_digest(F.col("body"), "k1") == F.col("signature")).alias("valid"))
