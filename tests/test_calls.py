"""Source scanning in all languages, and the way from sources to verdicts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from estatelens.operators import reach
from estatelens.sources import calls, rules

FILES = {
    "src/keys.ts": "import * as crypto from 'node:crypto';\nimport jwt from 'jsonwebtoken';\n// crypto.createHash('md5')\nexport function make() {\n  crypto.generateKeyPairSync('rsa', { modulusLength: 2048 });\n  const alg = pick();\n  crypto.createHash(alg);\n  crypto.createHash('sha1');\n  crypto.createCipheriv('aes-128-cbc', k, iv);\n  crypto.pbkdf2Sync(p, s, 100_000, 32, 'sha256');\n  crypto.createECDH('secp384r1');\n  jwt.sign({}, k, { algorithm: 'RS256' });\n}\n",
    "src/web.js": "await crypto.subtle.generateKey({ name: 'ECDSA', namedCurve: 'P-384' }, true, ['sign']);\nother.createHash('md5');\n",
    "src/main.go": 'package main\nimport (\n\t"crypto/rsa"\n\t"crypto/md5"\n)\nfunc main() {\n\trsa.GenerateKey(rand.Reader, 1024)\n\tmd5.Sum(b)\n}\n',
    "src/A.java": 'import javax.crypto.Cipher;\nclass A { void f() { Cipher.getInstance("AES/CBC/PKCS5Padding"); Signature.getInstance("SHA256withRSA"); KeyPairGenerator.getInstance("EC"); } }\n',
    "src/x.c": '#include <openssl/evp.h>\nint main() { EVP_EncryptInit_ex(ctx, EVP_aes_256_gcm(), 0, 0, 0); RSA_generate_key_ex(r, 4096, e, 0); EC_KEY_new_by_curve_name(NID_X9_62_prime256v1); }\n',
    "src/l.rs": "use sha2::Sha256;\nfn main() { let h = Sha256::new(); let c = Aes256Gcm::new(key); RsaPrivateKey::new(&mut rng, 2048); }\n",
    "src/p.cs": "using System.Security.Cryptography;\nclass P { static void Main() { var r = RSA.Create(2048); var d = SHA384.Create(); new RSACryptoServiceProvider(1024); } }\n",
    "src/a.py": "import hashlib\nhashlib.md5(b'')\n",
}
WANT = {
    "src/keys.ts": {("RSA", '{"modulusLength":2048}'), ("SHA1", '{"outputLength":160}'), ("AES", '{"keySize":128,"mode":"CBC"}'), ("PBKDF2", '{"hash":"SHA2","iterations":100000}'), ("ECDH", '{"curve":"P-384"}'), ("RSA", '{"alg":"RS256","padding":"PKCS1v15"}'), ("SHA2", '{"outputLength":256}')},
    "src/web.js": {("ECDSA", '{"curve":"P-384"}')},
    "src/main.go": {("RSA", '{"modulusLength":1024}'), ("MD5", '{"outputLength":128}')},
    "src/A.java": {("AES", '{"mode":"CBC","padding":"PKCS5PADDING"}'), ("SHA2", '{"outputLength":256}'), ("RSA", '{"padding":"PKCS1v15"}'), ("ECDSA", "{}")},
    "src/x.c": {("AES", '{"keySize":256,"mode":"GCM"}'), ("RSA", '{"modulusLength":4096}'), ("ECDSA", '{"curve":"P-256"}')},
    "src/l.rs": {("SHA2", '{"outputLength":256}'), ("AES", '{"keySize":256,"mode":"GCM"}'), ("RSA", '{"modulusLength":2048}')},
    "src/p.cs": {("RSA", '{"modulusLength":2048}'), ("RSA", '{"modulusLength":1024}'), ("SHA2", '{"outputLength":384}')},
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return calls.call_findings(calls.calls(files), "s").collect()


@pytest.mark.parametrize("path", sorted(WANT))
def test_rules(found, path):
    assert {(r["primitive"], r["parameters"]) for r in found if r["locator"].startswith(path + ":")} == WANT[path]


def test_lines_and_functions():
    rows = {(line, f, c) for line, f, c, *_ in calls.scan(FILES["src/keys.ts"])}
    assert (8, "make", "crypto.createHash") in rows and not any(line == 3 for line, *_ in rows)


def test_unresolved_arguments_are_not_guessed():
    (call,) = [x for x in calls.scan("f(`a${b}`, x + 1, 'lit', g.h, 12)") if x[2] == "f"]
    assert call[3] == [None, None, "lit", "g.h", "12"]


@pytest.mark.parametrize("text", ["", "((((", "'unclosed", "/* open", "f(" * 500, "a.b(" + "x," * 5000, "\x00\x01f(\x01)"])
def test_odd_texts_end(text):
    assert isinstance(calls.scan(text), list)


def test_from_sources_to_verdicts(spark):
    rows = [
        ("app/server.ts", "import { sign } from './keys.js';\nimport http from 'node:http';\nhttp.createServer(() => sign());\n"), ("app/keys.ts", "import crypto from 'crypto';\nexport function sign() { helper(); }\nfunction helper() { crypto.createHash('sha1'); }\nfunction dead() { crypto.createHash('md5'); }\n"),
        ("app/orphan.ts", "import crypto from 'crypto';\nexport const x = () => crypto.createHash('md5');\n"), ("tests/keys.test.ts", "import '../app/orphan';\n"),
    ]
    files = spark.createDataFrame([(*r, None, False) for r in rows], "path string, text string, package string, published boolean")
    vertices, imports, exported, edges = calls.module_graph(files)
    walked = reach.walk(reach.resolve_local(imports, vertices), reach.entry_points(vertices))
    assert {r["file"] for r in walked.collect()} == {"app/server.ts", "app/keys.ts"}
    live = reach.live_functions(edges, exported)
    assert {r["name"] for r in live.filter("file = 'app/keys.ts'").collect()} >= {"sign", "helper"} and not live.filter("name = 'dead'").count()
    seen = calls.calls(files).filter("callee like '%createHash'").selectExpr("concat(path, ':', line) as occurrence_id", "'SOURCE_AST' as modality", "path as file", "function")
    got = {r["occurrence_id"]: r["via"] for r in reach.verdicts(seen, walked, vertices, live).collect()}
    assert got == {"app/keys.ts:3": "ENTRY_POINT", "app/keys.ts:4": "NONE", "app/orphan.ts:2": "NONE"}


def test_regular_expressions_hide_no_code():
    assert [x[2:4] for x in calls.scan("const re = /['\"]/; crypto.createHash('md5')")] == [("crypto.createHash", ["md5"])]
    assert [x[2] for x in calls.scan("const half = total / 2; f(a / b); const o = c / d; g('x')")] == ["f", "g"]


def test_arguments_are_not_capped():
    (outer, *_) = calls.scan("f(1, g(" + "x, " * 2500 + "1), 'sha1', 4, 5, 6, 7, 8, 9, 'last')")
    assert outer[3][0] == "1" and outer[3][2] == "sha1" and outer[3][-1] == "last" and len(outer[3]) == 10
    (call,) = calls.scan("crypto.createCipheriv(" + " " * 5000 + "/* " + "c" * 5000 + " */ 'aes-128-cbc', k, iv)")
    assert call[3][0] == "aes-128-cbc"


@pytest.mark.parametrize("text", ["f(" * 100_000, "a(b,[{" * 60_000, "x = a / b; " * 30_000, "function f(){" * 20_000, "'" * 100_000])
def test_hostile_texts_take_linear_time(text):
    import time

    began = time.time()
    calls.scan(text)
    assert time.time() - began < 10


def test_innermost_function_by_nesting():
    rows = {c: f for _, f, c, *_ in calls.scan("function a() {\n function b() { x(); }\n y();\n}\nz();\nconst d = (q) => {\n w();\n};\nv();\n")}
    assert (rows["x"], rows["y"], rows["z"], rows["w"], rows["v"]) == ("b", "a", None, "d", None)


def test_renamed_imports():
    rust = calls.resolved_calls("use rsa::{RsaPrivateKey as PrivKey, pkcs8::{self, DecodePrivateKey}};\nfn f() { PrivKey::new(&mut rng, 2048); }", "rust")
    assert [(x[2], x[5]) for x in rust if x[2] != "f"] == [("rsa::RsaPrivateKey::new", "rsa::RsaPrivateKey")]
    assert dict(calls.imports_of("use a::{self, b::{C as D}, e::*};", "rust")) == {"a": "a", "D": "a::b::C", "e": "a::e"}
    go = calls.resolved_calls('import cryptorsa "crypto/rsa"\nfunc f() {\n cryptorsa.GenerateKey(r, 2048)\n}', "go")
    assert ("rsa.GenerateKey", "crypto/rsa") in [(x[2], x[5]) for x in go]
    assert calls.resolved_calls("import { createHash as h } from 'crypto'; h('md5');", "js")[0][2] == "createHash"


def rule_of(spark, own, rows):
    """By callee and module: the primitive of the first rule that fits."""
    table = spark.createDataFrame([(lang, callee, ["a", "2048"], {"bits": "128"}, module, gated) for lang, callee, module, gated in rows], "language string, callee string, args array<string>, kwargs map<string,string>, module string, gated boolean")
    return {(r["callee"], r["module"]): r["primitive"] for r in rules.with_rules(table, rules.rule_table(spark, own)).collect()}


def test_modules_open_rules_both_ways(spark):
    own = [rules.Rule("js", r"(^|\.)f$", "crypto", "INTEGRITY", "MD5"), rules.Rule("js", r"(^|\.)g$", "crypto-js/aes", "INTEGRITY", "RC4")]
    names = ["crypto", "node:crypto", "crypto/rsa", "crypto.subtle", "cryptography", "", None]
    got = rule_of(spark, own, [("js", "x.f", m, None) for m in names])
    assert set(got) == {("x.f", m) for m in names[:4]}
    assert set(rule_of(spark, own, [("js", "x.g", m, None) for m in ("crypto-js", "crypto-js/aes", "crypto-js/aes/x", "crypto-js/des", "crypto")])) == {("x.g", m) for m in ("crypto-js", "crypto-js/aes", "crypto-js/aes/x")}


def test_rules_are_found_as_by_trying_all(spark):
    rng, names = random.Random(4), "createHash sign verify subtle AES RSA rsa GenerateKey SHA256_Init MD5 create encrypt pbkdf2Sync x EVP_PKEY_CTX_new_id Hmac new Aes128Gcm getInstance Signature Sum256 sha256 tripledes".split()
    modules = ["crypto", "node:crypto", "crypto-js", "jsonwebtoken", "crypto/rsa", "crypto/sha256", "node-forge", "other", None]
    whole = "crypto.createHash createCipheriv rsa.SignPSS rsa.GenerateKey sha256.Sum224 sha256.New ecdsa.Sign Signature.getInstance KeyPairGenerator.getInstance RSA_sign RSA_x DSA_generate_key HMAC HMAC_Init_ex RSA.Create SHA384.Create Aes"
    whole += " TripleDES.Create Sha256::new Hmac::new Aes128Gcm::new CryptoJS.AES.encrypt forge.pki.rsa.generateKeyPair crypto.subtle.digest xcreateHash createHashes ecdh.X25519 curve25519.X des.NewTripleDESCipher crypto.generateKeyPair SignJWT"
    rows = list({(rng.choice(["js", "go", "java", "c", "rust", "csharp"]), rng.choice([rng.choice(whole.split()), rng.choice([".", "::", "_"]).join(rng.choices(names, k=rng.randrange(1, 4)))]), rng.choice(modules), rng.choice([True, False, None])) for _ in range(3000)})

    def opens(rule, module):
        bare, near = re.sub("^node:", "", module or ""), rule.modules.split("|")
        inside = any(bare == n or bare.startswith(tuple(n + x for x in "./:")) for n in near)
        return inside or any(n.startswith(tuple((module or "") + x for x in "./:")) for n in near if module)

    def fits(rule, lang, callee, module, gated):
        if rule.language != lang or not re.search(rule.callee, callee):
            return False
        if rule.modules:
            return opens(rule, module)
        if lang == "rust":
            return bool(re.search(rf"(::|^)({rules.RUST_METHODS})$", callee) and re.search(rf"^(({rules.RUST_CRATES})(::|$)|({rules.RUST_NAMES}))", callee))
        return rule.free or gated is not False

    want = Counter((*r, next(k for k, rule in enumerate(rules.RULES) if fits(rule, *r))) for r in rows if any(fits(rule, *r) for rule in rules.RULES))
    table = spark.createDataFrame([(*r, [], {}) for r in rows], "language string, callee string, module string, gated boolean, args array<string>, kwargs map<string,string>")
    got = Counter(tuple(r) for r in rules.with_rules(table, rules.rule_table(spark)).select("language", "callee", "module", "gated", "rule").collect())
    assert got == want and len({k for *_, k in want}) > 20


def test_rules_of_the_caller_come_first_or_last(spark):
    call = [("js", "crypto.createHash", "crypto", None)]
    own = [rules.Rule("js", r"(^|\.)createHash$", "crypto", "INTEGRITY", "OWN")]
    assert rule_of(spark, own, call) == {("crypto.createHash", "crypto"): "OWN"}
    rows = spark.createDataFrame([(*c, [], {}) for c in call], "language string, callee string, module string, gated boolean, args array<string>, kwargs map<string,string>")
    (last,) = rules.with_rules(rows, rules.rule_table(spark, own, first=False)).collect()
    assert last["vocabulary"] == "hash"
    as_rows = spark.createDataFrame([rules.rule_row(0, own[0])], rules.RULE_SCHEMA)
    assert rule_of(spark, as_rows, call) == {("crypto.createHash", "crypto"): "OWN"}


def test_first_names():
    assert rules.first_names(r"(^|\.)create(C|Dec)ipher(iv)?$") == ["createcipher", "createcipheriv", "createdecipher", "createdecipheriv"]
    assert rules.first_names(r"^RSA_(sign|verify)") == ["rsa"] and rules.first_names("Hmac") == ["*"] and rules.first_names(r"^RSA\w+") == ["*"] and rules.first_names(r"^sign") == ["*"]


def test_large_and_broken_files_are_reported(spark):
    files = spark.createDataFrame([("a.js", "x" * (calls.MAX_CHARS + 1)), ("b.py", "def ("), ("c.js", "f()")], "path string, text string")
    assert {(r["path"], r["problem"]) for r in calls.calls(files).filter("problem is not null").collect()} == {("a.js", "too large"), ("b.py", "does not parse")}
