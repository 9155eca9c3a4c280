"""Rules of source calls as a table that calls look up by equality.

A rule has a language, an expression that the callee must match, the modules it must come from, and what the call then
means. The table lists each rule under the first names that its expression can begin with (all names of its language,
under ANY, where it may begin anywhere) and under the modules that open it. A call asks with the names in its
callee and the ways to name its module, so it meets the few rules that it could fit and is compared with those
expressions only; of the rules that fit, the first counts. Rules of the caller are rows of the same table.

What a rule makes of a call (parameters, names read by a vocabulary) is data as well: one expression reads the sources
that the row lists, whatever the number of rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.functions import naming

_E, _S, _D, _I, _K = "KEY_ESTABLISHMENT", "DIGITAL_SIGNATURE", "DATA_ENCRYPTION", "INTEGRITY", "KEY_DERIVATION"


@dataclass(frozen=True)
class Rule:
    """What a call says: its callee's expression and the modules it must come from ("": the language's own gate), then
    either a primitive with the sources of its parameters, or a vocabulary that reads a name found in one of several sources.

    Sources: ("argument", k), ("member", name), ("text", value), ("callee",), or a reading of an argument or the callee:
    hash, mac hash, curve, go curve, openssl curve, bits, mode. by_default: the purpose is the rule's guess, as the call
    makes a key that serves several. free: the call counts without an import. note: what a reader should know of the finding.
    The vocabularies "key pair" and "web crypto" read the whole call.
    """

    language: str
    callee: str
    modules: str
    purpose: str | None
    primitive: str | None = None
    parameters: dict[str, tuple] = field(default_factory=dict)
    vocabulary: str | None = None
    of: tuple = ()
    by_default: bool = False
    free: bool = False
    note: str | None = None


#: What a finding rests on where the call alone does not say all: notes of rules that guess a purpose, and of ciphers without strength.
DUAL_USE = "the key made here can serve several purposes; until its use is seen, the one with the earlier deadline counts"
SINGLE_DES = "single DES has 56 bits and is broken today, without a quantum computer"
RC2 = "RC2 is broken today, without a quantum computer"
#: The rules, in the order in which they are tried.
RULES = (
    Rule("js", r"(^|\.)generateKeyPair(Sync)?$", "crypto", None, vocabulary="key pair"),
    Rule("js", r"(^|\.)subtle\.\w+$", "", None, vocabulary="web crypto", free=True),
    Rule("js", r"(^|\.)createHash$", "crypto", _I, vocabulary="hash", of=(("argument", 0),)),
    Rule("js", r"(^|\.)createHmac$", "crypto", _I, "HMAC", {"hash": ("hash", 0)}),
    Rule("js", r"(^|\.)create(C|Dec)ipher(iv)?$", "crypto", _D, vocabulary="cipher", of=(("argument", 0),)),
    Rule("js", r"(^|\.)pbkdf2(Sync)?$", "crypto", _K, "PBKDF2", {"iterations": ("argument", 2), "hash": ("hash", 4)}),
    Rule("js", r"(^|\.)scrypt(Sync)?$", "crypto", _K, "scrypt"),
    Rule("js", r"(^|\.)hkdf(Sync)?$", "crypto", _K, "PBKDF2", {"kdf": ("text", "HKDF"), "hash": ("hash", 0)}),
    Rule("js", r"(^|\.)createECDH$", "crypto", _E, "ECDH", {"curve": ("curve", 0)}),
    Rule("js", r"(^|\.)(createDiffieHellman(Group)?|diffieHellman)$", "crypto", _E, "DH", {"primeLength": ("argument", 0)}),
    Rule("js", r"(^|\.)(public|private)(En|De)crypt$", "crypto", _E, "RSA", {"mode": ("text", "KEY_TRANSPORT"), "oaepHash": ("member", "oaepHash")}),
    Rule("js", r"(^|\.)(createSign|createVerify|sign|verify)$", "crypto", _S, vocabulary="signature", of=(("argument", 0),)),
    Rule("js", r"(^|\.)(sign|verify|SignJWT|jwtVerify|setProtectedHeader)$", "jsonwebtoken|jose", _S, vocabulary="jose", of=(("member", "algorithm"), ("member", "alg"), ("member", "algorithms"))),
    Rule("js", r"rsa\.(generateKeyPair|setPublicKey)", "node-forge", _E, "RSA", {"modulusLength": ("member", "bits")}, by_default=True),
    Rule("js", r"(?i)(^|\.)(tripledes|des3)\.(en|de)crypt$", "crypto-js", _D, "3DES"),
    Rule("js", r"(?i)(^|\.)des\.(en|de)crypt$", "crypto-js", _D, "UNKNOWN", {"name": ("text", "DES"), "keySize": ("text", "56")}, note=SINGLE_DES),
    Rule("js", r"(?i)(^|\.)rc4\.(en|de)crypt$", "crypto-js", _D, "RC4"),
    Rule("js", r"(?i)(^|\.)aes\.(en|de)crypt$", "crypto-js", _D, "AES", {"mode": ("text", "CBC")}),
    Rule("js", r"(^|\.)(MD5|SHA1|SHA224|SHA256|SHA384|SHA512|SHA3)$", "crypto-js", _I, vocabulary="hash", of=(("callee",),)),
    Rule("go", r"^rsa\.(Sign|Verify)\w*PSS$", "crypto/rsa", _S, "RSA", {"padding": ("text", "PSS")}),
    Rule("go", r"^rsa\.(Sign|Verify)", "crypto/rsa", _S, "RSA", {"padding": ("text", "PKCS1v15")}),
    Rule("go", r"^rsa\.\w*(OAEP|PKCS1v15)$", "crypto/rsa", _E, "RSA", {"mode": ("text", "KEY_TRANSPORT")}),
    Rule("go", r"^rsa\.GenerateKey", "crypto/rsa", _E, "RSA", {"modulusLength": ("argument", 1)}, by_default=True),
    Rule("go", r"^ecdsa\.", "crypto/ecdsa", _S, "ECDSA", {"curve": ("go curve", 0)}, by_default=True),
    Rule("go", r"^ed25519\.", "crypto/ed25519", _S, "EdDSA", {"curve": ("text", "Ed25519")}),
    Rule("go", r"^ecdh\.P", "crypto/ecdh", _E, "ECDH", {"curve": ("go curve", "callee")}),
    Rule("go", r"^(ecdh\.X25519|curve25519\.)", "crypto/ecdh|golang.org/x/crypto/curve25519", _E, "X25519"),
    Rule("go", r"^dsa\.", "crypto/dsa", _S, "DSA"),
    Rule("go", r"^des\.NewTripleDESCipher$", "crypto/des", _D, "3DES"),
    Rule("go", r"^des\.", "crypto/des", _D, "UNKNOWN", {"name": ("text", "DES"), "keySize": ("text", "56")}, note=SINGLE_DES),
    Rule("go", r"^aes\.NewCipher$", "crypto/aes", _D, "AES"),
    Rule("go", r"^rc4\.", "crypto/rc4", _D, "RC4"),
    Rule("go", r"^chacha20poly1305\.", "golang.org/x/crypto/chacha20poly1305", _D, "ChaCha20", {"keySize": ("text", "256"), "mode": ("text", "POLY1305")}),
    Rule("go", r"^md5\.", "crypto/md5", _I, "MD5", {"outputLength": ("text", "128")}),
    Rule("go", r"^sha1\.", "crypto/sha1", _I, "SHA1", {"outputLength": ("text", "160")}),
    Rule("go", r"^sha256\.(Sum|New)224$", "crypto/sha256", _I, "SHA2", {"outputLength": ("text", "224")}),
    Rule("go", r"^sha256\.", "crypto/sha256", _I, "SHA2", {"outputLength": ("text", "256")}),
    Rule("go", r"^sha512\.", "crypto/sha512", _I, "SHA2", {"outputLength": ("text", "512")}),
    Rule("go", r"^hmac\.New$", "crypto/hmac", _I, "HMAC"),
    Rule("java", r"(^|\.)Signature\.getInstance$", "", _S, vocabulary="signature", of=(("argument", 0),)),
    Rule("java", r"(^|\.)MessageDigest\.getInstance$", "", _I, vocabulary="hash", of=(("argument", 0),)),
    Rule("java", r"(^|\.)Cipher\.getInstance$", "", _D, vocabulary="jca", of=(("argument", 0),)),
    Rule("java", r"(^|\.)Mac\.getInstance$", "", _I, "HMAC", {"hash": ("mac hash", 0)}),
    Rule("java", r"(^|\.)KeyAgreement\.getInstance$", "", _E, vocabulary="agree", of=(("argument", 0),)),
    Rule("java", r"(^|\.)Key(Pair)?Generator\.getInstance$", "", _S, vocabulary="generate", of=(("argument", 0),), by_default=True),
    Rule("java", r"(^|\.)SecretKeyFactory\.getInstance$", "", _K, "PBKDF2", {"hash": ("mac hash", 0)}),
    Rule("c", r"^RSA_generate_key_ex$", "", _E, "RSA", {"modulusLength": ("argument", 1)}, by_default=True),
    Rule("c", r"^RSA_(sign|verify)", "", _S, "RSA"),
    Rule("c", r"^RSA_", "", _E, "RSA"),
    Rule("c", r"^ECDSA_", "", _S, "ECDSA"),
    Rule("c", r"^EC_KEY_new_by_curve_name$", "", _S, "ECDSA", {"curve": ("openssl curve", 0)}, by_default=True),
    Rule("c", r"^ECDH_compute_key$", "", _E, "ECDH"),
    Rule("c", r"^DH_(generate|compute)_key$", "", _E, "DH"),
    Rule("c", r"^DSA_generate_key", "", _S, "DSA"),
    Rule("c", r"^DES_ede3_cbc_encrypt$", "", _D, "3DES", {"mode": ("text", "CBC")}),
    Rule("c", r"^AES_set_encrypt_key$", "", _D, "AES", {"keySize": ("argument", 1)}),
    Rule("c", r"^RC4_set_key$", "", _D, "RC4"),
    Rule("c", r"^PKCS5_PBKDF2_HMAC$", "", _K, "PBKDF2", {"iterations": ("argument", 4)}),
    Rule("c", r"^EVP_PBE_scrypt$", "", _K, "scrypt"),
    Rule("c", r"^(MD5|SHA1|SHA256|SHA512)_Init$", "", _I, vocabulary="hash", of=(("callee",),)),
    Rule("c", r"^HMAC(_Init_ex)?$", "", _I, "HMAC"),
    Rule("c", r"^EVP_(Digest|Encrypt|Decrypt)Init_ex$", "", _D, vocabulary="evp", of=(("argument", 1),)),
    Rule("c", r"^EVP_PKEY_CTX_new_id$", "", _S, vocabulary="pkey", of=(("argument", 0),), by_default=True),
    Rule("rust", r"Rsa\w*::(new|generate)", "", _E, "RSA", {"modulusLength": ("argument", 1)}, by_default=True),
    Rule("rust", r"Hmac", "", _I, "HMAC"),
    Rule("rust", r"(?i)ed25519", "", _S, "EdDSA", {"curve": ("text", "Ed25519")}),
    Rule("rust", r"X25519|StaticSecret::|EphemeralSecret::", "", _E, "X25519"),
    Rule("rust", r"p384::|P384", "", _S, "ECDSA", {"curve": ("text", "P-384")}),
    Rule("rust", r"p256::|P256|Ecdsa", "", _S, "ECDSA", {"curve": ("text", "P-256")}),
    Rule("rust", r"(?i)ChaCha20", "", _D, "ChaCha20", {"keySize": ("text", "256"), "mode": ("text", "POLY1305")}),
    Rule("rust", r"Aes(128|192|256)?\w*::", "", _D, "AES", {"keySize": ("bits", "callee"), "mode": ("mode", "callee")}),
    Rule("rust", r"Sha1::", "", _I, "SHA1", {"outputLength": ("text", "160")}),
    Rule("rust", r"Sha(224|256|384|512)::", "", _I, "SHA2", {"outputLength": ("bits", "callee")}),
    Rule("rust", r"Md5::", "", _I, "MD5", {"outputLength": ("text", "128")}),
    Rule("rust", r"(?i)pbkdf2", "", _K, "PBKDF2"),
    Rule("rust", r"Argon2", "", _K, "Argon2"),
    Rule("csharp", r"(^|\.)RSA(CryptoServiceProvider|Cng)?(\.Create)?$", "", _E, "RSA", {"modulusLength": ("argument", 0)}, by_default=True),
    Rule("csharp", r"(^|\.)ECDsa(Cng)?\.Create$", "", _S, "ECDSA", by_default=True),
    Rule("csharp", r"(^|\.)ECDiffieHellman(Cng)?\.Create$", "", _E, "ECDH"),
    Rule("csharp", r"(^|\.)DSA\.Create$", "", _S, "DSA", by_default=True),
    Rule("csharp", r"(^|\.)Aes(Cng|Managed)?(\.Create)?$", "", _D, "AES"),
    Rule("csharp", r"(^|\.)TripleDES(Cng)?\.Create$", "", _D, "3DES"),
    Rule("csharp", r"(^|\.)DES\.Create$", "", _D, "UNKNOWN", {"name": ("text", "DES"), "keySize": ("text", "56")}, note=SINGLE_DES),
    Rule("csharp", r"(^|\.)RC2\.Create$", "", _D, "UNKNOWN", {"name": ("text", "RC2")}, note=RC2),
    Rule("csharp", r"(^|\.)MD5(\.Create|CryptoServiceProvider)$", "", _I, "MD5", {"outputLength": ("text", "128")}),
    Rule("csharp", r"(^|\.)SHA1(\.Create|Managed|CryptoServiceProvider)$", "", _I, "SHA1", {"outputLength": ("text", "160")}),
    Rule("csharp", r"(^|\.)SHA(256|384|512)\.(Create|HashData)$", "", _I, "SHA2", {"outputLength": ("bits", "callee")}),
    Rule("csharp", r"(^|\.)HMACSHA1$", "", _I, "HMAC", {"hash": ("text", "SHA1")}),
    Rule("csharp", r"(^|\.)HMACSHA256$", "", _I, "HMAC", {"hash": ("text", "SHA2")}),
    Rule("csharp", r"(^|\.)Rfc2898DeriveBytes$", "", _K, "PBKDF2"),
)
#: Rust crates and type names that count as cryptography, and the methods that are calls of it.
RUST_CRATES = "rsa|ring|openssl|aes|aes_gcm|chacha20poly1305|ed25519_dalek|x25519_dalek|p256|p384|sha2|sha1|md5|hmac|pbkdf2|argon2"
RUST_NAMES = "Rsa|Ecdsa|Ed25519|X25519|Aes|ChaCha|Sha|Md5|Hmac|Pbkdf2|Argon2|SigningKey|StaticSecret"
RUST_METHODS = "generate|new|from_pkcs8|sign|verify|digest|derive|encrypt|decrypt|new_from_slice|pbkdf2_hmac|hash_password|random|random_from_rng"
#: Parameters that are numbers.
_NUMBERS = ("modulusLength", "keySize", "outputLength", "iterations", "primeLength")
#: Stands for every call of a language.
ANY = "*"
#: Rules as a table. keys: the lower-case names by which calls find a rule; parameters by name; sources of a vocabulary's name.
RULE_SCHEMA = (
    "rule int, language string, keys array<string>, callee string, modules array<string>, purpose string, primitive string, "
    "parameters array<struct<name:string,kind:string,of:string,number:boolean>>, vocabulary string, sources array<struct<kind:string,of:string>>, by_default boolean, free boolean, note string"
)


def first_names(callee: str) -> list[str]:
    """The first names (letters and digits, lower case) of all that an expression can match, ANY where it may begin anywhere."""
    start = re.match(r"(\(\?i\))?(\(\^\|\\\.\)|\^)", callee)
    if not start:
        return [ANY]
    todo = [callee[start.end() :]]
    while any("(" in x for x in todo):
        split = [(x, re.search(r"\(([^()]*)\)(\??)", x)) for x in todo]
        todo = [x[: m.start()] + way + x[m.end() :] if m else x for x, m in split for way in ([*m[1].split("|"), *([""] if m[2] else [])] if m else [x])]
    found = [re.match(r"([A-Za-z0-9]+)(\\\.|_|\$|$)", x) for x in todo]
    # a name that goes on in a way that is not known finds nothing by equality
    return sorted({m[1].lower() for m in found}) if all(found) and all(x.endswith("$") or x[m.end(1) :] for x, m in zip(todo, found, strict=True)) else [ANY]


def rule_row(number: int, rule: Rule) -> tuple:
    """A rule as a row of RULE_SCHEMA."""
    source = lambda s: (s[0], str(s[1]) if len(s) > 1 else None)
    parameters = [(name, *source(s), name in _NUMBERS) for name, s in sorted(rule.parameters.items())]
    modules = rule.modules.split("|") if rule.modules else []
    return (number, rule.language, first_names(rule.callee), rule.callee, modules, rule.purpose, rule.primitive, parameters, rule.vocabulary, [source(s) for s in rule.of], rule.by_default, rule.free, rule.note)


def rule_table(spark: SparkSession, own: tuple[Rule, ...] | list[Rule] | DataFrame = (), first: bool = True) -> DataFrame:
    """The fixed rules, with rules of the caller (or rows of RULE_SCHEMA) before or after them: of rules that fit, the first counts."""
    shift = -(1 << 30) if first else 1 << 20
    rows = [rule_row(k, r) for k, r in enumerate(RULES)]
    if not isinstance(own, DataFrame):
        # Spark does not know the size of rows that are made here, and would shuffle all calls by a few names
        return F.broadcast(spark.createDataFrame([*rows, *((k + shift, *rule_row(k, r)[1:]) for k, r in enumerate(own))], RULE_SCHEMA))
    known = spark.createDataFrame(rows, RULE_SCHEMA)
    own = own if "note" in own.columns else own.withColumn("note", F.lit(None).cast("string"))
    return known.unionByName(own.select(*known.columns).withColumn("rule", (F.col("rule") + shift).cast("int")))


def _cuts(module: Column) -> Column:
    """A module's name up to each of its dots, slashes and colons."""
    heads = F.transform(F.sequence(F.lit(1), F.length(module)), lambda k: F.substring(module, F.lit(1), k))
    return F.when(F.length(module) > 0, F.filter(heads, lambda x: F.substring(module, F.length(x) + 1, F.lit(1)).isin(".", "/", ":"))).otherwise(F.array().cast("array<string>"))


def _part(name: Column, whole: bool) -> Column:
    return F.named_struct(F.lit("opens"), name, F.lit("whole"), F.lit(whole))


def _gates() -> Column:
    """What opens a rule: a module, and whole if only that very module does; the empty name opens rules without modules."""
    named = F.when(F.size("modules") > 0, F.col("modules")).otherwise(F.array(F.lit("")))
    return F.concat(F.transform(named, lambda x: _part(x, False)), F.transform(F.flatten(F.transform(named, _cuts)), lambda x: _part(x, True)))


def _ways(module: Column) -> Column:
    """How a call's module can stand in a gate: any part from its beginning, or itself."""
    bare = F.regexp_replace(module, "^node:", "")
    every = F.concat(F.transform(F.concat(_cuts(bare), F.array(bare)), lambda x: _part(x, False)), F.array(_part(module, True)))
    return F.filter(every, lambda x: x["opens"] != "")


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (language, callee, args, kwargs, module, gated, ...) that a rule fits, with the columns of the first such rule.

    The lookup is a join by equality; rules of rule_table() are broadcast, a caller's table if it is small. Each rule carries
    its gates, so no call is written out for the ways to name its module. Only calls that a rule fits are brought together
    by call, to take the first.
    """
    named = rules.select("rule", "language", F.col("callee").alias("pattern"), "purpose", "primitive", "parameters", "vocabulary", "sources", "by_default", "free", "note", _gates().alias("gates"), F.explode("keys").alias("key"))
    names = F.array_distinct(F.concat(F.split(F.lower("callee"), "[^a-z0-9]+"), F.array(F.lit(ANY))))
    asked = rows.withColumn("call", F.monotonically_increasing_id()).select("*", F.explode(names).alias("key"))
    met = asked.join(named, ["language", "key"]).filter(F.rlike("callee", F.col("pattern")))
    # a rule without modules leaves the question to its language
    rust = F.col("callee").rlike(rf"(::|^)({RUST_METHODS})$") & F.col("callee").rlike(rf"^(({RUST_CRATES})(::|$)|({RUST_NAMES}))")
    own_gate = F.when(F.col("language") == "rust", rust).otherwise(F.coalesce("gated", F.lit(True)))
    unnamed = F.array_contains("gates", _part(F.lit(""), False)) & (F.coalesce("free", F.lit(False)) | own_gate)
    fits = met.filter(unnamed | F.arrays_overlap(_ways(F.coalesce("module", F.lit(""))), "gates"))
    kept = [*rows.columns, "rule", "purpose", "primitive", "parameters", "vocabulary", "sources", "by_default", "note"]
    return fits.groupBy("call").agg(F.min_by(F.struct(*kept), "rule").alias("c")).select("c.*")


def _value(source: Column) -> Column:
    """What a call has in a source (kind, of); hash and curve readings come from hash_read and curve_read."""
    kind, of = source["kind"], source["of"]
    argument = F.get(F.col("args"), of.try_cast("int"))
    base = F.when(of == "callee", F.col("callee")).otherwise(argument)
    first = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    return (
        F.when(kind == "text", of).when(kind == "argument", argument).when(kind == "member", F.try_element_at(F.col("kwargs"), of))
        .when(kind == "callee", F.regexp_replace(F.regexp_extract("callee", r"([^.:]+)$", 1), "_Init$", ""))
        .when(kind == "bits", first(base, "(128|192|224|256|384|512)")).when(kind == "mode", F.upper(first(base, "(Gcm|Cbc|Ctr|Ecb)")))
        .when(kind.isin(*_HASHES), F.col("hash_read")).when(kind.isin(*_CURVES), F.col("curve_read"))
    )


#: How the text of a hash or curve is made from an argument or the callee before its vocabulary reads it.
_HASHES = {"hash": lambda x: x, "mac hash": lambda x: F.regexp_replace(F.regexp_replace(x, "(?i).*With", ""), "(?i)^Hmac", "")}
_CURVES = {
    "curve": lambda x: x,
    "go curve": lambda x: F.concat(F.lit("p-"), F.nullif(F.regexp_extract(x, "P(224|256|384|521)", 1), F.lit(""))),
    "openssl curve": lambda x: F.regexp_replace(x, "^NID_(X9_62_)?", ""),
}


def _text_for(kinds: dict) -> Column:
    """The text that the first parameter of one of these kinds reads."""
    p = F.get(F.filter("parameters", lambda p: p["kind"].isin(*kinds)), F.lit(0))
    base = F.when(p["of"] == "callee", F.col("callee")).otherwise(F.get(F.col("args"), p["of"].try_cast("int")))
    return F.coalesce(*[F.when(p["kind"] == kind, read(base)) for kind, read in kinds.items()])


def with_specs(rows: DataFrame) -> DataFrame:
    """rows that with_rules() gave, with specs; each vocabulary stands once, whatever the number of rules."""
    name = F.coalesce(F.get(F.filter(F.transform("sources", _value), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))
    texts = rows.select("*", _text_for(_HASHES).alias("hash_text"), _text_for(_CURVES).alias("curve_text")).select(
        "*", F.get(naming.hash_from_name(F.col("hash_text")), F.lit(0))["primitive"].alias("hash_read"), naming.normalize_curve(F.col("curve_text")).alias("curve_read")
    )
    valued = F.filter(F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["number"].alias("number"), _value(p).alias("v"))), lambda p: p["v"].isNotNull())
    # a map of one member as JSON is that member in braces
    text = lambda p: F.regexp_replace(F.to_json(F.create_map(p["name"], p["v"])), r"^\{|\}$", "")
    number = lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["v"].try_cast("int").cast("string"))
    members = F.array_compact(F.transform("valued", lambda p: F.when(p["number"], number(p)).otherwise(text(p))))
    plain = F.array(F.struct(F.col("primitive"), F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("parameters"), F.col("purpose"))).cast(naming.SPECS)
    read = F.coalesce(*[F.when(F.col("vocabulary") == v, _read(v, F.col("name"))) for v in VOCABULARIES], F.when(F.col("vocabulary") == "key pair", _key_pair()), F.when(F.col("vocabulary") == "web crypto", _web_crypto()))
    named = texts.select("*", name.alias("name"), valued.alias("valued")).select("*", read.alias("named"))
    return named.select("*", F.when(F.col("vocabulary").isNull(), plain).otherwise(_with_purpose(F.col("named"), F.col("purpose"))).alias("specs"))


def guessed() -> Column:
    """Whether a call's rule guesses the purpose: it makes a key that serves several."""
    pair = (F.col("vocabulary") == "key pair") & F.lower(F.coalesce(F.get("args", F.lit(0)), F.lit(""))).isin("rsa", "ec", "dsa")
    return F.coalesce(pair, F.lit(False)) | F.col("by_default")


def noted() -> Column:
    """The rule's note on a call; a purpose that is guessed is one."""
    return F.coalesce("note", F.when(guessed(), F.lit(DUAL_USE)))


#: Vocabularies that read a name.
VOCABULARIES = tuple(sorted({r.vocabulary for r in RULES if r.vocabulary} - {"key pair", "web crypto"}))


def _read(vocabulary: str, value: Column) -> Column:
    """Specs of a name that a call carries."""
    one = lambda *s: F.array_compact(F.array(*s)).cast(naming.SPECS)
    if vocabulary in naming.VOCABULARIES:
        return naming.VOCABULARIES[vocabulary](value)
    upper, head = F.upper(value), F.split_part(value, F.lit("/"), F.lit(1))
    mode = F.upper(F.nullif(F.get(F.split(value, "/"), F.lit(1)), F.lit("")))
    padding = F.upper(F.nullif(F.get(F.split(value, "/"), F.lit(2)), F.lit("")))
    if vocabulary == "jca":
        rsa = one(naming.spec("RSA", _E, mode="KEY_TRANSPORT", padding=padding))
        sized = F.transform(naming.cipher_from_name(head), lambda s: naming.spec(s["primitive"], _D, keySize=F.get_json_object(s["parameters"], "$.keySize").cast("int"), mode=F.coalesce(mode, F.get_json_object(s["parameters"], "$.mode")), padding=padding)).cast(naming.SPECS)
        return F.when(F.upper(head) == "RSA", rsa).otherwise(sized)
    if vocabulary == "agree":
        return F.when(upper.startswith("ECDH"), one(naming.spec("ECDH", _E))).when(upper.startswith("DH"), one(naming.spec("DH", _E))).when(upper.startswith("X25519"), one(naming.spec("X25519", _E))).otherwise(F.array().cast(naming.SPECS))
    if vocabulary == "generate":
        known = F.when(upper == "RSA", naming.spec("RSA", _E)).when(upper.isin("EC", "ECDSA"), naming.spec("ECDSA", _S)).when(upper == "DSA", naming.spec("DSA", _S)).when(upper.isin("DH", "DIFFIEHELLMAN"), naming.spec("DH", _E)).when(upper == "ED25519", naming.spec("EdDSA", _S, curve="Ed25519"))
        return F.when(known.isNotNull(), one(known)).otherwise(naming.cipher_from_name(value))
    if vocabulary == "evp":
        name = F.replace(F.regexp_extract(value, "EVP_([a-z0-9_]+)", 1), F.lit("_"), F.lit("-"))
        hashed = naming.hash_from_name(name, _I)
        return F.when(F.size(hashed) > 0, hashed).otherwise(naming.cipher_from_name(name))
    known = F.when(value.contains("EVP_PKEY_RSA"), naming.spec("RSA", _E)).when(value.rlike(r"EVP_PKEY_EC\b"), naming.spec("ECDSA", _S)).when(value.contains("EVP_PKEY_ED25519"), naming.spec("EdDSA", _S, curve="Ed25519")).when(value.contains("EVP_PKEY_X25519"), naming.spec("X25519", _E)).when(value.contains("EVP_PKEY_DH"), naming.spec("DH", _E))
    return one(known)


def _key_pair() -> Column:
    """Specs of Node's generateKeyPair, whose first argument names the kind."""
    kind, member = F.lower(F.coalesce(F.get("args", F.lit(0)), F.lit(""))), lambda k: F.try_element_at(F.col("kwargs"), F.lit(k))
    size = member("modulusLength").try_cast("int")
    return F.array_compact(F.array(
        F.when(kind == "rsa", naming.spec("RSA", _E, modulusLength=size)).when(kind == "rsa-pss", naming.spec("RSA", _S, modulusLength=size, padding="PSS")).when(kind == "ec", naming.spec("ECDSA", _S, curve=naming.normalize_curve(member("namedCurve"))))
        .when(kind == "ed25519", naming.spec("EdDSA", _S, curve="Ed25519")).when(kind == "ed448", naming.spec("EdDSA", _S, curve="Ed448")).when(kind == "x25519", naming.spec("X25519", _E)).when(kind == "x448", naming.spec("X448", _E))
        .when(kind == "dsa", naming.spec("DSA", _S, modulusLength=size)).when(kind == "dh", naming.spec("DH", _E, primeLength=size))
    )).cast(naming.SPECS)


def _web_crypto() -> Column:
    """Specs of WebCrypto calls: the algorithm is an object's name member or a string."""
    member = lambda k: F.try_element_at(F.col("kwargs"), F.lit(k))
    n = F.upper(F.coalesce(member("name"), F.get("args", F.lit(0)), F.get("args", F.lit(2)), F.lit("")))
    size, curve = member("modulusLength").try_cast("int"), naming.normalize_curve(member("namedCurve"))
    wrap = F.col("callee").rlike("(un)?wrapKey$")
    main = (
        F.when(n.isin("RSASSA-PKCS1-V1_5", "RSA-PSS"), naming.spec("RSA", _S, modulusLength=size, padding=F.when(n == "RSA-PSS", "PSS").otherwise("PKCS1v15"))).when(n == "RSA-OAEP", naming.spec("RSA", _E, modulusLength=size, padding="OAEP"))
        .when(n == "ECDSA", naming.spec("ECDSA", _S, curve=curve)).when(n == "ECDH", naming.spec("ECDH", _E, curve=curve)).when(n == "X25519", naming.spec("X25519", _E)).when(n == "ED25519", naming.spec("EdDSA", _S, curve="Ed25519"))
        .when(n.startswith("AES-"), naming.spec("AES", F.when(wrap, _E).otherwise(_D), mode=F.substring(n, 5, 9), keySize=F.when(F.col("callee").rlike("(generate|import)Key$"), member("length").try_cast("int"))))
        .when(n == "HMAC", naming.spec("HMAC", _I, hash=F.get(naming.hash_from_name(member("hash")), F.lit(0))["primitive"])).when(n == "PBKDF2", naming.spec("PBKDF2", _K, iterations=member("iterations").try_cast("int")))
    )
    digest = naming.hash_from_name(F.coalesce(F.when(F.col("callee").endswith("digest"), n), member("hash"), F.lit("")), _I)
    return F.concat(F.array_compact(F.array(main)).cast(naming.SPECS), digest)


def _with_purpose(specs: Column, purpose: Column) -> Column:
    """specs with a purpose where they have none."""
    return F.transform(specs, lambda s: F.struct(s["primitive"], s["parameters"], F.coalesce(s["purpose"], purpose).alias("purpose"))).cast(naming.SPECS)
