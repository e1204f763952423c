"""Source files derived from the driver's ``orders``, one a row: what an order says decides the algorithms, sizes, names and
noise of its file. The texts are SQL that Spark and DuckDB both run; what is to be found in them follows from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import stored
from . import corpus


def pick(column: str, *values) -> str:
    """SQL: one of the values, by the column."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    cases = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE CAST({column} AS BIGINT) % {len(values)} {cases} END"


def text(*parts: str) -> str:
    """SQL: the lines of a file; ``{{expression}}`` inside a line is put in as text."""
    out = []
    for line in parts:
        bits = line.split("{{")
        out.append("'" + bits[0].replace("'", "''") + "'")
        for b in bits[1:]:
            expression, rest = b.split("}}")
            out += [f"CAST({expression} AS STRING)", "'" + rest.replace("'", "''") + "'"]
        out.append("chr(10)")
    return "concat(" + ", ".join(out) + ")"


PAIR_A, SIZE_A = pick("o_orderkey", "RSA", "DSA", "DiffieHellman"), pick("o_custkey", 1024, 2048, 4096)
PAIR_B, SIZE_B = pick("o_custkey", "DH", "RSA", "RSASSA-PSS"), pick("o_orderkey", 2048, 3072)
CURVE_J, BITS_J = pick("o_custkey", "secp256r1", "secp384r1", "secp521r1", "secp256k1"), pick("o_orderkey", 128, 192, 256)
#: Two generators interleaved, one variable used twice, a curve in a variable, a chained call, and noise.
JAVA = text(
    "class A{{o_orderkey}} {",
    "  void f() throws Exception {",
    '    KeyPairGenerator a = KeyPairGenerator.getInstance("{{' + PAIR_A + '}}"); // KeyPairGenerator.getInstance("DSA")',
    '    KeyPairGenerator b = KeyPairGenerator.getInstance("{{' + PAIR_B + '}}");',
    '    log.info("a.initialize(512); {{o_custkey}}");',
    "    b.initialize({{" + SIZE_B + "}});",
    "    a.initialize({{" + SIZE_A + "}}, new SecureRandom());",
    '    ECGenParameterSpec s = new ECGenParameterSpec("{{' + CURVE_J + '}}");',
    '    a = KeyPairGenerator.getInstance("EC");',
    "    /* a.initialize(99); */ a.initialize(s);",
    '    SecretKey k = KeyGenerator.getInstance("AES").init({{' + BITS_J + "}});",
    "  }",
    "}",
)
GO_BYTES, GO_MODE_A, GO_MODE_B = pick("o_custkey", 16, 24, 32), pick("o_orderkey", "NewGCM", "NewCTR", "NewCBCEncrypter"), pick("o_custkey", "NewOFB", "NewCFBEncrypter")
GO_TLS = pick("o_custkey", "VersionTLS10", "VersionTLS12", "VersionTLS13", "VersionSSL30")
#: Handles used by modes in another order than they were made, one without a mode, and options of a composite.
GO = text(
    "package main",
    "func f{{o_orderkey}}() {",
    "\tkey := make([]byte, {{" + GO_BYTES + "}})",
    "\tfirst, err := aes.NewCipher(key)",
    "\tif err != nil { return }",
    "\tsecond, err := des.NewTripleDESCipher(key3) // aes.NewCipher(other)",
    "\ts := cipher.{{" + GO_MODE_B + "}}(second, iv)",
    "\tg, err := cipher.{{" + GO_MODE_A + "}}(first)",
    '\tfmt.Println("cipher.NewGCM(second)", s, g)',
    "\tplain, _ := blowfish.NewCipher(k)",
    "\tc := &tls.Config{ServerName: name, MinVersion: tls.{{" + GO_TLS + "}}}",
    "}",
)
PY_HASH, PY_CALL, PY_CURVE = pick("o_orderkey", "md5", "sha1", "sha512"), pick("o_custkey", "sha256", "md5"), pick("o_custkey", "SECP256R1", "SECP384R1", "SECP521R1")
#: Names passed and assigned beside names called, each in a place of its own.
PYTHON = text(
    "import hashlib as h",
    "from hashlib import {{" + PY_CALL + "}} as made",
    "from cryptography.hazmat.primitives.asymmetric import ec",
    "from cryptography.hazmat.primitives.ciphers import algorithms",
    "D = h.{{" + PY_HASH + "}}",
    "run{{o_orderkey}}(made, h.{{" + PY_HASH + "}}(b'x'))",
    "CURVES = [ec.{{" + PY_CURVE + "}}]",
    "def pick(kind=algorithms.TripleDES): return 'hashlib.md4'  # h.blake2b",
    "ec.generate_private_key(ec.{{" + PY_CURVE + "}}())",
    "raise ValueError(h.sha224)",
)
JS_ALG, JS_SIZE, JS_MODE = pick("o_orderkey", "RSA-OAEP", "RSA-PSS", "RSASSA-PKCS1-v1_5"), pick("o_custkey", 1024, 2048, 4096), pick("o_orderkey", "AES-GCM", "AES-CBC", "AES-CTR")
JS_ITER, JS_TLS = pick("o_custkey", 1000, 100000, 600000), pick("o_orderkey", "TLSv1", "TLSv1.1", "TLSv1.2", "TLSv1.3")
#: Properties of nested objects, keys in any order, and keys that belong to another object.
JS = text(
    "const crypto = require('crypto');",
    "crypto.subtle.generateKey({ hash: { name: 'SHA-256', modulusLength: 99 }, 'modulusLength': {{" + JS_SIZE + "}}, name: \"{{" + JS_ALG + '}}" }, true, []);',
    "crypto.subtle.encrypt({ name: '{{" + JS_MODE + "}}', iv: pick({ length: 7 }), length: 256 }, key, data); // crypto.createHash('md5')",
    "crypto.pbkdf2Sync(pw{{o_orderkey}}, salt, {{" + JS_ITER + "}}, 32, 'sha512');",
    "tls.createServer({ key: k, options: { minVersion: 'SSLv3' }, minVersion: '{{" + JS_TLS + "}}' }, () => {});",
    "new NodeRSA({ b: {{" + JS_SIZE + "}} });",
)
FILES = {"java": JAVA, "go": GO, "python": PYTHON, "js": JS}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files are made of, dealt and stored: filters on the texts would else be moved before the deal, where a row group is one task."""
    return stored(corpus.dealt(corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")), "orders")


def files(spark: SparkSession, sf_dir: str, lang: str, rows: DataFrame | None = None) -> DataFrame:
    """``path, lang, text``: a source file for every order (of ``rows``, if given)."""
    o = corpus.dealt(corpus.table(spark, sf_dir, "orders")) if rows is None else rows
    return o.selectExpr("concat('src/', o_orderkey) AS path", f"'{lang}' AS lang", f"{FILES[lang]} AS text")


# --- one statement a line, derived from ``part``: a family of calls each ------------------------------------------------------------------

#: (line of code, its findings as (family, key_size, curve, mode)); ``{{...}}`` and values that begin with ``=`` are SQL over ``part``.
BITS, EC3 = pick("p_partkey", 1024, 2048, 3072, 4096), pick("p_partkey", "SECP256R1", "SECP384R1", "SECP521R1")
MODE3, HASH3 = pick("p_size", "GCM", "CBC", "ECB"), pick("p_partkey", "md5", "sha1", "sha384")
HASH_FAMILY, HASH_SIZE = pick("p_partkey", "MD5", "SHA-1", "SHA-2"), pick("p_partkey", None, None, 384)
PYTHON_CALLS = [
    ("import hashlib, hmac, ssl, jwt as tokens, oqs", []),
    ("from cryptography.hazmat.primitives import hashes, padding as pads", []),
    ("from cryptography.hazmat.primitives.asymmetric import rsa, dsa, dh, ec as curves, ed25519, x448, padding", []),
    ("from cryptography.hazmat.primitives.ciphers import Cipher, algorithms as algs, modes", []),
    ("from cryptography.hazmat.primitives.ciphers.aead import AESGCM, ChaCha20Poly1305 as Box", []),
    ("from cryptography.hazmat.primitives.kdf.pbkdf2 import PBKDF2HMAC", []),
    ("from Crypto.Cipher import AES, DES3, ARC4", []),
    ("BITS = {{" + BITS + "}}", []),
    ("a = rsa.generate_private_key(public_exponent=65537, key_size=BITS)", [("RSA", "=" + BITS, None, None)]),
    ("b = dsa.generate_private_key({{" + BITS + "}})", [("DSA", "=" + BITS, None, None)]),
    ("c = dh.generate_parameters(2, {{" + BITS + "}})", [("DH", "=" + BITS, None, None)]),
    ("d = curves.generate_private_key(curves.{{" + EC3 + "}}())", [("ECDSA", None, "=lower(" + EC3 + ")", None)]),
    ("e = ed25519.Ed25519PrivateKey.generate()", [("Ed25519", None, None, None)]),
    ("f = x448.X448PrivateKey.generate()", [("X448", None, None, None)]),
    ("g = Cipher(algs.AES(k), modes.{{" + MODE3 + "}}(iv))", [("AES", None, None, "=" + MODE3)]),
    ("h = Cipher(algs.TripleDES(k), modes.CBC(iv))  # Cipher(algs.ARC4(k))", [("3DES", None, None, "CBC")]),
    ("i = AESGCM(k); j = Box(k)", [("AES", None, None, "GCM"), ("ChaCha20", None, None, None)]),
    ("k = AES.new(key, AES.MODE_{{" + MODE3 + "}})", [("AES", None, None, "=" + MODE3)]),
    ("l = ARC4.new(key)", [("RC4", None, None, None)]),
    ("m = hashlib.{{" + HASH3 + "}}(b'x')", [("=" + HASH_FAMILY, "=" + HASH_SIZE, None, None)]),
    ("n = hashlib.new('{{" + HASH3 + "}}', b'x')", [("=" + HASH_FAMILY, "=" + HASH_SIZE, None, None)]),
    ("o = hashes.Hash(hashes.SHA3_256())", [("SHA-3", 256, None, None)]),
    ("p = hmac.new(k, m, hashlib.{{" + HASH3 + "}})", [("HMAC", "=" + HASH_SIZE, None, None)]),
    ("q = tokens.encode({}, k, algorithm='{{" + pick("p_size", "HS256", "RS256", "none") + "}}')", [("=" + pick("p_size", "HMAC", "RSA", "JWT"), "=" + pick("p_size", 256, None, None), None, None)]),
    ("r = ssl.SSLContext(ssl.PROTOCOL_TLSv1_{{" + pick("p_size", 1, 2) + "}})", [("=" + pick("p_size", "TLS1.1", "TLS1.2"), None, None, None)]),
    ("s = oqs.KeyEncapsulation('Kyber{{" + pick("p_size", 512, 768, 1024) + "}}')", [("ML-KEM", "=" + pick("p_size", 512, 768, 1024), None, None)]),
    ("raise ValueError('MD5 and hashlib.md5(x)')", []),
]
C_CALLS = [
    ("/* EVP_md5() and RSA_generate_key_ex(r, 512, e, 0) */ #define NOTHING \"EVP_rc4()\"", []),
    ("x{{p_partkey}} = EVP_aes_{{" + pick("p_size", 128, 192, 256) + "}}_{{lower(" + MODE3 + ")}}();", [("AES", "=" + pick("p_size", 128, 192, 256), None, "=" + MODE3)]),
    ("y = EVP_{{" + HASH3 + "}}(); // EVP_sha1()", [("=" + HASH_FAMILY, "=" + HASH_SIZE, None, None)]),
    ("RSA_generate_key_ex(r, {{" + BITS + "}}, e, NULL);", [("RSA", "=" + BITS, None, None)]),
    ("k = EC_KEY_new_by_curve_name(NID_{{" + pick("p_partkey", "X9_62_prime256v1", "secp384r1", "secp521r1") + "}});", [("EC", None, "=lower(" + EC3 + ")", None)]),
    ("DES_ede3_cbc_encrypt(a, b); MD5_Update(&c, d, 3);", [("3DES", None, None, None), ("MD5", None, None, None)]),
    ("SSL_CTX_new(TLSv1_{{" + pick("p_size", 1, 2) + "}}_client_method());", [("=" + pick("p_size", "TLS1.1", "TLS1.2"), None, None, None)]),
    ("HMAC(EVP_md(), key, n, s, m, out, &len);", [("HMAC", None, None, None)]),
]
JAVA_CALLS = [
    ("class A{{p_partkey}} { void f() { /* MessageDigest.getInstance(\"MD4\") */", []),
    ('Cipher.getInstance("AES/{{' + MODE3 + '}}/PKCS5Padding"); // Cipher.getInstance("RC4")', [("AES", None, None, "=" + MODE3)]),
    ('Cipher a = Cipher.getInstance("{{' + pick("p_size", "DES", "DESede") + '}}");', [("=" + pick("p_size", "DES", "3DES"), None, None, "ECB")]),
    ('MessageDigest.getInstance("{{' + pick("p_partkey", "MD5", "SHA-1", "SHA-384") + '}}");', [("=" + HASH_FAMILY, "=" + HASH_SIZE, None, None)]),
    ('Mac.getInstance("HmacSHA256"); String s = "Mac.getInstance(x)";', [("HMAC", 256, None, None)]),
    ('Signature.getInstance("SHA256with{{' + pick("p_size", "RSA", "ECDSA") + '}}");', [("SHA-2", 256, None, None), ("=" + pick("p_size", "RSA", "ECDSA"), None, None, None)]),
    ('KeyAgreement.getInstance("{{' + pick("p_size", "ECDH", "X25519") + '}}");', [("=" + pick("p_size", "ECDH", "X25519"), None, None, None)]),
    ('SSLContext.getInstance("TLSv1.{{' + pick("p_size", 1, 2, 3) + '}}");', [("=" + pick("p_size", "TLS1.1", "TLS1.2", "TLS1.3"), None, None, None)]),
    ('new SecretKeySpec(bytes, "AES"); } }', [("AES", None, None, None)]),
]
GO_CALLS = [
    ("package main // md5.New()", []),
    ("func f{{p_partkey}}() { {{" + pick("p_partkey", "md5.New()", "sha1.New()", "sha512.New384()") + "}} }", [("=" + HASH_FAMILY, "=" + HASH_SIZE, None, None)]),
    ("var a, _ = rsa.GenerateKey(rand.Reader, {{" + BITS + "}})", [("RSA", "=" + BITS, None, None)]),
    ("var b, _ = ecdsa.GenerateKey(elliptic.P{{" + pick("p_partkey", 256, 384, 521) + "}}(), rand.Reader)", [("ECDSA", None, "=lower(" + EC3 + ")", None)]),
    ('var c = "rsa.GenerateKey(x, 512)" + `md5.New()`', []),
    ("var d = hmac.New(h, key); var e, _ = chacha20poly1305.New(key)", [("HMAC", None, None, None), ("ChaCha20", 256, None, None)]),
    ("var g = pbkdf2.Key(pw, salt, {{" + pick("p_size", 1000, 600000) + "}}, 32, h)", [("PBKDF2", None, None, None)]),
]
JS_CALLS = [
    ("const c{{p_partkey}} = require('crypto'); // c.createHash('md5')", []),
    ("c.createHash('{{" + HASH3 + "}}');", [("=" + HASH_FAMILY, "=" + HASH_SIZE, None, None)]),
    ("c.createCipheriv('aes-{{" + pick("p_size", 128, 192, 256) + "}}-{{lower(" + MODE3 + ")}}', k, iv);", [("AES", "=" + pick("p_size", 128, 192, 256), None, "=" + MODE3)]),
    ("c.generateKeyPairSync('rsa', { modulusLength: {{" + BITS + "}} });", [("RSA", "=" + BITS, None, None)]),
    ("c.createECDH('{{" + pick("p_partkey", "prime256v1", "secp384r1", "secp521r1") + "}}'); log('c.createECDH(1)');", [("ECDH", None, "=lower(" + EC3 + ")", None)]),
    ("c.createDiffieHellman({{" + BITS + "}});", [("DH", "=" + BITS, None, None)]),
    ("jsonwebtoken.sign(p, k, { algorithm: '{{" + pick("p_size", "HS256", "RS256") + "}}' });", [("=" + pick("p_size", "HMAC", "RSA"), "=" + pick("p_size", 256, None), None, None)]),
]
CALLS = {"python": PYTHON_CALLS, "c": C_CALLS, "java": JAVA_CALLS, "go": GO_CALLS, "js": JS_CALLS}


def call_files(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """``path, lang, text``: a file of ``CALLS`` for every part."""
    body = text(*(line for line, _ in CALLS[lang]))
    return corpus.dealt(corpus.table(spark, sf_dir, "part")).selectExpr("concat('lib/', p_partkey) AS path", f"'{lang}' AS lang", f"{body} AS text")


def call_rows(lang: str) -> str:
    """SQL: what is to be found in ``call_files``."""
    lit = lambda v: "NULL" if v is None else v[1:] if isinstance(v, str) and v.startswith("=") else f"'{v}'" if isinstance(v, str) else str(v)
    rows = [f"SELECT p_partkey, {i} AS line, {lit(f)} AS family, CAST({lit(n)} AS INTEGER) AS key_size, CAST({lit(c)} AS VARCHAR) AS curve, CAST({lit(m)} AS VARCHAR) AS mode FROM part" for i, (_, told) in enumerate(CALLS[lang], 1) for f, n, c, m in told]
    return "SELECT concat('lib/', p_partkey) AS file, CAST(line AS INTEGER) AS line, family, key_size, curve, mode FROM (" + " UNION ALL ".join(rows) + ")"
